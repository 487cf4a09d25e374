"""Ordered label rules as ``CASE WHEN ... RLIKE`` columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# A word character is a letter, a number or "_" in any script, as in Python's ``re`` on text. The
# JVM's own \w and \b are ASCII-only or count combining marks, depending on flag and version.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = "[^" + SPACE[1:]
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

_ESCAPES = {"b": BOUNDARY, "w": WORD, "W": NOT_WORD, "s": SPACE, "S": NOT_SPACE}
_WHOLE_WORDS = re.compile(r"\\b\(([^()\\\[\]]+)\)\\b")

# Letters that match an ASCII letter when case is ignored, though lower-casing does not reach it.
_FOLD_FROM, _FOLD_TO = "\u017f\u0131\u0130\u212a", "siik"


def _plain_words(match: re.Match) -> str:
    """``\\b(a|b c|d)\\b`` over literals with word characters at both ends: two cheap lookarounds.

    A look at the first letter comes before them, since it rules out most positions.
    """
    words = match.group(1).split("|")
    if not all(re.fullmatch(r"\w(?:[\w' -]*\w)?", word) for word in words):
        return match.group(0)
    first = "".join(sorted({word[0] for word in words}))
    return rf"(?=[{first}])(?<!{WORD})(?:{match.group(1)})(?!{WORD})"


def jvm_pattern(pattern: str, flags: str = "") -> str:
    """A Python-style pattern in the JVM's syntax with the same Unicode meaning."""
    body = _WHOLE_WORDS.sub(_plain_words, pattern)
    body = re.sub(r"\\([\s\S])", lambda m: _ESCAPES.get(m.group(1), m.group(0)), body)
    return f"(?{flags})" + body if flags else body


def folded(text: Column) -> Column:
    """Text prepared for rules that ignore case: what matches the lower-case rule in any case."""
    special = text.rlike(f"[{_FOLD_FROM}]")
    return F.lower(F.when(special, F.translate(text, _FOLD_FROM, _FOLD_TO)).otherwise(text))


def can_fold(rules: Mapping[str, str]) -> bool:
    """Whether the rules are plain lower case, so that folded text may stand in for ignoring case.

    Folding a text once is much cheaper than comparing every character of every rule both ways.
    """
    return all(p.isascii() and not re.search(r"[A-Z]", re.sub(r"\\.", "", p)) for p in rules.values())


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(jvm_pattern(pattern, "iu" if ignore_case else ""))


def first_label(text: Column, rules: Mapping[str, str], default: str, ignore_case: bool = True) -> Column:
    """Label of the first rule that matches; ``default`` if none does or the text is null."""
    chain = None
    for label, pattern in rules.items():
        test = matches(text, pattern, ignore_case)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def all_labels(text: Column, rules: Mapping[str, str], ignore_case: bool = True) -> Column:
    """Array of the labels of all matching rules, in rule order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(matches(text, p, ignore_case), F.lit(label)) for label, p in rules.items()])
    )
