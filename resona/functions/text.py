"""Text expressions: cleaning, hashtags, sections, sentiment, emotion, intent."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping

from pyspark.sql import Column, functions as F

from . import rulesets
from .rules import NOT_SPACE, SPACE, WORD, first_label, jvm_pattern


# The alternatives of a heading, where a pattern starts with a bold line that holds one of them.
HEADINGS = re.compile(r"\\\*\\\*\.\*\?(?:\(\?:)?([a-z |]+)\)?\.\*\?")


def strip(text: Column) -> Column:
    """Remove white space of any script at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def clean_text(text: Column) -> Column:
    """URLs become a blank, white space collapses to one blank; null becomes the empty text."""
    without_urls = F.regexp_replace(
        F.coalesce(text, F.lit("")), rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+", " "
    )
    return F.trim(F.regexp_replace(without_urls, rf"{SPACE}+", " "))


def compact_text(*parts: Column) -> Column:
    """Stripped parts joined by a blank; null and blank parts are left out."""
    return F.concat_ws(" ", *[F.nullif(strip(p), F.lit("")) for p in parts])


def hashtags(title: Column) -> Column:
    """All ``#word`` of a text in order, lower-cased, any script."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(rf"#{WORD}+"), F.lit(0))
    return F.transform(found, F.lower)


def section(text: Column, pattern: str) -> Column:
    """First captured group of ``pattern`` (which is the end of it), stripped; null if it is absent."""
    compiled = jvm_pattern(pattern, "isud")
    # The long text is searched once, as the one element of an array; the group is then read from the passage found.
    passage = F.array(F.regexp_extract(text, compiled, 0))
    found = F.get(F.transform(passage, lambda p: F.when(p != "", strip(F.regexp_extract(p, compiled, 1)))), F.lit(0))
    headings = HEADINGS.match(pattern)
    if not headings:
        return found
    # Most headings are absent, and a plain search for them is much cheaper than the pattern. The two
    # letters that ignore-case equates with s and k are left to the pattern.
    lowered = F.lower(text)
    possible = lowered.contains("\u017f") | text.contains("\u212a")
    for heading in headings.group(1).split("|"):
        possible = possible | lowered.contains(heading)
    return F.when(possible, found)


def sections(text: Column, patterns: Mapping[str, str] = rulesets.SECTION_PATTERNS) -> list[Column]:
    return [section(text, pattern).alias(name) for name, pattern in patterns.items()]


def _count_tokens(text: Column, words: Collection[str]) -> Column:
    # Only runs of a-z and ' can equal a token; other entries match nothing, as does an empty list.
    tokens = sorted((w for w in words if re.fullmatch("[a-z']+", w)), key=len, reverse=True)
    if not tokens:
        return F.lit(0)
    alternatives = "|".join(tokens)
    return F.regexp_count(text, F.lit(rf"(?<![a-z'])(?:{alternatives})(?![a-z'])"))


def sentiment_score(
    text: Column,
    positive: Collection[str] = rulesets.POSITIVE_WORDS,
    negative: Collection[str] = rulesets.NEGATIVE_WORDS,
) -> Column:
    """(positive - negative tokens) / sqrt(all tokens); 0 without tokens. Tokens are runs of a-z and '.

    The text, here and in the two labels below, is lower-cased already.
    """
    tokens = F.regexp_count(text, F.lit("[a-z']+"))
    balance = _count_tokens(text, positive) - _count_tokens(text, negative)
    return F.coalesce(balance / F.sqrt(F.nullif(tokens, F.lit(0))), F.lit(0.0))


def sentiment_label(score: Column, threshold: float = rulesets.SENTIMENT_THRESHOLD) -> Column:
    return (
        F.when(score > threshold, "positive").when(score < -threshold, "negative").otherwise("neutral")
    )


def emotion_label(text: Column, rules: Mapping[str, str] = rulesets.EMOTION_RULES) -> Column:
    return first_label(text, rules, rulesets.EMOTION_DEFAULT, ignore_case=False)


def comment_intent(text: Column, rules: Mapping[str, str] = rulesets.INTENT_RULES) -> Column:
    return first_label(text, rules, rulesets.INTENT_DEFAULT, ignore_case=False)


def content_type(has_video: Column, has_audio: Column, has_images: Column) -> Column:
    """Format of a post from the files captured for it."""
    return (
        F.when(has_video, "video")
        .when(has_audio & has_images, "images_audio")
        .when(has_images, "images_music")
        .otherwise("unknown")
    )
