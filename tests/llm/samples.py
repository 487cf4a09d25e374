"""Rows and helpers that the tests of the text operators share."""

import random

# Columns whose names occur inside the operators.
EXTRA = ("n", "key", "place", "size", "score", "rank", "part", "hash", "words", "node", "target", "copies", "held_out", "mix_size", "_place", "p", "h")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in EXTRA)


def words(random_, n, stem="w"):
    return [f"{stem}{random_.randrange(400)}" for _ in range(n)]


def sample_rows():
    """Documents with copies, near copies, nulls, empty and very long texts, repeated rows and ids, odd characters."""
    r = random.Random(5)
    base = words(r, 120)
    near = [*base]
    near[60] = "changed"
    far = [*base]
    far[10:100:9] = words(r, 10, "x")
    text = " ".join(base)
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (3, " ".join(near), "en", "b"), (4, " ".join(far), None, "a"),
        (5, None, None, None), (6, "", "en", "b"), (7, " \n\t ", "en", "b"), (8, "One", "en", None), (9, "one", "en", None),
        (10, "one two", "en", "c"), (11, "!!! ??? 123", "de", "c"), (12, " ".join(words(r, 3000)), "en", "a"),
        (None, text, "en", "a"), (None, None, None, None), (13, "kept line\n" + text + "\nlast line", "en", "b"),
        (14, "kept line\n" + text.upper() + "\nother", "en", "b"), (15, "日本語 テキスト 😀 é", "ja", "c"), (16, "same row here", "en", "c"),
        (16, "same row here", "en", "c"), (17, "one id " + " ".join(words(r, 20)), "en", "c"), (17, "two texts " + " ".join(words(r, 20)), "en", "c"),
        (18, "a<|endoftext|>b  c\x1c d", "en", "a"), (19, "x\n" * 60 + "end", "en", "a"), (-4, " ".join(near), "en", "b"),
    ]
    rows += [(100 + i, " ".join(words(r, r.randrange(1, 60))), "en", r.choice("abc")) for i in range(12)]
    return rows


def ordered(df, *columns):
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))
