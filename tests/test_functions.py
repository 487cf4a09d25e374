"""Column expressions against hand-worked values."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.functions import numbers, rulesets, text
from resona.functions.rules import all_labels, first_label, folded, jvm_pattern


def evaluate(spark, values, expression, schema="v STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("out")).collect()]


def test_hashtags(spark):
    out = evaluate(spark, ["Save #Éco #climate #climate", None, "no tags # here", "#a_1#B"], text.hashtags)
    assert out == [["#éco", "#climate", "#climate"], [], [], ["#a_1", "#b"]]


def test_clean_text(spark):
    values = ["see https://x.y ok", "!!!", None, "a  b\t\n c ", "www.x.org/a?b c", "\x1c x \x1f"]
    assert evaluate(spark, values, text.clean_text) == ["see ok", "!!!", "", "a b c", "c", "x"]


def test_sentiment(spark):
    values = ["I love this, thank you", "too late, it is a hoax", "!!!", None, "don't hope hopeful", "LOVE love'"]
    scores = evaluate(spark, values, lambda c: text.sentiment_score(F.lower(c)))
    # "love'" is another token than "love"; "hopeful" is another word than "hope"
    assert [round(s, 6) for s in scores] == [0.894427, -0.816497, 0.0, 0.0, round(1 / 3**0.5, 6), round(1 / 2**0.5, 6)]
    labels = evaluate(spark, values, lambda c: text.sentiment_label(text.sentiment_score(F.lower(c))))
    assert labels == ["positive", "negative", "neutral", "neutral", "positive", "positive"]


def test_sentiment_matches_token_lists(spark):
    values = ["bad badly 'bad bad' it's bad.", "hope-love/save_true", "écologie die, DIE! problem?", "a" * 50, "' ''"]
    expected = []
    for value in values:
        tokens = re.findall(r"[a-z']+", value.lower())
        hits = sum(t in rulesets.POSITIVE_WORDS for t in tokens) - sum(t in rulesets.NEGATIVE_WORDS for t in tokens)
        expected.append(hits / len(tokens) ** 0.5 if tokens else 0.0)
    assert evaluate(spark, values, lambda c: text.sentiment_score(F.lower(c))) == pytest.approx(expected)


def test_emotion(spark):
    values = ["I love this, thank you", "too late, it is a hoax", "!!!", None, "really?", "I dont know", "HOPE dies"]
    assert evaluate(spark, values, lambda c: text.emotion_label(F.lower(c))) == [
        "support", "anxiety", "neutral", "neutral", "confusion", "confusion", "hope",
    ]


def test_intent(spark):
    values = ["I can't afford it", "but how?", "really?", None, "It's a HOAX", "wow", "nothing"]
    assert evaluate(spark, values, lambda c: text.comment_intent(F.lower(c))) == [
        "action_oriented", "barrier_or_constraint", "info_question", "general_reaction", "skeptic_or_counter",
        "support_affect", "general_reaction",
    ]


def test_summary_labels(spark):
    values = ["Governments must act on the climate crisis; plant a tree", "education", None]
    themes = evaluate(spark, values, lambda c: all_labels(c, rulesets.THEME_RULES))
    assert themes == [["climate_impacts", "solutions_action", "nature_biodiversity"], [], []]
    moods = evaluate(spark, values, lambda c: first_label(c, rulesets.MOOD_RULES, rulesets.MOOD_DEFAULT))
    assert moods == ["urgent_alarm", "neutral_or_mixed", "neutral_or_mixed"]
    actions = evaluate(spark, values, lambda c: first_label(c, rulesets.ACTION_RULES, rulesets.ACTION_DEFAULT))
    assert actions == ["no_clear_action"] * 3


@pytest.mark.parametrize("pattern", [r"\b(sea|été|can't)\b", r"\bx\w+\b", r"a\sb|\bé", r"\W\b(oil|gas)\b", r"\?|\bhow\b"])
def test_patterns_mean_the_same_as_in_python(spark, pattern):
    values = [
        "the sea.", "seaside", "ésea", "l'été", "étés", "can't!", "xyz", "x", "éx1", "a b", "a b", "_sea", "sea_",
        "no oil", "oil", "boil gas", "²sea", "how", "show", "seá", "É", "SEA", "why?",
    ]
    expected = [bool(re.search(pattern, v, re.IGNORECASE)) for v in values]
    assert evaluate(spark, values, lambda c: c.rlike(jvm_pattern(pattern, "iu"))) == expected


def test_all_default_rules_match_python(spark):
    rules = [
        p
        for r in (rulesets.THEME_RULES, rulesets.MOOD_RULES, rulesets.ACTION_RULES, rulesets.INTENT_RULES, rulesets.EMOTION_RULES)
        for p in r.values()
    ]
    words = sorted({w for p in rules for w in re.findall(r"[a-z][a-z' ]*", p)})
    values = [form for w in words for form in (w, w.upper(), f"x{w}", f"{w}é", f"({w})", f"{w}_", w.replace("s", "\u017f"), w.replace("i", "\u0130"), w.replace("k", "\u212a"))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    columns = [F.col("v").rlike(jvm_pattern(p, "iu")).alias(f"p{j}") for j, p in enumerate(rules)]
    columns += [folded(F.col("v")).rlike(jvm_pattern(p)).alias(f"f{j}") for j, p in enumerate(rules)]
    got = [tuple(r) for r in df.orderBy("i").select(*columns).collect()]
    got, by_folding = [r[: len(rules)] for r in got], [r[len(rules) :] for r in got]
    assert by_folding == got
    assert got == [tuple(bool(re.search(p, v, re.IGNORECASE)) for p in rules) for v in values]


def test_sections(spark):
    value = "**1. The overall mood:**\nSad and hopeful \n**2. Narrative message:**\nPlanet.\n"
    df = spark.createDataFrame([(value,), (None,), ("plain",)], "v STRING").select(*text.sections(F.col("v")))
    first, second, third = df.collect()
    assert first.overall_mood_tone == "Sad and hopeful" and first.overall_narrative_message == "Planet."
    assert [v for v in first if v is not None] == ["Sad and hopeful", "Planet."]
    assert all(v is None for v in second) and all(v is None for v in third)


def test_sections_match_python(spark):
    values = [
        "**Overall mood and tone**\n calm\n**Music track or audio used:** none\n**Nature of the audio:** speech\n\n",
        "x **NARRATIVE** y **overall MOOD** z", "**key events**\nA\r\nB\n**Describe the video**\nC", "****", "",
        "**prominent lines:** hey \n**spoken content:** ho",
    ]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING").orderBy("i")
    got = [tuple(r) for r in got.select(*text.sections(F.col("v"))).collect()]
    expected = []
    for value in values:
        found = [re.search(p, value, re.IGNORECASE | re.DOTALL) for p in rulesets.SECTION_PATTERNS.values()]
        expected.append(tuple(m.group(1).strip() if m else None for m in found))
    assert got == expected


def test_compact_text(spark):
    df = spark.createDataFrame([(" a ", None, " ", "b")], "a STRING, b STRING, c STRING, d STRING")
    assert df.select(text.compact_text(*map(F.col, "abcd"))).first()[0] == "a b"


def test_content_type(spark):
    rows = [(True, False, False), (False, True, True), (False, False, True), (False, True, False), (False, False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, v BOOLEAN, a BOOLEAN, p BOOLEAN")
    out = df.orderBy("i").select(text.content_type(F.col("v"), F.col("a"), F.col("p"))).collect()
    assert [r[0] for r in out] == ["video", "images_audio", "images_music", "unknown", "unknown"]


def test_numbers(spark):
    assert evaluate(spark, ["1.5", "x", None, "NaN", " 7 ", "-2"], numbers.number) == [1.5, 0, 0, 0, 7, -2]
    values = [0.1235, 0.0005, 0.5055, 0.5115, 0.5035, 1.0005, 2.6755]
    rounded = evaluate(spark, values, numbers.round_half_even, "v DOUBLE")
    assert rounded == [float(x) for x in np.round(values, 3)]
    assert evaluate(spark, [2.5], lambda c: numbers.round_half_even(c, 0), "v DOUBLE") == [2.0]


def test_creator_scale(spark):
    values = [None, 0.0, 1000.0, 1001.0, 10000.0, 100001.0, 1000000.0, 1000001.0]
    assert evaluate(spark, values, numbers.creator_scale, "v DOUBLE") == [
        "nano", "nano", "nano", "micro", "micro", "macro", "macro", "mega",
    ]


def test_time_features(spark):
    df = spark.createDataFrame([("1672617600",), ("bad",), (None,), ("99999999999999",)], "create_time STRING")
    rows = [tuple(r) for r in numbers.add_time_features(df).select("date", "month", "dow", "hour").collect()]
    assert rows == [("2023-01-02", "2023-01", "Monday", 0)] + [(None,) * 4] * 3
