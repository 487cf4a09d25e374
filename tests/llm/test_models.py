"""Language mixtures and quality scores: held-out accuracy, planted mixtures, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.llm.frames import table
from resona.llm.languages import detect_languages, fit_mixture
from resona.llm.quality import WIDTH, FourierMap, good_documents, pooled, quality_scores, statistics

SMALL = "/root/testdata/sf0.01"


def test_mixture_of_known_parts():
    r = np.random.default_rng(0)
    likelihoods = r.dirichlet(np.ones(200) * 0.1, size=2).T + 1e-9
    counts = r.multinomial(20_000, likelihoods @ [0.7, 0.3]).astype(float)
    share, _ = fit_mixture(counts, likelihoods, np.array([0.5, 0.5]))
    assert abs(share[0] - 0.7) < 0.02


def test_languages_held_out(spark):
    docs = table(spark, SMALL, "documents")
    found = detect_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 150 and right >= 0.98


def test_mixed_text_has_two_languages(spark):
    docs = table(spark, SMALL, "documents").filter("length(text) > 800")
    one = {r["lang"]: r["text"][:800] for r in docs.groupBy("lang").agg(F.min("text").alias("text")).collect()}
    extra = spark.createDataFrame([(9_000_002, one["en"] + " " + one["de"], None)], "doc_id long, text string, lang string")
    found = detect_languages(docs.select("doc_id", "text", "lang").unionByName(extra)).filter("doc_id = 9000002").first()
    names = {x.split(":")[0] for x in found["languages"].split(",")}
    assert {"en", "de"} <= names and found["score"] < 0.75


def test_languages_of_odd_rows(spark, docs, no_docs, rows):
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in detect_languages(docs).collect()}
    by_id = {i: (p, s) for i, p, s in found}
    assert all(by_id[i] == ("und", 0.0) for i in (5, 6, 7, 11))
    assert all(0 <= s <= 1 for _, _, s in found)
    assert detect_languages(docs).count() == len(rows)
    assert detect_languages(no_docs).count() == 0
    unlabelled = detect_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in unlabelled.select("lang_pred").distinct().collect()} == {"und"}


def test_pooling_is_rising():
    xs, ys = pooled(np.arange(5.0), np.array([0.0, 2, 1, 1, 3]), np.array([2.0, 2, 2, 2, 3]))
    assert ys.tolist() == sorted(ys.tolist()) and ys[0] == 0 and ys[-1] == 1 and len(xs) == 3


def test_random_cosines_approximate_the_kernel():
    r = np.random.default_rng(3)
    features = FourierMap(np.zeros(4), np.ones(4), size=20_000)
    a, b = r.normal(size=(2, 1, 4))
    kernel = np.exp(-((a - b) ** 2).sum() / 4 / 2)
    got = (features(a)[:, :-1] @ features(b)[:, :-1].T).item()
    assert got == pytest.approx(kernel, abs=0.03)


def test_quality_held_out(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    found = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count(F.lit(1))).first()
    assert n > 60 and right >= 0.95


def test_quality_of_odd_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame(
        [(1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (None, 1, "x"), (3, None, "x"), (4, 7, "x"), (100, 0, "x"), (101, 1, "x"), (102, 0, "x"), (103, 1, "x"), (104, 1, "x")],
        "doc_id long, quality int, stats string",
    )
    found = quality_scores(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert statistics(None) == statistics("") == [0.0] * WIDTH
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality_scores(docs, labels.filter("quality = 1 AND doc_id <> 2")).collect()} == {1.0}
    assert quality_scores(no_docs, labels).count() == 0
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in found)
