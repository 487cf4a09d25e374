"""Quality scores: kernel ridge regression on document statistics, calibrated by isotonic regression.

Random Fourier features (Rahimi and Recht, 2007) approximate a Gaussian kernel over standardised statistics.
The ridge weights solve normal equations summed over partitions; scores of labelled rows that the ridge has not
seen are then pooled to a rising step function.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from .frames import arrow_rows, held_out, map_arrow, read_docs, stored

FOURIER = 256
RIDGE = 1e-3
SEED = 20
# Scores are rounded to so many steps before they are pooled.
STEPS = 2000
GOOD = 0.7

# Character classes that are counted: lower and upper case, digits, blanks, line ends, the marks of
# running text, exclamation marks, everything else.
CLASSES = 8
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _classes:
        kinds = np.full(0x110000, 7, np.uint8)
        for code in range(0x30000):  # no cased letters, digits or blanks lie above
            char = chr(code)
            if char.isalpha():
                kinds[code] = 1 if char.isupper() else 0
            elif char.isdigit():
                kinds[code] = 2
            elif char == "\n":
                kinds[code] = 4
            elif char.isspace():
                kinds[code] = 3
            elif char in ".,;:'\"-()?’“”":
                kinds[code] = 5
        kinds[ord("!")] = 6
        _classes.append(kinds)
    return _classes[0]


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; of an empty one all are 0."""
    text = text or ""
    n = len(text)
    if not n:
        return [0.0] * WIDTH
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = class_table()[codes]
    counts = np.bincount(kinds, minlength=CLASSES)
    words = text.split()
    n_words = max(1, len(words))
    distinct = len(set(words))
    repeats = sum(map(operator.eq, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    # How often the class changes from letter to mark and back: symbols glued to words.
    marked = kinds >= 6
    glued = np.count_nonzero(marked[1:] & (kinds[:-1] < 2))
    pairs = np.count_nonzero(marked[1:] & (codes[1:] == codes[:-1]))
    lone = np.count_nonzero(lengths == 1) / n_words
    return [
        *np.sqrt(counts / n).tolist(),
        float(np.log1p(n)),
        float(np.log1p(n_words)),
        float(lengths.mean()),
        float(lengths.std()),
        distinct / n_words,
        distinct / n_words**0.8,
        repeats / n_words,
        float(np.sqrt(glued / n_words)),
        float(np.sqrt(pairs / n_words)),
        float(np.sqrt(lone)),
        len(set(lines)) / len(lines),
        float(np.log1p(n_words / len(lines))),
    ]


WIDTH = CLASSES + 12


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, stats)`` per row, written once: a few numbers per document, not the texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, held, texts) in arrow_rows(batches, "doc_id", "held_out", "text"):
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "stats"],
            )

    rows = read_docs(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return stored(map_arrow(rows, task, "doc_id long, held_out boolean, stats array<double>"), "quality-stats")


class FourierMap:
    """Standardises statistics and maps them to random cosines, with a constant term."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, size: int = FOURIER, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        # Kernel width: the typical distance of standardised points.
        self.directions = random.normal(size=(len(mean), size)) / np.sqrt(len(mean))
        self.phases = random.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(stats), 1))], axis=1)


def matrix_of(part: pa.RecordBatch, column: str) -> np.ndarray:
    return part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def normal_equations(rows: DataFrame, features: FourierMap) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of z z' and z y over all rows ``(stats, y)``: each task sends one matrix, Spark adds them row by row."""
    size = len(features.phases) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        seen = False
        for part, _ in arrow_rows(batches):
            z = features(matrix_of(part, "stats"))
            total += z.T @ np.c_[z, part.column("y").to_numpy()]
            seen = True
        if seen:
            yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "sums"])

    parts = map_arrow(rows.select("stats", "y"), task, "i int, sums array<double>")
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    found = {r[0]: r[1] for r in summed.collect()}  # size rows of size + 1 numbers, whatever the input
    if not found:
        return np.zeros((size, size)), np.zeros(size), 0
    matrix = np.array([found[i] for i in range(size)])
    return matrix[:, :-1], matrix[:, -1], int(round(matrix[-1, -2]))


def pooled(scores: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: the middle score and the mean of each pool."""
    pools: list[list[float]] = []
    for score, total, count in zip(scores, sums, counts):
        pools.append([total, count, score * count])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def raw_scores(rows: DataFrame, features: FourierMap, weights: np.ndarray) -> DataFrame:
    """``y`` and the ridge's score of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in arrow_rows(batches):
            yield pa.record_batch([part.column("y"), pa.array(features(matrix_of(part, "stats")) @ weights)], names=["y", "raw"])

    return map_arrow(rows.select("y", "stats"), task, "y double, raw double")


class QualityModel:
    """Scores statistics: ridge weights on random cosines, then the rising step function."""

    def __init__(self, features: FourierMap | None, weights: np.ndarray | None, xs: np.ndarray, ys: np.ndarray):
        self.features, self.weights, self.xs, self.ys = features, weights, xs, ys

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.ys[0])
        return np.clip(np.interp(self.features(stats) @ self.weights, self.xs, self.ys), 0, 1)


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Model from the statistics of all labelled documents that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    marks = marks.filter("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = stats.filter("NOT held_out AND doc_id IS NOT NULL").join(marks, "doc_id").select("doc_id", "stats", "y")
    train = stored(train, "quality-train")
    vector = array_to_vector("stats")
    share = train.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        return QualityModel(None, None, np.zeros(1), np.array([0.5 if share is None else share]))
    first = train.agg(Summarizer.mean(vector).alias("mean"), Summarizer.std(vector).alias("spread")).first()
    features = FourierMap(first["mean"].toArray(), first["spread"].toArray())
    calibrating = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3
    matrix, target, n = normal_equations(train.filter(~calibrating), features)
    weights = np.linalg.solve(matrix + RIDGE * max(1, n) * np.eye(len(target)), target)
    step = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * STEPS)
    steps = raw_scores(train.filter(calibrating), features, weights).groupBy(step.alias("step"))
    steps = sorted(tuple(r) for r in steps.agg(F.sum("y"), F.count(F.lit(1))).collect())  # 3 * STEPS rows at most
    if not steps:
        steps = [(0.0, 0.0, 1), (float(STEPS), 1.0, 1)]
    places, sums, counts = (np.array(x, dtype=float) for x in zip(*steps))
    return QualityModel(features, weights, *pooled(places / STEPS, sums, counts))


def quality_scores(docs: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``, over whole texts.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; other values and nulls are no label). Several labels of a
    document count as their mean; a null id is never matched. Ids with crc32 remainder 2 are held out, remainder 3
    calibrates, the rest fits. Without any label every score is 0.5; if all labels agree, it is that label. Empty and
    null texts have all-zero statistics and a score like any other. Repeated rows get equal rows, an empty table
    gives an empty one, further columns are ignored.
    """
    stats = document_statistics(docs)
    model = fit_quality(stats, labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in arrow_rows(batches):
            score = model(matrix_of(part, "stats"))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= good).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return map_arrow(stats, task, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``good``, judged in the pass that keeps them."""
    model = fit_quality(document_statistics(docs), labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in arrow_rows(batches, "text"):
            yield part.filter(pa.array(model(np.array([statistics(t) for t in texts])) >= good))

    return map_arrow(docs, task, docs.schema)
