"""Language mixtures of documents.

Each language is a distribution over hashed letter trigrams. A document is a mixture of languages; its
proportions are fitted by expectation-maximisation. Languages enter the set one by one, best first, as long as
the likelihood, less a penalty for each language of the set, still rises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import arrow_rows, held_out, map_arrow, read_docs

BINS = 1 << 16
# Bound of the labelled sample: about so many documents of each language are learned from.
PER_LANGUAGE = 4000
SMOOTHING = 0.05
ROUNDS = 40
# Log-likelihood that a further language must add, per language and per logarithm of the trigram count.
PENALTY = 4.0
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigram_bins(text: str | None) -> np.ndarray:
    """Sorted hash bins of all letter trigrams of the lower-cased text; runs of other characters are one blank."""
    if not text:
        return np.empty(0, np.uint16)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letter_table()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[kept]
    if not letter.any():
        return np.empty(0, np.uint16)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    return np.sort(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.uint16))


def counted(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    edge = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    return bins[edge], np.diff(np.r_[edge, len(bins)]).astype(np.float64)


def fit_mixture(counts: np.ndarray, likelihoods: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the given languages (columns) and the log-likelihood, by expectation-maximisation."""
    share, total = start, counts.sum()
    for _ in range(ROUNDS):
        mixed = likelihoods @ share
        new = share * (likelihoods.T @ (counts / mixed)) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihoods @ share))


def mixture(bins: np.ndarray, model: np.ndarray, logs: np.ndarray) -> dict[int, float]:
    """Proportion of each language of the chosen set, by column of the model."""
    values, counts = counted(bins)
    total = counts.sum()
    singles = counts @ logs[values]
    chosen = [int(np.argmax(singles))]
    share, best = np.ones(1), float(singles[chosen[0]])
    likelihoods = model[values]
    price = PENALTY * np.log(total + 1)
    while len(chosen) < model.shape[1]:
        weights = counts / (likelihoods[:, chosen] @ share)
        # The likelihood is concave in the proportions: only a language with a rising direction can help.
        slopes = likelihoods.T @ weights - total
        slopes[chosen] = -np.inf
        # What a language can add at most is its slope times its proportion, so flat ones need no fit.
        tried = None
        for candidate in np.flatnonzero(slopes > price):
            start = np.r_[share * 0.8, 0.2]
            fitted, value = fit_mixture(counts, likelihoods[:, [*chosen, candidate]], start)
            if tried is None or value > tried[2]:
                tried = (int(candidate), fitted, value)
        if tried is None or tried[2] - best <= price:
            break
        chosen, share, best = [*chosen, tried[0]], tried[1], tried[2]
    return dict(zip(chosen, (share / share.sum()).tolist()))


def learn_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram distributions, from documents that have a language and aren't held out.

    About ``per_language`` documents of each language are taken, picked by a hash of id and text; the model has
    ``BINS`` numbers per language.
    """
    rows = read_docs(docs, "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.empty((BINS, 0))
    pick = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 20))
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1 << 20, -(-per_language * (1 << 20) // sizes[k])))])
    sample = rows.filter(pick < limit[F.col("lang")]).select("lang", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for _, (langs, texts) in arrow_rows(batches, "lang", "text"):
            for lang, text in zip(langs, texts):
                held = sums.setdefault(lang, np.zeros(BINS, np.int64))
                held += np.bincount(trigram_bins(text), minlength=BINS)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.record_batch(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["lang", "bin", "n"]
            )

    sums = map_arrow(sample, task, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    model = np.full((BINS, len(languages)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(languages)}
    names = np.array([column[x] for x in found["lang"].to_pylist()], dtype=np.int64)
    model[found["bin"].to_numpy(), names] += found["n"].to_numpy()
    return languages, model / model.sum(axis=0)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


def detect_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, languages)`` per row of ``docs``, over whole texts.

    ``lang_pred`` has the largest share of the mixture (of equal ones the first by name), ``score`` is that share,
    ``languages`` lists the set as ``name:share``. Predictions see the text only. A null text, or one without a
    letter, is ``und`` with score 0; so is every text where no language can be learned. Repeated rows get equal
    rows, null ids stay, an empty table gives an empty one, further columns are ignored.
    """
    languages, model = learn_languages(docs, per_language)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((languages, model, np.log(model)))  # BINS numbers per language

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probabilities, logs = shared.value
        for _, (ids, held, texts) in arrow_rows(batches, "doc_id", "held_out", "text"):
            labels, scores, sets = [], [], []
            for text in texts:
                bins = trigram_bins(text)
                if not len(bins) or not names:
                    labels.append(UNDETERMINED)
                    scores.append(0.0)
                    sets.append("")
                    continue
                found = mixture(bins, probabilities, logs)
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))
                labels.append(names[ranked[0][0]])
                scores.append(min(1.0, ranked[0][1]))
                sets.append(",".join(f"{names[k]}:{v:.3f}" for k, v in ranked))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    rows = read_docs(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, task, SCHEMA)
