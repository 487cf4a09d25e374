"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of the incremental Lempel-Ziv dictionary (1978): each phrase is the shortest
stretch not met before. Texts that compress well together share phrases, so the Jaccard similarity of the phrase
sets (Raff and Nicholas, 2017) stands in for a compression distance; the smallest hashes of a set estimate it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.buckets import add_bucket, edges_of
from .frames import arrow_rows, map_arrow, read_docs

SIGNATURE = 128


def parse(text: str, phrases: set[str], pending: str = "") -> str:
    """Add the phrases of ``text`` to the dictionary; returns the stretch that is still open at the end."""
    add = phrases.add
    for char in text:
        pending += char
        if pending not in phrases:
            add(pending)
            pending = ""
    return pending


def signature(phrases: set[str]) -> np.ndarray:
    """The smallest distinct 32-bit hashes of the phrases, rising."""
    if not phrases:
        return np.empty(0, np.uint32)
    hashes = pd.util.hash_array(np.array(list(phrases), dtype=object), categorize=False) >> np.uint64(32)
    if len(hashes) > 4 * SIGNATURE:
        # Every distinct hash occurs about once, so this many smallest ones hold enough distinct ones, or else all are used.
        few = np.unique(np.partition(hashes, 2 * SIGNATURE)[: 2 * SIGNATURE])
        if len(few) >= SIGNATURE:
            return few[:SIGNATURE].astype(np.uint32)
    return np.unique(hashes)[:SIGNATURE].astype(np.uint32)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Estimated Jaccard similarity: the share of common hashes among the smallest of the union."""
    if not len(left) and not len(right):
        return 1.0
    both, counts = np.unique(np.concatenate([left, right]), return_counts=True)
    return float(np.count_nonzero(counts[:SIGNATURE] == 2) / min(SIGNATURE, len(both)))


def fingerprint(text: str) -> np.ndarray:
    phrases: set[str] = set()
    parse(text, phrases)
    return signature(phrases)


def with_edited(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited text, and the edited text; the kept half is parsed once."""
    half = len(text) // 2
    kept, tail, other = text[: len(text) - half], text[len(text) - half :], following[:half]
    phrases: set[str] = set()
    pending = parse(kept, phrases)
    edited = set(phrases)
    parse(tail, phrases, pending)
    parse(other, edited, pending)
    return signature(phrases), signature(edited), kept + other


def power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def descending_parts(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` dealt to tasks by falling ``doc_id`` (nulls last, texts rising within an id), sorted within them.

    Each part ends with the first rows of the part after it (the last with those of the first), marked
    ``ahead``, so that a task sees the next document of every row of its own. The limits of the parts come from
    the ids alone: one number per part is all that reaches the driver.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    buckets = power_of_two(parts)
    edges = docs.agg(edges_of(key, buckets).alias("e")).first()["e"] if buckets > 1 else []

    def with_part(df: DataFrame) -> DataFrame:
        if not edges:
            return df.withColumn("part", F.lit(0))
        placed = add_bucket(df.withColumn("edges", F.lit(list(edges))), "key", "edges", "bucket", buckets)
        return placed.withColumn("part", ((buckets - 1 - F.col("bucket")) * parts / buckets).cast("int")).drop("bucket")

    heads = sorted(tuple(r) for r in with_part(docs.select(key.alias("key"))).groupBy("part").agg(F.max("key")).collect())
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    targets = docs.sparkSession.createDataFrame(before, "key long, target int")  # one row per part
    rows = with_part(docs.withColumn("key", key)).join(F.broadcast(targets), "key", "left")
    own: Column = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    copy = F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("part"), F.lit(True).alias("ahead")))
    rows = rows.select("key", "doc_id", "text", F.inline(F.array_compact(F.array(own, copy))))
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("ahead", F.desc("key"), "text").drop("key", "part")


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def phrase_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, per row of ``docs``.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones of the next
    document in falling ``doc_id`` order; the first document follows the last. Returns ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``. Null texts are
    empty; an empty text has an empty fingerprint, which is like another empty one (1) and unlike all others (0).
    Rows of one id are ordered by text, null ids come last, a single row is its own next document, an empty table
    gives an empty one, and further columns are ignored.
    """
    import hashlib

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # id, text
        waiting: tuple | None = None  # a finished row that lacks the next fingerprint

        def row(following: str) -> tuple:
            own, edited, text = with_edited(last[1], following)
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            return (last[0], len(last[1]), digest, as_text(own), as_text(edited), likeness(own, edited)), own

        ended = False
        for _, (ids, texts, aheads) in arrow_rows(batches, "doc_id", "text", "ahead"):
            done = []
            for doc_id, text, ahead in zip(ids, texts, aheads):
                if ended:
                    break
                if last is not None:
                    values, own = row(text)
                    if waiting is not None:
                        done.append((*waiting[0], likeness(waiting[1], own)))
                    waiting = (values, own)
                if ahead:
                    if waiting is not None:
                        done.append((*waiting[0], likeness(waiting[1], fingerprint(text))))
                    ended = True
                last = (doc_id, text)
            if done:
                columns = list(zip(*done))
                types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = read_docs(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(descending_parts(rows, parts), task, SCHEMA)
