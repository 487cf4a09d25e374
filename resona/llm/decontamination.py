"""Benchmark decontamination: short test items searched inside long documents.

Items are partitioned by the number of their shingles. All items of a partition keep so many minimum hashes that
a document that contains the wanted share of an item's shingles must contain one of them. Documents are
probed with all their shingles; hits are verified by exact containment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bitmaps import bitmap, hits, without_ids
from .frames import arrow_rows, map_arrow, stored
from .shingles import rolled, word_hashes, words_of

WIDTH = 5
CONTAINED = 80
# Ratio of the sizes of successive partitions.
GROWTH = 1.25


def partition_limit(size: int) -> int:
    """Largest item size of the partition that ``size`` falls into."""
    limit = 4
    while limit < size:
        limit = math.floor(limit * GROWTH)
    return limit


def kept_hashes(limit: int, percent: int) -> int:
    """Minimum hashes per item of a partition: one more than the shingles that a document may lack."""
    return limit - -(-percent * limit // 100) + 1


def item_shingles(items: DataFrame, width: int, percent: int) -> DataFrame:
    """``item_id, width, n_item, hash, probe``: distinct shingles of every item; an item of fewer words is one shingle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, texts) in arrow_rows(batches, "item_id", "text"):
            parts = []
            for item, text in zip(ids, texts):
                hashes = word_hashes(words_of(text))
                own = min(width, len(hashes))
                if not own:
                    continue
                found = np.unique(rolled(hashes, own))
                probes = np.arange(len(found)) < kept_hashes(partition_limit(len(found)), percent)
                parts.append((np.full(len(found), item), np.full(len(found), own), np.full(len(found), len(found)), found.view(np.int64), probes))
            if parts:
                names = ["item_id", "width", "n_item", "hash", "probe"]
                columns = [np.concatenate(c) for c in zip(*parts)]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").distinct()
    return map_arrow(rows, task, "item_id long, width int, n_item long, hash long, probe boolean")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = CONTAINED) -> DataFrame:
    """``(doc_id, item_id, n_item, matched, containment)`` for every document that holds at least ``percent`` of an item's shingles.

    Words are runs of non-blank characters, A-Z lower-cased. An item of fewer than ``width`` words is matched as
    one run of its words; one without words is never found. Null texts hold nothing and rows with a null id are not searched. Rows
    of one id count together. Repeated items are one; items of one id with different texts count apart if their sizes
    differ. Empty tables give an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    known = stored(item_shingles(items, width, percent), "item-shingles")
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # ``width`` values at most
    mask = (1 << 26) - 1
    places = F.col("hash").bitwiseAND(mask)
    shared = spark.sparkContext.broadcast((bitmap(known.filter("probe").select(places)), bitmap(known.select(places))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, every = shared.value
        for _, (ids, texts) in arrow_rows(batches, "doc_id", "text"):
            owners, found = [], []
            for doc_id, text in zip(ids, texts):
                hashes = word_hashes(words_of(text))
                runs = [rolled(hashes, w) for w in widths if len(hashes) >= w]
                if not runs:
                    continue
                runs = np.concatenate(runs)
                spots = (runs & np.uint64(mask)).astype(np.int64)
                if not hits(probes, spots).any():
                    continue
                met = np.unique(runs[hits(every, spots)])
                owners.append(np.full(len(met), doc_id))
                found.append(met.view(np.int64))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(owners), pa.int64()), pa.array(np.concatenate(found), pa.int64())], names=["doc_id", "hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    met = stored(map_arrow(rows, task, "doc_id long, hash long"), "item-hits")
    candidates = met.join(known.filter("probe").select("hash", "item_id"), "hash").select("doc_id", "item_id").distinct()
    matched = met.join(known.select("hash", "item_id", "n_item"), "hash").groupBy("doc_id", "item_id", "n_item")
    matched = matched.agg(F.count_distinct("hash").alias("matched")).filter(100 * F.col("matched") >= percent * F.col("n_item"))
    out = matched.join(candidates, ["doc_id", "item_id"], "left_semi")
    return out.withColumn("containment", F.col("matched") / F.col("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = CONTAINED) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id stay."""
    found = stored(contained_items(docs, items, width, percent).select("doc_id").distinct(), "leaked")
    return without_ids(docs, found)
