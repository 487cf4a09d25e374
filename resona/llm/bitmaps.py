"""Bitmaps of fixed size that thin rows before a join; the join itself decides, so false hits only cost work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import map_arrow

# Bits of a bitmap: 8 MB, whatever the data. A full one lets everything pass.
BITS = 1 << 26


def place(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS))


def bitmap(places: DataFrame) -> np.ndarray:
    """Bitmap of a column of places, built in tasks 32,768 bits at a time."""
    column = F.col(places.columns[0]) + 1  # bucket 1 starts at the value 1
    parts = places.groupBy(F.bitmap_bucket_number(column).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        start = (row["n"] - 1) * 4096
        out[start : start + len(bits)] = bits
    return out


def hits(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is among ``ids`` (one column, no null).

    Only rows that hit the bitmap of ``ids`` are shuffled for the exact join; rows with a null id stay.
    """
    gone = ids.select(F.col(ids.columns[0]).alias("gone")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(place(F.col("gone")))))
    # The row travels as one column, so that no name can clash.
    doc_id = F.col("doc_id").cast("long")
    placed = docs.select(F.struct("*").alias("row"), doc_id.alias("id"), F.coalesce(place(doc_id), F.lit(-1)).alias("at"))

    def rows(hit: bool) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = batch.column("at").to_numpy()
                met = hits(shared.value, np.maximum(places, 0)) & (places >= 0)
                yield batch.filter(pa.array(met == hit))

        return map_arrow(placed, task, placed.schema)

    doubtful = rows(True).join(gone, F.col("id") == F.col("gone"), "left_anti")
    return rows(False).unionByName(doubtful).select("row.*")
