"""Short codes for vectors: each part of a vector becomes the number of its nearest codebook entry.

A part lies in a coarse cell of a grid. For every cell that occurs, the entries' least and greatest distances to the
cell's box are compared once: an entry that is farther at best than another one is at worst is dominated, as it can be
nearest to no point of the box. The entries left are kept in a bounded table under the cell's hash, and only they are
evaluated exactly. Components are integers and all distances exact, so the table changes no result.

* Rows whose vector is null, has a null or non-finite component, or cannot be cut (its length is no positive multiple of
  ``parts`` or differs from that of the smallest id's vector) are dropped. All others are returned, repeated ones too.
* Integers beyond ``limit_of(length)`` (2^23 for 64 components, so values beyond 32,768) count as that limit, so that all
  distances fit 64 bits.
* A null id is kept, but is no seed. If an id has several vectors, its least one is the seed. Fewer ids make fewer entries.
* Distances that tie go to the lower entry. An empty table gives no rows and empty codebooks.
* An error sum that 64 bits cannot hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import lookup
from .frames import map_arrow, stored
from .shingles import mixed

# Cells of one part position that a worker's table holds; a full table is emptied, which changes no result.
CELLS = 20_000
ROWS = 4096


def limit_of(length: int) -> int:
    """Greatest integer whose squared differences, summed over all components and entries of a sum, fit 64 bits."""
    return 1 << ((55 - length.bit_length()) // 2 - 1)


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` are the integer entries of part ``p``: (parts, entries, width)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class NearestEntry:
    """Nearest entries of one part position, with the undominated entries of each cell kept."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.shift = side_bits(entries)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.cells = np.empty((0, self.entries.shape[1]), np.int64)
        self.left = np.empty((0, len(self.entries)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """(cells, entries): could the entry be nearest to a point of the cell, or tie?"""
        low = (cells << self.shift)[:, None, :]
        high = low + (1 << self.shift) - 1
        below, above = self.entries[None] - low, high - self.entries[None]
        # Outside the box one of them is negative; the farther side is always the greater of the two.
        outside = np.maximum(np.maximum(-below, -above), 0)
        least = (outside * outside).sum(2)
        farther = np.maximum(below, above)
        greatest = (farther * farther).sum(2)
        return least <= greatest.min(1)[:, None]

    def rows_of(self, cells: np.ndarray) -> np.ndarray:
        """Row in the table of each cell; missing ones are added. The hash only finds rows, coordinates decide."""
        keys = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            keys = mixed(keys + column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.rows) + len(distinct) > CELLS:
            self.forget()
        names = distinct.tolist()
        new = np.array([name not in self.rows for name in names], bool)
        if new.any():
            fresh = cells[first[new]]
            start = len(self.cells)
            self.rows.update((name, start + i) for i, name in enumerate(distinct[new].tolist()))
            self.cells = np.concatenate([self.cells, fresh])
            self.left = np.concatenate([self.left, self.undominated(fresh)])
        at = np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))[inverse]
        return np.where((self.cells[at] == cells).all(1), at, -1)

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each point; the lower of equally near ones."""
        at = self.rows_of(points >> self.shift)
        left = self.left[at]
        left[at < 0] = True  # two cells of one hash
        point, entry = np.nonzero(left)
        apart = points[point] - self.entries[entry]
        squared = (apart * apart).sum(1)
        starts = np.searchsorted(point, np.arange(len(points)))
        nearest = np.minimum.reduceat(squared, starts)
        entry[squared != nearest[point]] = len(self.entries)
        return np.minimum.reduceat(entry, starts), nearest


def side_bits(entries: np.ndarray) -> int:
    """Cells about half as wide as entries lie apart: few entries stay per cell, and cells are met again."""
    if len(entries) < 2:
        return 8
    apart = np.sqrt(((entries[:, None] - entries[None]).astype(float) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    return max(0, int(np.log2(max(1.0, np.median(apart.min(1)) / 2))))


def integers(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """(rows, length) of floor(256 * x), within ``limit_of(length)``."""
    vectors = batch.column("vector")
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), length)
    limit = limit_of(length)
    return np.clip(np.floor(values * 256.0), -limit, limit).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


@dataclass(frozen=True)
class VectorCodes:
    """Codes of ``parts`` entry numbers; codebooks start as the vectors of the smallest ids and move ``rounds`` times."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2

    def kept(self, rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
        """(key, label, vector) of the rows whose vector can be cut, vectors as doubles."""
        doubles = rows.select(
            F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
        )
        finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        return doubles.filter((F.size("vector") > 0) & (F.size("vector") % self.parts == 0)).filter(finite)

    def seeds(self, kept: DataFrame) -> list[list[float]]:
        """Vectors of the smallest ids. Repeated ids may ask for a further pass, at most one for each entry."""
        found: dict = {}
        rest = kept.filter("key IS NOT NULL").select("key", "vector")
        while len(found) < self.entries:
            wanted = rest.filter(F.col("key") > max(found)) if found else rest
            rows = wanted.orderBy("key", "vector").limit(self.entries).collect()  # at most `entries` rows
            for row in rows:
                if len(found) < self.entries:
                    found.setdefault(row["key"], row["vector"])
            if len(rows) < self.entries:
                break
        length = len(next(iter(found.values()), []))
        return [v for v in found.values() if len(v) == length]

    def fit(self, kept: DataFrame) -> Codebooks:
        seeds = self.seeds(kept)
        if not seeds:
            return Codebooks(np.empty((self.parts, 0, 1), np.int64))
        length = len(seeds[0])
        whole = pa.record_batch([pa.array(seeds, pa.list_(pa.float64()))], ["vector"])
        books = integers(whole, length).reshape(len(seeds), self.parts, -1).swapaxes(0, 1).copy()
        for _ in range(self.rounds):
            books = self.moved(kept, books)
        return Codebooks(books)

    def moved(self, kept: DataFrame, books: np.ndarray) -> np.ndarray:
        """Entries replaced by the mean of their parts, rounded down; unused ones stay. Sums are made per task first."""
        parts, entries, width = books.shape

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = [NearestEntry(book) for book in books]
            sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
            for batch in slices(batches):
                points = integers(batch, parts * width).reshape(-1, parts, width)
                for part in range(parts):
                    entry, _ = nearest[part](points[:, part])
                    counts[part] += np.bincount(entry, minlength=entries)
                    for place in range(width):  # sums of one slice are exact as doubles
                        sums[part, :, place] += np.bincount(entry, points[:, part, place], entries).astype(np.int64)
            slot = np.flatnonzero(counts.ravel())
            values = sums.reshape(-1, width)[slot]
            yield pa.record_batch(
                [pa.array(np.repeat(slot, width)), pa.array(np.tile(np.arange(width), len(slot))), pa.array(values.ravel()),
                 pa.array(np.repeat(counts.ravel()[slot], width))],
                ["slot", "place", "total", "n"],
            )

        partial = map_arrow(self.cuttable(kept, parts * width).select("vector"), task, "slot long, place long, total long, n long")
        out = books.reshape(-1, width).copy()
        summed = partial.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for row in summed.toLocalIterator():  # parts * entries * width rows at most
            out[row["slot"], row["place"]] = int(row["total"]) // row["n"]
        return out.reshape(books.shape)

    @staticmethod
    def cuttable(kept: DataFrame, length: int) -> DataFrame:
        return kept.filter(F.size("vector") == length)

    def encode(self, kept: DataFrame, codebooks: Codebooks) -> DataFrame:
        """key, label, ``code`` (entry numbers, one byte or two each, in part order) and ``error`` per row."""
        books = codebooks.entries
        parts, entries, width = books.shape
        kind = np.uint8 if entries <= 256 else np.dtype(">u2")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = [NearestEntry(book) for book in books]
            for batch in slices(batches):
                points = integers(batch, parts * width).reshape(-1, parts, width)
                codes, error = np.empty((len(points), parts), kind), np.zeros(len(points), np.int64)
                for part in range(parts):
                    entry, squared = nearest[part](points[:, part])
                    codes[:, part] = entry
                    error += squared
                packed = pa.array([row.tobytes() for row in codes], pa.binary())
                yield pa.record_batch([batch.column("key"), batch.column("label"), packed, pa.array(error)], ["key", "label", "code", "error"])

        fields = {f.name: f.dataType.simpleString() for f in kept.schema}
        schema = f"key {fields['key']}, label {fields['label']}, code binary, error long"
        rows = kept if entries else kept.limit(0)
        return map_arrow(self.cuttable(rows, parts * width), task, schema)

    def decode(self, code: bytes, codebooks: Codebooks) -> list[int]:
        """The integer vector that a code stands for."""
        numbers = np.frombuffer(code, np.uint8 if codebooks.entries.shape[1] <= 256 else np.dtype(">u2"))
        return codebooks.entries[np.arange(self.parts), numbers].ravel().tolist()


def vector_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", model: VectorCodes = VectorCodes()) -> DataFrame:
    """Per kept row: the key, ``code`` in hex, ``error``, ``label_error`` (summed over equal labels, nulls together) and
    ``codebooks_sha256``. Other columns of ``rows`` are not read; see the module for nulls, ties and odd vectors."""
    kept = model.kept(rows, key, vector, label)
    codebooks = model.fit(kept)
    coded = stored(model.encode(kept, codebooks), "vector-codes")
    # Null labels are a group of their own, so the group's name is never null.
    named = coded.withColumn("group", F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("label").cast("string"))))
    sums = named.groupBy("group").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup(named, sums, "group", weight="n").select(
        F.col("key").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks.sha256).alias("codebooks_sha256")
    )
