"""Ranked lexical search by a K2-treap over the grid of terms (rows) and documents (columns).

A cell of the grid is the impact of a term in a document: a document's score for an item is the sum of its cells in the
rows of the item's terms. The grid is kept as a compressed quadtree: one bit per quadrant tells whether it holds anything,
only such quadrants have children, and each node keeps the greatest impact below it. An item's rows go down the tree
jointly. The sum of the greatest impacts of its rows bounds the score of every document of a range, so ranges are opened
best first, until no range left can reach the item's k-th best score so far.

Spark cuts the documents: each task builds trees over as many documents as hold ``POSTINGS`` cells, searches them for all
items of a block, and hands on k documents per item at most. Items travel in blocks of bounded size; each block is searched
against all documents.

* Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null texts have none.
* Equal scores rank by ascending id, a null id last; each row of the documents is a document of its own.
* An item is a distinct (id, text); items without terms, and empty tables, give no rows. Documents score above 0 or are left out.
* Very long texts are read whole. Other columns of both tables are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .frames import arrow_rows, map_arrow, stored

# Bytes of item text that travel at once, on average; and cells of one tree (a single larger document stays whole).
BLOCK_BYTES = 4 << 20
POSTINGS = 2_000_000
# Ranges opened at once.
STEP = 256
# Parts of an item's candidates before the last ranking.
PARTS = 64

_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """All terms in order, as UTF-8: every other ASCII byte becomes a space."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


@dataclass(frozen=True)
class Corpus:
    documents: int
    terms: int

    def length_weight(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.documents) // max(1, self.terms)

    def term_weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def interleaved(rows: np.ndarray, columns: np.ndarray, height: int) -> np.ndarray:
    """Path of a cell from the root: two bits a level, the row's first."""
    path = np.zeros(len(rows), np.int64)
    for bit in range(height - 1, -1, -1):
        path = (path << 2) | (((rows >> bit) & 1) << 1) | ((columns >> bit) & 1)
    return path


class ImpactTree:
    """K2-treap of (row, column, impact) cells; every level is a bitmap of quadrants, their ranks and their maxima."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int):
        self.height = height
        paths = interleaved(rows, columns, height)
        order = np.argsort(paths)
        paths, best = paths[order], impacts[order]
        self.child: list[np.ndarray] = [np.empty(0, np.int32)] * height  # of quadrant 4 * node + q: node below, or -1
        self.best: list[np.ndarray] = [best] * (height + 1)
        for level in range(height - 1, -1, -1):
            parents, start = np.unique(paths >> 2, return_index=True)
            self.best[level + 1] = best
            below = np.full(4 * len(parents), -1, np.int32)
            node = np.repeat(np.arange(len(parents)), np.diff(np.append(start, len(paths))))
            below[4 * node + (paths & 3)] = np.arange(len(paths), dtype=np.int32)
            self.child[level] = below
            best = np.maximum.reduceat(best, start)
            paths = parents
        self.best[0] = best

    def halves(self, level: int, nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(ranges, rows) nodes of a level to (2 * ranges, rows) of the next: left halves, then right ones."""
        bit = (rows >> (self.height - 1 - level)) & 1
        slot = 4 * nodes + 2 * bit
        below = self.child[level]
        out = [np.where(nodes < 0, -1, below[np.maximum(slot + half, 0)]) for half in (0, 1)]
        return np.concatenate(out)

    def bounds(self, level: int, nodes: np.ndarray, times: np.ndarray) -> np.ndarray:
        best = self.best[level]
        return np.where(nodes < 0, 0, best[np.maximum(nodes, 0)]) @ times

    def search(self, rows: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of all documents that score ``floor`` or more and may be among the k best (ties included)."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * self.height
        root = np.zeros((1, len(rows)), np.int32)
        held[0] = (self.bounds(0, root, times), np.zeros(1, np.int64), root)
        found_columns, found_scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        best = np.empty(0, np.int64)
        while True:
            tops = [int(level[0].max()) if level is not None and len(level[0]) else 0 for level in held]
            level = max(range(self.height), key=lambda i: (tops[i], i))
            if tops[level] < max(1, floor):
                return np.concatenate(found_columns), np.concatenate(found_scores)
            bounds, columns, nodes = held[level]
            alive = bounds >= floor
            if not alive.all():
                bounds, columns, nodes = bounds[alive], columns[alive], nodes[alive]
            if len(bounds) > STEP:
                pick = np.argpartition(-bounds, STEP - 1)
                pick, rest = pick[:STEP], pick[STEP:]
                held[level] = (bounds[rest], columns[rest], nodes[rest])
                columns, nodes = columns[pick], nodes[pick]
            else:
                held[level] = None
            below = self.halves(level, nodes, rows)
            columns = np.concatenate([2 * columns, 2 * columns + 1])
            bounds = self.bounds(level + 1, below, times)
            alive = bounds >= max(1, floor)
            bounds, columns, below = bounds[alive], columns[alive], below[alive]
            if level + 1 == self.height:  # single documents: the bound is the score
                found_columns.append(columns)
                found_scores.append(bounds)
                best = np.concatenate([best, bounds])
                if len(best) >= k:
                    best = -np.partition(-best, k - 1)[:k]
                    floor = max(floor, int(best.min()))
            elif len(bounds):
                old = held[level + 1]
                held[level + 1] = (bounds, columns, below) if old is None else tuple(np.concatenate(x) for x in zip(old, (bounds, columns, below)))


@dataclass(frozen=True)
class Block:
    """Items that travel together: their ids, the rows of their terms and how often they occur."""

    ids: list
    terms: dict[bytes, int]
    rows: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple]) -> Block:
        terms: dict[bytes, int] = {}
        ids, rows, times = [], [], []
        for item, text in items:
            counted = Counter(terms_of(text))
            if counted:
                ids.append(item)
                rows.append(np.array([terms.setdefault(t, len(terms)) for t in counted], np.int64))
                times.append(np.array(list(counted.values()), np.int64))
        return cls(ids, terms, rows, times)


def corpus_of(lengths: DataFrame) -> Corpus:
    row = lengths.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")).first()
    return Corpus(row["documents"], row["terms"] or 0)


def postings(docs: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    """(key, n, terms, tf): length of each document and its terms of the block; documents without any term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)  # at most the terms of a block
    id_type = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, (texts,) in arrow_rows(batches, "text"):
            lengths, ends, terms, counts, at = [], [0], [], [], []
            for i, text_ in enumerate(texts):
                words = terms_of(text_)
                if words:
                    held = Counter(map(known.get, words))
                    held.pop(None, None)
                    at.append(i)
                    lengths.append(len(words))
                    terms.extend(held)
                    counts.extend(held.values())
                    ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch(
                [batch.column("key").take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
                ["key", "n", "terms", "tf"],
            )

    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return map_arrow(plain, task, f"key {id_type}, n long, terms array<int>, tf array<long>")


def best_of_tasks(held: DataFrame, block: Block, corpus: Corpus, weights: np.ndarray, k: int) -> DataFrame:
    """(item, key, score): what each task found, at most k rows per item and tree."""
    shared = held.sparkSession.sparkContext.broadcast((block.rows, block.times, weights))
    kind = held.schema["key"].dataType.simpleString()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Documents in runs of bounded size."""
        run, cells = [], 0
        for batch in batches:
            ends = batch.column("terms").offsets.to_numpy()
            ends = ends - ends[0]
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + POSTINGS - cells, "right")) - 1)
                stop = min(stop, batch.num_rows)
                run.append(batch.slice(start, stop - start))
                cells += int(ends[stop] - ends[start])
                start = stop
                if cells >= POSTINGS or (start < batch.num_rows):
                    yield pa.Table.from_batches(run)
                    run, cells = [], 0
        if run:
            yield pa.Table.from_batches(run)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, times, weight = shared.value
        floors = [1] * len(rows)
        tops = [np.empty(0, np.int64)] * len(rows)
        for table in trees(batches):
            terms, tf = table.column("terms").combine_chunks(), table.column("tf").combine_chunks()
            sizes = terms.value_lengths().to_numpy()
            columns = np.repeat(np.arange(len(sizes)), sizes)
            term, tf, n = terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy(), table.column("n").to_numpy()
            if not len(term):
                continue
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * corpus.length_weight(n)[columns]))
            height = max(1, int(max(len(weight), len(sizes)) - 1).bit_length())
            tree = ImpactTree(term, columns, impact, height)
            key = table.column("key").combine_chunks()
            ranks = key_ranks(key)
            for item in range(len(rows)):
                found, scores = tree.search(rows[item], times[item], k, floors[item])
                best = np.lexsort((ranks[found], -scores))[:k]
                found, scores = found[best], scores[best]
                tops[item] = -np.sort(-np.concatenate([tops[item], scores]))[:k]
                if len(tops[item]) == k:
                    floors[item] = int(tops[item][-1])
                if len(found):
                    yield pa.record_batch([pa.array(np.full(len(found), item)), key.take(pa.array(found)), pa.array(scores)], ["item", "key", "score"])

    return map_arrow(held, task, f"item long, key {kind}, score long")


def key_ranks(key: pa.Array) -> np.ndarray:
    """Place of each key in ascending order, nulls last."""
    order = pc.array_sort_indices(key, null_placement="at_end").to_numpy()
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows per item; first within parts of its candidates, so that no item's candidates meet in one task."""
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    parts = found.withColumn("part", F.pmod(F.xxhash64("key", "score"), F.lit(PARTS)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def item_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """Distinct (id, text) rows in blocks of about ``BLOCK_BYTES`` of text."""
    plain = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").distinct()
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    placed = plain.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    if blocks > 1:
        placed = stored(placed, "item-blocks")
    for block in range(blocks):
        rows = placed.filter(F.col("block") == block).orderBy("item", "text").collect()
        yield [(r["item"], r["text"]) for r in rows]


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The ``k`` best documents of every item: item id, rank (from 1), document id and score; see the module for the rest."""
    id_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    spark = docs.sparkSession
    out, corpus = None, None
    for chosen in item_blocks(items, item, item_text):
        block = Block.of(chosen)
        if not block.ids:
            continue
        held = stored(postings(docs, block, key, text), "postings")
        corpus = corpus or corpus_of(held)
        counted = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = np.zeros(len(block.terms), np.int64)
        for row in counted.toLocalIterator():  # at most the terms of a block
            weights[row["term"]] = corpus.term_weight(row["df"])
        best = ranked(best_of_tasks(held.filter(F.size("terms") > 0), block, corpus, weights, k), k)
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {item_type}")  # the items of a block
        named = best.join(F.broadcast(ids), "item").select(F.col("item_id").alias(item), F.col("rank"), F.col("key").alias(key), "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"{item} {item_type}, rank int, {key} {id_type}, score long")
    return out
