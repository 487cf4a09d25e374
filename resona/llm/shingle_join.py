"""Self-join of documents on the Jaccard similarity of their word shingles, by parity sketches.

A shingle flips one bit of a document's sketch, so the sketches of two documents differ in at most as many bits
as their sets differ in shingles. Within a band of set sizes that difference has an upper limit ``d``; cut into
``d + 1 + spare`` slices, two sketches within the limit agree on ``spare + 1`` slices at least (pigeonhole). So a document
that shares fewer of its slices with anyone has no partner, and of the others only the rarest slices need to be looked up:
they agree on one of these. Equal slices give candidates, exact set differences verify them.

No group is expanded into pairs. Equal sets are one node. Each node is compared with one hub first; only slice buckets
whose nodes are not all joined by then are looked at further. There all nodes are compared with the bucket's hub, and those
of other components than the hub's with further hubs as long as that joins any. Two nodes that are still apart can only be
linked if their *differences from the hub* overlap; a prefix join over those differences, rarest elements first, finds all
such pairs. So all nodes that links connect are found to be connected, while near copies cost what they differ in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.graph import connected_components
from .bitmaps import bitmap, hits, place, without_ids
from .frames import Scratch, arrow_rows, map_arrow, read_docs, release, small_batches, stored
from .shingles import mixed, shingle_set


# Sets are never larger than this; bands are made by rule, so that no pass over the data has to find their number.
LARGEST = 1 << 40
NO_KEYS = np.empty(0, np.int64)
# Partitions of all documents' keys, as a multiple of the session's number.
KEY_PARTS = 4
# Keys that a task deals out at a time.
DEALT_KEYS = 1 << 21
# Counters of elements around hubs, whatever the data, and how many of them a task sums at a time. Shared ones only change an order.
SPOTS, SPOTS_PART = 1 << 24, 1 << 16
HALVES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


class Bands:
    """Size bands and slice counts for sets that are linked if 100 * intersection >= percent * union."""

    def __init__(self, percent: int, largest: int):
        edges = [1]
        while edges[-1] <= largest:
            edges.append(100 * edges[-1] // percent + 1)
        edges += [100 * edges[-1] // percent + 1]
        edges += [100 * edges[-1] // percent + 1]
        self.edges = np.array(edges)
        # Partners of a set of band k lie in the bands k - 1, k and k + 1. Cell k holds the pairs within band k and those of k and k + 1.
        low = self.edges[1:-1] - 1
        high = np.minimum(self.edges[2:] - 1, 100 * low // percent)
        self.differ = (low + high) * (100 - percent) // (100 + percent)

    def cells(self, size: int) -> list[tuple[int, int, int]]:
        """Cells of a set of this size: number, slices, and how many of these are more than differences plus one.

        Similar sets agree on ``spare + 1`` slices of a cell at least. Where sets must be equal there is no cell.
        """
        band = int(np.searchsorted(self.edges, size, side="right")) - 1
        out = []
        for cell in (band - 1, band):
            if cell >= 0 and self.differ[cell] > 0:
                least = int(self.differ[cell]) + 1
                spare = 1 + least // 2 + int(4 * least * np.exp(-self.edges[cell] / least))
                out.append((cell, least + spare, spare))
        return out


def slices(hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity words of ``count`` equal ranges of a sorted hash array (128 bits per slice, folded to 64), and which are filled."""
    steps = np.arange(1, count, dtype=np.float64) * (2.0**64 / count)
    cuts = np.r_[0, np.searchsorted(hashes, steps.astype(np.uint64))]
    filled = np.diff(np.r_[cuts, len(hashes)]) > 0
    out = np.zeros(count, np.uint64)
    if filled.any():
        # The low bits choose the place of a shingle's bit; each half has a place of its own.
        for shift, mark in ((0, HALVES[0]), (6, HALVES[1])):
            bits = np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
            words = np.bitwise_xor.reduceat(bits, cuts[filled])
            out[filled] ^= mixed(words + mark)
    return out, filled


def slice_keys(hashes: np.ndarray, bands: Bands) -> list[tuple[int, int, np.ndarray]]:
    """Per cell of a set: its number, how many keys similar sets share at least, and a key per (cell, slice, parity word).

    Unrelated sets agree on empty slices, so these are left out, unless similar sets might agree on them alone. A set that
    keeps them may have a partner that doesn't, with which it shares one filled slice at least.
    """
    out = []
    for cell, count, spare in bands.cells(len(hashes)):
        words, filled = slices(hashes, count)
        spots = np.arange(count, dtype=np.uint64) + np.uint64(cell << 40)
        keys = mixed(words + mixed(spots)).view(np.int64)
        least = spare + 1 - (count - int(np.count_nonzero(filled)))
        out.append((cell, least, keys[filled]) if least > 0 else (cell, 1, keys))
    return out


def identity(hashes: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit sums, equal for equal sets and (but for a chance of 2**-128) for no others."""
    with np.errstate(over="ignore"):
        return len(hashes), int(hashes.sum(dtype=np.uint64).view(np.int64)), int(mixed(hashes).sum(dtype=np.uint64).view(np.int64))


SET_KEY = ["n", "sum_a", "sum_b"]


def set_rows(docs: DataFrame, width: int, mode: str = "", percent: int = 0, chosen=None) -> DataFrame:
    """Rows ``doc_id, n, sum_a, sum_b`` per document; by mode with the whole ``shingles``, or with the ``keys`` of all cells
    and per cell its number (``cell``), ``least`` and number of keys (``held``).

    ``chosen``, a broadcast bitmap, keeps only documents whose id is in it.
    """
    extra = {"keys": {"cell": "array<int>", "least": "array<int>", "held": "array<int>", "keys": "array<long>"}, "shingles": {"shingles": "array<long>"}}.get(mode, {})
    bands = Bands(percent, LARGEST) if mode == "keys" else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chosen is not None:
                batch = batch.filter(pa.array(hits(chosen.value, batch.column("place").to_numpy())))
            for _, (ids, texts) in arrow_rows([batch], "doc_id", "text", most_bytes=1 << 20):
                rows, lists = [], []
                for i, text in zip(ids, texts):
                    found = shingle_set(text, width)
                    rows.append((i, *identity(found)))
                    if mode == "keys":
                        cells = slice_keys(found, bands)
                        keys = [k for _, _, k in cells]
                        lists.append(([c for c, _, _ in cells], [x for _, x, _ in cells], list(map(len, keys)), np.concatenate(keys) if keys else NO_KEYS))
                    elif mode:
                        lists.append((found.view(np.int64),))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                kinds = [pa.list_(pa.int64() if "long" in kind else pa.int32()) for kind in extra.values()]
                columns += [pa.array(c, kind) for c, kind in zip(zip(*lists), kinds)]
                yield pa.record_batch(columns, names=["doc_id", *SET_KEY, *extra])

    rows = docs.select("doc_id", "text", place(F.col("doc_id")).alias("place"))
    return map_arrow(rows, task, ", ".join(["doc_id long, n long, sum_a long, sum_b long", *[f"{k} {v}" for k, v in extra.items()]]))


def set_nodes(rows: DataFrame) -> DataFrame:
    """One node per distinct set: ``n, sum_a, sum_b, rep`` (lowest doc_id), ``copies``, ``node``.

    A node is named by its lowest id. Where rows of one id have different texts, the further ones get names of their own.
    """
    groups = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*SET_KEY).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    firsts = groups.groupBy("rep").agg(F.min(F.struct(*SET_KEY)).alias("first"))
    named = groups.join(firsts, "rep")
    own = F.col("first") == F.struct(*SET_KEY)
    return named.withColumn("node", F.when(own, F.col("rep")).otherwise(-F.abs(F.xxhash64("rep", *SET_KEY)))).drop("first")


def linked(size_a: Column, size_b: Column, differ: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, from the sizes and the symmetric difference."""
    return 100 * (size_a + size_b - differ) >= percent * (size_a + size_b + differ)


def most_different(size_a: Column, size_b: Column, percent: int) -> Column:
    return F.floor((size_a + size_b) * (100 - percent) / F.lit(100 + percent))


def with_hubs(members: DataFrame) -> DataFrame:
    """``(key, node, copies, top, hub)`` for the members ``(key, node, copies)`` of every bucket of two or more.

    Its hub has most copies, then most company in all buckets; ``top`` orders hubs.
    """
    sized = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n_key")).filter("n_key > 1"), "key")
    weight = sized.groupBy("node").agg(F.sum("n_key").alias("weight"))
    order = F.struct("copies", "weight", (-F.col("node")).alias("first"))
    hubs = sized.join(weight, "node").groupBy("key").agg(F.max(order).alias("top"))
    return members.join(hubs, "key").withColumn("hub", -F.col("top.first"))


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with both sizes and the symmetric difference of their sets."""
    of_node = sets.select("node", F.col("n").alias("n_node"), F.col("shingles").alias("s_node"))
    of_hub = sets.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("shingles").alias("s_hub"))
    both = pairs.join(of_node, "node").join(of_hub, "hub")
    differ = F.concat(F.array_except("s_node", "s_hub"), F.array_except("s_hub", "s_node"))
    return both.select("hub", "node", "n_node", "n_hub", differ.alias("differ"))


def spots(hubs: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Counters of elements around hubs."""
    return (mixed(elements.view(np.uint64) + mixed(hubs.view(np.uint64))) & np.uint64(SPOTS - 1)).astype(np.int64)


def of_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a batch's rows, and the row of each."""
    lists = batch.column("differ")
    return lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())


def frequencies(rows: DataFrame) -> np.ndarray:
    """How many rows ``(hub, differ)`` hold an element, to about a tenth, in a table of fixed size that different ones may share."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, row = of_rows(batch)
            found, times = np.unique(spots(batch.column("hub").to_numpy()[row], elements), return_counts=True)
            starts = np.flatnonzero(np.r_[True, np.diff(found // SPOTS_PART) > 0]) if len(found) else np.empty(0, int)
            ends = np.r_[starts[1:], len(found)].astype(int)
            low, times = (found % SPOTS_PART).astype(np.uint16), times.astype(np.uint32)
            yield pa.record_batch(
                [pa.array((found[starts] // SPOTS_PART).astype(np.int32)), *[pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (low, times)]],
                names=["part", "low", "times"],
            )

    def total(part: pa.Table) -> pa.Table:
        low, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in (("low", np.uint16), ("times", np.uint32)))
        levels = np.ceil(8 * np.log2(np.bincount(low, times, SPOTS_PART) + 1)).astype(np.uint8)
        return pa.table([part.column("part").slice(0, 1), pa.array([levels.tobytes()], pa.binary())], names=["part", "levels"])

    found = map_arrow(rows.select("hub", "differ"), tally, "part int, low binary, times binary").groupBy("part").applyInArrow(total, "part int, levels binary")
    out = np.zeros(SPOTS, np.uint8)
    for row in found.toLocalIterator():
        out[row["part"] * SPOTS_PART : (row["part"] + 1) * SPOTS_PART] = np.frombuffer(row["levels"], np.uint8)
    return out


def prefixes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(hub, node, c, n, linked, a, r, e)``: the first ``reach`` elements of each row, in one order for all rows of a hub.

    Any such order is right. Rare elements come first, by counters of a fixed size: exact counts would have to be moved to all
    elements of all rows.
    """
    levels = scratch.broadcast(frequencies(rows))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, row = of_rows(batch)
            order = np.lexsort((elements, levels.value[spots(batch.column("hub").to_numpy()[row], elements)], row))
            elements, row = elements[order], row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            few = rank < batch.column("reach").to_numpy()[row]
            of = pa.array(row[few])
            columns = [batch.column(c).take(of) for c in ("hub", "node", "c", "n", "linked", "a")]
            yield pa.record_batch([*columns, pa.array(rank[few].astype(np.int32)), pa.array(elements[few])], names=["hub", "node", "c", "n", "linked", "a", "r", "e"])

    given = rows.select("hub", "node", "c", "n", "linked", "a", "differ", "reach")
    return map_arrow(given, task, "hub long, node long, c long, n long, linked boolean, a int, r int, e long")


def around_hubs(compared: DataFrame, components: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links ``(src, dst)`` among nodes that were compared with one hub and lie in different components."""
    placed = compared.join(components, "node").withColumn("a", F.size("differ"))
    # The pairs with the hub itself are known, so a hub whose other nodes are all joined is done.
    groups = placed.groupBy("hub").agg((F.min("c") < F.max("c")).alias("open")).filter("open").select("hub")
    rows = scratch.stored(placed.join(groups, "hub").select("hub", "node", "c", F.col("n_node").alias("n"), "linked", "a", "differ"), "hub-rows")
    # A partner differs from the hub by at least a - d, and shares at least (a + b - d) / 2 elements.
    own = F.floor(F.col("n") * 100 / F.lit(percent))
    limit = most_different(F.col("n"), own, percent)
    # Of a linked node and one that isn't, b exceeds the limit towards the hub, which may be a share of a below d.
    reach = F.when(F.col("linked"), F.floor(F.col("a") * 100 / F.lit(100 + percent)) + 2).otherwise(F.least(F.col("a"), limit + 1))
    ranked = prefixes(rows.withColumn("reach", F.greatest(reach, F.lit(1)).cast("int")), scratch)
    # Elements that only nodes of one component have join nothing.
    often = ranked.groupBy("hub", "e").agg((F.min("c") < F.max("c")).alias("apart")).filter("apart").select("hub", "e")
    ranked = scratch.stored(ranked.join(often, ["hub", "e"]), "hub-prefixes")
    left = ranked.select("hub", "e", *[F.col(c).alias(f"{c}1") for c in ("node", "c", "n", "linked", "a", "r")])
    right = ranked.select("hub", "e", *[F.col(c).alias(f"{c}2") for c in ("node", "c", "n", "linked", "a", "r")])
    shared = F.ceil((F.col("a1") + F.col("a2") - most_different(F.col("n1"), F.col("n2"), percent)) / 2)
    fits = (
        (F.col("c1") < F.col("c2"))
        & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
        & (shared <= F.least("a1", "a2"))
        & (F.col("r1") <= F.col("a1") - shared)
        & (F.col("r2") <= F.col("a2") - shared)
    )
    met = left.join(right, (left.hub == right.hub) & (left.e == right.e) & fits).select(left.hub, "node1", "node2").distinct()
    one = rows.select("hub", F.col("node").alias("node1"), F.col("n").alias("n1"), F.col("differ").alias("d1"))
    two = rows.select("hub", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("differ").alias("d2"))
    both = met.join(one, ["hub", "node1"]).join(two, ["hub", "node2"])
    differ = F.size("d1") + F.size("d2") - 2 * F.size(F.array_intersect("d1", "d2"))
    return both.filter(linked(F.col("n1"), F.col("n2"), differ, percent)).select(F.least("node1", "node2").alias("src"), F.greatest("node1", "node2").alias("dst"))


def repeated_keys(keys: DataFrame) -> DataFrame:
    """The keys (one column) that occur more than once.

    Nearly all are alone, so that counting them before they are moved would fill tables of hundreds of MB to no avail. After it,
    each partition is counted in one table: there are more and smaller ones than elsewhere.
    """
    parts = KEY_PARTS * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n_key")).filter("n_key > 1").select("key")


def dealt_keys(docs: DataFrame, width: int, percent: int, chosen) -> DataFrame:
    """The slice keys of the documents in the bitmap ``chosen``, as few rows ``part, batch, first, owners, keys``.

    A batch holds some documents of a task. Their cells have numbers; of each part of the keys a row has the low 48 bits, and the
    number of each key's cell as the step from the one before, since rows of a key each would take four times as much disk. A
    row of its own with ``first`` -1 has what the numbers stand for: ``least`` and the documents' places.
    """
    bands, parts = Bands(percent, LARGEST), min(1 << 15, KEY_PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(places: list[int], least: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
        named = np.array(places, np.int32), np.array(least, np.int32)
        keys, owners = np.concatenate(lists).view(np.uint64), np.repeat(np.arange(len(lists)), list(map(len, lists)))
        part = ((keys >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        keys, owners, part = keys[order], owners[order], part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        steps = np.diff(owners, prepend=0)
        first, steps[starts] = owners[starts], 0
        low = keys.view(np.uint8).reshape(-1, 8)[:, :6]
        # Named by what it holds, so that a task that is repeated in another order of rows is seen.
        batch = int(mixed(mixed(owners.astype(np.uint64) + keys) + named[0][owners].astype(np.uint64)).sum(dtype=np.uint64).view(np.int64))
        rows = [(int(part[a]), int(f), narrow(steps[a:b]), low[a:b].tobytes()) for a, b, f in zip(starts, np.r_[starts[1:], len(keys)], first)]
        rows.append((batch % parts, -1, named[1].tobytes(), named[0].tobytes()))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
        return pa.record_batch([columns[0], pa.array([batch] * len(rows), pa.int64()), *columns[1:]], names=["part", "batch", "first", "owners", "keys"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, least, lists, held = [], [], [], 0
        for batch in batches:
            batch = batch.filter(pa.array(hits(chosen.value, batch.column("place").to_numpy())))
            for _, (at, texts) in arrow_rows([batch], "place", "text", most_bytes=1 << 20):
                for spot, text in zip(at, texts):
                    for _, few, keys in slice_keys(shingle_set(text, width), bands):
                        places.append(spot)
                        least.append(few)
                        lists.append(keys)
                        held += len(keys)
                    if held >= DEALT_KEYS:
                        yield dealt(places, least, lists)
                        places, least, lists, held = [], [], [], 0
        if held:
            yield dealt(places, least, lists)

    rows = docs.filter("doc_id IS NOT NULL").select("text", place(F.col("doc_id")).alias("place"))
    return map_arrow(rows, task, "part int, batch long, first int, owners binary, keys binary")


def narrow(steps: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes each."""
    return steps.astype(np.min_scalar_type(int(steps.max(initial=0)))).tobytes()


def meeting(dealt: DataFrame) -> DataFrame:
    """Places of the documents of which some cell shares ``least`` keys with others, from ``dealt_keys``.

    Two keys that agree in 48 bits and their part count as shared, which only lets more documents pass.
    """

    def shared(part: pa.Table) -> pa.Table:
        names = part.filter(pc.less(part.column("first"), 0))
        rows = part.filter(pc.greater_equal(part.column("first"), 0))
        out = {"batch": names.column("batch").to_pylist(), "owners": [None] * names.num_rows, "counts": names.column("owners").to_pylist(), "places": names.column("keys").to_pylist()}
        lists, steps = rows.column("keys").to_pylist(), rows.column("owners").to_pylist()
        counts = np.array([len(x) // 6 for x in lists], np.int64)
        wide = np.zeros((int(counts.sum()), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, 6)
        keys = wide.view(np.uint64).ravel()
        order = np.argsort(keys)
        again = keys[order[1:]] == keys[order[:-1]]
        met = np.zeros(len(keys), bool)
        met[order[1:][again]] = met[order[:-1][again]] = True
        for batch, first, step, a, count in zip(rows.column("batch").to_pylist(), rows.column("first").to_pylist(), steps, np.cumsum(counts) - counts, counts):
            if met[a : a + count].any():
                owners = first + np.cumsum(np.frombuffer(step, f"u{len(step) // count}"), dtype=np.int64)
                found, times = np.unique(owners[met[a : a + count]], return_counts=True)
                for name, value in zip(out, (batch, found.astype(np.int32).tobytes(), times.astype(np.int32).tobytes(), None)):
                    out[name].append(value)
        release()
        return pa.table([pa.array(v, pa.int64() if k == "batch" else pa.binary()) for k, v in out.items()], names=list(out))

    def enough(batch: pa.Table) -> pa.Table:
        named = batch.filter(pc.is_valid(batch.column("places")))
        if named.num_rows != 1:
            raise RuntimeError("a repeated task read its rows in another order; run the job again")
        least, places = (np.frombuffer(named.column(c)[0].as_py(), np.int32) for c in ("counts", "places"))
        rows = batch.filter(pc.is_null(batch.column("places")))
        owners, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int32) for c in ("owners", "counts"))
        total = np.bincount(owners, counts, len(least))
        return pa.table([pa.array(np.unique(places[total >= least]).astype(np.int64))], names=["place"])

    counted = dealt.groupBy("part").applyInArrow(shared, "batch long, owners binary, counts binary, places binary")
    return counted.groupBy("batch").applyInArrow(enough, "place long")


def similar_slices(docs: DataFrame, width: int, percent: int, nodes: DataFrame) -> DataFrame:
    """``(key, node, copies)``: the slices by which nodes may have partners.

    Similar nodes share ``least`` of a cell's keys. Nodes that share fewer with anyone are dropped, which makes further
    keys rare, and so on. Of the others' shared keys, all but the ``least - 1`` most frequent ones are enough.
    """
    scratch = Scratch(docs.sparkSession)
    # Documents that stand for a node, by bitmap; the join below drops what hits it by chance.
    first = scratch.broadcast(bitmap(nodes.select(place(F.col("rep")))))
    # All documents' keys are moved once, packed. Only those of documents that share enough become rows.
    left = scratch.stored(meeting(dealt_keys(docs, width, percent, first)), "meeting")
    met = scratch.broadcast(bitmap(left))
    named = nodes.select(F.col("rep").alias("doc_id"), "sum_a", "node")
    keyed = set_rows(docs.filter("doc_id IS NOT NULL"), width, "keys", percent, chosen=met).join(named, ["doc_id", "sum_a"])
    keyed = keyed.select("node", "cell", "least", "held", "keys").dropDuplicates(["node"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, least, cell = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("held", "least", "cell"))
            rows = np.repeat(np.arange(batch.num_rows), batch.column("cell").value_lengths().to_numpy())
            owner = np.repeat(np.arange(len(held)), held)  # of each key, its document's cell
            nodes = batch.column("node").take(pa.array(rows[owner]))
            yield pa.record_batch([batch.column("keys").flatten(), nodes, pa.array(cell[owner]), pa.array(least[owner])], names=["key", "node", "cell", "least"])

    rows = scratch.stored(map_arrow(keyed, split, "key long, node long, cell int, least int"), "slices")
    before, count = None, rows.count()
    # Any number of rounds is right; they end when little is left to drop.
    while before is None or count < 0.9 * before:
        kept = rows.select("key", "node", "cell", "least").join(repeated_keys(rows.select("key")), "key")
        held = kept.groupBy("node", "cell").agg(F.count(F.lit(1)).alias("held"))
        rows = scratch.stored(kept.join(held, ["node", "cell"]).filter("held >= least"), "shared-slices")
        before, count = count, rows.count()
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_key"))
    own = Window.partitionBy("node", "cell").orderBy("n_key", "key")  # the slices of one text
    rarest = rows.join(often, "key").withColumn("r", F.row_number().over(own)).filter(F.col("r") <= F.col("held") - F.col("least") + 1)
    members = stored(rarest.select("key", "node").distinct().join(nodes.select("node", "copies"), "node").select("key", "node", "copies"), "members")
    scratch.clear()
    return members


def merged(components: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``(node, c)`` after further links: only those that links join are looked at."""
    one = components.select(F.col("node").alias("src"), F.col("c").alias("a"))
    two = components.select(F.col("node").alias("dst"), F.col("c").alias("b"))
    ends = links.join(one, "src").join(two, "dst").filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    ends = scratch.stored(ends, "joins")
    if ends.isEmpty():
        return components
    found = connected_components(ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), ends)
    found = found.select(F.col("id").alias("c"), "component_id")
    return scratch.stored(components.join(found, "c", "left").select("node", F.coalesce("component_id", "c").alias("c")), "components")


def linked_nodes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, nodes (distinct sets), links that connect all nodes that are similar, and the components ``(node, c)``
    of those that may have partners."""
    scratch = Scratch(docs.sparkSession)
    base = stored(set_rows(docs, width), "sets")
    nodes = stored(set_nodes(base), "set-nodes")
    buckets = scratch.stored(with_hubs(similar_slices(docs, width, percent, nodes)), "buckets")
    involved = scratch.stored(buckets.select("node").distinct().join(nodes, "node").select("node", *SET_KEY, F.col("rep").alias("doc_id")), "involved")
    chosen = scratch.broadcast(bitmap(involved.select(place(F.col("doc_id")))))
    sets = set_rows(docs.filter("doc_id IS NOT NULL"), width, "shingles", chosen=chosen).join(involved, ["doc_id", *SET_KEY])
    sets = scratch.stored(sets.select("node", "n", "shingles").dropDuplicates(["node"]), "involved-sets")

    def compare(pairs: DataFrame) -> DataFrame:
        found = differences(pairs, sets)
        return scratch.stored(found.withColumn("linked", linked(F.col("n_node"), F.col("n_hub"), F.size("differ"), percent)), "compared")

    def links_of(compared: DataFrame) -> DataFrame:
        return compared.filter("linked").select(F.least("hub", "node").alias("src"), F.greatest("hub", "node").alias("dst"))

    # Every node and its best hub.
    pairs = buckets.filter("hub <> node").groupBy("node").agg(F.max("top").alias("top")).select((-F.col("top.first")).alias("hub"), "node")
    around = compare(pairs)
    links = links_of(around)
    components = merged(involved.select("node", F.col("node").alias("c")), links, scratch)
    # Buckets whose nodes are not all joined: all their nodes and their hub.
    rest = buckets.join(components, "node")
    apart = rest.groupBy("key").agg((F.min("c") < F.max("c")).alias("apart")).filter("apart").select("key")
    rest = scratch.stored(rest.join(apart, "key").select("key", "node", "copies", "hub"), "apart")
    known = around.select("hub", "node")
    around = around.unionByName(compare(rest.filter("hub <> node").select("hub", "node").distinct().join(known, ["hub", "node"], "left_anti")))
    more = links_of(around)
    links = links.unionByName(more).distinct()
    # Further hubs among those that their bucket's hubs do not join, as long as that finds links.
    while True:
        components = merged(components, more, scratch)
        of_hub = components.select(F.col("node").alias("hub"), F.col("c").alias("c_hub"))
        others = rest.join(components, "node").join(of_hub, "hub").filter("c <> c_hub").select("key", "node", "copies")
        rest = scratch.stored(with_hubs(others).select("key", "node", "copies", "hub"), "apart")
        pairs = rest.join(components, "node").join(of_hub, "hub").filter("c <> c_hub").select("hub", "node").distinct()
        more = links_of(compare(pairs))
        if more.isEmpty():
            break
        links = links.unionByName(more)
    more = scratch.stored(around_hubs(around, components, percent, scratch), "last-links")
    components = stored(merged(components, more, scratch), "node-components")
    links = stored(links.unionByName(more).distinct(), "links")
    scratch.clear()
    return base, nodes, links, components


def shingle_links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, nodes (distinct sets), and links between nodes that connect all that are similar."""
    with small_batches(docs.sparkSession):
        return linked_nodes(docs, width, percent)[:3]


def similar_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``, over whole texts.

    Words are runs of characters other than ASCII blanks, A-Z lower-cased; a set holds the distinct runs of
    ``width`` words, or the whole shorter sequence. Two sets are linked if 100 * intersection >= percent * union;
    ``component_id`` is the lowest id that can be reached. Null and empty texts, and texts of blanks, have an empty set
    and are linked with nothing, as are rows with a null id (whose component is null). Repeated rows are linked, as equal sets
    are; rows of one id with different texts are linked only if their sets are. An empty table gives an empty one,
    further columns are ignored.
    """
    found = set_components(docs, width, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def set_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, sum_a, sum_b, component_id`` per row of ``docs``: the components with the sets they are found by."""
    rows = read_docs(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        base, nodes, _, components = linked_nodes(rows, width, percent)
    joined = stored(nodes.join(components, "node", "left").select(*SET_KEY, "rep", F.coalesce("c", "node").alias("c")), "set-components")
    lowest = joined.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_set = joined.join(lowest, "c").select(*SET_KEY, "component_id")
    out = base.join(by_set, SET_KEY, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", *SET_KEY, component.alias("component_id"))


def one_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``docs`` with one document of each component of similar ones: that with the lowest id.

    Rows of one id that are equal in all columns are one document; of an id with different texts only the rows go that are
    copies of a lower id. Rows with a null id stay.
    """
    found = stored(set_components(docs, width, percent), "components")
    goes = F.col("doc_id") != F.col("component_id")
    per_id = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(goes).alias("some"), F.bool_and(goes).alias("all"))
    per_id = stored(per_id.filter("n > 1 OR all"), "ids")
    kept = without_ids(docs, stored(per_id.filter("all").select("doc_id"), "copies"))
    twice = stored(per_id.filter("n > 1 AND NOT all").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, kept["doc_id"].cast("long") == twice["doc_id"], "left_semi")
    split = stored(per_id.filter("some AND NOT all").select("doc_id"), "split-ids")
    if not split.isEmpty():
        # The texts of these ids, told apart by hash, with the sets that stay.
        texts = read_docs(again).select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        sets = set_rows(texts, width).withColumnRenamed("doc_id", "hash")
        stay = found.join(twice, "doc_id", "left_semi").filter(~goes)
        stay = stored(stay.join(sets, SET_KEY).select("doc_id", "hash").distinct(), "staying-texts")
        again = again.join(stay, (again["doc_id"].cast("long") == stay["doc_id"]) & (F.xxhash64(again["text"]) == stay["hash"]), "left_semi")
    return without_ids(kept, twice).unionByName(again.dropDuplicates())
