"""Undirected graphs as edge tables: degree, connected components, betweenness.

Edges are rows ``(src, dst)`` with ``src <= dst``; self-loops are allowed and only count for the
degree. Every loop below is a driver loop over distributed jobs; each round ends in a checkpoint.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .skew import lookup

# Edges of one vertex that one task expands at a time.
HUB_PART = 20_000
# (source, vertex) pairs kept per batch of sources.
BATCH_PAIRS = 20_000_000
# Folding trees goes on as long as a round folds this share of the vertices left.
LEAST_FOLDED = 0.001
# Up to this many edges one task may hold them all, so hubs need no care.
FEW_EDGES = 500_000


def undirected_edges(*edge_lists: DataFrame) -> DataFrame:
    """Distinct undirected edges of several two-column lists; null endpoints are skipped."""
    every = None
    for edges in edge_lists:
        a, b = (F.col(f"`{c}`").cast("string") for c in edges.columns)
        part = edges.filter(a.isNotNull() & b.isNotNull()).select(
            F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")
        )
        every = part if every is None else every.unionByName(part)
    return every.distinct()


def vertices_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All endpoints and seed ids, once each."""
    seed = F.col(f"`{seeds.columns[0]}`").cast("string").alias("id")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.unionByName(seeds.select(seed).filter("id IS NOT NULL")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per vertex (a self-loop has two)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _lowest_neighbour(arcs: DataFrame, few: bool) -> DataFrame:
    """arcs with the lowest neighbour of ``src`` (or itself) as ``low``; hubs do not gather in one task."""
    lowest = arcs.groupBy("src").agg(
        F.least(F.col("src"), F.min("dst")).alias("low"), F.count(F.lit(1)).alias("_arcs")
    )
    if few:
        return arcs.join(lowest.drop("_arcs"), "src")
    return lookup(arcs, lowest, "src", weight="_arcs")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` with the lowest id of the component as its id.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until every vertex hangs
    directly below the lowest id of its component.
    """
    pairs = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    before = (pairs.count(), None)
    while True:
        few = before[0] <= FEW_EDGES
        large = (
            _lowest_neighbour(_both_ways(pairs), few)
            .filter(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .distinct()
        )
        small = _lowest_neighbour(large, few)
        down = small.filter(F.col("dst") != F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        up = small.select("src", F.col("low").alias("dst"))
        pairs = cut(down.unionByName(up).distinct())
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    linked = pairs.select(F.col("src").alias("id"), F.col("dst").alias("component_id"))
    return vertices.join(linked, "id", "left").select(
        "id", F.coalesce("component_id", "id").alias("component_id")
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component_id").agg(F.count(F.lit(1)).alias("component_nodes"))


def _fold_trees(vertices: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold pendant trees into the vertices they hang on: (edges left, both ways; all vertices with their branches).

    Of every vertex: ``size`` (itself and its branches), ``squares`` (sum of the branches' squared sizes), and ``core``
    (still in the graph). A round folds all vertices of degree one; of two that are joined only to each other the lower id
    stays. Rounds end when few are left to fold: that is only work, as what stays is searched like the rest.
    """
    arcs = cut(_both_ways(pairs))
    known = cut(vertices.select("id", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("squares"), F.lit(True).alias("core")))
    left = arcs.select("src").distinct().count()
    while left:
        degree = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("_degree"))
        met = lookup(arcs, degree.withColumn("_arcs", F.col("_degree")), "src", weight="_arcs")
        ends = degree.select(F.col("src").alias("dst"), F.col("_degree").alias("_other"))
        met = lookup(met, ends.withColumn("_arcs", F.col("_other")), "dst", weight="_arcs")

        def folded(degree: str, other: str, own: str, opposite: str) -> Column:
            return (F.col(degree) == 1) & ((F.col(other) > 1) | (F.col(own) > F.col(opposite)))

        met = cut(met.select("src", "dst", folded("_degree", "_other", "src", "dst").alias("_src"), folded("_other", "_degree", "dst", "src").alias("_dst")))
        leaves = met.filter("_src").select(F.col("src").alias("id"), F.col("dst").alias("onto"))
        count = leaves.count()
        if not count:
            break
        sizes = leaves.join(known.select("id", "size"), "id")
        branches = sizes.groupBy(F.col("onto").alias("id")).agg(F.sum("size").alias("_size"), F.sum(F.col("size").cast("double") ** 2).alias("_squares"))
        known = known.join(branches, "id", "left").join(leaves.select("id", F.lit(True).alias("_leaf")), "id", "left")
        known = cut(
            known.select(
                "id", (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"), (F.col("squares") + F.coalesce("_squares", F.lit(0.0))).alias("squares"),
                (F.col("core") & F.col("_leaf").isNull()).alias("core"),
            )
        )
        arcs = cut(met.filter("NOT _src AND NOT _dst").select("src", "dst"))
        left -= count
        if count < LEAST_FOLDED * left:
            break
    return arcs, known


def _merge_twins(arcs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices with the same neighbours become one: (edges between classes, classes, their members).

    Neighbourhoods are told apart by their size and two sums of hashes, so no list of neighbours is gathered.
    """
    low = F.xxhash64("dst").cast("decimal(38,0)")
    sign = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum(low).alias("_a"), F.bit_xor(F.xxhash64(F.lit(7), "dst")).alias("_b"))
    held = sign.join(known.select(F.col("id").alias("src"), "size"), "src")
    grouped = held.groupBy("degree", "_a", "_b").agg(
        F.min("src").alias("name"), F.count(F.lit(1)).alias("members"), F.sum("size").alias("weight"), F.sum(F.col("size").cast("double") ** 2).alias("squares")
    )
    classes = cut(grouped.withColumn("vid", F.monotonically_increasing_id()))
    members = cut(sign.join(classes, ["degree", "_a", "_b"]).select(F.col("src").alias("id"), "vid", "degree"))
    # One member's edges stand for all.
    ends = members.select("id", "vid", F.col("degree").alias("_arcs"))
    first = arcs.join(classes.select(F.col("name").alias("src"), F.col("vid").alias("v")), "src")
    joined = lookup(first, ends.withColumnsRenamed({"id": "dst", "vid": "w"}), "dst", weight="_arcs").select("v", "w").distinct()
    return joined, classes.drop("_a", "_b"), members


def _reduced(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What shortest paths have to be counted on: (graph, classes, parts).

    ``parts`` has for every vertex what is known without counting (``exact``: the pairs that folded branches and twins send
    through it) and its class ``vid``, null for folded vertices.
    """
    arcs, known = _fold_trees(vertices, edges.filter("src <> dst"))
    joined, classes, members = _merge_twins(arcs, known)
    classes = cut(classes.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("degree") / HUB_PART)).cast("int")))
    ends = classes.select(F.col("vid").alias("w"), F.col("weight").alias("w_weight"), F.col("members").alias("w_members"), F.col("parts").alias("w_parts"))
    graph = joined.join(ends, "w").join(classes.select(F.col("vid").alias("v"), F.col("parts").alias("_parts")), "v")
    # The edges of a hub are cut into parts; a frontier row of the hub is sent to each of them.
    graph = cut(
        graph.select("v", F.pmod(F.xxhash64("w"), F.col("_parts")).cast("int").alias("part"), "w", "w_weight", "w_members", "w_parts")
    )
    # Two members of a class are two steps apart, over any of their neighbours.
    twins = classes.filter("members > 1").select(F.col("vid").alias("w"), ((F.col("weight").cast("double") ** 2 - F.col("squares")) / F.col("degree")).alias("between"))
    over = joined.join(twins, "w").groupBy(F.col("v").alias("vid")).agg(F.sum("between").alias("between"))
    sized = components.join(component_sizes(components), "component_id").select("id", "component_nodes")
    branches = (F.col("size") - 1).cast("double")
    through = branches**2 - F.col("squares") + 2 * branches * (F.col("component_nodes") - 1 - branches)
    parts = known.join(sized, "id").join(members.select("id", "vid"), "id", "left").join(over, "vid", "left")
    return graph, classes, cut(parts.select("id", "vid", (through + F.coalesce("between", F.lit(0.0))).alias("exact")))


def _scored(vertices: DataFrame, parts: DataFrame, sums: DataFrame | None, scale: float) -> DataFrame:
    """Betweenness from what is known and the sums ``(v, bc)`` of the classes."""
    known = parts.withColumn("bc", F.lit(0.0)) if sums is None else parts.join(sums.select(F.col("v").alias("vid"), "bc"), "vid", "left")
    scored = known.select("id", ((F.coalesce("bc", F.lit(0.0)) + F.col("exact")) / scale).alias("betweenness"))
    # Sums arrive in any order; the last digits are noise and would break ties.
    return vertices.join(scored, "id", "left").select("id", F.coalesce(F.round("betweenness", 12), F.lit(0.0)).alias("betweenness"))


def _start(classes: DataFrame, weight: Column) -> DataFrame:
    return classes.select(
        F.col("vid").alias("s"), weight.alias("s_weight"), F.col("vid").alias("v"), F.col("weight").alias("v_weight"),
        F.lit(1).cast("long").alias("v_members"), "parts", F.lit(1.0).alias("sigma"),
    )


def betweenness(vertices: DataFrame, edges: DataFrame, components: DataFrame, batch_pairs: int = BATCH_PAIRS) -> DataFrame:
    """``(id, betweenness)`` of every vertex, normalised by the number of ordered vertex pairs. Exact.

    Brandes' accumulation (2001) over all sources at once, level by level: a frontier is a table of
    (source, vertex, shortest-path count). Before, pendant trees are folded into weights and vertices with equal
    neighbours are merged into one with a number of members; both are exact, and leave little of a follower graph. The work
    that remains is classes times edges; ``betweenness_estimate`` is for graphs where that is too much.
    """
    n = vertices.count()
    if n <= 2:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    graph, classes, parts = _reduced(vertices, edges, components)
    count = classes.count()
    batches = max(1, math.ceil(count * count / batch_pairs))
    total = None
    for batch in range(batches):
        start = _start(classes.filter(F.pmod(F.xxhash64("vid"), F.lit(batches)) == batch), F.col("weight"))
        part = _accumulate(start, graph)
        if part is not None:
            total = part if total is None else cut(total.unionByName(part).groupBy("v").agg(F.sum("bc").alias("bc")))
    return _scored(vertices, parts, total, float((n - 1) * (n - 2)))


def betweenness_estimate(
    vertices: DataFrame, edges: DataFrame, components: DataFrame, error: float, confidence: float = 0.99, seed: int = 1
) -> DataFrame:
    """``(id, betweenness)`` that lies within ``error`` of the exact value for all vertices at once, with probability
    ``confidence`` at least.

    Sources are drawn with replacement, in proportion to the vertices they stand for, twice as many in each round, until an
    empirical Bernstein bound (Maurer and Pontil, 2009), shared among all classes and rounds, is below ``error`` for every
    class. What folded trees and twins contribute is exact. The number of sources does not grow with the graph, but for a
    logarithm; if it reaches that of all sources, the exact values are returned.
    """
    n = vertices.count()
    if n <= 2:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    graph, classes, parts = _reduced(vertices, edges, components)
    count, whole = classes.agg(F.count(F.lit(1)), F.sum("weight")).first()
    scale = float((n - 1) * (n - 2))
    if not count:
        return _scored(vertices, parts, None, scale)
    # One draw's value is at most `most`: a source meets n - 2 others at most.
    most = whole * (n - 2) / scale
    rounds = max(1, math.ceil(math.log2(count)) + 1)
    log_term = math.log(4 * count * rounds / (1 - confidence))
    sums, draws, wanted = None, 0, max(16, math.ceil(7 * most * log_term / (3 * error)))
    for turn in range(rounds):
        if draws + wanted >= count:
            return betweenness(vertices, edges, components)
        chosen = _drawn(classes, whole, wanted, seed + turn)
        part = _accumulate(_start(chosen, F.col("draws")), graph)
        draws += wanted
        if part is not None:
            sums = part if sums is None else cut(sums.unionByName(part).groupBy("v").agg(F.sum("bc").alias("bc"), F.sum("squares").alias("squares")))
        spread = 0.0
        if sums is not None:
            mean = F.col("bc") / draws
            variance = F.greatest((F.col("squares") / draws - mean * mean) * draws / max(1, draws - 1), F.lit(0.0))
            spread = (sums.agg(F.max(variance)).first()[0] or 0.0) * (whole / scale) ** 2
        if math.sqrt(2 * spread * log_term / draws) + 7 * most * log_term / (3 * max(1, draws - 1)) <= error:
            break
        wanted = draws
    else:
        return betweenness(vertices, edges, components)
    scaled = None if sums is None else sums.select("v", (F.col("bc") * (whole / draws)).alias("bc"))
    return _scored(vertices, parts, scaled, scale)


def _drawn(classes: DataFrame, whole: int, draws: int, seed: int) -> DataFrame:
    """Classes with how often they are drawn: random places along the running sum of all weights."""
    # By the order of vid, in ranges whose sums are known first; a range's running sum stays within it.
    ranges = classes.withColumn("range", F.shiftright("vid", 33))  # the task that numbered the class
    sums = sorted(tuple(r) for r in ranges.groupBy("range").agg(F.sum("weight")).collect())  # a row per task
    before = np.append(0, np.cumsum([w for _, w in sums]))
    places = np.sort(np.random.default_rng(seed).integers(0, whole, draws))
    at = np.searchsorted(before, places, "right") - 1
    rows = [(sums[r][0], int(p - before[r])) for r, p in zip(at.tolist(), places.tolist())]
    spots = classes.sparkSession.createDataFrame(rows, "range long, place long").groupBy("range").agg(F.sort_array(F.collect_list("place")).alias("places"))
    upto = F.sum("weight").over(Window.partitionBy("range").orderBy("vid"))
    met = ranges.withColumn("upto", upto).join(F.broadcast(spots), "range")  # no more than the draws
    hits = F.size(F.filter("places", lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("weight"))))
    return cut(met.withColumn("draws", hits).filter("draws > 0").select(*classes.columns, "draws"))


def _expand(frontier: DataFrame, graph: DataFrame, carried: list[str]) -> DataFrame:
    """Frontier rows joined with the edges of their vertex, hub parts spread over tasks."""
    spread = frontier.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select("s", "v", "part", *carried).join(graph, ["v", "part"])


def _accumulate(start: DataFrame, graph: DataFrame) -> DataFrame | None:
    """Per class the sums over the given sources of weight x dependency of one member, and x its square, as ``(v, bc, squares)``."""
    levels = [cut(start)]
    while True:
        reached = (
            _expand(levels[-1].withColumn("sigma", F.col("sigma") * F.col("v_members")), graph, ["s_weight", "sigma"])
            .groupBy("s", "w")
            .agg(
                F.max("s_weight").alias("s_weight"), F.max("w_weight").alias("v_weight"), F.max("w_members").alias("v_members"),
                F.max("w_parts").alias("parts"), F.sum("sigma").alias("sigma"),
            )
            .withColumnRenamed("w", "v")
        )
        # A neighbour of level i lies on level i-1, i or i+1.
        for earlier in levels[-2:]:
            reached = reached.join(earlier.select("s", "v"), ["s", "v"], "left_anti")
        reached = cut(reached.select("s", "s_weight", "v", "v_weight", "v_members", "parts", "sigma"))
        if reached.isEmpty():
            break
        levels.append(reached)

    sums = None
    below = None
    for depth in range(len(levels) - 1, 0, -1):
        level = levels[depth]
        dependency = F.lit(0.0)
        if below is not None:
            level = level.join(below, ["s", "v"], "left")
            dependency = F.coalesce("delta", F.lit(0.0))
        level = level.withColumn("delta", dependency)
        level = level.withColumn("q", (F.col("v_weight") + F.col("v_members") * F.col("delta")) / F.col("sigma"))
        part = level.filter("delta > 0").groupBy("v").agg(
            F.sum(F.col("s_weight") * F.col("delta")).alias("bc"), F.sum(F.col("s_weight") * F.col("delta") ** 2).alias("squares")
        )
        sums = part if sums is None else sums.unionByName(part)
        if depth > 1:
            received = _expand(level, graph, ["q"]).groupBy("s", "w").agg(F.sum("q").alias("q"))
            above = levels[depth - 1].select("s", "v", "sigma")
            below = cut(
                received.withColumnRenamed("w", "v").join(above, ["s", "v"]).select(
                    "s", "v", (F.col("sigma") * F.col("q")).alias("delta")
                )
            )
    return None if sums is None else cut(sums.groupBy("v").agg(F.sum("bc").alias("bc"), F.sum("squares").alias("squares")))
