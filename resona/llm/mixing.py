"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies. Its whole part is certain; the fraction is an inclusion
probability. Pareto order sampling (Rosen, 1997) ranks documents by random odds over inclusion odds and takes
them in that order until the words left of the source's target are reached. Which documents are taken follows
from one cut-off per source, so no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import stored

MOST_COPIES = 3
SEED = 6
# Ranges of the order in which a source's words are summed before its cut-off range is sorted.
RANGES = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_order(groups: DataFrame, column: str) -> DataFrame:
    """``groups`` with ``place``, counted from 0 by rising ``column`` (nulls last), without gathering them in one task."""
    ordered = groups.repartitionByRange(F.asc_nulls_last(column)).sortWithinPartitions(F.asc_nulls_last(column))
    ordered = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33).alias("_part")
    sizes = sorted(tuple(r) for r in ordered.groupBy(part).agg(F.count(F.lit(1))).collect())  # one row per task
    before, starts = 0, []
    for number, size in sizes:
        starts.append((number, before))
        before += size
    offsets = F.broadcast(groups.sparkSession.createDataFrame(starts, "_part long, _start long"))
    placed = ordered.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn("place", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` with ``target``: weights 1, 2, 3, repeating by name, up to MOST_COPIES times the size.

    What a source can't take is shared anew by weight among the others until none is above its limit.
    """
    weighed = stored(in_order(sizes, "source").withColumn("weight", F.col("place") % 3 + 1).drop("place"), "source-weights")
    most = F.lit(float(MOST_COPIES)) * F.col("source_size")
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / weight if weight else 0.0, -1
    while True:
        is_full = most <= F.lit(level) * F.col("weight")
        now, taken, left = weighed.agg(F.count_if(is_full), F.sum(F.when(is_full, most)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if now == full or not left:
            break
        full, level = now, (total - (taken or 0.0)) / left
    return weighed.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("weight")


def same_source(left: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join of rows with the one row of their source; null is a source like any other."""
    named = per_source.withColumnRenamed("source", "_source")
    return left.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def random_odds(seed: int) -> Column:
    """u / (1 - u) for a number u in (0, 1) that depends on seed, id, source and hash ``t`` of the text only."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source", "t"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return u / (1 - u)


def ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Rows ``doc_id, source, t, size, rate`` with certain ``whole`` copies, the ``chance`` of one more, and its rank ``q``."""
    rate = F.least(F.lit(float(MOST_COPIES)), F.coalesce("rate", F.lit(0.0)))
    out = rows.withColumn("whole", F.floor(rate)).withColumn("chance", rate - F.col("whole"))
    return out.withColumn("q", F.when(F.col("chance") > 0, random_odds(seed) * (1 - F.col("chance")) / F.col("chance")))


def rates(rows: DataFrame, plan: DataFrame, preference: str | None) -> DataFrame:
    """Expected copies of each source's documents per unit of preference, so that the expected words are its target.

    Without preferences that is target over size. With them, documents at MOST_COPIES are set aside and the rest of
    the target is shared anew until no further one reaches it.
    """
    if preference is None:
        return plan.withColumn("per_unit", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("per_unit", F.lit(0.0)).withColumn("full", F.lit(-1).cast("long"))
    while True:
        met = same_source(rows, plan)
        is_full = F.col("per_unit") * F.col("p") >= MOST_COPIES
        sums = met.groupBy("source").agg(
            F.count_if(is_full).alias("_now"), F.sum(F.when(is_full, MOST_COPIES * F.col("size")).otherwise(0)).alias("_taken"),
            F.sum(F.when(~is_full, F.col("size") * F.col("p")).otherwise(0.0)).alias("_left"),
        )
        rate = F.when(F.col("_left") > 0, (F.col("target") - F.col("_taken")) / F.col("_left")).otherwise(F.col("per_unit"))
        new = same_source(plan, sums).withColumn("changed", F.col("_now") != F.col("full")).withColumn("per_unit", rate)
        new = stored(new.withColumn("full", F.col("_now")).drop("_now", "_taken", "_left"), "rates")
        if not new.filter("changed").limit(1).count():
            return new.drop("full", "changed")
        plan = new.drop("changed")


def liking(column: str) -> Column:
    return F.greatest(F.coalesce(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def mixing_plan(docs: DataFrame, seed: int = SEED, preference: str | None = None) -> DataFrame:
    """One row per source: ``source, source_size, target, per_unit`` and the last place ``cut`` in its order that is taken,
    with the number of rows there (``same``) and how many of them are taken (``keep``)."""
    p = F.lit(1.0) if preference is None else liking(f"`{preference}`")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("t"), word_count(F.col("text")).alias("size"), p.alias("p"))
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(rates(rows, targets(sizes), preference), "mix-rates")
    order = ranked(same_source(rows, plan).withColumn("rate", F.col("per_unit") * F.col("p")), seed)
    order = order.withColumn("range", F.floor(F.col("q") / (1 + F.col("q")) * RANGES).cast("int"))
    order = stored(order.select("doc_id", "source", "t", "size", "whole", "q", "range", "target"), "mix-order")
    sums = order.groupBy("source", "range").agg(
        F.sum(F.when(F.col("q").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target")
    )
    own = Window.partitionBy("source")  # RANGES rows and one at most
    sums = sums.withColumn("rest", F.col("target") - F.sum("sure").over(own)).filter("range IS NOT NULL")
    upto = F.sum("words").over(own.orderBy("range"))
    sums = sums.withColumn("before", upto - F.col("words")).filter("before < rest")
    last = sums.groupBy("source").agg(F.max_by(F.struct("range", "before", "rest"), "range").alias("last")).select("source", "last.*")
    edge = same_source(order, last.withColumnRenamed("range", "last_range")).filter("range = last_range")
    # Equal rows share a place and go through as one row.
    spot = F.struct("q", "doc_id", "size", "t")
    edge = edge.groupBy("source", spot.alias("cut")).agg(F.count(F.lit(1)).alias("same"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    size = F.col("cut.size")
    along = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.col("before") + F.sum(size * F.col("same")).over(along))
    # The document that crosses the target is taken if that comes nearer to it.
    left = F.col("rest") - F.col("upto") + size * F.col("same")
    fit = F.floor(left / size)
    nearest = fit + ((fit + 1) * size - left < left - fit * size).cast("long")
    keep = F.when(F.col("upto") <= F.col("rest"), F.col("same")).otherwise(F.least(F.col("same"), nearest))
    cuts = edge.withColumn("keep", keep).filter("keep > 0").groupBy("source").agg(F.max(F.struct("cut", "keep", "same")).alias("m")).select("source", "m.*")
    # With no document taken from the last range, all ranges before it still are.
    floor = last.select("source", F.struct((F.col("range") / F.lit(float(RANGES))).alias("t")).alias("floor"))
    plan = same_source(same_source(plan, cuts), floor)
    start = F.col("floor.t") / (1 - F.col("floor.t"))

    def bare(q: Column, size: int) -> Column:
        no = F.lit(None).cast("long")
        return F.struct(q.alias("q"), no.alias("doc_id"), F.lit(size).cast("long").alias("size"), no.alias("t"))

    cut = F.coalesce(F.col("cut"), F.when(F.col("floor").isNotNull(), bare(start, -1)), bare(F.lit(0.0), 0))
    return plan.withColumn("cut", cut).na.fill(0, ["keep", "same"]).drop("floor")


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with ``number``, counted from 1 within each group; no group is gathered in one task."""
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = counts.select("_group", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_id"))
    met = rows.withColumn("_within", within).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return met.withColumn("number", F.col("_start") + F.col("_within")).drop("_id", "_part", "_within", "_group", "_of", "_start")


def mixed_copies(docs: DataFrame, seed: int = SEED, preference: str | None = None) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``size``, ``source_size``, ``target`` and ``copies``.

    Sizes are words; a null text has none. A null source is a source of its own, the last by name. A source's
    taken words (copies times size) differ from its target by half a document at most. ``preference`` names a
    column of relative weights of the documents of one source (null and negative: 0); without it all are equal.
    Copies depend on seed, id, source and text only, so reruns agree. Rows equal in these have one place in the order; of those on
    the cut-off as many are taken as come nearest to the target, so rows without an id, or with one id, are rows like any others.
    An empty table gives an empty one, further columns may have any names.
    """
    plan = stored(mixing_plan(docs, seed, preference), "mix-plan")
    shared = not plan.filter("keep < same").isEmpty()
    plan = plan.select(F.col("source").alias("name"), F.struct("source_size", "target", "per_unit", "cut", "keep", "same").alias("plan"))
    p = F.lit(1.0) if preference is None else liking(f"row.`{preference}`")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("t"))
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("name")), "left").withColumn("size", word_count(F.col("row.text")))
    rate = F.least(F.lit(float(MOST_COPIES)), F.col("plan.per_unit") * p)
    whole = F.floor(rate)
    chance = rate - whole
    odds = F.when(chance > 0, random_odds(seed) * (1 - chance) / chance)
    spot = F.struct(odds.alias("q"), "doc_id", "size", "t")

    def copies(rows: DataFrame, more: Column) -> DataFrame:
        more = F.coalesce((F.col("chance") > 0) & more, F.lit(False)).cast("long")
        return rows.select("row", "size", "plan.source_size", "plan.target", (F.col("whole") + more).alias("copies"))

    met = met.select("row", "source", "size", "plan", whole.alias("whole"), chance.alias("chance"), spot.alias("spot"))
    upto = F.col("spot") <= F.col("plan.cut")
    if not shared:
        return copies(met, upto)
    split = F.coalesce((F.col("chance") > 0) & (F.col("spot") == F.col("plan.cut")), F.lit(False))
    tied = numbered(met.filter(split), "source")
    return copies(met.filter(~split), upto).unionByName(copies(tied, F.col("number") <= F.col("plan.keep")))


def mix(docs: DataFrame, seed: int = SEED, preference: str | None = None) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    copies = mixed_copies(docs, seed, preference).filter("copies > 0")
    repeated = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return copies.select("row", repeated.alias("copy")).select("row.*")


def mixed_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` per row of ``docs``.

    A source's taken words miss its target by half a document at most, which shows in sources of few documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed_copies(rows, seed).select("row.doc_id", "size", "source_size", "target", taken, "copies")
