"""Exact grouped medians, also for groups too large for one task.

The built-in median keeps all distinct values of a group in one task's memory. Here the rows are
reduced to (group, value, count), the values are cut into order-preserving buckets, the bucket that
holds the middle rank is found from the bucket totals, and only that bucket is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .buckets import place_values
from .skew import join_groups


def split_medians(df: DataFrame, keys: Sequence[str], medians: Mapping[str, str]) -> DataFrame:
    """One row per group with the exact median of each column (``{output: column}``), nulls skipped.

    Even counts give the mean of the two middle values. Groups without any value are absent.
    """
    names = list(medians)
    group = [f"_g{i}" for i in range(len(keys))]
    cells = F.array(
        *[F.struct(F.lit(i).alias("_m"), F.col(medians[n]).cast("double").alias("_v")) for i, n in enumerate(names)]
    )
    cells = df.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.inline(cells))
    placed = place_values(cells.filter("_v IS NOT NULL"), group)

    cell = [*group, "_m"]
    along = Window.partitionBy(*cell).orderBy("_b")  # at most BUCKETS rows per group
    totals = (
        placed.groupBy(*cell, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(along) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*cell)))
        .withColumn("_low", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_high", F.floor(F.col("_total") / 2) + 1)
        .filter("_before < _high AND _before + _bn >= _low")
        .drop("_bn", "_total")
    )
    middle = placed.select(*[F.col(c).alias(f"_p{c}") for c in [*cell, "_b"]], "_v", "_n")
    same = F.lit(True)
    for c in [*cell, "_b"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_p{c}"))
    inside = Window.partitionBy(*cell, "_b").orderBy("_v")
    ranked = (
        middle.join(totals, same)
        .select(*cell, "_b", "_before", "_low", "_high", "_v", "_n")
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    )
    outputs = []
    for i, name in enumerate(names):
        value = [
            F.max(F.when((F.col("_m") == i) & (F.col("_upto") >= F.col(r)) & (F.col("_upto") - F.col("_n") < F.col(r)), F.col("_v")))
            for r in ("_low", "_high")
        ]
        outputs.append(((value[0] + value[1]) / 2).alias(name))
    result = ranked.groupBy(*group).agg(*outputs)
    return result.withColumnsRenamed(dict(zip(group, keys)))


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    medians: Mapping[str, str] | None = None,
) -> DataFrame:
    """Grouped aggregates (null is a group of its own) plus exact medians of further columns.

    With medians the rows are written once and read by both; callers select the columns they need.
    """
    if not medians:
        return df.groupBy(*keys).agg(*aggregates)
    df = stored(df, "grouped-rows")
    return join_groups(df.groupBy(*keys).agg(*aggregates), split_medians(df, keys, medians), keys)


def grouped_mode(df: DataFrame, keys: Sequence[str], label: str, value: str, count: str) -> DataFrame:
    """Most frequent non-null label per group and its count; the lowest label wins a tie."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(label, F.struct(-F.col("_n"), F.col(label)))
    return counted.groupBy(*keys).agg(best.alias(value), F.max("_n").alias(count))


def total(column: str) -> Column:
    """Sum in which a group without values counts as 0."""
    return F.coalesce(F.sum(column), F.lit(0.0))
