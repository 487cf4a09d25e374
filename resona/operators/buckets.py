"""Order-preserving buckets of numeric values, balanced by their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

# A power of two; no bucket holds much more than 1/BUCKETS of the rows the edges were taken from.
BUCKETS = 512


def edges_of(value: Column, buckets: int = BUCKETS) -> Column:
    """Aggregate: ``buckets - 1`` approximate quantiles. They only decide the balance of the buckets."""
    steps = [i / buckets for i in range(1, buckets)]
    return F.percentile_approx(value, steps, max(10_000, 10 * buckets))


def add_bucket(df: DataFrame, value: str, edges: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Number of edges below the value, by binary search: one projection per halving."""
    out = df.withColumn(name, F.lit(0))
    step = buckets // 2
    while step >= 1:
        above = F.get(F.col(edges), F.col(name) + F.lit(step - 1)) < F.col(value)
        out = out.withColumn(name, F.when(above, F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return out.drop(edges)


def place_values(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distinct (group, measure ``_m``, value ``_v``) with count ``_n`` and bucket number ``_b``.

    The bucket edges are shared by all groups of a measure, so a group that holds most of the rows
    is cut into as many parts as its values spread over.
    """
    counted = cells.groupBy(*group, "_m", "_v").agg(F.count(F.lit(1)).alias("_n"))
    # The test on _n is always true; it keeps both readers of the shuffled counts alike, so that
    # the shuffle is done once.
    edges = counted.groupBy("_m").agg(edges_of(F.when(F.col("_n") > 0, F.col("_v"))).alias("_edges"))
    # edges: one row per measure. The result is read several times, so it is kept.
    return cut(add_bucket(counted.join(F.broadcast(edges), "_m"), "_v", "_edges", "_b"))
