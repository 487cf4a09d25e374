"""Percent rank of whole columns without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .buckets import place_values
from .skew import lookup


def value_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values ``_v`` of column number ``_m``, their count ``_n`` and percent rank ``_pct``.

    Percent rank = average position of the value's ties / number of non-null values. Running totals
    are taken over the few bucket totals, then inside each bucket, never over all rows.
    """
    cells = F.array(
        *[F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]
    )
    placed = place_values(df.select(F.inline(cells)).filter("_v IS NOT NULL"), [])
    totals = placed.groupBy("_m", "_b").agg(F.sum("_n").alias("_bn"))
    along = Window.partitionBy("_m").orderBy("_b")
    offsets = totals.select(
        "_m",
        "_b",
        (F.sum("_bn").over(along) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(Window.partitionBy("_m")).alias("_total"),
    )
    inside = Window.partitionBy("_m", "_b").orderBy("_v")
    position = F.col("_before") + F.sum("_n").over(inside) - F.col("_n") + (F.col("_n") + 1) / 2
    # offsets: BUCKETS rows per column at most
    return placed.join(F.broadcast(offsets), ["_m", "_b"]).select(
        "_m", "_v", "_n", (position / F.col("_total")).alias("_pct")
    )


def add_percent_ranks(df: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """Append the percent rank of each column (``{output: column}``); null stays null."""
    names = list(ranks)
    table = stored(value_ranks(df, [ranks[n] for n in names]), "value-ranks")
    out = df
    for i, name in enumerate(names):
        one = table.filter(F.col("_m") == i).select("_v", "_n", F.col("_pct").alias(name))
        out = lookup(out.withColumn("_v", F.col(ranks[name]).cast("double")), one, "_v", weight="_n").drop("_v")
    return out


def add_percent_ranks_of_groups(df: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """The same by plain windows in one task: only for tables of label combinations.

    Their size is bounded by the number of labels in the rule sets, not by the data.
    """
    out = df
    for name, column in ranks.items():
        every = Window.partitionBy(F.lit(0))
        ties = F.count(F.lit(1)).over(Window.partitionBy(column))
        lowest = F.rank().over(every.orderBy(F.col(column).asc_nulls_last()))
        filled = F.count(column).over(every)
        out = out.withColumn(name, F.when(F.col(column).isNotNull(), (lowest + (ties - 1) / 2) / filled))
    return out
