"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType

# Most keys treated apart. A key outside the list holds less than about 1/HOT_KEYS of the rows, and
# the broadcast side of the join never has more rows than this.
HOT_KEYS = 512
SPREAD = 4096


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEYS) -> DataFrame:
    """At most ``limit`` frequent keys of ``df``, from one pass with a fixed-size sketch.

    Only the balance of a later join depends on the sketch, never its result.
    """
    top = df.agg(F.expr(f"approx_top_k(`{key}`, {limit}, {16 * limit})").alias("top"))
    return top.select(F.explode("top.item").alias(key)).filter(F.col(key).isNotNull())


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two tables with one row per group; null keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, condition, "left").drop(*[f"_right_{k}" for k in keys])


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Left join on ``key`` where ``right`` has one row per key, safe for hot and null keys of ``left``.

    The rows of hot keys get their values from a broadcast of at most ``HOT_KEYS`` rows and then
    travel with a spread key, as do rows with a null key; all other rows join as usual.
    ``weight`` names a column of ``right`` that counts the rows of ``left`` per key: the hot keys are
    then read off it (and the column is dropped); without it one pass over the keys of ``left``
    finds them.
    """
    payload = [c for c in right.columns if c not in (key, weight)]
    values = F.struct(*[F.col(c) for c in payload])
    if weight is None:
        keys = hot_keys(left, key)
        found = right.join(F.broadcast(keys), key, "left_semi")
        hot = keys.join(F.broadcast(found), key, "left").select(key, values.alias("_hot"))
    else:
        hot = right.orderBy(F.col(weight).desc(), F.col(key)).limit(HOT_KEYS)
        hot = hot.select(key, values.alias("_hot"))

    marked = left.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), key, "left")
    cold_key = F.when(F.col("_is_hot").isNull(), F.col(key))
    # By the row's content, not at random: a repeated task must send each row where it went before.
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema if not isinstance(f.dataType, MapType)])
    spread = marked.withColumn("_key", cold_key).withColumn(
        "_spread", F.when(F.col("_key").isNull(), 1 + F.pmod(content, F.lit(SPREAD))).otherwise(F.lit(0))
    )
    cold = right.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_spread"), values.alias("_cold"))
    joined = spread.join(cold, ["_key", "_spread"], "left")
    picked = [
        F.when(F.col("_is_hot"), F.col(f"_hot.`{c}`")).otherwise(F.col(f"_cold.`{c}`")).alias(c)
        for c in payload
    ]
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *picked)
