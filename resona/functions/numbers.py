"""Numbers, time features, ratios and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .rulesets import COUNT_COLUMNS, CREATOR_SCALE

# Seconds that fit a nanosecond clock (years 1677 to 2262); other epochs count as bad input.
EPOCH_LIMIT = 9_223_372_036


def number_or_null(value: Column) -> Column:
    """Double, or null where the value cannot be read as a number (NaN counts as null)."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def number(value: Column) -> Column:
    """Double, 0 where the value is missing or cannot be read as a number."""
    return F.coalesce(number_or_null(value), F.lit(0.0))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = {c: number(F.col(c)) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 for a zero or missing denominator, or a missing numerator."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0.0)), F.lit(0.0))


def epoch_timestamp(value: Column) -> Column:
    """UTC timestamp of epoch seconds, null if unreadable or out of range."""
    seconds = number_or_null(value)
    return F.when(F.abs(seconds) <= EPOCH_LIMIT, F.timestamp_seconds(seconds))


def time_features(ts: Column) -> dict[str, Column]:
    return {
        "date": F.date_format(ts, "yyyy-MM-dd"),
        "month": F.date_format(ts, "yyyy-MM"),
        "dow": F.date_format(ts, "EEEE"),
        "hour": F.hour(ts),
    }


def add_time_features(df: DataFrame, create_column: str = "create_time") -> DataFrame:
    if create_column not in df.columns:
        return df
    df = df.withColumn("ts", epoch_timestamp(F.col(create_column)))
    return df.withColumns(time_features(F.col("ts")))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def add_engagement(df: DataFrame, counts: Sequence[str] = COUNT_COLUMNS) -> DataFrame:
    """``eng_total`` over the counters present (plays included) and the rate per 1,000 plays."""
    present = [F.col(c) for c in counts if c in df.columns]
    total = F.lit(0.0)
    if present:
        total = present[0]
        for column in present[1:]:
            total = total + column
    df = df.withColumn("eng_total", total)
    plays = F.col("play_count") if "play_count" in df.columns else F.lit(0.0)
    return df.withColumn("eng_per_1k_views", ratio(F.lit(1000.0) * F.col("eng_total"), plays))


def has_video(df: DataFrame) -> Column:
    return (F.col("duration") > 0) if "duration" in df.columns else F.lit(False)


def creator_scale(followers: Column, classes: Sequence[tuple[str, int | None]] = CREATOR_SCALE) -> Column:
    """Size class by followers, upper bounds inclusive; a missing count is the smallest class."""
    value = F.coalesce(followers, F.lit(0.0))
    chain = None
    for label, upper in classes:
        if upper is None:
            return F.lit(label) if chain is None else chain.otherwise(label)
        chain = F.when(value <= upper, label) if chain is None else chain.when(value <= upper, label)
    return chain


def round_half_even(value: Column, digits: int = 3) -> Column:
    """Scale, round to the nearest even integer, scale back: ties are ties of the product, as in numpy and SQL's ROUND_EVEN."""
    scale = 10.0**digits
    return F.rint(value.cast("double") * scale) / scale


