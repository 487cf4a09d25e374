"""Small report views over the written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.nesting import keep_present
from .rollups import descending

SNAPSHOT_COLUMNS = (
    "video_id",
    "date",
    "region",
    "content_type",
    "primary_theme",
    "action_frame",
    "mood_label",
    "play_count",
    "share_count",
    "comment_count",
    "eng_per_1k_views",
    "overall_narrative_message",
)


def snapshot(posts_enriched: DataFrame) -> DataFrame:
    return keep_present(posts_enriched, SNAPSHOT_COLUMNS).orderBy(*descending("play_count", ties=["video_id"]))


def totals(post_metrics: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row: posts, captured comments, summary rows."""
    counts = post_metrics.agg(
        F.count(F.lit(1)).alias("posts"),
        F.coalesce(F.sum("n_comments_captured"), F.lit(0)).alias("captured_comments"),
    )
    return counts.withColumn("summary_rows", summaries.agg(F.count(F.lit(1))).scalar())


def message_frames(theme_performance: DataFrame, n: int = 8) -> DataFrame:
    """The message frames with the highest median plays, as ``theme | frame``."""
    best = theme_performance.orderBy(
        *descending("median_views", ties=["primary_theme", "action_frame", "mood_label"])
    ).limit(n)
    label = F.concat_ws(" | ", "primary_theme", "action_frame")
    return best.select(label.alias("message_frame"), "mood_label", "median_views")


def hashtags_of_several_posts(hashtag_performance: DataFrame, min_posts: int = 2, n: int = 15) -> DataFrame:
    several = hashtag_performance.filter(F.col("posts") >= min_posts)
    return several.orderBy(*descending("median_eng_per_1k", ties=["hashtag"])).limit(n)


def head(table: DataFrame, n: int, *columns: str, ties: list[str]) -> DataFrame:
    return table.orderBy(*descending(*columns, ties=ties)).limit(n)
