"""Rankings and rollups of posts by region, hashtag, format, theme and message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_half_even
from ..functions.rulesets import OPPORTUNITY_WEIGHTS
from ..operators.medians import summarise, total
from ..operators.nesting import keep_present
from ..operators.ranks import add_percent_ranks_of_groups
from ..session import stored

SUMMED_COLUMNS = ("video_id", "play_count", "share_count", "comment_count", "eng_per_1k_views")


def lacks(df: DataFrame, *columns: str) -> bool:
    return not set(columns) <= set(df.columns)


def empty_table(df: DataFrame, schema: str) -> DataFrame:
    """What a rollup returns where its grouping column is missing."""
    return df.sparkSession.createDataFrame([], schema)


def _posts() -> Column:
    return F.count_distinct("video_id").alias("posts")


def descending(*columns: str, ties: Sequence[str]) -> list[Column]:
    """Sort order: the columns from high to low, nulls last, then the tie-break keys."""
    return [F.col(c).desc_nulls_last() for c in columns] + [F.col(c).asc_nulls_last() for c in ties]


def enough_views(posts: DataFrame, min_views: float) -> Column:
    return F.coalesce(F.col("play_count"), F.lit(0.0)) >= min_views


def top_by(posts: DataFrame, column: str, n: int) -> DataFrame:
    return posts.orderBy(*descending(column, ties=["video_id"])).limit(n)


def top_posts(post_metrics: DataFrame, min_views: float = 1000, n: int = 20) -> dict[str, DataFrame]:
    """Top posts by plays, by engagement rate (with enough plays only) and by shares."""
    eligible = post_metrics.filter(enough_views(post_metrics, min_views))
    return {
        "top_posts_by_reach": top_by(post_metrics, "play_count", n),
        "top_posts_by_engagement_efficiency": top_by(eligible, "eng_per_1k_views", n),
        "top_posts_by_shares": top_by(post_metrics, "share_count", n),
    }


def hashtag_performance(post_metrics: DataFrame, hashtags: DataFrame) -> DataFrame:
    tagged = hashtags.filter("hashtag IS NOT NULL").join(keep_present(post_metrics, SUMMED_COLUMNS), "video_id", "left")
    out = summarise(
        tagged,
        ["hashtag"],
        [
            _posts(),
            F.avg("play_count").alias("mean_views"),
            total("share_count").alias("total_shares"),
            total("comment_count").alias("total_comments"),
        ],
        {"median_views": "play_count", "median_eng_per_1k": "eng_per_1k_views"},
    )
    return out.select(
        "hashtag", "posts", "median_views", "mean_views", "median_eng_per_1k", "total_shares", "total_comments"
    ).orderBy(*descending("posts", "median_eng_per_1k", ties=["hashtag"]))


def region_performance(post_metrics: DataFrame) -> DataFrame:
    if lacks(post_metrics, "region"):
        return empty_table(
            post_metrics,
            "region string, posts long, total_views double, median_views double, total_shares double, total_comments double, median_eng_per_1k double",
        )
    out = summarise(
        keep_present(post_metrics, ("region", *SUMMED_COLUMNS)),
        ["region"],
        [
            _posts(),
            total("play_count").alias("total_views"),
            total("share_count").alias("total_shares"),
            total("comment_count").alias("total_comments"),
        ],
        {"median_views": "play_count", "median_eng_per_1k": "eng_per_1k_views"},
    )
    return out.select(
        "region", "posts", "total_views", "median_views", "total_shares", "total_comments", "median_eng_per_1k"
    ).orderBy(*descending("total_views", ties=["region"]))


def content_type_performance(post_metrics: DataFrame, summaries: DataFrame) -> DataFrame:
    typed = keep_present(post_metrics, SUMMED_COLUMNS).join(
        summaries.select("video_id", "content_type"), "video_id", "left"
    )
    out = summarise(
        typed,
        ["content_type"],
        [_posts(), F.avg("share_count").alias("mean_shares"), F.avg("comment_count").alias("mean_comments")],
        {"median_views": "play_count", "median_eng_per_1k": "eng_per_1k_views"},
    )
    return out.select(
        "content_type", "posts", "median_views", "median_eng_per_1k", "mean_shares", "mean_comments"
    ).orderBy(*descending("posts", ties=["content_type"]))


def theme_performance(posts_enriched: DataFrame) -> DataFrame:
    keys = ["primary_theme", "action_frame", "mood_label"]
    if lacks(posts_enriched, *keys):
        return empty_table(
            posts_enriched,
            "primary_theme string, action_frame string, mood_label string, posts long, median_views double, "
            "median_eng_per_1k double, mean_shares double, mean_comments double, total_shares double",
        )
    out = summarise(
        keep_present(posts_enriched, (*keys, *SUMMED_COLUMNS)),
        keys,
        [
            _posts(),
            F.avg("share_count").alias("mean_shares"),
            F.avg("comment_count").alias("mean_comments"),
            total("share_count").alias("total_shares"),
        ],
        {"median_views": "play_count", "median_eng_per_1k": "eng_per_1k_views"},
    )
    return out.select(
        *keys, "posts", "median_views", "median_eng_per_1k", "mean_shares", "mean_comments", "total_shares"
    ).orderBy(*descending("median_eng_per_1k", "median_views", ties=keys))


def with_enough_views(posts: DataFrame, min_views: float) -> DataFrame:
    """Posts with enough plays, or all posts if there is none."""
    any_enough = posts.agg(F.bool_or(enough_views(posts, min_views))).scalar()
    return posts.filter(enough_views(posts, min_views) | ~F.coalesce(any_enough, F.lit(False)))


def messaging_recommendations(posts_enriched: DataFrame, min_views: float = 1000) -> DataFrame:
    """Message combinations by a blend of three percent ranks of their medians."""
    keys = ["primary_theme", "action_frame", "content_type"]
    if lacks(posts_enriched, *keys):
        return empty_table(
            posts_enriched,
            "primary_theme string, action_frame string, content_type string, posts long, median_views double, median_eng_per_1k double, "
            "median_shares double, views_rank_pct double, eng_rank_pct double, share_rank_pct double, opportunity_score double",
        )
    narrow = stored(keep_present(posts_enriched, (*keys, *SUMMED_COLUMNS)), "enriched-rows")
    grouped = summarise(
        with_enough_views(narrow, min_views),
        keys,
        [_posts()],
        {"median_views": "play_count", "median_eng_per_1k": "eng_per_1k_views", "median_shares": "share_count"},
    )
    ranked = add_percent_ranks_of_groups(
        grouped,
        {
            "views_rank_pct": "median_views",
            "eng_rank_pct": "median_eng_per_1k",
            "share_rank_pct": "median_shares",
        },
    )
    score = F.lit(0.0)
    for column, weight in OPPORTUNITY_WEIGHTS.items():
        score = score + F.lit(weight) * F.col(column)
    return ranked.withColumn("opportunity_score", round_half_even(score)).orderBy(
        *descending("opportunity_score", ties=keys)
    )
