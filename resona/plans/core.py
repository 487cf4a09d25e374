"""Core tables: posts, authors, author activity and network, normalised from nested records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import (
    add_engagement,
    add_time_features,
    coerce_numeric,
    epoch_timestamp,
    has_video,
    minutes_between,
    number,
    ratio,
)
from ..functions.rulesets import COUNT_COLUMNS
from ..functions.text import hashtags
from ..operators.medians import total
from ..operators.nesting import (
    cast_ids,
    distinct_pairs,
    ensure_video_id,
    explode_records,
    explode_values,
    flatten_struct,
    scalar_columns,
)

STATS_COLUMNS = (
    "stats_followingCount",
    "stats_followerCount",
    "stats_heartCount",
    "stats_videoCount",
    "stats_diggCount",
)
NETWORK_FIELDS = {
    "id": ("id",),
    "unique_id": ("unique_id", "uniqueId"),
    "nickname": ("nickname",),
    "region": ("region",),
}


# --- posts ------------------------------------------------------------------------------------
def post_scalars(raw: DataFrame, url_prefix: str) -> DataFrame:
    """Scalar columns of each post with coerced counters, time features and engagement."""
    posts = raw.select(*scalar_columns(raw))
    posts = coerce_numeric(posts, [*COUNT_COLUMNS, "duration", "download_count"])
    posts = add_engagement(posts.withColumn("has_video", has_video(posts)))
    return posts.withColumn("url", F.concat(F.lit(url_prefix), F.col("video_id")))


def post_comments(raw: DataFrame) -> DataFrame:
    """One row per comment. The post's time travels along, so no join back to the posts is needed."""
    comments = explode_records(raw.withColumnRenamed("ts", "_post_ts"), "comments", ["video_id", "_post_ts"])
    if "id" in comments.columns:
        comments = comments.withColumnRenamed("id", "comment_id")
    if "digg_count" in comments.columns:
        comments = comments.withColumn("digg_count", number(F.col("digg_count")))
    if "create_time" in comments.columns:
        comments = comments.withColumn("comment_ts", epoch_timestamp(F.col("create_time")))
    if {"comment_ts", "_post_ts"} <= set(comments.columns):
        comments = comments.withColumn("mins_since_post", minutes_between(F.col("comment_ts"), F.col("_post_ts")))
    return comments.withColumnRenamed("_post_ts", "ts")


def post_images(raw: DataFrame) -> DataFrame:
    return explode_values(raw, "images", ["video_id"], "image_url", "image_idx")


def post_hashtags(posts: DataFrame) -> DataFrame:
    tagged = posts.select("video_id", F.explode(F.array_distinct(hashtags(F.col("title")))).alias("hashtag"))
    return distinct_pairs(tagged, "video_id", "hashtag")


def build_post_metrics(
    posts: DataFrame, comments: DataFrame, images: DataFrame, tags: DataFrame
) -> DataFrame:
    """Posts with the number of captured hashtags, images and comments and the mean comment likes.

    The three sources are counted in one grouping by post, joined back once. Posts have a row per id, so no key is hot.
    """
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    likes = number(F.col("digg_count")) if "digg_count" in comments.columns else F.lit(0.0)
    captured = None
    for source, flags in ((tags, (one, zero, zero)), (images, (zero, one, zero)), (comments, (zero, zero, one))):
        part = source.select(
            "video_id",
            flags[0].alias("n_hashtags"),
            flags[1].alias("n_images"),
            flags[2].alias("n_comments_captured"),
            (likes if source is comments else F.lit(0.0)).alias("_likes"),
        )
        captured = part if captured is None else captured.unionByName(part)
    counts = ("n_hashtags", "n_images", "n_comments_captured")
    per_post = (
        captured.filter("video_id IS NOT NULL")
        .groupBy("video_id")
        .agg(*[F.sum(c).alias(c) for c in counts], F.sum("_likes").alias("_likes"))
    )
    out = posts.join(per_post, "video_id", "left")
    out = out.select(*posts.columns, *counts, "_likes")
    out = out.withColumns({c: F.coalesce(F.col(c), zero) for c in counts})
    mean_likes = ratio(F.col("_likes"), F.col("n_comments_captured").cast("double"))
    return out.withColumn("avg_comment_diggs", mean_likes).drop("_likes")


def post_tables(raw: DataFrame, url_prefix: str) -> dict[str, DataFrame]:
    """The tables that come straight from the post records."""
    raw = add_time_features(cast_ids(ensure_video_id(raw)))
    posts = post_scalars(raw, url_prefix)
    return {
        "posts": posts,
        "posts_author": flatten_struct(raw, ["video_id"], "author", "author_"),
        "posts_music": flatten_struct(raw, ["video_id"], "music_info", "music_"),
        "posts_commerce": flatten_struct(raw, ["video_id"], "commerce_info", "commerce_"),
        "posts_comments": post_comments(raw),
        "posts_images": post_images(raw),
        "posts_hashtags": post_hashtags(posts),
    }


def normalize_posts(raw: DataFrame, url_prefix: str) -> dict[str, DataFrame]:
    tables = post_tables(raw, url_prefix)
    parts = (tables[f"posts{suffix}"] for suffix in ("", "_comments", "_images", "_hashtags"))
    return {**tables, "post_metrics": build_post_metrics(*parts)}


# --- authors ----------------------------------------------------------------------------------
def flatten_authors(raw: DataFrame) -> DataFrame:
    """Author id with the flattened ``user`` and ``stats`` records of the same row."""
    raw = cast_ids(raw)
    both = flatten_struct(raw, ["author_id", "stats"] if "stats" in raw.columns else ["author_id"], "user", "user_")
    return flatten_struct(both, [c for c in both.columns if c != "stats"], "stats", "stats_")


def build_author_metrics(authors: DataFrame) -> DataFrame:
    present = [c for c in STATS_COLUMNS if c in authors.columns]
    out = coerce_numeric(authors.select("author_id", *present), present)

    def stat(name: str):
        return F.col(name) if name in present else F.lit(0.0)

    followers, videos, hearts = (stat(f"stats_{n}Count") for n in ("follower", "video", "heart"))
    return out.withColumns(
        {
            "avg_hearts_per_video": ratio(hearts, videos),
            "hearts_per_follower": ratio(hearts, followers),
            "videos_per_1k_followers": ratio(F.lit(1000.0) * videos, followers),
        }
    )


def normalize_authors(raw: DataFrame) -> dict[str, DataFrame]:
    authors = flatten_authors(raw)
    return {"authors": authors, "author_metrics": build_author_metrics(authors)}


# --- author activity --------------------------------------------------------------------------
def author_activity(raw: DataFrame) -> DataFrame:
    """One row per (author, post of the author's list) with time features and engagement."""
    rows = cast_ids(ensure_video_id(explode_records(cast_ids(raw), "record", ["author_id"])))
    rows = coerce_numeric(add_time_features(rows), [*COUNT_COLUMNS, "duration"])
    if "play_count" not in rows.columns:
        return rows
    rows = add_engagement(rows)
    return rows.withColumn("has_video", has_video(rows))


def build_authorpost_metrics(activity: DataFrame) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("posts_total")]
    if "month" in activity.columns:
        aggregates.append(F.count_distinct("month").alias("active_months"))
    for column in COUNT_COLUMNS:
        if column in activity.columns:
            name = column.removesuffix("_count")
            aggregates += [total(column).alias(f"sum_{name}"), F.avg(column).alias(f"avg_{name}")]
    if "eng_per_1k_views" in activity.columns:
        aggregates.append(F.avg("eng_per_1k_views").alias("eng_per_1k_views_mean"))
    out = activity.groupBy("author_id").agg(*aggregates)
    if "active_months" not in out.columns:
        return out
    rate = ratio(F.col("posts_total").cast("double"), F.col("active_months").cast("double"))
    return out.withColumn("posts_per_month", rate)


# --- network ----------------------------------------------------------------------------------
def network_edges(raw: DataFrame, entity: str) -> DataFrame:
    """One row per listed account, its fields prefixed by ``entity``."""
    rows = explode_records(cast_ids(raw), "record", ["author_id"])
    columns = []
    for field, alternates in NETWORK_FIELDS.items():
        found = [F.col(a) for a in alternates if a in rows.columns]
        if found:
            value = F.coalesce(*found)
            columns.append((value.cast("string") if field == "id" else value).alias(f"{entity}_{field}"))
    return rows.select("author_id", *columns)


def build_network_metrics(edges: DataFrame, entity: str) -> DataFrame:
    """Per author: accounts captured, distinct regions, most frequent region and its count.

    Accounts are first counted per (author, region), so that an author with very many accounts
    arrives at the second step as one row per region.
    """
    region = f"{entity}_region"
    counted = (
        edges.filter("author_id IS NOT NULL")
        .groupBy("author_id", region)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    named = F.col(region).isNotNull()
    best = F.min_by(F.when(named, F.col(region)), F.when(named, F.struct(-F.col("_n"), F.col(region))))
    return counted.groupBy("author_id").agg(
        F.sum("_n").alias("captured"),
        F.count(region).alias("distinct_regions"),
        best.alias("top_region"),
        F.max(F.when(named, F.col("_n"))).alias("top_region_count"),
    )


def normalize_network(name: str, raw: DataFrame, entity: str) -> dict[str, DataFrame]:
    edges = network_edges(raw, entity)
    tables = {name: edges}
    if f"{entity}_region" in edges.columns:
        tables[f"{name}_metrics"] = build_network_metrics(edges, entity)
    return tables


# --- all together -----------------------------------------------------------------------------
def base_tables(raw: Mapping[str, DataFrame], url_prefix: str) -> dict[str, DataFrame]:
    """Tables read off the raw records row by row."""
    return {
        **post_tables(raw["posts"], url_prefix),
        "authors": flatten_authors(raw["authors"]),
        "authorposts": author_activity(raw["author_posts"]),
        "authorfavorites": author_activity(raw["author_favorites"]),
        "authorfollowers": network_edges(raw["author_followers"], "follower"),
        "authorfollowings": network_edges(raw["author_followings"], "followed"),
    }


def derived_tables(base: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables computed from the base tables, as lazy DataFrames."""
    tables = {
        "post_metrics": build_post_metrics(
            base["posts"], base["posts_comments"], base["posts_images"], base["posts_hashtags"]
        ),
        "author_metrics": build_author_metrics(base["authors"]),
        "authorpost_metrics": build_authorpost_metrics(base["authorposts"]),
    }
    for name, entity in (("authorfollowers", "follower"), ("authorfollowings", "followed")):
        if f"{entity}_region" in base[name].columns:
            tables[f"{name}_metrics"] = build_network_metrics(base[name], entity)
    return tables


def build_core_tables(raw: Mapping[str, DataFrame], url_prefix: str) -> dict[str, DataFrame]:
    """All core tables but the summaries, as lazy DataFrames."""
    base = base_tables(raw, url_prefix)
    return {**base, **derived_tables(base)}
