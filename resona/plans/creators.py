"""Creators: reach relative to audience, and their place in the follower graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import creator_scale, number, number_or_null, ratio, round_half_even
from ..functions.rulesets import BRIDGE_WEIGHTS
from ..operators.graph import (
    betweenness,
    betweenness_estimate,
    connected_components,
    component_sizes,
    degrees,
    undirected_edges,
    vertices_of,
)
from ..operators.nesting import keep_present
from ..operators.ranks import add_percent_ranks
from ..operators.skew import lookup
from ..session import cut
from .rollups import descending

# --- fixed values: columns of the public tables, in their order
LEVERAGE_COLUMNS = (
    "video_id",
    "author_id",
    "author_unique_id",
    "author_nickname",
    "creator_scale",
    "stats_followerCount",
    "stats_heartCount",
    "posts_total",
    "active_months",
    "posts_per_month",
    "avg_play",
    "avg_share",
    "eng_per_1k_views_mean",
    "views_per_follower_history",
)
PROFILE_COLUMNS = (
    "author_id",
    "user_uniqueId",
    "user_nickname",
    "stats_followerCount",
    "stats_heartCount",
    "stats_videoCount",
)


def creator_leverage(
    posts_author: DataFrame, authors: DataFrame, authorpost_metrics: DataFrame
) -> DataFrame:
    """Posts with their creator's size class and historic plays per follower.

    Profile and history have one row per author; they are joined with each other first, so the
    posts (of which one author may hold many) are joined once.
    """
    profile = keep_present(authors, PROFILE_COLUMNS)
    history = authorpost_metrics.select(
        "author_id", *[c for c in authorpost_metrics.columns if c not in profile.columns]
    )
    known = profile.join(history, "author_id", "full_outer")
    known = known.select("author_id", *[c for c in known.columns if c not in posts_author.columns])
    out = lookup(posts_author, known, "author_id")
    followers = number_or_null(F.col("stats_followerCount")) if "stats_followerCount" in out.columns else F.lit(None).cast("double")
    plays = number(F.col("avg_play")) if "avg_play" in out.columns else F.lit(0.0)
    out = out.withColumns(
        {"views_per_follower_history": ratio(plays, followers), "creator_scale": creator_scale(followers)}
    )
    return keep_present(out, LEVERAGE_COLUMNS).orderBy(
        *descending("views_per_follower_history", ties=["author_id", "video_id"])
    )


def creator_graph(
    posts_author: DataFrame, followers: DataFrame, followings: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Vertices and undirected edges of the seeds' follower and following lists."""
    edges = undirected_edges(
        followers.select("author_id", "follower_id"), followings.select("author_id", "followed_id")
    )
    edges = cut(edges)
    return cut(vertices_of(edges, posts_author.select("author_id"))), edges


def creator_bridge_metrics(
    posts_author: DataFrame,
    authors: DataFrame,
    followers: DataFrame,
    followings: DataFrame,
    post_metrics: DataFrame,
    error: float | None = None,
) -> DataFrame:
    """Posts with their creator's degree, betweenness and component, and a blended bridge score.

    With ``error`` the betweenness is an estimate within that error (of values from 0 to 1), else exact.
    """
    vertices, edges = creator_graph(posts_author, followers, followings)
    components = cut(connected_components(vertices, edges))
    if error is None:
        central = betweenness(vertices, edges, components)
    else:
        central = betweenness_estimate(vertices, edges, components, error)

    author = F.col("author_id").cast("string")
    base = posts_author.select(
        "video_id", author.alias("author_id"), *[c for c in ("author_unique_id", "author_nickname") if c in posts_author.columns]
    )
    # All values of an author side by side, one row per author, before the posts come in.
    seeds = base.select("author_id").filter("author_id IS NOT NULL").distinct()

    def counted(edges_of: DataFrame, name: str) -> DataFrame:
        return edges_of.groupBy(author.alias("author_id")).agg(F.count(F.lit(1)).alias(name))

    facts = (
        seeds.join(degrees(edges).withColumnRenamed("id", "author_id"), "author_id", "left")
        .join(central.withColumnRenamed("id", "author_id"), "author_id", "left")
        .join(components.withColumnRenamed("id", "author_id"), "author_id", "left")
        .join(counted(followers, "captured_followers"), "author_id", "left")
        .join(counted(followings, "captured_followings"), "author_id", "left")
        .join(keep_present(authors, ("author_id", "stats_followerCount", "stats_heartCount", "stats_videoCount")), "author_id", "left")
    )
    nodes = component_sizes(components)
    posts_of = base.groupBy("author_id").agg(F.count(F.lit(1)).alias("_posts"))
    posts_of = posts_of.join(components.withColumnRenamed("id", "author_id"), "author_id")
    posts_of = posts_of.groupBy("component_id").agg(F.sum("_posts").alias("component_size"))
    sized = nodes.join(posts_of, "component_id", "left")
    facts = lookup(facts, sized, "component_id").select(
        "author_id",
        F.coalesce("degree", F.lit(0)).alias("network_degree"),
        F.coalesce("betweenness", F.lit(0.0)).alias("network_betweenness"),
        "component_id",
        F.coalesce("component_size", F.lit(1)).alias("component_size"),
        "component_nodes",
        F.coalesce("captured_followers", F.lit(0)).alias("captured_followers"),
        F.coalesce("captured_followings", F.lit(0)).alias("captured_followings"),
        *[c for c in facts.columns if c.startswith("stats_")],
    )
    out = lookup(base, facts, "author_id")
    out = out.fillna({"network_degree": 0, "network_betweenness": 0.0, "component_size": 1, "captured_followers": 0, "captured_followings": 0})
    kept = keep_present(post_metrics, ("video_id", "play_count", "share_count", "comment_count", "eng_per_1k_views"))
    if "video_id" in kept.columns:
        out = out.join(kept, "video_id", "left")

    def given(name: str):
        return F.col(name) if name in out.columns else F.lit(0.0)

    scored = cut(
        out.withColumns(
            {
                "_engagement": number_or_null(given("eng_per_1k_views")),
                "_followers": F.log1p(number(given("stats_followerCount"))),
            }
        )
    )
    ranks = {
        "betweenness": "network_betweenness",
        "degree": "network_degree",
        "engagement": "_engagement",
        "followers": "_followers",
    }
    ranked = add_percent_ranks(scored, {f"_{k}_rank": v for k, v in ranks.items()})
    score = F.lit(0.0)
    for name, weight in BRIDGE_WEIGHTS.items():
        score = score + F.coalesce(f"_{name}_rank", F.lit(0.0)) * weight
    return (
        ranked.withColumn("bridge_score", round_half_even(score))
        .select(*out.columns, "bridge_score")
        .orderBy(*descending("bridge_score", "network_betweenness", ties=["author_id", "video_id"]))
    )
