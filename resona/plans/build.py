"""The batch job: raw records and summaries in, core and analytics tables and a manifest out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..session import stored
from ..sources.tables import WrittenTable, manifest, read_table, write_table, write_tables
from .clusters import semantic_clusters
from .comments import comment_intent_tables, comment_sentiment_tables
from .core import base_tables, derived_tables
from .creators import creator_bridge_metrics, creator_leverage
from .rollups import (
    content_type_performance,
    hashtag_performance,
    messaging_recommendations,
    region_performance,
    theme_performance,
    top_posts,
)
from .summaries import enrich_posts


def write_core(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    root: str,
    url_prefix: str,
    summaries: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], list[WrittenTable]]:
    """Write the core tables as Parquet and return them read back, so nothing is computed twice.

    The post records, which feed seven tables, are first turned into columns once; each table then
    reads only its own. Tables derived from others start from those as written.
    """
    written: list[WrittenTable] = []
    core: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> None:
        path = f"{root.rstrip('/')}/{name}.parquet"
        rows, cols = write_table(df, path)
        written.append(WrittenTable(name, "core", rows, cols, path))
        core[name] = read_table(spark, path, schema=df.schema)

    columnar = {**raw, "posts": stored(raw["posts"], "posts-raw")}
    for name, df in base_tables(columnar, url_prefix).items():
        keep(name, df)
    for name, df in derived_tables(core).items():
        keep(name, df)
    if summaries is not None:
        keep("posts_summaries", summaries)
        keep("posts_enriched", enrich_posts(core["post_metrics"], core["posts_summaries"]))
    return core, written


def insight_tables(core: Mapping[str, DataFrame], min_views: float = 1000, error: float | None = None) -> dict[str, DataFrame]:
    metrics = core["post_metrics"]
    tables = {
        **top_posts(metrics, min_views=min_views),
        "region_performance": region_performance(metrics),
        "hashtag_performance": hashtag_performance(metrics, core["posts_hashtags"]),
        **comment_intent_tables(core["posts_comments"], metrics),
        "creator_leverage": creator_leverage(
            core["posts_author"], core["authors"], core["authorpost_metrics"]
        ),
        "creator_bridge_metrics": creator_bridge_metrics(
            core["posts_author"], core["authors"], core["authorfollowers"], core["authorfollowings"], metrics,
            error=error,
        ),
    }
    if "posts_summaries" in core:
        tables["content_type_performance"] = content_type_performance(metrics, core["posts_summaries"])
        tables["theme_performance"] = theme_performance(core["posts_enriched"])
        tables["messaging_recommendations"] = messaging_recommendations(core["posts_enriched"], min_views)
    return tables


def text_tables(core: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The deeper reading of texts: narrative clusters and comment sentiment."""
    tables = comment_sentiment_tables(core["posts_comments"], core["post_metrics"])
    if "posts_summaries" in core:
        tables.update(semantic_clusters(core["posts_summaries"], core["post_metrics"]))
    return tables


def run(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    out: str,
    url_prefix: str,
    summaries: DataFrame | None = None,
    min_views: float = 1000,
    error: float | None = None,
    with_text: bool = True,
) -> DataFrame:
    """Build everything below ``out`` and return the manifest (core and insight tables)."""
    out = out.rstrip("/")
    core, written = write_core(spark, raw, f"{out}/core", url_prefix, summaries)
    written += write_tables(
        insight_tables(core, min_views, error), f"{out}/analytics", "analytics", "csv", arrays_as_text=("theme_labels",)
    )
    if with_text:
        write_tables(text_tables(core), f"{out}/analytics", "analytics", "csv", arrays_as_text=("theme_labels",))
    listing = manifest(spark, written)
    write_table(listing.coalesce(1), f"{out}/manifest.csv", "csv")
    return listing
