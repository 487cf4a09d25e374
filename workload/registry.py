"""Registered queries: each takes (spark, directory of the given tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from resona.functions.numbers import add_time_features, creator_scale, round_half_even
from resona.functions.text import clean_text, content_type, sections
from resona.operators import graph, topics
from resona.operators.medians import grouped_mode, split_medians
from resona.operators.nesting import ensure_video_id, explode_records, keyed_records, nested_to_json
from resona.operators.ranks import add_percent_ranks
from resona.plans import clusters, comments, core, creators, rollups, summaries, views
from resona.plans.build import write_core
from resona.session import cut, fresh_path, stored
from resona.sources.media import as_uri, media_flags
from resona.sources.schemas import POSTS_RAW
from resona.sources.tables import manifest, read_table, write_table

from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Round computed fractions, whose last digits depend on the order of addition."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def raw_posts(spark: SparkSession, d: str) -> DataFrame:
    return add_time_features(ensure_video_id(a.posts_raw(spark, d)))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return core.post_scalars(raw_posts(spark, d), a.URL_PREFIX).drop("first_supplier")


def stored_posts(spark: SparkSession, d: str) -> DataFrame:
    """The post records written once, as in the batch job, for tables that read them several times."""
    return stored(a.posts_raw(spark, d), "posts-raw")


def post_metrics(spark: SparkSession, d: str) -> DataFrame:
    raw = add_time_features(ensure_video_id(stored_posts(spark, d)))
    flat = core.post_scalars(raw, a.URL_PREFIX).drop("first_supplier")
    return core.build_post_metrics(flat, core.post_comments(raw), core.post_images(raw), core.post_hashtags(flat))


def labelled_summaries(spark: SparkSession, d: str) -> DataFrame:
    return summaries.label_summaries(a.summaries(spark, d), a.THEMES, a.MOODS, a.ACTIONS)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.enrich_posts(posts(spark, d).drop("download_count", "url"), labelled_summaries(spark, d))
    return stored(out, "enriched")  # read several times, as in the batch job


# --- posts ------------------------------------------------------------------------------------
def q_post_engagement(spark, d):
    return rounded(
        posts(spark, d).select(
            "video_id", "play_count", "digg_count", "comment_count", "share_count", "collect_count",
            "duration", "has_video", "eng_total", "eng_per_1k_views", "url",
        ),
        "eng_per_1k_views",
    )


def q_time_features(spark, d):
    return raw_posts(spark, d).select("video_id", F.unix_seconds("ts").alias("epoch"), "date", "month", "dow", "hour")


def q_scalar_columns(spark, d):
    raw = a.posts_raw(spark, d).drop("first_supplier")
    return raw.select(*core.scalar_columns(raw))


def q_flatten_struct(spark, d):
    raw = a.posts_raw(spark, d)
    author = core.flatten_struct(raw, ["video_id"], "author", "author_")
    music = core.flatten_struct(raw, ["video_id"], "music_info", "music_")
    commerce = core.flatten_struct(raw, ["video_id"], "commerce_info", "commerce_")
    return author.join(music, "video_id").join(commerce, "video_id")


def q_unify_ids(spark, d):
    orders = a.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("post_id"), "o_orderstatus"
    )
    return ensure_video_id(orders).select(F.col("id").cast("string").alias("id"), "video_id", "o_orderstatus")


def q_keyed_records(spark, d):
    events = a.table(spark, d, "events")
    record = F.struct(F.col("event_type").alias("kind"), F.floor("value").alias("amount"))
    mapped = events.select(F.create_map(F.col("event_id").cast("string"), record).alias("entries"))
    return keyed_records(mapped, "entries", "author_id")


def q_explode_comments(spark, d):
    return rounded(
        core.post_comments(raw_posts(spark, d)).select(
            "video_id", "comment_id", "text", "digg_count", "user_id", "user_region",
            F.unix_seconds("comment_ts").alias("comment_epoch"), "mins_since_post",
        ),
        "mins_since_post",
    )


def q_images_indexed(spark, d):
    return core.post_images(a.posts_raw(spark, d))


def q_hashtags(spark, d):
    return core.post_hashtags(a.posts_raw(spark, d))


def q_post_metrics(spark, d):
    return rounded(
        post_metrics(spark, d).select(
            "video_id", "eng_total", "n_hashtags", "n_images", "n_comments_captured", "avg_comment_diggs"
        ),
        "avg_comment_diggs",
    )


def q_json_export(spark, d):
    return nested_to_json(a.posts_raw(spark, d).select("video_id", "author", "images", "commerce_info"))


def q_csv_round_trip(spark, d):
    path = fresh_path(spark, "csv")
    pages = a.table(spark, d, "pages")
    write_table(pages, path, "csv")
    return read_table(spark, path, "csv", pages.schema, multi_line=True)


# --- authors and network ----------------------------------------------------------------------
def q_authors(spark, d):
    return core.flatten_authors(a.authors_raw(spark, d))


def q_author_metrics(spark, d):
    metrics = core.build_author_metrics(core.flatten_authors(a.authors_raw(spark, d)))
    return rounded(metrics, "avg_hearts_per_video", "hearts_per_follower", "videos_per_1k_followers")


def q_creator_scale(spark, d):
    authors = core.flatten_authors(a.authors_raw(spark, d))
    return authors.select("author_id", creator_scale(F.col("stats_followerCount").cast("double")).alias("creator_scale"))


def q_author_activity(spark, d):
    rows = core.author_activity(a.author_posts_raw(spark, d))
    return rounded(
        rows.select("author_id", "video_id", "month", "hour", "play_count", "share_count", "collect_count", "eng_total", "eng_per_1k_views", "has_video"),
        "eng_per_1k_views",
    )


def q_authorpost_metrics(spark, d):
    out = core.build_authorpost_metrics(core.author_activity(a.author_posts_raw(spark, d)))
    return rounded(out, *[c for c in out.columns if c.startswith("avg_")], "posts_per_month", "eng_per_1k_views_mean")


def q_network_edges(spark, d):
    return core.network_edges(a.followers_raw(spark, d), "follower")


def q_network_region_metrics(spark, d):
    return core.build_network_metrics(core.network_edges(a.followers_raw(spark, d), "follower"), "follower")


def q_creator_leverage(spark, d):
    raw = stored(a.posts_raw(spark, d).select("video_id", "author"), "posts-raw")
    out = creators.creator_leverage(
        core.flatten_struct(raw, ["video_id"], "author", "author_"),
        core.flatten_authors(a.authors_raw(spark, d)),
        core.build_authorpost_metrics(core.author_activity(a.author_posts_raw(spark, d))),
    )
    return rounded(out, "posts_per_month", "avg_play", "avg_share", "eng_per_1k_views_mean", "views_per_follower_history")


# --- graph ------------------------------------------------------------------------------------
def network(spark, d):
    """Suppliers with the nations that buy from them: centrality needs all pairs of vertices."""
    followers = core.network_edges(a.market_raw(spark, d), "follower")
    followings = core.network_edges(a.followings_raw(spark, d), "followed")
    return followers, followings


def whole_network(spark, d):
    """Every supplier with all its customers."""
    followers = core.network_edges(a.followers_raw(spark, d), "follower")
    return followers, core.network_edges(a.followings_raw(spark, d), "followed")


def q_graph_edges(spark, d):
    followers, followings = whole_network(spark, d)
    return graph.undirected_edges(
        followers.select("author_id", "follower_id"), followings.select("author_id", "followed_id")
    )


def q_graph_degree(spark, d):
    followers, followings = whole_network(spark, d)
    vertices, edges = creators.creator_graph(a.seeds(spark, d), followers, followings)
    joined = vertices.join(graph.degrees(edges), "id", "left")
    return joined.select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def q_connected_components(spark, d):
    lonely, links = a.places(spark, d)
    edges = cut(graph.undirected_edges(links))
    vertices = graph.vertices_of(edges, lonely)
    components = graph.connected_components(vertices, edges)
    return components.join(graph.component_sizes(components), "component_id")


def q_betweenness(spark, d):
    followers, followings = network(spark, d)
    vertices, edges = creators.creator_graph(a.seeds(spark, d), followers, followings)
    components = cut(graph.connected_components(vertices, edges))
    return rounded(graph.betweenness(vertices, edges, components), "betweenness", digits=9)


def q_creator_bridge(spark, d):
    followers, followings = network(spark, d)
    raw = stored(a.posts_raw(spark, d).drop("images", "comments"), "posts-raw")  # for the posts, their authors and the vertices
    metrics = core.post_scalars(add_time_features(ensure_video_id(raw)), a.URL_PREFIX).drop("first_supplier")
    out = creators.creator_bridge_metrics(a.seed_posts(raw), a.seeds(spark, d), followers, followings, metrics)
    return rounded(
        out.select(
            "video_id", "author_id", "network_degree", "network_betweenness", "component_id", "component_size",
            "component_nodes", "captured_followers", "captured_followings", "stats_followerCount", "bridge_score",
        ),
        "network_betweenness",
        digits=9,
    )


# --- rollups ----------------------------------------------------------------------------------
MEDIANS = ("median_views", "median_eng_per_1k")


def _top(name: str) -> Query:
    def query(spark, d):
        top = rollups.top_posts(posts(spark, d), min_views=1000, n=20)[name]
        return rounded(top.select("video_id", "play_count", "share_count", "eng_per_1k_views"), "eng_per_1k_views")

    return query


def q_region_performance(spark, d):
    return rounded(rollups.region_performance(posts(spark, d)), *MEDIANS)


def hashtag_table(spark, d):
    return rollups.hashtag_performance(posts(spark, d), core.post_hashtags(a.posts_raw(spark, d)))


def q_hashtag_performance(spark, d):
    return rounded(hashtag_table(spark, d), *MEDIANS, "mean_views")


def q_content_type_performance(spark, d):
    out = rollups.content_type_performance(posts(spark, d), a.summaries(spark, d))
    return rounded(out, *MEDIANS, "mean_shares", "mean_comments")


def q_theme_performance(spark, d):
    return rounded(rollups.theme_performance(enriched(spark, d)), *MEDIANS, "mean_shares", "mean_comments")


def q_messaging_recommendations(spark, d):
    out = rollups.messaging_recommendations(enriched(spark, d), min_views=1000)
    return rounded(out, *MEDIANS, "median_shares", "views_rank_pct", "eng_rank_pct", "share_rank_pct")


def q_min_views_fallback(spark, d):
    return rollups.with_enough_views(posts(spark, d), 1e12).select("video_id", "play_count")


def q_exact_medians(spark, d):
    out = split_medians(
        a.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"median_price": "l_extendedprice", "median_quantity": "l_quantity"}
    )
    return rounded(out, "median_price", "median_quantity")


def q_pct_rank_large(spark, d):
    lines = a.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    ranked = add_percent_ranks(lines, {"price_pct": "l_extendedprice", "quantity_pct": "l_quantity"})
    return rounded(ranked.drop("l_extendedprice", "l_quantity"), "price_pct", "quantity_pct", digits=9)


def q_top_label(spark, d):
    return grouped_mode(a.table(spark, d, "events"), ["user_id"], "event_type", "top_type", "top_count")


# --- texts ------------------------------------------------------------------------------------
def q_theme_labels(spark, d):
    return labelled_summaries(spark, d).select(
        "video_id", F.array_join("theme_labels", ", ").alias("theme_labels"), "primary_theme", "mood_label",
        "action_frame", "n_theme_labels",
    )


def q_default_rule_labels(spark, d):
    docs = comments.label_intents(summaries.label_summaries(a.summaries(spark, d)).withColumn("text", F.col("semantic_text")))
    scored = comments.score_sentiment(docs)
    return rounded(
        scored.select(
            "video_id", F.array_join("theme_labels", ", ").alias("theme_labels"), "mood_label", "action_frame",
            "rough_intent", "emotion_label", "sentiment_label", "sentiment_score",
        ),
        "sentiment_score",
    )


def summary_text():
    """A summary with all seven headings, made of a document's columns."""
    headings = ("1. The overall mood:", "2. NARRATIVE message:", "3. Key events:", "4. The storyline:", "5. Music track:", "6. Nature of the audio:", "7. Spoken content:")
    values = (F.concat("source", F.lit(" ")), "text", F.concat_ws(" and ", "lang", "source"), F.concat_ws(" ", "lang", "doc_id"), F.concat(F.lit("\ttune "), "doc_id"), "lang", F.col("doc_id").cast("string"))
    parts = [x for h, v in zip(headings, values) for x in (F.lit(f"\n**{h}**\n"), v)]
    return F.concat(F.lit("Summary."), *parts, F.lit("\n"))


SECTIONS = ("overall_mood_tone", "overall_narrative_message", "prominent_objects_actions", "description_storyline", "music_description", "audio_nature", "prominent_audio_content")


def q_section_extract(spark, d):
    docs = a.texts(spark, d, "documents")
    return docs.select("doc_id", *sections(summary_text())).select("doc_id", *SECTIONS)


def media_tree(spark, d) -> str:
    """Folders of captured files, one per document: written by the executors, some without a text or without any file."""
    root = as_uri(fresh_path(spark, "media"))
    files = F.filter(
        F.array(
            F.when(F.col("lang") != "es", "summary.txt"), F.when(F.col("lang") == "en", "video.mp4"), F.when(F.col("lang").isin("en", "fr"), "audio.mp3"),
            F.when(F.col("lang").isin("fr", "de"), "image_1.jpg"), F.when(F.col("lang") == "de", "image_2.jpg"),
        ),
        lambda x: x.isNotNull(),
    )
    text = F.when(F.col("doc_id") % 10 == 3, "").otherwise(summary_text())
    docs = a.texts(spark, d, "documents").select(F.concat(F.lit(f"{root}/"), "doc_id").alias("folder"), files.alias("files"), text.alias("text"))
    docs.mapInArrow(a.write_folders, "folder string").write.format("noop").mode("overwrite").save()
    return root


def q_summary_tables(spark, d):
    """Summaries read from folders: flags, sections, the text they make up, and its labels."""
    out = summaries.read_summaries(spark, media_tree(spark, d), themes=a.THEMES, moods=a.MOODS, actions=a.ACTIONS)
    return out.select(
        "video_id", "n_image_files", "has_local_video", "has_local_audio", "content_type", *SECTIONS, "semantic_text",
        F.array_join("theme_labels", ", ").alias("theme_labels"), "primary_theme", "mood_label", "action_frame", "n_theme_labels",
    )


def q_clean_text(spark, d):
    pages = a.texts(spark, d, "pages")
    text = F.concat_ws("\n\t", "url", "html", F.concat(F.lit("  see "), "url", F.lit(" or www.x.org/a  ")))
    return pages.select("page_id", clean_text(text).alias("clean"))


def q_media_flags(spark, d):
    docs = a.table(spark, d, "documents")
    files = F.array(
        F.lit("summary.txt"),
        F.when(F.col("lang") == "en", "video.mp4"),
        F.when(F.col("lang").isin("en", "fr"), "audio.mp3"),
        F.when(F.col("lang").isin("fr", "de"), "image_1.jpg"),
        F.when(F.col("lang") == "de", "image_2.jpg"),
    )
    paths = docs.select(F.explode(F.array_compact(files)).alias("file"), "doc_id").select(
        F.concat(F.lit("file:/media/"), "doc_id", F.lit("/"), "file").alias("path")
    )
    return media_flags(paths)


def q_posts_enriched(spark, d):
    out = summaries.enrich_posts(post_metrics(spark, d), labelled_summaries(spark, d))
    return out.select(
        "video_id", "n_hashtags", "content_type", "primary_theme", "mood_label", "action_frame", "n_theme_labels",
        F.array_join("theme_labels", ", ").alias("theme_labels"),
    )


# --- comments ---------------------------------------------------------------------------------
def q_comment_intent_summary(spark, d):
    labelled = comments.label_intents(a.event_comments(spark, d), {"buys": r"\b(purchase|signup)\b", "looks": r"\bview\b"})
    return rounded(comments.intent_summary(labelled), "avg_comment_likes", "median_mins_since_post")


def q_post_comment_intents(spark, d):
    labelled = comments.label_intents(a.event_comments(spark, d), {"buys": r"\b(purchase|signup)\b", "looks": r"\bview\b"})
    return rounded(comments.post_intents(labelled, a.event_pages(spark, d)), "avg_comment_likes")


def q_text_intents(spark, d):
    labelled = comments.label_intents(a.text_comments(spark, d), a.INTENTS)
    return labelled.select("comment_id", "rough_intent")


def scored(spark, d):
    return comments.score_sentiment(a.text_comments(spark, d), a.EMOTIONS, a.POSITIVE, a.NEGATIVE)


def q_sentiment_scores(spark, d):
    return rounded(
        scored(spark, d).select("video_id", "comment_id", "sentiment_label", "sentiment_score", "emotion_label"),
        "sentiment_score",
    )


def q_sentiment_summary(spark, d):
    return rounded(comments.sentiment_summary(scored(spark, d)), "avg_comment_likes")


def q_post_comment_sentiment(spark, d):
    out = comments.post_sentiment(scored(spark, d), a.event_pages(spark, d))
    return rounded(out, "avg_sentiment_score", "pct_positive", "pct_negative")


def q_raw_json_source(spark, d):
    """Post records written as JSON lines, some with other types, unknown fields or broken, read by the schema."""
    posts_ = a.posts_raw(spark, d).drop("first_supplier")
    line = F.to_json(F.struct("*"))
    number = F.col("video_id").cast("long")
    line = (
        F.when(number % 7 == 0, F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(', "unknown": {"a": [1]}}')))
        .when(number % 7 == 1, F.regexp_replace(line, '"play_count":"(\\d+)"', '"play_count":$1'))
        .when(number % 7 == 2, F.lit('{"video_id": "broken'))
        .otherwise(line)
    )
    path = fresh_path(spark, "posts-json")
    posts_.select(line.alias("value")).write.text(path)
    rows = read_table(spark, path, "json", POSTS_RAW)
    return rows.select(
        "video_id", "title", "play_count", F.col("author.id").alias("author_id"), F.col("commerce_info.adv_promotable").alias("promotable"),
        F.size("comments").alias("comments"), F.size(F.array_compact("images")).alias("images"), F.get("comments", F.lit(0))["user"]["id"].alias("first_user"),
    )


def q_records_and_parents(spark, d):
    """Records that have a parent's column: it fills in only where the parent has none."""
    orders = a.table(spark, d, "orders")
    record = F.struct(F.col("o_custkey").cast("string").alias("author_id"), F.col("o_totalprice").alias("price"))
    status = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("p"), "o_custkey")).alias("author_id")
    nested = orders.select("o_orderkey", status, F.array(record, F.lit(None), record).alias("records"))
    return explode_records(nested, "records", ["o_orderkey", "author_id"])


def q_single_cluster(spark, d):
    """Summaries of which one text at most is long enough for a cluster."""
    nations = a.table(spark, d, "nation")
    text = F.when(F.col("n_nationkey") == 7, F.concat_ws(" ", "n_name", "n_name", "n_name", "n_name", F.lit("of the world"))).otherwise(F.substring("n_name", 1, 9))
    posts_ = nations.select(F.col("n_nationkey").cast("string").alias("video_id"), text.alias("semantic_text"))
    metrics = nations.select(
        F.col("n_nationkey").cast("string").alias("video_id"), *[F.col("n_regionkey").cast("double").alias(c) for c in ("play_count", "eng_per_1k_views", "share_count", "comment_count")]
    )
    tables = clusters.semantic_clusters(posts_, metrics)
    return tables["semantic_clusters"].join(tables["semantic_cluster_performance"], ["cluster_id", "cluster_name"])


def q_emotion_pivot(spark, d):
    return comments.emotion_by_sentiment(comments.sentiment_summary(scored(spark, d)))


# --- topics -----------------------------------------------------------------------------------
def documents_with_terms(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", "text", "lang")
    return topics.add_terms(docs, "text", a.STOP_WORDS, doc="doc_id")


def q_tfidf_weights(spark, d):
    return rounded(topics.term_weights(documents_with_terms(spark, d), "doc_id"), "weight", digits=9)


def q_cluster_terms(spark, d):
    """Terms, name and representative of given groups of documents (their language)."""
    docs = a.table(spark, d, "documents")
    return clusters.describe_clusters(docs.select("doc_id", "text"), "text", docs.select("doc_id", "lang"), "doc_id", "lang", a.STOP_WORDS)


def semantic(spark, d):
    texts = a.summaries(spark, d).drop("lang")
    return clusters.semantic_clusters(texts, posts(spark, d))


def q_semantic_clusters(spark, d):
    return semantic(spark, d)["semantic_clusters"]


def q_semantic_cluster_checks(spark, d):
    """What holds for any clustering: documents kept, one representative per cluster, totals over all clusters."""
    tables = semantic(spark, d)
    found = stored(tables["semantic_clusters"].select("video_id", "cluster_id", "is_cluster_representative"), "clusters")
    kept = found.agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_distinct("video_id").alias("distinct_docs"),
        (F.count_if("is_cluster_representative") - F.count_distinct("cluster_id")).alias("surplus_representatives"),
    )
    sums = tables["semantic_cluster_performance"].agg(F.sum("posts").alias("posts"), F.sum("total_views").alias("total_views"))
    one = F.lit(1)
    return kept.withColumn("_one", one).join(sums.withColumn("_one", one), "_one").drop("_one")


def q_cluster_counts(spark, d):
    """Numbers of clusters for the documents of each language."""
    sizes = a.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    rows = []
    for lang, n in sizes:
        tried = topics.cluster_counts_to_try(n)
        rows.append((lang, n, topics.auto_cluster_count(n), len(tried), max(tried, default=0)))
    return spark.createDataFrame(rows, "lang string, n_docs long, clusters int, tried int, most int")


def q_cluster_text(spark, d):
    """Cleaned cluster texts of documents with two text columns."""
    docs = a.texts(spark, d, "documents").select("doc_id", F.col("text").alias("summary_text"), F.concat(F.lit(" see www.x.org/a "), "source").alias("title"))
    return docs.select("doc_id", clusters.cluster_text(docs).alias("cluster_text"))


def q_cluster_performance(spark, d):
    source = F.col("lang")
    given = a.summaries(spark, d).select("video_id", F.length(source).alias("cluster_id"), source.alias("cluster_name"))
    return rounded(clusters.cluster_performance(given, posts(spark, d)), *MEDIANS)


# --- reports ----------------------------------------------------------------------------------
def q_snapshot(spark, d):
    return rounded(views.snapshot(enriched(spark, d)), "eng_per_1k_views")


def q_totals(spark, d):
    return views.totals(post_metrics(spark, d), a.summaries(spark, d))


def q_message_frames(spark, d):
    return rounded(views.message_frames(rollups.theme_performance(enriched(spark, d))), "median_views")


def q_hashtags_multi_post(spark, d):
    return rounded(views.hashtags_of_several_posts(hashtag_table(spark, d)), *MEDIANS, "mean_views")


def q_rounding(spark, d):
    lines = a.table(spark, d, "lineitem")
    # Decimal halves that have no exact binary form, next to exact ones.
    return lines.select(
        "l_orderkey", "l_linenumber", round_half_even(F.col("l_quantity") / 2, 0).alias("half"),
        round_half_even(F.col("l_orderkey") / 16, 3).alias("part"),
        round_half_even((F.lit(2.0) * F.col("l_orderkey") + 1) / 2000.0, 3).alias("decimal_half"),
    )


def q_content_kind(spark, d):
    events = a.table(spark, d, "events")
    kind = content_type(F.col("event_type") == "view", F.col("event_type") == "click", F.col("value") > 20)
    return events.select("event_id", kind.alias("content_type"))


def q_manifest(spark, d):
    """Write the core tables of the given data and list them (without the run's own paths)."""
    raw = {
        "posts": a.posts_raw(spark, d).drop("first_supplier"),
        "authors": a.authors_raw(spark, d),
        "author_posts": a.author_posts_raw(spark, d),
        "author_favorites": a.author_posts_raw(spark, d),
        "author_followers": a.followers_raw(spark, d),
        "author_followings": a.followings_raw(spark, d),
    }
    _, written = write_core(spark, raw, fresh_path(spark, "core"), a.URL_PREFIX)
    return manifest(spark, written).drop("path")


def queries() -> Mapping[str, Query]:
    named = {name.removeprefix("q_"): fn for name, fn in globals().items() if name.startswith("q_")}
    named["top_posts_by_reach"] = _top("top_posts_by_reach")
    named["top_posts_by_engagement_efficiency"] = _top("top_posts_by_engagement_efficiency")
    named["top_posts_by_shares"] = _top("top_posts_by_shares")
    return named
