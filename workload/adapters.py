"""The given tables, seen as posts, comments, authors and follower lists.

Counters and epochs are turned into text, with some unreadable values, because coercing them is
part of what the queries check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from resona.functions.numbers import minutes_between
from resona.operators.skew import lookup
from resona.sources.media import opened
from resona.sources.tables import fill_cores

URL_PREFIX = "https://video.example/post/"

# Rules over function words, which the prose of the given documents does contain.
THEMES = {
    "definite": r"\b(the|le|la|der|die|das|el|los)\b",
    "joining": r"\b(and|et|und|y)\b",
    "relating": r"\b(of|de|von|with|avec|mit|con)\b",
    "being": r"\b(is|est|ist|es|was|are)\b",
}
MOODS = {"calm": r"\b(un|une|ein|eine|una)\b", "busy": r"\b(by|par|pour|for|por)\b", "odd": r"\b(é\w*|è\w*)\b"}
ACTIONS = {"asking": r"\b(que|qui|was|wh\w+)\b|\?", "telling": r"\b(the|la)\b"}
INTENTS = {"asks": r"\?", "points": r"\b(the|la|das)\b", "adds": r"\b(and|et|und|y)\b"}
EMOTIONS = {"warm": r"\b(le|el|der)\b", "cold": r"\b(of|de|von)\b", "open": r"\b(is|est|ist)\b|!"}
POSITIVE = ("the", "la", "und", "is", "el")
NEGATIVE = ("of", "de", "der", "by", "en")
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "as", "by", "on", "with", "was", "are", "this",
    "le", "la", "les", "des", "et", "un", "une", "que", "qui", "en", "dans", "pour",
    "der", "die", "das", "und", "ein", "eine", "mit", "von", "ist",
    "el", "los", "las", "de", "con", "por", "una", "es",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each."""
    return fill_cores(table(spark, sf_dir, name))


def _epoch_text(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp")).cast("string")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey)


def posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested post records; each of their lines is a comment and an image."""
    line = F.struct("l_linenumber", "l_shipdate", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.min("l_suppkey").alias("first_supplier"),
        F.sort_array(F.collect_list(line)).alias("items"),  # the lines of one order
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = orders.join(customers(spark, sf_dir), "c_custkey", "left")
    joined = joined.join(lines, joined.o_orderkey == lines.l_orderkey, "left")
    joined = joined.withColumns({"video_id": F.col("o_orderkey").cast("string"), "region": F.col("n_name")})
    items = F.coalesce("items", F.array().cast(lines.schema["items"].dataType))

    def comment(item: Column, i: Column) -> Column:
        return F.struct(
            F.concat_ws("-", "video_id", i.cast("string")).alias("id"),
            F.concat(item["l_returnflag"], item["l_linestatus"]).alias("text"),
            _epoch_text(item["l_shipdate"]).alias("create_time"),
            item["l_quantity"].cast("string").alias("digg_count"),
            F.struct(item["l_suppkey"].cast("string").alias("id"), F.col("region").alias("region")).alias("user"),
        )

    def image(item: Column) -> Column:
        """The day of the line; lines with a high discount have none."""
        return F.when(item["l_discount"] <= 0.08, F.date_format(item["l_shipdate"], "yyyy-MM-dd"))

    return joined.select(
        "video_id",
        F.concat(F.lit("#"), "c_mktsegment", F.lit(" #"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" "), "o_orderpriority").alias("title"),
        "region",
        F.lit("0").alias("download_count"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(_epoch_text(F.col("o_orderdate"))).alias("create_time"),
        F.when(F.col("o_orderstatus") == "F", "0").otherwise("15").alias("duration"),
        F.when(F.col("o_orderpriority").startswith("4"), "n/a")
        .otherwise(F.floor("o_totalprice").cast("string")).alias("play_count"),
        F.col("quantity").cast("string").alias("digg_count"),
        F.col("lines").cast("string").alias("comment_count"),
        F.col("returned").cast("string").alias("share_count"),
        F.col("discounted").cast("string").alias("collect_count"),
        F.struct(
            F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("unique_id"), F.col("c_mktsegment").alias("nickname")
        ).alias("author"),
        F.struct(F.col("o_orderstatus").alias("id"), F.col("o_orderpriority").alias("title")).alias("music_info"),
        F.struct((F.col("o_orderstatus") == "O").alias("adv_promotable")).alias("commerce_info"),
        F.transform(items, image).alias("images"),
        F.transform(items, comment).alias("comments"),
        "first_supplier",
    )


def authors_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as author records; followers spread over all size classes."""
    customer = table(spark, sf_dir, "customer")
    balance = F.floor(F.abs("c_acctbal"))
    kind = F.col("c_custkey") % 4
    scale = F.when(kind == 0, 0).when(kind == 1, 1).when(kind == 2, 10).otherwise(1000)
    return customer.select(
        F.col("c_custkey").cast("string").alias("author_id"),
        F.struct(F.col("c_name").alias("uniqueId"), F.col("c_mktsegment").alias("nickname")).alias("user"),
        F.struct(
            F.col("c_nationkey").cast("long").alias("followingCount"),
            (balance * scale).alias("followerCount"),
            (balance + 7).alias("heartCount"),
            (F.col("c_custkey") % 5).alias("videoCount"),
            F.col("c_nationkey").cast("long").alias("diggCount"),
        ).alias("stats"),
    )


def author_posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of their customer's list, one entry per row, with a null among them."""
    orders = table(spark, sf_dir, "orders")
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        _epoch_text(F.col("o_orderdate")).alias("create_time"),
        F.when(F.col("o_orderstatus") == "F", "0").otherwise("15").alias("duration"),
        F.floor("o_totalprice").cast("string").alias("play_count"),
        F.length("o_orderpriority").cast("string").alias("digg_count"),
        F.lit("1").alias("comment_count"),
        F.when(F.col("o_orderstatus") == "O", "2").alias("share_count"),
        F.lit("x").alias("collect_count"),
    )
    return orders.select(
        F.col("o_custkey").cast("string").alias("author_id"), F.array(record, F.lit(None)).alias("record")
    )


def event_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comments on their user's page, timed from the user's first event."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("video_id"),
        F.col("event_id").cast("string").alias("comment_id"),
        F.col("event_type").alias("text"),
        F.floor("value").cast("double").alias("digg_count"),
        F.col("ts").cast("timestamp").alias("comment_ts"),
    )
    first = events.groupBy("video_id").agg(F.min("comment_ts").alias("ts"))
    timed = lookup(events, first, "video_id")
    return timed.withColumn("mins_since_post", minutes_between(F.col("comment_ts"), F.col("ts")))


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event user, with counters from its events."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("video_id")).agg(
        F.count(F.lit(1)).cast("double").alias("play_count"),
        F.count_if(F.col("event_type") == "purchase").cast("double").alias("share_count"),
    )


def text_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as comments without time."""
    return texts(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"),
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("comment_id"),
        "text",
        F.col("turn").cast("double").alias("digg_count"),
        F.lit(None).cast("double").alias("mins_since_post"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summary texts; doc ids meet order keys as post ids."""
    source = F.col("source")
    return texts(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("video_id"),
        source.alias("content_type"),
        F.col("text").alias("semantic_text"),
        "lang",
    )


def write_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Make the folder of each row ``(folder, files, text)``; its summary holds the text, other files a letter."""
    for batch in batches:
        for row in batch.to_pylist():
            store, folder = opened(row["folder"])
            store.create_dir(folder, recursive=True)
            for name in row["files"]:
                with store.open_output_stream(f"{folder}/{name}") as file:
                    file.write((row["text"] or "").encode() if name == "summary.txt" else b"x")
        yield pa.record_batch([batch.column("folder")], ["folder"])


# --- follower graph ---------------------------------------------------------------------------
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seed creators."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("author_id"), F.floor(F.abs("s_acctbal")).alias("stats_followerCount")
    )


def _account() -> Column:
    return F.struct(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.col("c_name").alias("unique_id"),
        F.col("c_mktsegment").alias("nickname"),
        F.col("n_name").alias("region"),
    )


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct pair of supplier and buyer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey")
    return lines.select("l_suppkey", "c_custkey").distinct()


def _of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customers(spark, sf_dir)
    return people.select(F.concat(F.lit("n"), "c_nationkey").alias("author_id"), F.array(_account()).alias("record"))


def followers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer follows every supplier it buys from, and its nation."""
    met = lookup(_bought(spark, sf_dir), customers(spark, sf_dir), "c_custkey")
    of_supplier = met.select(F.concat(F.lit("s"), "l_suppkey").alias("author_id"), F.array(_account()).alias("record"))
    return of_supplier.unionByName(_of_nation(spark, sf_dir))


def market_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is followed by every nation that buys from it, a nation by its customers.

    All lines count, but the graph stays small: centrality needs all pairs of its vertices.
    """
    # The buyer's nation comes to its orders first: so the lines meet one table, and few pairs are left of them before any move.
    people = customers(spark, sf_dir).select("c_custkey", "c_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = lines.join(orders.join(people, "c_custkey"), "l_orderkey").select("l_suppkey", "c_nationkey", "n_name").distinct()
    nation = F.struct(
        F.concat(F.lit("n"), "c_nationkey").alias("id"), F.col("n_name").alias("unique_id"), F.lit("nation").alias("nickname"), F.col("n_name").alias("region")
    )
    of_supplier = pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("author_id"), F.array(nation).alias("record"))
    return of_supplier.unionByName(_of_nation(spark, sf_dir))


def followings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier follows its nation."""
    account = F.struct(F.concat(F.lit("n"), "s_nationkey").alias("id"), F.lit(None).cast("string").alias("region"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("author_id"), F.array(account, F.lit(None)).alias("record")
    )


def seed_posts(raw: DataFrame) -> DataFrame:
    """Post records as posts of the first of their suppliers; those without lines count for supplier 0."""
    author = F.concat(F.lit("s"), F.coalesce("first_supplier", F.lit(0).cast("long")).cast("string"))
    return raw.select("video_id", author.alias("author_id"), author.alias("author_unique_id"), F.col("region").alias("author_nickname"))


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers linked to their nation, nations to their region: one tree per region."""
    nation = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")
    )
    people = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b")
    )
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return parts, nation.unionByName(people).unionByName(suppliers)
