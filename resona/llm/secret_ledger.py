"""Secret scans that read every blob once per rule version, native.

A text is a blob, addressed by its SHA-256, whatever paths and versions hold it. The ledger is a Parquet folder with a row
per blob and scan: which (rule, version) pairs were tried and which spans they found. A scan

1. addresses all given texts and counts each address (narrow rows only),
2. finds the addresses that are new to the ledger, or were not seen by some of today's rules,
3. scans each of them once, for the missing rules only, and appends what it found to the ledger,
4. joins the findings back to all rows by address.

Texts that occur once and are new are scanned where they lie. The others are told by a bitmap of fixed size; only those
are shuffled, one text per address and task, and joined with the ledger. A full bitmap costs work, no result.

A ledger row carries both the pairs and their spans, so a scan that was cut short leaves a true ledger: the next one goes on.

* A null text counts as empty. Repeated rows and equal texts of several rows each get the same spans. An empty table gives
  no rows and leaves the ledger as it is. Null keys are kept. Other columns are not read, whatever they are called.
* Spans are code points, end exclusive. Matches of a rule do not overlap, leftmost first; those of two rules may.
* Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.skew import lookup
from ..session import fresh_path
from .frames import cut, stored

SPANS = "array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters. A changed pattern is a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of 24 hex digits at least is the same as a run that has 24 at least; likewise for the access keys, as a shorter one
# holds no other. An assignment with a short value may hide another one, so its length is tested afterwards.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url", r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D/:@]{1,100}:[^\x20\x09-\x0D/:@]{1,100}@"),
)


def spans_of(rule: Rule, text: Column) -> Column:
    """Spans of a rule in a text. The pieces between the matches are what ``split`` leaves, so lengths give the places."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    step = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("met"), values.alias("value"))
    # The last piece has no match behind it.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def walk(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["gap"])
        last = first + F.length(x["met"])
        span = F.array(F.struct(F.lit(rule.name).alias("rule"), first.alias("start"), last.alias("end")))
        kept = F.when(F.length(x["value"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(F.coalesce(last, first).alias("at"), kept.alias("spans"))

    found = F.aggregate(step, start, walk, lambda state: state["spans"])
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(SPANS))


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


class SecretLedger:
    """What was scanned and found, kept in the Parquet folder ``path`` (shared by all executors)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """blob, pairs (names of the rules tried), spans; a blob may have several rows."""
        schema = f"blob string, pairs array<string>, spans {SPANS}"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scan(self, texts: DataFrame, counted: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Scan what is unseen of ``texts`` (blob, text) and append it; ``counted`` has the blobs and how often they occur."""
        names = [r.name for r in rules]
        known = self.rows().select("blob", F.explode("pairs").alias("pair")).filter(F.col("pair").isin(names))
        # Kept, as the ledger is appended to below.
        tried = cut(known.join(counted, "blob", "left_semi").groupBy("blob").agg(F.collect_set("pair").alias("tried")))
        finished = tried.filter(F.size("tried") == len(rules)).select("blob")
        unfinished = counted.select("blob").join(finished, "blob", "left_anti")
        special = counted.filter("n > 1").select("blob").unionByName(tried.select("blob"))

        marked = with_bit(with_bit(texts, special, "special"), unfinished, "unfinished").filter("unfinished")
        none_tried = F.array().cast("array<string>")
        plain = marked.filter("NOT special").select("blob", "text", none_tried.alias("tried"))
        # One text per blob: partly done before the shuffle, so many copies arrive as one row per task.
        doubtful = marked.filter("special").groupBy("blob").agg(F.first("text").alias("text")).join(tried, "blob", "left")
        doubtful = doubtful.withColumn("tried", F.coalesce("tried", none_tried))
        for part in (plain, doubtful):
            missing = [F.when(~F.array_contains("tried", r.name), F.lit(r.name)) for r in rules]
            spans = [F.when(F.array_contains("tried", r.name), F.array().cast(SPANS)).otherwise(spans_of(r, F.col("text"))) for r in rules]
            todo = part.withColumn("pairs", F.filter(F.array(*missing), lambda x: x.isNotNull())).filter(F.size("pairs") > 0)
            todo.select("blob", "pairs", F.concat(*spans).alias("spans")).write.mode("append").parquet(self.path)

    def found(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, spans) of all blobs in which the given rules found something."""
        names = [r.name for r in rules]
        current = self.rows().select("blob", F.filter("spans", lambda s: s["rule"].isin(names)).alias("spans")).filter(F.size("spans") > 0)
        return current.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


# A bitmap of 2^26 bits is cut into 2,048 pieces of 4,096 bytes: never more than 8 MB.
BITS = 1 << 26


def place(blob: Column) -> Column:
    return F.pmod(F.xxhash64(blob), F.lit(BITS)) + 1


def bucket(blob: Column) -> Column:
    return F.bitmap_bucket_number(place(blob))


def bitmap(blobs: DataFrame) -> DataFrame:
    """(bucket, bits): 2,048 rows at most, whatever the data."""
    return blobs.groupBy(bucket(F.col("blob")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(F.col("blob")))).alias("bits"))


def with_bit(rows: DataFrame, blobs: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column that is false only for blobs that are not among ``blobs``."""
    bits = bitmap(blobs).select(F.col("bucket").alias(f"{name}_bucket"), F.col("bits").alias(f"{name}_bits"))
    joined = rows.join(F.broadcast(bits), bucket(F.col("blob")) == F.col(f"{name}_bucket"), "left")
    position = F.bitmap_bit_position(place(F.col("blob"))).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod(position, F.lit(8))) == 1
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop(f"{name}_bucket", f"{name}_bits")


def secret_spans(
    rows: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, ledger: SecretLedger | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, spans): every row's spans by start, then in the order of ``rules``. Without a ledger, a new one is begun."""
    spark = rows.sparkSession
    ledger = ledger or SecretLedger(spark, fresh_path(spark, "secret-ledger"))
    plain = rows.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    addressed = plain.withColumn("blob", blob_of(F.col("text")))
    versions = stored(addressed.select("key", "blob"), "versions")
    counted = stored(versions.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), "blobs")
    ledger.scan(addressed.select("blob", "text"), counted, rules)
    order = F.array(*[F.lit(r.name) for r in rules])
    sorted_spans = F.transform(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("place"), s.alias("span")))),
        lambda x: F.struct(F.substring_index(x["span"]["rule"], "@", 1).alias("kind"), x["span"]["start"].alias("start"), x["span"]["end"].alias("end")),
    )
    found = ledger.found(rules).join(counted, "blob").select("blob", sorted_spans.alias("spans"), "n")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    joined = lookup(versions, stored(found, "found-secrets"), "blob", weight="n")
    return joined.select(F.col("key").alias(key), F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(rows: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans, per row of ``rows``."""
    found = secret_spans(rows)

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(listed(of(*[r.kind for r in BASE])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
