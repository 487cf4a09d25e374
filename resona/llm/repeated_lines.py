"""Removal of repeated line runs by prefix doubling over line-id sequences.

Lines get order-preserving ids. In round k every suffix of a document's line sequence that occurs again with its
first 2^k lines gets a rank among those; the ranks of round k + 1 come from pairs of ranks 2^k lines apart, sorted over
the whole cluster. Suffixes with equal ranks form an interval of common prefix 2^k or more, and two overlapping
ranks of one round tell the intervals of any length between. A run that reaches the least number of words and
lies in an interval with an earlier occurrence is a later copy; its lines go. Shortest such windows, taken from
every line forwards and backwards, cover exactly the maximal repeated runs of that many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import stored

LEAST_WORDS = 50
DOC = ["d", "t"]


def line_sequences(docs: DataFrame) -> DataFrame:
    """Per distinct (id, text): ``d, t, u`` (id and two hashes of the text), ``n_lines, words`` and ``lines`` with a word.

    A line with a word has its place ``i`` in the text, a hash ``h`` and its number of words ``w``.
    """
    text = F.col("text")
    words = r"[^\x20\x09-\x0D]+"
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(i.alias("i"), F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(words)).alias("w")),
    )
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"), lines.alias("all"),
    ).filter(text.isNotNull())
    kept = F.filter("all", lambda x: x.w > 0)
    total = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x.w)
    return rows.select(*DOC, "u", F.size("all").alias("n_lines"), total.alias("words"), kept.alias("lines"))


def ranked(names: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct names with a rank that rises with their order, from a sort over the whole cluster."""
    ordered = names.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def suffix_ranks(suffixes: DataFrame, longest: int) -> DataFrame:
    """``d, t, p, k, r``: rank of each suffix among those whose first 2^k lines occur again, up to 2^k <= ``longest``."""
    names = suffixes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    current = suffixes.join(ranked(names, ["h"]), "h").select(*DOC, "p", F.col("rank").alias("r"))
    current = stored(current, "suffixes")
    rounds, k = current.withColumn("k", F.lit(0)), 0
    while 2 << k <= longest:
        step = 1 << k
        ahead = Window.partitionBy(*DOC).orderBy("p").rangeBetween(step, step)
        pairs = current.withColumn("s", F.first("r").over(ahead)).filter("s IS NOT NULL")
        pairs = stored(pairs, "suffix-pairs")
        names = pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("r", "s")
        k += 1
        current = pairs.join(ranked(names, ["r", "s"]), ["r", "s"]).select(*DOC, "p", F.col("rank").alias("r"))
        current = stored(current, "suffixes")
        if current.isEmpty():
            break
        rounds = rounds.unionByName(current.withColumn("k", F.lit(k)))
    return rounds


def shortest_windows(lines: DataFrame, least_words: int) -> DataFrame:
    """``d, t, p, size``: from every line forwards and backwards, the fewest lines with ``least_words`` words."""
    own = Window.partitionBy(*DOC)
    upto = F.sum("w").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = lines.withColumn("c", upto).withColumn("s", F.col("c") - F.col("w"))
    onward = own.orderBy("s").rangeBetween(0, least_words - 1)
    back = own.orderBy("c").rangeBetween(-(least_words - 1), 0)
    placed = placed.select(
        *DOC, "p",
        F.count(F.lit(1)).over(onward).alias("f"), (F.max("c").over(onward) - F.col("s")).alias("f_words"),
        F.count(F.lit(1)).over(back).alias("b"), (F.col("c") - F.min("s").over(back)).alias("b_words"),
    )
    both = F.array_compact(
        F.array(
            F.when(F.col("f_words") >= least_words, F.struct(F.col("p").alias("p"), F.col("f").cast("int").alias("size"))),
            F.when(F.col("b_words") >= least_words, F.struct((F.col("p") - F.col("b") + 1).cast("int").alias("p"), F.col("b").cast("int").alias("size"))),
        )
    )
    return placed.select(*DOC, F.inline(F.array_distinct(both)))


def later_windows(windows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Windows that have an earlier occurrence, by document and place."""
    level = (F.length(F.bin("size")) - 1).cast("int")  # the largest power of two within
    windows = windows.withColumn("k", level)
    second = F.col("p") + F.col("size") - F.expr("shiftleft(1, k)")
    first_rank = ranks.select(*DOC, "p", "k", F.col("r").alias("first"))
    second_rank = ranks.select(*DOC, F.col("p").alias("q"), "k", F.col("r").alias("second"))
    met = windows.join(first_rank, [*DOC, "p", "k"]).withColumn("q", second.cast("int")).join(second_rank, [*DOC, "q", "k"])
    met = stored(met.select(*DOC, "p", "size", "first", "second").distinct(), "line-windows")
    interval = ["size", "first", "second"]
    spot: Column = F.struct("d", "t", "p")
    earliest = met.groupBy(*interval).agg(F.min(spot).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return met.join(earliest, interval).filter(spot > F.col("earliest")).select(*DOC, "p", "size")


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, t, n_lines, n_removed, removed_words, removed)`` per distinct row: which lines of it are later copies.

    Removed are the lines of every run of lines with at least ``least_words`` words that occurs at an earlier
    place, places being ordered by ``doc_id`` and line. Lines without a word are no part of a run and stay. ``removed``
    lists the line numbers from 0, ``t`` is xxhash64 of the text. A null text has 0 lines, an empty one 1; nulls among ids come first. Rows
    equal in id and text are one document; of rows with one id and different texts the lower ``t`` comes first. An
    empty table gives an empty one; further columns are ignored.
    """
    base = stored(line_sequences(docs), "line-sequences").distinct()
    # Equal texts: every run of a copy occurs in the first, so only that one goes into the rounds.
    firsts = base.groupBy("t", "u").agg(F.min("d").alias("first_d"))
    marked = stored(base.join(firsts, ["t", "u"]).withColumn("is_first", F.col("d") == F.col("first_d")), "line-copies")
    lines = marked.filter("is_first").select(*DOC, F.posexplode("lines").alias("p", "x")).select(*DOC, "p", "x.i", "x.h", "x.w")
    lines = stored(lines, "lines")
    ranks = suffix_ranks(lines.select(*DOC, "p", "h"), least_words)
    later = later_windows(shortest_windows(lines.select(*DOC, "p", "w"), least_words), ranks)
    ends = later.groupBy(*DOC, "p").agg(F.max(F.col("p") + F.col("size")).alias("end"))
    reach = F.max("end").over(Window.partitionBy(*DOC).orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    affected = lines.join(ends.select(*DOC).distinct(), DOC, "left_semi")
    covered = affected.select(*DOC, "p", "i", "w").join(ends, [*DOC, "p"], "left").withColumn("reach", reach).filter("reach > p")
    of_first = covered.groupBy(*DOC).agg(F.sort_array(F.collect_list("i")).alias("gone"), F.sum("w").alias("gone_words"))
    whole = ~F.col("is_first") & (F.col("words") >= least_words)
    out = marked.join(of_first, DOC, "left")
    gone = F.when(whole, F.transform("lines", lambda x: x.i)).when(F.col("is_first"), F.col("gone"))
    gone = F.coalesce(gone, F.array().cast("array<int>"))
    words = F.when(whole, F.col("words")).when(F.col("is_first"), F.coalesce("gone_words", F.lit(0))).otherwise(0)
    # A copy too short to go as a whole holds no run that is long enough.
    out = out.select(*DOC, "n_lines", F.size(gone).alias("n_removed"), words.cast("long").alias("removed_words"), gone.alias("removed"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").isNull().alias("none")).distinct()
    keys = keys.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found = keys.filter("NOT none").join(out, DOC).select("doc_id", *out.columns[1:])
    empty = keys.filter("none").select("doc_id", "t", F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed"), F.lit(0).cast("long").alias("removed_words"), F.array().cast("array<int>").alias("removed"))
    return found.unionByName(empty)


def without_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text``."""
    gone = removed_lines(docs, least_words).filter("n_removed > 0").select(F.col("doc_id").alias("id"), F.col("t").alias("hash"), "removed")
    rows = docs.select(F.struct("*").alias("row"))  # one column, so that no name can clash
    met = rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("hash")), "left")
    kept = F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains(F.col("removed"), i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return met.select(F.col("row").withField("text", text).alias("row")).select("row.*")
