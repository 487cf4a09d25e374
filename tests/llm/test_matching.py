"""Similarity join, test items, repeated lines, fingerprints, mix and licences against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import components, contained, cosine, lz_phrases, removed_lines as plain_removed, water_filling
from samples import ordered
from pyspark.sql import functions as F

from resona.llm import shingle_join
from resona.llm.bitmaps import BITS, place
from resona.llm.decontamination import contained_items, decontaminated
from resona.llm.licenses import NOTICES, TEXTS as LICENCES, license_scan, rarity
from resona.llm.mixing import mix, mixed_words
from resona.llm.phrases import phrase_fingerprints
from resona.llm.repeated_lines import removed_lines, without_repeated_lines
from resona.llm.shingle_join import Bands, dealt_keys, meeting, one_of_each, prefixes, repeated_keys, shingle_links, similar_components, slice_keys
from resona.llm.shingles import shingle_set

TEXTS = "doc_id long, text string"


def near_copies():
    """Chains and stars of near copies, a group whose hub misses some, and small sets on the limit."""
    r = random.Random(11)
    rows, base = [], [f"b{i}" for i in range(150)]
    for i in range(60):
        text = [*base]
        for _ in range(r.randrange(0, 6)):
            text[r.randrange(150)] = f"e{r.randrange(30)}"
        rows.append((i, " ".join(text)))
    chain = [f"c{i}" for i in range(90)]
    for i in range(12):
        chain[7 * i] = f"step{i}"
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + i, " ".join(f"s{k}" for k in range(8 + i))) for i in range(8)]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_of_near_copies(spark, width, percent):
    rows = near_copies()
    wanted = sorted((i, *v) for (i, _), v in components(rows, width, percent).items())
    found = similar_components(spark.createDataFrame(rows, TEXTS).repartition(4), width, percent)
    assert ordered(found) == wanted


def test_components_of_odd_rows(docs, no_docs, rows):
    plain = components([(r[0], r[1]) for r in rows], 3, 90)
    found = similar_components(docs, 3, 90)
    wanted = [(i, *(plain[i, t] if i is not None else (None, None))) for i, t, *_ in rows]
    got = [(r[0], *r[1:]) if r[0] is not None else (None, None, None) for r in found.collect()]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert similar_components(no_docs, 3, 90).count() == 0


def test_one_of_each_keeps_the_lowest(docs, rows):
    plain = components([(r[0], r[1]) for r in rows], 5, 80)
    kept = one_of_each(docs, 5, 80)
    wanted = {(i, t) for (i, t), (_, c) in plain.items() if i == c} | {(None, rows[0][1]), (None, None)}
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(str(r) for r in docs.select("doc_id", "text").distinct().collect() if (r[0], r[1]) in wanted)


def test_bands_hold_all_partners():
    for percent in (80, 90):
        bands = Bands(percent, 3000)
        for a in range(1, 1500):
            for b in (a, 100 * a // percent):
                differ = (a + b) * (100 - percent) // (100 + percent)
                if differ and 100 * a >= percent * b:
                    shared = set(bands.cells(a)) & set(bands.cells(b))
                    assert any(m > differ + spare for _, m, spare in shared)


def test_no_group_is_expanded(spark):
    """300 near copies of one text: the pairs that are compared stay near the number of documents."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(300):
        text = [*base]
        text[r.randrange(300)] = f"e{i}"
        rows.append((i, " ".join(text)))
    _, _, links = shingle_links(spark.createDataFrame(rows, TEXTS), 3, 90)
    assert links.count() < 4 * len(rows)


def test_families_that_share_a_passage(spark, monkeypatch):
    """A family whose texts hold a passage of another one's hub: the pairs that are compared grow with the texts."""
    compared = []
    original = shingle_join.differences
    monkeypatch.setattr(shingle_join, "differences", lambda pairs, sets: compared.append(pairs.count()) or original(pairs, sets))
    passage = [f"p{i}" for i in range(300)]

    def rows_of(size):
        r = random.Random(3)
        rows = []
        for family in ("a", "b"):
            own = [f"{family}{i}" for i in range(200)]
            for i in range(size if family == "b" else size // 10):
                text = [*passage, *own]
                text[300 + r.randrange(200)] = f"{family}x{i}"
                rows.append((len(rows), " ".join(text)))
        return rows + [(1000 + i, rows[0][1]) for i in range(5)]  # copies make the first family's text the hub

    counts = []
    for size in (40, 160):
        compared.clear()
        rows = rows_of(size)
        wanted = sorted((i, *v) for (i, _), v in components(rows, 5, 80).items())
        assert ordered(similar_components(spark.createDataFrame(rows, TEXTS), 5, 80)) == wanted
        counts.append(sum(compared))
    assert counts[1] < 6 * counts[0] and counts[1] < 8 * 176


def test_keys_of_all_documents_are_not_stored(spark, monkeypatch):
    """Of documents without partners no key is stored or becomes a row, and what is moved takes less than a key and its row."""
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(400))) for i in range(200)]
    rows += [(300 + i, f"{rows[0][1]} more{i}") for i in range(3)] + [(400, rows[1][1])]
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    stored_rows = []

    class Spy(shingle_join.Scratch):
        def stored(self, df, name):
            out = super().stored(df, name)
            stored_rows.append((name, out.count()))
            return out

    monkeypatch.setattr(shingle_join, "Scratch", Spy)
    assert ordered(similar_components(docs, 5, 80)) == sorted((i, *v) for (i, _), v in components(rows, 5, 80).items())
    bands, keys = Bands(80, 4000), {}
    for i, text in rows[:-1]:
        keys[i] = [(least, set(k.tolist())) for _, least, k in slice_keys(shingle_set(text, 5), bands)]
    stored_rows = dict(reversed(stored_rows))  # the first of each name
    assert "set-keys" not in stored_rows and 0 < stored_rows["slices"] < 10 * max(len(k) for cells in keys.values() for _, k in cells)
    everyone = spark.sparkContext.broadcast(np.full(BITS // 8, 255, np.uint8))
    dealt = dealt_keys(spark.createDataFrame(rows[:-1], TEXTS).repartition(3), 5, 80, everyone).cache()
    found = {x.place for x in meeting(dealt).collect()}
    held = [k for cells in keys.values() for _, own in cells for k in own]
    often = {k for k, n in Counter(held).items() if n > 1}
    wanted = [i for i, cells in keys.items() if any(len(own & often) >= least for least, own in cells)]
    assert wanted == [0, 300, 301, 302]
    assert found == {x.at for x in spark.createDataFrame([(i,) for i in wanted], "i long").select(place(F.col("i")).alias("at")).collect()}
    moved = dealt.filter("first >= 0").agg(F.sum(F.length("owners") + F.length("keys"))).first()[0]
    assert 6 * len(held) < moved < 8 * len(held)


def test_rare_elements_come_first(spark):
    rows = [(1, i, 10 * i, 5, False, 4, [7, 8, 100 + i, 200 + i], 2) for i in range(40)] + [(2, 50, 1, 5, True, 2, [7, 300], 2), (2, 51, 1, 5, True, 0, [], 1)]
    given = spark.createDataFrame(rows, "hub long, node long, c long, n long, linked boolean, a int, differ array<long>, reach int").repartition(3)
    scratch = shingle_join.Scratch(spark)
    found = defaultdict(dict)
    for x in prefixes(given, scratch).collect():
        found[x.hub, x.node][x.r] = x.e
    assert all(set(found[1, i].values()) == {100 + i, 200 + i} and set(found[1, i]) == {0, 1} for i in range(40))
    assert set(found[2, 50].values()) == {7, 300} and (2, 51) not in found
    scratch.clear()


def test_similar_sets_share_enough_slices():
    r = np.random.default_rng(4)
    for percent in (80, 90):
        bands = Bands(percent, 4000)
        for size in (3, 7, 20, 90, 400, 2500):
            for _ in range(20):
                one = r.integers(0, 2**63, size).astype(np.uint64)
                differ = 2 * size * (100 - percent) // (100 + percent)
                gone = int(r.integers(0, differ + 1))
                new = r.integers(0, 2**63, int(r.integers(0, differ - gone + 1))).astype(np.uint64)
                two = np.unique(np.concatenate([one[gone:], new]))
                one = np.unique(one)
                union = len(np.union1d(one, two))
                if 100 * len(np.intersect1d(one, two)) < percent * union or len(np.setxor1d(one, two)) == 0:
                    continue
                cells = {c: (least, keys) for c, least, keys in slice_keys(one, bands)}
                both = [(least, keys, *cells[c]) for c, least, keys in slice_keys(two, bands) if c in cells]
                assert any(len(np.intersect1d(a, b)) >= max(x, y) for x, a, y, b in both)


def test_items_in_documents(spark, docs, no_docs, rows):
    r = random.Random(4)
    item = [f"i{k}" for k in range(40)]
    holed = [*item]
    holed[20] = "hole"
    long = [f"w{r.randrange(500)}" for _ in range(5000)]
    more = [(300, " ".join([*long, *item, *long])), (301, " ".join([*long[:50], *holed])), (302, " ".join(item[:25])), (303, "zig Zag zog")]
    extra = spark.createDataFrame(more, TEXTS)
    items = [(1, " ".join(item).upper()), (2, "zig zag"), (3, ""), (4, None), (5, "one"), (1, " ".join(item).upper()), (None, "one two")]
    table = spark.createDataFrame([(*i, "?") for i in items], "item_id long, text string, hash string")
    every = docs.select("doc_id", "text").unionByName(extra)
    wanted = contained([(r[0], r[1]) for r in rows] + more, [i for i in items if i[0] is not None])
    found = contained_items(every, table)
    assert {(300, 1), (301, 1), (303, 2)} <= wanted
    assert [tuple(r) for r in ordered(found, "doc_id", "item_id")] == sorted(wanted)
    left = decontaminated(docs, table)
    assert left.columns == docs.columns and left.count() == sum((r[0], 5) not in wanted and (r[0], 2) not in wanted for r in rows)
    assert contained_items(no_docs, table).count() == contained_items(docs, table.limit(0)).count() == 0


def test_removed_lines(spark, docs, no_docs, rows):
    r = random.Random(8)
    lines = [f"line {i} " + "word " * r.randrange(0, 6) for i in range(25)]
    more = [(400 + i, "\n".join(r.choice(["", *lines[k : k + 6]]) if r.random() < 0.3 else lines[(k + j) % 25] for j in range(r.randrange(1, 30)))) for i, k in enumerate(r.choices(range(20), k=40))]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, TEXTS)).filter("doc_id IS NOT NULL")
    plain = [(i, t) for i, t, *_ in rows if i is not None] + more
    wanted = plain_removed(plain, 12)
    found = removed_lines(every, 12)
    got = {(x["doc_id"], x["t"]): x["removed"] for x in found.collect()}
    hashed = {(x[0], x[1]): x[2] for x in every.select("doc_id", "text", F.xxhash64("text")).collect()}
    assert sum(map(bool, wanted.values())) > 10
    single = {k: v for k, v in wanted.items() if k[0] != 17}
    assert all(got[k[0], hashed[k]] == v for k, v in single.items())
    assert got[5, hashed[5, None]] == []
    assert removed_lines(no_docs, 12).count() == 0
    cleaned = {(x[0], x[1]) for x in without_repeated_lines(every, 12).select("doc_id", "text").collect()}
    for (i, text), gone in single.items():
        assert (i, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)) in cleaned
    assert without_repeated_lines(docs, 12).columns == docs.columns


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fingerprints(docs, rows, parts):
    ranked = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    wanted = []
    for k, (i, text) in enumerate(ranked):
        following, half = ranked[(k + 1) % len(ranked)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        wanted.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    found = phrase_fingerprints(docs, parts)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert ordered(found, "doc_id", "n_chars", "edited_sha256") == sorted(wanted, key=key)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and by_id[5]["fingerprint"] == by_id[6]["fingerprint"] == ""
    assert by_id[2]["near_next"] == 1.0  # the next one is its copy with another id
    exact = {i: lz_phrases(t) for i, t in ranked}
    for i, after in ((101, 100), (12, 11)):
        share = len(exact[i] & exact[after]) / len(exact[i] | exact[after])
        assert by_id[i]["near_next"] == pytest.approx(share, abs=0.12)


def test_fingerprints_of_few_rows(spark, no_docs):
    assert phrase_fingerprints(no_docs, 4).count() == 0
    one = phrase_fingerprints(spark.createDataFrame([(1, "abcdef")], TEXTS), 4).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdabc"[:3] + b"abc").hexdigest() and one["near_next"] == 1.0


def test_mix_meets_targets(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), s) for i, s in enumerate(r.choices(["a", "b", "c", "é", None], [50, 30, 5, 5, 10], k=3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in rows}
    for _, text, s in rows:
        sizes[s] += len(text.split())
    wanted, found = water_filling(sizes), mixed_words(docs).collect()
    for x in found:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(wanted[s])
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 40 for s in sizes)
    assert ordered(mixed_words(docs.repartition(2))) == ordered(mixed_words(docs))
    assert mix(docs).count() == sum(x["copies"] for x in found)


def test_mix_with_preferences(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b", 3.0 if i % 4 == 1 else 1.0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, liking double")
    found = mix(docs, preference="liking").filter("source = 'a'").groupBy("liking").count().collect()
    counts = {r[0]: r[1] for r in found}
    assert counts[3.0] / counts[1.0] == pytest.approx(3.0, rel=0.2)


def test_mix_of_odd_rows(docs, no_docs, rows):
    found = mixed_words(docs).collect()
    assert len(found) == len(rows) and {r["size"] for r in found if r["doc_id"] in (5, 6, 7)} == {0}
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert mixed_words(no_docs).count() == 0 and mix(docs).columns == docs.columns


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(None, f"w{i} w", "a") for i in range(1000)] + [(7, f"w{i} w", "b") for i in range(1000)] + [(7, "w w", "c")] * 1000 + [(None, "w w", "d")] * 1000
    rows += [(None, "w w", None)] * 1000
    docs = spark.createDataFrame(rows, TEXTS + ", source string").repartition(7)
    sizes = dict.fromkeys(["a", "b", "c", "d", None], 2000)
    taken = {r[0]: r[1] for r in mix(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect()}
    assert all(abs(taken[s] - wanted) <= 1 for s, wanted in water_filling(sizes).items())
    assert len(set(taken.values())) > 1
    found = ordered(mixed_words(docs))
    assert len(found) == len(rows) and ordered(mixed_words(docs.repartition(3))) == found


def test_one_of_each_with_several_texts_of_one_id(spark):
    a, b, c = ("".join(f" {stem}{i}" for i in range(40)) for stem in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (5, None), (9, b), (9, b), (12, c), (13, c), (13, a), (None, a)]
    kept = one_of_each(spark.createDataFrame(rows, TEXTS).repartition(3), 5, 80)
    assert ordered(kept, "doc_id", "text") == [(None, a), (1, a), (5, None), (5, b), (12, c)]


def test_licences(spark, docs, no_docs):
    notice = NOTICES[0][1]
    rows = [
        ("r/LICENSE", notice), ("r/a.py", "import x\n# " + notice + "\ny = 1 2 3"), ("r/b.py", "print"), ("r/s/t/c.py", None), ("r/s/LICENSE", NOTICES[5][1]),
        ("q/d.py", "Released software under pressure"), ("top", "text"), (None, notice), ("r/b.py", "again"), ("q/mit.txt", "Released under the MIT License"),
    ]
    found = {r[0]: (r[1], r[3]) for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {
        "r/LICENSE": ("Apache-2.0", "header"), "r/a.py": ("Apache-2.0", "header"), "r/b.py": ("Apache-2.0", "inherited"), "r/s/t/c.py": ("GPL-3.0", "inherited"),
        "r/s/LICENSE": ("GPL-3.0", "header"), "q/d.py": ("MIT", "inherited"), "top": (None, None), "q/mit.txt": ("MIT", "header"),
    }
    assert license_scan(no_docs.withColumn("path", F.lit("a/b"))).count() == 0


GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def commented(text, mark, first="", last=""):
    return first + "".join(f"{mark} {line}".rstrip() + "\n" for line in text.split("\n")) + last


def test_whole_licences_and_wrapped_headers(spark):
    whole = dict(LICENCES)
    bsd = whole["BSD-3-Clause"].replace("The Regents of the University of California", "2020 A. Person")
    code = "\nfrom x import y\nvalue = y(1)\n" * 20
    rows = [(f"{name}/LICENSE", text.replace("<year> <copyright holders>", "2021 B. Person")) for name, text in LICENCES]
    rows += [(f"{name}/src/plain.c", "int main() { return 0; }") for name, _ in LICENCES]
    rows += [
        ("h/a.py", "#!/usr/bin/env python\n" + commented("Copyright (C) 2020 C. Person\n" + GPL_HEADER, "#") + code),
        ("h/b.c", commented(GPL_HEADER, " *", "/* Copyright 2020 D. Person\n", " */\n#include <stdio.h>\n") + code),
        ("h/c.js", commented("Draws things.\n\n" + bsd, "//") + code), ("h/d.sql", commented(whole["BSD-2-Clause"], "--") + code),
        ("h/e.html", "<!--\n" + whole["MIT"] + "-->\n<p>text</p>"), ("h/f.c", "/* MIT here */\n\n" + commented(whole["MIT"], " *", "/*\n", " */\n") + code),
        ("h/g.py", "# SPDX-License-Identifier: GPL-3.0-or-later\n" + code), ("h/h.c", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */\n" + code),
        ("h/i.py", "# Free software is software under terms of a license.\n" + code), ("h/j.py", code + commented("Not a header\n" + GPL_HEADER, "#")),
        ("h/k.py", "# one\n" * 20000),
        ("h/l.py", "/* never closed" + code), ("m/m.py", commented(GPL_HEADER, "#").rstrip("\n")),
    ]
    found = {r[0]: (r[1], r[3]) for r in license_scan(spark.createDataFrame(rows, "path string, text string").repartition(3)).collect()}
    for name, _ in LICENCES:
        assert found[f"{name}/LICENSE"][0] == name
        assert found[f"{name}/src/plain.c"] == (name, "inherited")
    assert found["GPL-3.0/LICENSE"] == ("GPL-3.0", "file") and found["m/m.py"] == ("GPL-3.0", "header")
    assert {p: v for p, v in found.items() if p.startswith("h/")} == {
        "h/a.py": ("GPL-3.0", "header"), "h/b.c": ("GPL-3.0", "header"), "h/c.js": ("BSD-3-Clause", "header"), "h/d.sql": ("BSD-2-Clause", "header"),
        "h/e.html": ("MIT", "header"), "h/f.c": ("MIT", "header"), "h/g.py": ("GPL-3.0", "header"), "h/h.c": ("MIT OR Apache-2.0", "header"),
        "h/i.py": (None, None), "h/j.py": (None, None), "h/k.py": (None, None), "h/l.py": (None, None),
    }


def test_licence_cosines(spark):
    texts = [n for _, n in NOTICES] + ["some version of the work", "licensed", "under the MIT License released here", "plain text", "GNU GNU GNU Public"]
    files = spark.createDataFrame([(f"d{i}/f", t) for i, t in enumerate(texts)], "path string, text string")
    held = defaultdict(int)
    import re

    for t in texts:
        for term in set(re.findall(r"[^\W_]+", t.lower())):
            held[term] += 1
    vocabulary = {x for _, n in NOTICES for x in re.findall(r"[^\W_]+", n.lower())}
    idf, unseen = {x: rarity(len(texts), held[x]) for x in vocabulary}, rarity(len(texts), 0)
    for row in license_scan(files).collect():
        best = max(cosine(texts[int(row["path"][1:-2])], n, idf, unseen) for _, n in NOTICES)
        assert (row["cosine"] is not None) == (best >= 0.5 - 1e-9)
        if row["cosine"] is not None:
            assert row["cosine"] == pytest.approx(best, abs=1e-6)


def test_keys_are_not_counted_before_they_are_moved(spark):
    """Nearly all are alone, and tables of all of a task's keys took 302 MB a task."""
    keys = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 3, 3, None, None)], "key long")
    found = repeated_keys(keys)
    assert sorted((r.key for r in found.collect()), key=lambda k: (k is None, k)) == [2, 3, None]
    lines = repeated_keys(keys)._jdf.queryExecution().sparkPlan().toString().splitlines() + found._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert moved and not any("HashAggregate" in line for line in lines[moved[-1] :])
