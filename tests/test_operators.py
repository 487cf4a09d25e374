"""Distributed operators against plain Python on small inputs."""

import itertools
import random
import re
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import records
from pyspark.sql import functions as F

from resona.operators import graph, kmeans, nesting, topics
from resona.operators.medians import grouped_mode, split_medians, summarise
from resona.operators.ranks import add_percent_ranks, add_percent_ranks_of_groups
from resona.operators.skew import hot_keys, lookup
from resona.plans import clusters
from resona.session import Scratch


# --- medians, modes, ranks --------------------------------------------------------------------
@pytest.fixture(scope="module")
def measured():
    rng = np.random.default_rng(7)
    n = 6000
    group = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 50, n).astype(str))
    frame = pd.DataFrame({"g": group, "x": np.round(rng.lognormal(3, 2, n), 2), "y": rng.integers(0, 5, n) * 1.0})
    frame.loc[rng.random(n) < 0.1, "x"] = np.nan
    frame.loc[rng.random(n) < 0.05, "g"] = None
    frame.loc[frame.g == "7", "y"] = np.nan
    return frame


def to_spark(spark, frame, schema):
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def test_split_medians_match_pandas(spark, measured):
    df = to_spark(spark, measured, "g STRING, x DOUBLE, y DOUBLE")
    got = {r.g: (r.mx, r.my) for r in split_medians(df, ["g"], {"mx": "x", "my": "y"}).collect()}
    expected = measured.groupby("g", dropna=False)[["x", "y"]].median()
    assert len(got) == len(expected)
    for key, row in expected.iterrows():
        mine = got[None if pd.isna(key) else key]
        for a, b in zip(mine, row):
            assert (a is None and pd.isna(b)) or a == pytest.approx(b, abs=1e-12)


def test_summarise(spark, measured):
    df = to_spark(spark, measured, "g STRING, x DOUBLE, y DOUBLE")
    out = summarise(df, ["g"], [F.count(F.lit(1)).alias("n")], {"m": "x"})
    expected = measured.groupby("g", dropna=False).agg(n=("x", "size"), m=("x", "median"))
    got = {r.g: (r.n, r.m) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {None if pd.isna(k) else k: n for k, n in expected.n.items()}
    for key, m in expected.m.items():
        assert got[None if pd.isna(key) else key][1] == pytest.approx(m)


def test_summarise_of_empty_input(spark):
    df = spark.createDataFrame([], "g STRING, x DOUBLE")
    assert summarise(df, ["g"], [F.count(F.lit(1)).alias("n")], {"m": "x"}).count() == 0


def test_percent_ranks_match_pandas(spark, measured):
    frame = measured.assign(i=range(len(measured)))
    df = to_spark(spark, frame, "g STRING, x DOUBLE, y DOUBLE, i INT")
    out = add_percent_ranks(df, {"px": "x", "py": "y"}).toPandas().sort_values("i").reset_index(drop=True)
    assert np.allclose(out.px, frame.x.rank(pct=True), equal_nan=True)
    assert np.allclose(out.py, frame.y.rank(pct=True), equal_nan=True)


@pytest.mark.parametrize("method", [add_percent_ranks, add_percent_ranks_of_groups])
def test_percent_rank_golden(spark, method):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (4.0,)], "v DOUBLE")
    out = method(df, {"p": "v"})
    assert records(out, "v", "p") == [(None, None), (1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (4.0, 1.0)]


def test_grouped_mode(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "x"), ("b", None), ("b", None)], "k STRING, l STRING")
    assert records(grouped_mode(df, ["k"], "l", "top", "n")) == [("a", "x", 1), ("b", "x", 1)]


# --- joins ------------------------------------------------------------------------------------
@pytest.mark.parametrize("weighted", [False, True])
def test_lookup_keeps_every_row_with_hot_null_and_missing_keys(spark, weighted):
    rng = random.Random(3)
    keys = ["hot"] * 900 + ["gone"] * 400 + [None] * 500 + [f"k{rng.randrange(700)}" for _ in range(900)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i INT, k STRING")
    values = {k: f"v-{k}" for k in set(keys) if k not in (None, "gone")}
    right = spark.createDataFrame([(k, v, keys.count(k)) for k, v in values.items()], "k STRING, v STRING, n INT")
    out = lookup(left, right, "k", weight="n") if weighted else lookup(left, right.drop("n"), "k")
    assert out.columns == ["i", "k", "v"]
    assert sorted((r.i, r.k, r.v) for r in out.collect()) == [(i, k, values.get(k)) for i, k in enumerate(keys)]


def test_hot_keys_are_bounded_and_found(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    found = [r.k for r in hot_keys(df, "k", 32).collect()]
    assert -1 in found and len(found) <= 32


# --- nesting ----------------------------------------------------------------------------------
def test_ids_take_the_first_present_column(spark):
    df = spark.createDataFrame([(1, 2, None)], "id INT, aweme_id INT, post_id INT")
    assert nesting.ensure_video_id(df).first().video_id is None
    assert nesting.ensure_video_id(df.drop("post_id")).first().video_id == "2"
    assert "video_id" not in nesting.ensure_video_id(df.select(F.col("id").alias("x"))).columns


def test_records_and_parents(spark):
    df = spark.createDataFrame(
        [("1", [("9", ("u", 1)), None]), ("2", []), ("3", None), (None, [("8", None)])],
        "video_id STRING, r ARRAY<STRUCT<video_id: STRING, user: STRUCT<id: STRING, n: INT>>>",
    )
    out = nesting.explode_records(df, "r", ["video_id"])
    assert out.columns == ["video_id", "user_id", "user_n"]
    assert records(out) == [("1", "u", 1), ("8", None, None)]
    assert nesting.explode_records(df, "absent", ["video_id"]).columns == ["video_id"]
    assert nesting.flatten_struct(df, ["video_id"], "absent", "x_").columns == ["video_id"]


def test_json_export_keeps_null_fields(spark):
    df = spark.sql("SELECT named_struct('a', 'é', 'b', CAST(NULL AS INT)) s, array(1, 2) l, map('k', 'v') m, 3 n, array('x', 'y') t")
    row = nesting.nested_to_json(df, ["t"]).first()
    assert tuple(row) == ('{"a":"é","b":null}', "[1,2]", '{"k":"v"}', 3, "x, y")


# --- graph ------------------------------------------------------------------------------------
def brute_betweenness(nodes, edges):
    neighbours = defaultdict(set)
    for a, b in edges:
        if a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    distance, paths = {}, {}
    for s in nodes:
        dist, count, queue = {s: 0}, defaultdict(float), deque([s])
        count[s] = 1
        while queue:
            v = queue.popleft()
            for w in neighbours[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        distance[s], paths[s] = dist, count
    for s, t in itertools.permutations(nodes, 2):
        if t not in distance[s]:
            continue
        for v in nodes:
            if v not in (s, t) and v in distance[s] and t in distance[v] and distance[s][v] + distance[v][t] == distance[s][t]:
                score[v] += paths[s][v] * paths[v][t] / paths[s][t]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


def random_graph(seed):
    rng = random.Random(seed)
    nodes = [f"v{i:02d}" for i in range(rng.randrange(3, 26))]
    edges = {tuple(sorted(rng.choices(nodes, k=2))) for _ in range(rng.randrange(0, 40))}
    hub = nodes[0]
    edges |= {tuple(sorted((hub, f"leaf{i}"))) for i in range(rng.randrange(0, 6))}
    nodes = sorted(set(nodes) | {x for e in edges for x in e})
    return nodes, sorted(edges)


def brute_components(nodes, edges):
    label = {v: v for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


@pytest.mark.parametrize("seed,batch,few", [(1, 10**6, 10**6), (2, 300, -1)])
def test_graph_matches_brute_force(spark, monkeypatch, seed, batch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    nodes, links = random_graph(seed)
    edges = graph.undirected_edges(spark.createDataFrame(links + links[:2], "a STRING, b STRING"))
    vertices = graph.vertices_of(edges, spark.createDataFrame([(v,) for v in nodes], "id STRING"))
    assert vertices.count() == len(nodes)
    degree = {r.id: r.degree for r in graph.degrees(edges).collect()}
    assert degree == {v: d for v in nodes if (d := sum((a == v) + (b == v) for a, b in links))}
    components = graph.connected_components(vertices, edges)
    assert {r.id: r.component_id for r in components.collect()} == brute_components(nodes, links)
    got = {r.id: r.betweenness for r in graph.betweenness(vertices, edges, components, batch_pairs=batch).collect()}
    expected = brute_betweenness(nodes, links)
    assert got.keys() == expected.keys()
    assert all(got[v] == pytest.approx(expected[v], abs=1e-9) for v in nodes)


def test_hub_edges_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_PART", 2)
    nodes, links = random_graph(2)
    links = sorted(set(links) | {tuple(sorted((nodes[0], v))) for v in nodes[1:12]})
    edges = graph.undirected_edges(spark.createDataFrame(links, "a STRING, b STRING"))
    vertices = graph.vertices_of(edges, spark.createDataFrame([(v,) for v in nodes], "id STRING"))
    components = graph.connected_components(vertices, edges)
    got = {r.id: r.betweenness for r in graph.betweenness(vertices, edges, components).collect()}
    assert got == pytest.approx(brute_betweenness(nodes, links), abs=1e-9)


@pytest.mark.parametrize("links", [[("a", "b")], [("a", "a")], [("a", "b"), ("c", "d"), ("d", "e")]])
def test_tiny_graphs(spark, links):
    edges = graph.undirected_edges(spark.createDataFrame(links, "a STRING, b STRING"))
    vertices = graph.vertices_of(edges, spark.createDataFrame([("z",)], "id STRING"))
    components = graph.connected_components(vertices, edges)
    nodes = sorted({x for e in links for x in e} | {"z"})
    got = {r.id: r.betweenness for r in graph.betweenness(vertices, edges, components).collect()}
    assert got == pytest.approx(brute_betweenness(nodes, links))


def reducible_graph(kind):
    """Chains around a star, twins with branches of their own, or all of these on a random graph."""
    stars = [("hub", f"s{i}") for i in range(5)] + [(f"s{i}", f"t{i}") for i in range(5)] + [(f"t{i}", f"u{i}") for i in range(3)] + [("u1", "v"), ("u1", "w")]
    twins = [(f"x{i}", y) for i in range(6) for y in ("y1", "y2", "y3")] + [("y1", "z"), ("z", "y4"), ("y4", "x0"), ("x1", "leaf"), ("leaf", "leaf2"), ("x2", "own")]
    if kind == "stars":
        return stars
    if kind == "twins":
        return twins
    return stars + twins + random_graph(4)[1] + [("hub", "y1"), ("z", random_graph(4)[0][0])]


def graph_tables(spark, links):
    edges = graph.undirected_edges(spark.createDataFrame(links, "a STRING, b STRING"))
    vertices = graph.vertices_of(edges, spark.createDataFrame([("lonely",)], "id STRING"))
    return vertices, edges, graph.connected_components(vertices, edges)


@pytest.mark.parametrize("kind,left", [("stars", 0), ("twins", 5), ("all", None)])
def test_reduced_graphs(spark, kind, left):
    links = reducible_graph(kind)
    nodes = sorted({x for e in links for x in e} | {"lonely"})
    tables = graph_tables(spark, links)
    _, classes, _ = graph._reduced(*tables)
    count = classes.count()
    assert count < len(nodes) and (left is None or count <= left + 3)
    assert {r.id: r.betweenness for r in graph.betweenness(*tables).collect()} == pytest.approx(brute_betweenness(nodes, links), abs=1e-9)


def test_estimate_keeps_its_error(spark):
    r = random.Random(5)
    nodes = [f"n{i:03d}" for i in range(140)]
    links = sorted({tuple(sorted(r.sample(nodes[: 20 if r.random() < 0.5 else 140], 2))) for _ in range(420)})
    nodes = sorted({x for e in links for x in e} | {"lonely"})
    tables = graph_tables(spark, links)
    exact = brute_betweenness(nodes, links)
    found = {r.id: r.betweenness for r in graph.betweenness_estimate(*tables, error=0.6, confidence=0.9).collect()}
    off = max(abs(found[v] - exact[v]) for v in nodes)
    assert found.keys() == exact.keys() and 0 < off <= 0.6
    # Where the bound asks for all sources, the values are exact.
    assert {r.id: r.betweenness for r in graph.betweenness_estimate(*tables, error=0.01).collect()} == pytest.approx(exact, abs=1e-9)


def test_draws_follow_the_weights(spark):
    rows = [(i, w) for i, w in enumerate([1, 5, 0, 30, 64])]
    classes = spark.createDataFrame(rows, "vid LONG, weight LONG").unionByName(spark.createDataFrame([(1 << 33, 100)], "vid LONG, weight LONG"))
    drawn = {r.vid: r.draws for r in graph._drawn(classes, 200, 20_000, 3).collect()}
    assert sum(drawn.values()) == 20_000 and all(abs(drawn.get(v, 0) - 100 * w) < 5 * (100 * w) ** 0.5 + 1 for v, w in [*rows, (1 << 33, 100)])


# --- topics -----------------------------------------------------------------------------------
def test_term_weights_golden(spark):
    docs = spark.createDataFrame([("0", "sun wind sun"), ("1", "sun coal"), ("2", "gas coal")], "id STRING, t STRING")
    terms = topics.add_terms(docs, "t", [], max_ngram=1)
    got = {(r.id, r.term): round(r.weight, 6) for r in topics.term_weights(terms, "id").collect()}
    assert got[("0", "sun")] == 0.835592 and got[("0", "wind")] == 0.549351
    assert len(got) == 6


def test_terms_and_pruning(spark):
    docs = spark.createDataFrame([("0", "The Sun, a wind x sun"), ("1", "sun COAL"), ("2", None)], "id STRING, t STRING")
    docs = docs.fillna("", ["t"])
    rows = {r.id: r.terms for r in topics.add_terms(docs, "t").collect()}
    assert rows == {"0": ["sun", "wind", "sun", "sun wind", "wind sun"], "1": ["sun", "coal", "sun coal"], "2": []}
    weights = topics.term_weights(topics.add_terms(docs, "t"), "id", max_df=0.5)
    assert "sun" not in {r.term for r in weights.collect()}


def test_weights_move_no_row_per_document_and_term(spark):
    texts = spark.createDataFrame([(i % 40, f"sun wind coal{i % 3} gas") for i in range(50)] + [(None, "sun sun"), (7, "")], "id LONG, t STRING")
    docs = topics.add_terms(texts, "t", [], doc="id")
    weights = topics.term_weights(docs, "id", max_df=1.0)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    # Texts and vocabularies go by block, the latter by term too; a weight stays where it is made.
    assert {key.split("#")[0] for key in re.findall(r"hashpartitioning\(([^,]+),", plan)} <= {"block", "term"}
    rows = {(r.id, r.term): (r.tf, r.df) for r in weights.collect()}
    assert rows[(3, "sun")] == (2, 41) and rows[(20, "sun")] == (1, 41) and rows[(None, "sun")] == (2, 41)
    assert topics.vocabulary(docs, "id", 52).groupBy("block", "term").count().filter("count > 1").isEmpty()


def test_cluster_descriptions_with_repeated_and_null_ids(spark):
    texts = spark.createDataFrame([(1, "sun wind"), (2, "sun coal"), (2, "sun coal"), (3, "gas"), (4, "oil"), (None, "sun wind gas")], "id LONG, t STRING")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (None, "a"), (9, "c")], "id LONG, lang STRING")
    weights = {}
    for r in topics.term_weights(topics.add_terms(texts, "t", [], doc="id"), "id").collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    sums, near = {}, {}
    for i, lang in [(1, "a"), (2, "a"), (2, "a"), (3, "b")]:
        for term, w in weights[i].items():
            sums[lang, term] = sums.get((lang, term), 0.0) + w
    for i, lang in [(1, "a"), (2, "a"), (2, "a"), (3, "b")]:
        near[lang, i] = near.get((lang, i), 0.0) + sum(w * sums[lang, t] for t, w in weights[i].items())
    found = {r.lang: r for r in clusters.describe_clusters(texts, "t", labels, "id", "lang", []).collect()}
    assert found.keys() == {"a", "b", "c", None}
    for lang in ("a", "b"):
        terms = sorted((t for k, t in sums if k == lang), key=lambda t: (-round(sums[lang, t], 10), t))
        assert found[lang].cluster_terms == ", ".join(terms[:8]) and found[lang].cluster_name == " / ".join(terms[:3])
        assert found[lang].representative == min((-round(v, 10), i) for (k, i), v in near.items() if k == lang)[1]
    assert found["c"].cluster_terms is None and found[None].representative is None


def plain_lloyd(vectors, seeds):
    """Labels, cost and silhouette (squared distances) of dense vectors from the given seeds, lower cluster on a tie."""
    centres = [vectors[i].copy() if i is not None else None for i in seeds]
    labels = None
    while True:
        apart = np.array([[np.inf if c is None else round(max(((x - c) ** 2).sum(), 0.0), 10) for c in centres] for x in vectors])
        found = apart.argmin(1)
        if labels is not None and (found == labels).all():
            break
        labels = found
        centres = [vectors[labels == j].mean(0) if (labels == j).any() else None for j in range(len(seeds))]
    cost = sum(((x - centres[j]) ** 2).sum() for x, j in zip(vectors, labels))
    scores = []
    for i, x in enumerate(vectors):
        mean = [((vectors[labels == j] - x) ** 2).sum(1).mean() if (labels == j).any() else np.inf for j in range(len(seeds))]
        size = (labels == labels[i]).sum()
        inside, outside = mean[labels[i]] * size / max(1, size - 1), min(m for j, m in enumerate(mean) if j != labels[i])
        scores.append((outside - inside) / max(inside, outside) if size > 1 and max(inside, outside) > 0 else 0.0)
    return labels.tolist(), cost, float(np.mean(scores))


def term_rows(topics_of, r):
    rows = []
    for i, topic in enumerate(topics_of):
        held = {f"{topic}{r.randrange(12)}" for _ in range(6)} | {f"all{r.randrange(5)}" for _ in range(2)} | {f"own{i}"}
        raw = {t: r.randrange(1, 4) for t in sorted(held)}
        length = sum(v * v for v in raw.values()) ** 0.5
        rows += [(f"d{i}", t, v / length) for t, v in raw.items()]
    return rows


@pytest.mark.parametrize("cells,matrix", [(100_000, 1 << 24), (60, 400)])
def test_kmeans_equals_dense_rounds(spark, monkeypatch, cells, matrix):
    monkeypatch.setattr(kmeans, "BLOCK_CELLS", cells)
    monkeypatch.setattr(kmeans, "MATRIX", matrix)
    rows = term_rows(["a"] * 14 + ["b"] * 9 + ["c"] * 11 + ["a"] * 3, random.Random(3))
    rows += [("copy", t, w) for d, t, w in rows if d == "d4"]
    names = sorted({d for d, *_ in rows} | {"empty"})
    terms = sorted({t for _, t, _ in rows})
    dense = np.zeros((len(names), len(terms)))
    for d, t, w in rows:
        dense[names.index(d), terms.index(t)] = w
    scratch = Scratch(spark)
    weights = spark.createDataFrame(rows, "doc STRING, term STRING, weight DOUBLE")
    space = kmeans.space_of(weights, spark.createDataFrame([(d,) for d in names], "doc STRING"), "doc", scratch)
    starts = kmeans.seeds(space, 4, 4, 42, scratch)
    assert all(len({step[r] for step in starts}) == 4 for r in range(4))
    runs = [[step[r] for step in starts[:clusters]] for clusters in (2, 4) for r in range(4)]
    wanted = [plain_lloyd(dense, [names.index(d) for d in own]) for own in runs]
    got, costs, scores = {}, [], []
    for batch in kmeans.batches_of(space, [len(own) for own in runs]):
        found = kmeans.fit(space, [runs[run] for run in batch], scratch)
        labels = {row["doc"]: row["labels"] for row in found.state.collect()}
        got |= {run: [labels[d][place] for d in names] for place, run in enumerate(batch)}
        costs += found.costs.tolist()
        scores += kmeans.silhouettes(space, found, list(range(len(batch))))
    assert [got[run] for run in range(8)] == [w[0] for w in wanted]
    assert costs == pytest.approx([w[1] for w in wanted]) and scores == pytest.approx([w[2] for w in wanted])
    # A small space held whole gives the same.
    few = kmeans.fit_few(space, runs)
    assert [f[0] for f in few] == pytest.approx(costs) and [f[1] for f in few] == pytest.approx(scores)
    small = kmeans.SmallSpace.of(space)
    assert small.docs == names and [small.lloyd(own, 300)[0].tolist() for own in runs] == [w[0] for w in wanted]
    scratch.clear()


def test_kmeans_with_fewer_texts_than_clusters(spark, monkeypatch):
    rows = [(f"{d}{i}", t, 1.0) for d, t in (("x", "sun"), ("y", "coal")) for i in range(4)]
    weights = spark.createDataFrame(rows, "doc STRING, term STRING, weight DOUBLE")
    found = topics.assign_clusters(weights, weights.select("doc"), "doc", 8, restarts=3)
    monkeypatch.setattr(topics, "FEW_CELLS", 0)
    assert records(topics.assign_clusters(weights, weights.select("doc"), "doc", 8, restarts=3)) == records(found)
    labels = {r.doc: r.cluster_id for r in found.collect()}
    assert {labels[f"x{i}"] for i in range(4)} != {labels[f"y{i}"] for i in range(4)} and set(labels.values()) == {0, 1}


def test_cluster_counts():
    tried = {n: list(topics.cluster_counts_to_try(n)) for n in (1, 2, 3, 4, 10, 13, 100)}
    assert tried == {1: [], 2: [], 3: [2], 4: [2, 3], 10: [2, 3, 4], 13: [2, 3, 4, 5], 100: list(range(2, 10))}


def test_terms_are_sent_once_and_packed(spark):
    """A row per term of a block took 15 bytes and more each way."""
    docs = spark.createDataFrame([(i, [f"word{j} word{(j * j) % 997}" for j in range(i % 5, 900, 3)] + ["", "é ø", "x" * i]) for i in range(60)] + [(60, []), (61, None)], "id long, terms array<string>")
    docs = topics.in_blocks(docs, "id", F.lit(1))
    plain = {}
    for row in docs.collect():
        for term in set(row.terms or ()):
            plain.setdefault(term, {}).setdefault(row.block, set()).add(row.id)
    wanted = {(block, term): len(set().union(*held.values())) for term, held in plain.items() for block in held}
    found = topics.vocabulary(docs, "id", 62, max_df=1.0)
    assert {(x.block, x.term): x.df for x in found.collect()} == wanted and found.count() == len(wanted)
    few = topics.vocabulary(docs, "id", 62, max_df=0.5, min_df=2).collect()
    assert {(x.block, x.term): x.df for x in few} == {k: v for k, v in wanted.items() if 2 <= v <= 31}
    packed = topics.packed_vocabulary(docs, "id")
    assert packed.agg(F.sum(F.length("df"))).first()[0] < 3 * len(wanted) and packed.count() <= 4 * 4


def test_terms_of_equal_numbers_have_one_order(monkeypatch):
    terms = pa.array([f"t{i}" for i in range(500)] + ["", "a" * 70, "é"])
    order, numbers = topics._in_order(terms)
    assert sorted(order) == list(range(503)) and (np.diff(numbers.astype(float)) >= 0).all()
    monkeypatch.setattr(topics, "_mixed", lambda values: values * np.uint64(0))
    turned = terms.take(pa.array(np.arange(502, -1, -1)))
    assert terms.take(pa.array(topics._in_order(terms)[0])) == turned.take(pa.array(topics._in_order(turned)[0])) == pa.array(sorted(terms.to_pylist()))
    ends = topics._dealt(np.array([0, 1 << 62, 1 << 63, 2**64 - 1], np.uint64), 4)
    assert ends.tolist() == [0, 1, 2, 3, 4]


def test_descriptions_store_no_row_per_term(spark, monkeypatch):
    r = random.Random(6)
    texts = [(i, " ".join(f"w{r.randrange(4000)}" for _ in range(150)) + " sun" * (i % 3)) for i in range(60)]
    frame = spark.createDataFrame(texts, "id long, t string")
    rows = []

    def spy(df, name, kept=clusters.stored):
        out = kept(df, name)
        rows.append(out.count())
        return out

    for module in (clusters, topics):
        monkeypatch.setattr(module, "stored", spy, raising=False)
    found = {x.c: x for x in clusters.describe_clusters(frame, "t", frame.selectExpr("id", "id % 2 AS c"), "id", "c", []).collect()}
    sums, weights = defaultdict(float), defaultdict(dict)
    for x in topics.term_weights(topics.add_terms(frame, "t", [], doc="id"), "id").collect():
        sums[x.id % 2, x.term] += x.weight
        weights[x.id][x.term] = x.weight
    for c in (0, 1):
        terms = sorted((t for k, t in sums if k == c), key=lambda t: (-round(sums[c, t] / 30, 10), t))
        assert found[c].cluster_terms == ", ".join(terms[:8])
        assert found[c].representative == min((-round(sum(w * sums[c, t] / 30 for t, w in own.items()), 10), i) for i, own in weights.items() if i % 2 == c)[1]
    assert len(sums) > 10_000 and max(rows) < 400
