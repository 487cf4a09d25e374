"""The public tables on hand-written rows, the batch job, media folders, streaming and plans."""

import json
import time

import pytest
from helpers import records
from pyspark.sql import functions as F

from resona.operators import topics
from resona.plans import build, clusters, comments, core, creators, rollups, summaries, views
from resona.session import fresh_path, stored
from resona.sources import media, tables
from resona.sources.schemas import AUTHOR_ACTIVITY_RAW, AUTHORS_RAW, NETWORK_RAW, POSTS_RAW
from resona.streaming.comments import label_comments, stream_comment_labels

URL = "https://video.example/post/"
T0 = 1672617600


def post(video_id, title, region, create, duration, counts, images=None, found=None, author="A"):
    play, digg, comment, share, collect = counts
    return dict(
        video_id=video_id, title=title, region=region, create_time=create, duration=duration, download_count=None,
        play_count=play, digg_count=digg, comment_count=comment, share_count=share, collect_count=collect,
        author=dict(id=author, unique_id=f"u{author}", nickname=None), music_info=dict(id="m", title=None),
        commerce_info=None, images=images, comments=found,
    )


POSTS = [
    post(
        "1", "Save #Éco #climate #climate", "AU", str(T0), "15", ("1000", "200", "30", "30", "10"),
        found=[
            dict(id="c1", text="I can't afford it", create_time=str(T0 + 60), digg_count="4", user=dict(id="u1", region="AU")),
            dict(id="c2", text="but how?", create_time=str(T0 + 7200), digg_count="2", user=None),
            dict(id="c3", text="really?", create_time=None, digg_count=None, user=None),
        ],
    ),
    post("2", "plain", "AU", "bad", "0", ("0", "5", None, None, None), images=["a", None, "b"], found=[], author="B"),
    post("3", None, None, str(T0), None, ("x", "1", "1", "1", "1"), author="Z"),
]


@pytest.fixture(scope="module")
def raw(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    activity = [
        dict(author_id="A", record=[
            dict(id="p1", create_time=str(T0), duration="3", play_count="100", digg_count="10", share_count="1"),
            None,
            dict(id="p2", create_time=str(T0 + 40 * 86400), duration="0", play_count="300", digg_count="x"),
        ]),
        dict(author_id="B", record=[]),
    ]
    return {
        "posts": frame(POSTS, POSTS_RAW),
        "authors": frame(
            [
                dict(author_id="A", user=dict(uniqueId="ua", nickname="Ann"), stats=dict(followerCount=100, heartCount=50, videoCount=2)),
                dict(author_id="B", user=dict(uniqueId="ub", nickname="Bo"), stats=dict(followerCount=10, heartCount=5, videoCount=0)),
            ],
            AUTHORS_RAW,
        ),
        "author_posts": frame(activity, AUTHOR_ACTIVITY_RAW),
        "author_favorites": frame(activity, AUTHOR_ACTIVITY_RAW),
        "author_followers": frame(
            [
                dict(author_id="A", record=[dict(id="f1", region="AU"), dict(id="f1", region="AU"), dict(id="f2", region="NZ"), dict(id=None)]),
                dict(author_id="B", record=[dict(id="f2", region="NZ")]),
            ],
            NETWORK_RAW,
        ),
        "author_followings": frame([dict(author_id="B", record=[dict(id="C", region="AU")])], NETWORK_RAW),
    }


@pytest.fixture(scope="module")
def tables_of(raw):
    return core.build_core_tables(raw, URL)


def test_posts(tables_of):
    got = records(tables_of["posts"], "video_id", "play_count", "eng_total", "eng_per_1k_views", "has_video", "date", "url")
    assert got == [
        ("1", 1000.0, 1270.0, 1270.0, True, "2023-01-02", URL + "1"),
        ("2", 0.0, 5.0, 0.0, False, None, URL + "2"),
        ("3", 0.0, 4.0, 0.0, False, "2023-01-02", URL + "3"),
    ]
    assert records(tables_of["posts_images"]) == [("2", "a", 1), ("2", "b", 2)]
    assert records(tables_of["posts_hashtags"]) == [("1", "#climate"), ("1", "#éco")]
    assert tables_of["posts_author"].columns == ["video_id", "author_id", "author_unique_id", "author_nickname"]


def test_comments(tables_of):
    got = records(tables_of["posts_comments"], "comment_id", "digg_count", "mins_since_post", "user_id")
    assert got == [("c1", 4.0, 1.0, "u1"), ("c2", 2.0, 120.0, None), ("c3", 0.0, None, None)]


def test_post_metrics(tables_of):
    got = records(tables_of["post_metrics"], "video_id", "n_hashtags", "n_images", "n_comments_captured", "avg_comment_diggs")
    assert got == [("1", 2, 0, 3, 2.0), ("2", 0, 2, 0, 0.0), ("3", 0, 0, 0, 0.0)]


def test_copies_of_a_post_are_kept(spark):
    posts = spark.createDataFrame([("1",)] * 50 + [("2",), (None,)], "video_id STRING")
    found = spark.createDataFrame([("1", "3"), ("1", "x"), (None, "1")], "video_id STRING, digg_count STRING")
    empty = spark.createDataFrame([], "video_id STRING")
    out = core.build_post_metrics(posts, found, empty, empty)
    counted = out.groupBy("video_id", "n_comments_captured", "avg_comment_diggs").count()
    assert records(counted) == [(None, 0, 0.0, 1), ("1", 2, 1.5, 50), ("2", 0, 0.0, 1)]


def test_author_tables(tables_of):
    got = records(tables_of["author_metrics"], "author_id", "avg_hearts_per_video", "hearts_per_follower", "videos_per_1k_followers")
    assert got == [("A", 25.0, 0.5, 20.0), ("B", 0.0, 0.5, 0.0)]
    got = records(tables_of["authorpost_metrics"], "author_id", "posts_total", "active_months", "posts_per_month", "sum_play", "avg_digg")
    assert got == [("A", 2, 2, 1.0, 400.0, 5.0)]


def test_network_metrics(spark):
    rows = [("A", [("AU",), ("AU",), ("NZ",), (None,)]), ("B", [("NZ",), ("AU",)]), ("C", [(None,)])]
    raw = spark.createDataFrame(
        [dict(author_id=a, record=[dict(id=str(i), region=r[0]) for i, r in enumerate(l)]) for a, l in rows], NETWORK_RAW
    )
    out = core.normalize_network("x", raw, "follower")["x_metrics"]
    assert records(out) == [("A", 4, 2, "AU", 2), ("B", 2, 2, "AU", 1), ("C", 1, 0, None, None)]


def test_comment_intents(tables_of):
    out = comments.comment_intent_tables(tables_of["posts_comments"], tables_of["post_metrics"])
    got = records(out["post_comment_intents"], "video_id", "captured_comments", "avg_comment_likes", "early_comments_60m", "top_comment_intent", "play_count")
    assert got == [("1", 3, 2.0, 1, "action_oriented", 1000.0)]
    assert out["comment_intent_summary"].count() == 3


def test_missing_regions_are_a_group(tables_of):
    out = rollups.region_performance(tables_of["post_metrics"])
    assert [(r.region, r.posts, r.total_views) for r in out.collect()] == [("AU", 2, 1000.0), (None, 1, 0.0)]


def test_min_views_fallback(tables_of):
    posts = tables_of["posts"]
    assert records(rollups.with_enough_views(posts, 1000), "video_id") == [("1",)]
    assert rollups.with_enough_views(posts, 10**9).count() == 3


def test_creator_leverage(tables_of):
    out = creators.creator_leverage(tables_of["posts_author"], tables_of["authors"], tables_of["authorpost_metrics"])
    got = [(r.video_id, r.creator_scale, r.posts_total, r.views_per_follower_history) for r in out.collect()]
    assert got == [("1", "nano", 2, 2.0), ("2", "nano", None, 0.0), ("3", "nano", None, 0.0)]


def test_creator_bridge(spark, tables_of):
    metrics = spark.createDataFrame([("1", 1100.0), ("2", 1300.0), ("3", 1000.0)], "video_id STRING, eng_per_1k_views DOUBLE")
    out = creators.creator_bridge_metrics(
        tables_of["posts_author"], tables_of["authors"], tables_of["authorfollowers"], tables_of["authorfollowings"], metrics
    )
    got = records(
        out, "author_id", "network_degree", "network_betweenness", "component_id", "component_size", "component_nodes",
        "captured_followers", "captured_followings", "bridge_score",
    )
    assert got == [
        ("A", 2, 0.3, "A", 2, 5, 4, 0, 0.817),
        ("B", 2, 0.3, "A", 2, 5, 1, 1, 0.85),
        ("Z", 0, 0.0, "Z", 1, 1, 0, 0, 0.333),
    ]


@pytest.fixture(scope="module")
def media_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    climate = "**Overall mood:**\nurgent\n**Narrative:**\nPlant a tree and vote\n"
    folders = {
        "1": {"summary.txt": climate, "video.mp4": "v"},
        "2": {"audio.mp3": "a", "image_1.jpg": "i", "image_2.jpg": "i"},
        "9": {"summary.txt": "Solar wind été", "image_1.jpg": "i", "note.jpg": "n"},
    }
    for name, files in folders.items():
        (root / name).mkdir()
        for file, content in files.items():
            (root / name / file).write_text(content, encoding="utf-8")
    (root / "9" / "summary.txt").write_bytes("Solar wind ".encode() + b"\xff\xfe")
    return str(root)


def test_media_folders(spark, media_root):
    out = summaries.read_summaries(spark, media_root)
    got = records(
        out, "video_id", "content_type", "n_image_files", "has_local_video", "has_local_audio", "overall_mood_tone",
        "primary_theme", "mood_label", "n_theme_labels",
    )
    assert got == [
        ("1", "video", 0, True, False, "urgent", "solutions_action", "urgent_alarm", 2),
        ("2", "images_audio", 2, False, True, None, "uncategorized", "neutral_or_mixed", 0),
        ("9", "images_music", 1, False, False, None, "solutions_action", "neutral_or_mixed", 1),
    ]
    text = out.filter("video_id = '9'").first().summary_text
    assert text.startswith("Solar wind �")


def test_folders_are_listed_level_by_level(spark, tmp_path):
    for path in ("1/summary.txt", "1/deep/er/video.mp4", "3/deep/image_1.jpg"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("")
    (tmp_path / "2").mkdir()
    listed = {r.path.removeprefix(f"file://{tmp_path}") for r in media.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"/", "/1/", "/2/", "/3/", "/1/deep/", "/1/deep/er/", "/3/deep/", "/1/summary.txt", "/1/deep/er/video.mp4", "/3/deep/image_1.jpg"}
    assert records(media.list_files(spark, str(tmp_path), levels=1)) == [(f"file://{tmp_path}/",)]
    got = {r.video_id: (r.content_type, r.summary_text) for r in media.read_media_folders(spark, str(tmp_path)).collect()}
    assert got == {"1": ("unknown", ""), "2": ("unknown", None), "3": ("unknown", None)}


def test_enriched_posts_without_summary(tables_of, spark, media_root):
    out = summaries.enrich_posts(tables_of["post_metrics"], summaries.read_summaries(spark, media_root))
    got = records(out, "video_id", "primary_theme", "action_frame", "n_theme_labels")
    assert got == [
        ("1", "solutions_action", "policy_systemic", 2),
        ("2", "uncategorized", "no_clear_action", 0),
        ("3", "missing_summary", "missing_summary", None),
    ]


def test_batch_job(spark, raw, media_root, tmp_path):
    out = str(tmp_path / "out")
    listing = build.run(spark, raw, out, URL, summaries.read_summaries(spark, media_root), with_text=True)
    rows = {r.table: r for r in listing.collect()}
    assert len(rows) == 19 + 12
    assert list(rows) == sorted(rows)
    assert (rows["posts_comments"].rows, rows["posts_comments"].category) == (3, "core")
    assert rows["creator_bridge_metrics"].category == "analytics"
    written = tables.read_table(spark, f"{out}/manifest.csv", "csv")
    assert written.count() == 31
    for name in (
        "semantic_clusters", "semantic_cluster_performance", "comment_sentiment_emotion", "comment_sentiment_summary",
        "post_comment_sentiment",
    ):
        assert tables.read_table(spark, f"{out}/analytics/{name}.csv", "csv").columns
    enriched = tables.read_table(spark, f"{out}/core/posts_enriched.parquet")
    assert views.snapshot(enriched).first().video_id == "1"
    assert tuple(views.totals(enriched, spark.range(2)).first()) == (3, 3, 2)


def test_single_cluster(spark):
    one = spark.createDataFrame([("1", "a long enough text to count here"), ("2", "short")], "video_id STRING, semantic_text STRING")
    metrics = spark.createDataFrame([("1", 5.0, 1.0, 1.0, 1.0)], "video_id STRING, play_count DOUBLE, eng_per_1k_views DOUBLE, share_count DOUBLE, comment_count DOUBLE")
    out = clusters.semantic_clusters(one, metrics)
    assert records(out["semantic_clusters"]) == [("1", 0, "single cluster", "")]
    assert out["semantic_cluster_performance"].first().total_views == 5.0


def test_clusters_of_two_topics(spark):
    rows = [(f"s{i}", f"solar panels power homes with sunlight number{i}") for i in range(6)]
    rows += [(f"w{i}", f"whales swim deep oceans eating krill item{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "video_id STRING, semantic_text STRING")
    metrics = docs.select("video_id", *[F.lit(1.0).alias(c) for c in ("play_count", "eng_per_1k_views", "share_count", "comment_count")])
    out = clusters.semantic_clusters(docs, metrics)
    rows = out["semantic_clusters"].collect()
    assert len(rows) == 12
    by_cluster = {}
    for r in rows:
        by_cluster.setdefault(r.cluster_id, []).append(r)
    assert all(len({r.video_id[0] for r in group}) == 1 for group in by_cluster.values())
    assert all(sum(r.is_cluster_representative for r in group) == 1 for group in by_cluster.values())
    assert all(len(r.cluster_terms.split(", ")) == 8 and len(r.cluster_name.split(" / ")) == 3 for r in rows)


# --- sources and sinks ------------------------------------------------------------------------
def test_raw_json_source(spark, tmp_path):
    folder = tmp_path / "raw" / "posts"
    folder.mkdir(parents=True)
    line = dict(video_id=7, title="t", play_count=12, comments=[dict(id=1, text="x")], extra=1)
    (folder / "part.json").write_text(json.dumps(line))
    row = tables.read_table(spark, str(folder), "json", POSTS_RAW).first()
    assert (row.video_id, row.play_count, row.comments[0].text, row.region) == ("7", "12", "x", None)


def test_optional_table(spark, tmp_path):
    missing = tables.read_optional(spark, str(tmp_path / "none"), "a INT, b STRING")
    assert missing.columns == ["a", "b"] and missing.count() == 0


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_csv_keeps_quotes_and_line_breaks(spark):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None)], "i INT, t STRING")
    path = fresh_path(spark, "csv")
    assert tables.write_table(df, path, "csv") == (2, 2)
    assert records(tables.read_table(spark, path, "csv", df.schema, multi_line=True)) == [(1, 'a "b", c\nd'), (2, None)]


# --- streaming --------------------------------------------------------------------------------
def test_stream_gives_the_batch_result(spark, tmp_path):
    schema = "video_id STRING, comment_id STRING, text STRING"
    rows = [("1", "a", "I love this, thank you"), ("1", "b", "but how?"), ("2", "c", None)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame(rows, schema)
    for part in (batch.limit(2), batch.subtract(batch.limit(2))):
        part.write.mode("append").parquet(source)
        query = stream_comment_labels(spark, source, schema, target, str(tmp_path / "state"))
        assert query.awaitTermination(120)
    assert records(spark.read.parquet(target)) == records(label_comments(batch))


# --- plans ------------------------------------------------------------------------------------
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_posts_need_no_full_sort(tables_of):
    for top in rollups.top_posts(tables_of["posts"]).values():
        assert "TakeOrderedAndProject" in plan(top)


def test_no_python_in_plans(tables_of):
    scored = comments.score_sentiment(comments.label_intents(tables_of["posts_comments"]))
    for df in (*tables_of.values(), scored, comments.sentiment_summary(scored)):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text


def test_top_terms_are_cut_before_the_shuffle(spark):
    centres = spark.createDataFrame([(0, "a", 0.5, 1), (0, "b", 0.5, 1)], "cluster_id INT, term STRING, centre DOUBLE, _rows INT")
    out = topics.top_terms(centres, n=1)
    assert "WindowGroupLimit" in plan(out)
    assert tuple(out.first()) == (0, "a", "a")


def test_summary_texts_keep_their_partitions(spark):
    """Reading sections and labels is much work on few bytes: adaptive execution must not join it into one task."""
    media = spark.createDataFrame([("1", "**Overall mood:**\ncalm"), ("2", None)], "video_id STRING, summary_text STRING")
    flags = spark.createDataFrame([("1", 0), ("2", 1)], "video_id STRING, n_image_files INT")
    out = summaries.summarise_media(flags.join(media.hint("merge"), "video_id", "left"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("REPARTITION_BY_NUM") < plan.index("SortMergeJoin")
    assert {r.video_id: r.overall_mood_tone for r in out.collect()} == {"1": "calm", "2": None}


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    """Shuffles stayed until the driver collected its garbage, beside those of all later steps."""

    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {line for line in found.split("\n") if "/shuffle_" in line}

    before = shuffles()
    table = stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "of-a-test")
    deadline = time.time() + 20  # they go in the background
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert sorted(tuple(r) for r in table.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
