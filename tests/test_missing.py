"""Missing columns, odd folder names, odd lexicon entries."""

from pyspark.sql import functions as F

from resona.functions.text import section, sentiment_score
from resona.plans import comments, rollups
from resona.sources.media import media_flags, read_media_folders, read_summary_texts


def test_rollups_without_their_columns(spark):
    posts = spark.createDataFrame([("1", 5.0)], "video_id string, play_count double")
    for rollup in (rollups.region_performance, rollups.theme_performance, rollups.messaging_recommendations):
        out = rollup(posts)
        assert out.count() == 0 and "posts" in out.columns


def test_comment_tables_without_texts(spark):
    bare = spark.createDataFrame([("1", "a")], "video_id string, comment_id string")
    tables = comments.comment_intent_tables(bare, bare) | comments.comment_sentiment_tables(bare, bare)
    assert len(tables) == 5 and all(t.count() == 0 for t in tables.values())


def test_folder_names_are_decoded(spark, tmp_path):
    for name in ("a b", "50%", "x+y", "plain"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.txt").write_text(f"text of {name}")
    (tmp_path / "plain" / "sub").mkdir()
    (tmp_path / "plain" / "sub" / "image_1.jpg").write_text("x")
    texts = {r[0]: r[1] for r in read_summary_texts(spark, str(tmp_path)).collect()}
    assert texts == {n: f"text of {n}" for n in ("a b", "50%", "x+y", "plain")}
    folders = {r["video_id"]: r for r in read_media_folders(spark, str(tmp_path)).collect()}
    assert set(folders) == set(texts) and folders["a b"]["summary_text"] == "text of a b"
    assert folders["plain"]["n_image_files"] == 0


def test_inventory_keeps_empty_folders_and_files(spark):
    paths = ["/m/1/video.mp4", "/m/2/", "/m/3/sub/image_1.jpg", "/m/4/image_1.jpg", "/other/9/video.mp4"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["video_id"]: r["content_type"] for r in media_flags(files, root="/m").collect()}
    assert got == {"1": "video", "2": "unknown", "4": "images_music"}


def test_lexicon_entries_that_are_no_tokens(spark):
    df = spark.createDataFrame([("a.b x good",), ("aab x",), ("",)], "t string")
    assert [r[0] for r in df.select(sentiment_score(F.col("t"), ["a.b", "A"], [])).collect()] == [0.0, 0.0, 0.0]
    assert df.select(sentiment_score(F.col("t"), ["good"], ["a.b"])).first()[0] == 0.5


def test_sections_with_and_without_heading(spark):
    pattern = r"\*\*.*?(?:key events|prominent objects).*?\*\*\n?(.*?)(?=\n\*\*|$)"
    rows = [("**1. Key EVENTS**\nboat\n**2.**",), ("key events",), ("**other**\nx",), (None,), ("**Prominent ob\u017fects: pro\u017f** y",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(section(F.col("t"), pattern)).collect()] == ["boat", None, None, None, None]
