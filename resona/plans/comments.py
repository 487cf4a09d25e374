"""What comments say: intent, sentiment and emotion, per label and per post."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rulesets
from ..functions.text import clean_text, comment_intent, emotion_label, sentiment_label, sentiment_score
from ..operators.medians import summarise
from ..operators.nesting import keep_present
from ..session import stored
from .rollups import descending, empty_table, lacks

EARLY_MINUTES = 60
# --- fixed values: columns of the public tables, in their order
POST_COLUMNS = ("video_id", "title", "play_count", "comment_count", "share_count", "eng_per_1k_views")
LABELLED_COLUMNS = ("video_id", "comment_id", "digg_count", "mins_since_post")
SCORED_COLUMNS = (
    "video_id",
    "comment_id",
    "text",
    "digg_count",
    "mins_since_post",
    "sentiment_label",
    "sentiment_score",
    "emotion_label",
)


def _top_label(label: str, count: str) -> Column:
    """Most frequent label over rows that already carry counts; the lowest one wins a tie."""
    return F.min_by(label, F.struct(-F.col(count), F.col(label)))


def _with_post_columns(per_post: DataFrame, post_metrics: DataFrame) -> DataFrame:
    kept = keep_present(post_metrics, POST_COLUMNS)
    return per_post.join(kept, "video_id", "left") if "video_id" in kept.columns else per_post


def label_intents(comments: DataFrame, rules: Mapping[str, str] = rulesets.INTENT_RULES) -> DataFrame:
    lowered = comments.withColumn("_lowered", F.lower("text"))
    return lowered.withColumn("rough_intent", comment_intent(F.col("_lowered"), rules)).drop("_lowered")


def intent_summary(labelled: DataFrame) -> DataFrame:
    return summarise(
        keep_present(labelled, ("rough_intent", "comment_id", "digg_count", "mins_since_post")),
        ["rough_intent"],
        [F.count("comment_id").alias("comments"), F.avg("digg_count").alias("avg_comment_likes")],
        {"median_mins_since_post": "mins_since_post"},
    ).orderBy(*descending("comments", ties=["rough_intent"]))


def post_intents(labelled: DataFrame, post_metrics: DataFrame) -> DataFrame:
    """Per post: comments, mean likes, comments within the first hour, most frequent intent.

    Rows are reduced to one per (post, intent) first, so a post with very many comments is spread
    over tasks and reaches the second step as a handful of rows.
    """
    partial = labelled.groupBy("video_id", "rough_intent").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("comment_id").alias("_comments"),
        F.sum("digg_count").alias("_likes"),
        F.count("digg_count").alias("_liked"),
        F.count_if(F.col("mins_since_post") <= EARLY_MINUTES).alias("_early"),
    )
    per_post = partial.groupBy("video_id").agg(
        F.sum("_comments").alias("captured_comments"),
        (F.sum("_likes") / F.nullif(F.sum("_liked"), F.lit(0))).alias("avg_comment_likes"),
        F.sum("_early").alias("early_comments_60m"),
        _top_label("rough_intent", "_rows").alias("top_comment_intent"),
    )
    return _with_post_columns(per_post, post_metrics).orderBy(
        *descending("captured_comments", "avg_comment_likes", ties=["video_id"])
    )


def comment_intent_tables(
    comments: DataFrame, post_metrics: DataFrame, rules: Mapping[str, str] = rulesets.INTENT_RULES
) -> dict[str, DataFrame]:
    if lacks(comments, "text"):
        return {
            "comment_intent_summary": empty_table(comments, "rough_intent string, comments long, avg_comment_likes double, median_mins_since_post double"),
            "post_comment_intents": empty_table(
                comments, "video_id string, captured_comments long, avg_comment_likes double, early_comments_60m long, top_comment_intent string"
            ),
        }
    # Read by two tables: written once, without the texts.
    labelled = stored(keep_present(label_intents(comments, rules), (*LABELLED_COLUMNS, "rough_intent")), "labelled-comments")
    return {
        "comment_intent_summary": intent_summary(labelled),
        "post_comment_intents": post_intents(labelled, post_metrics),
    }


def score_sentiment(
    comments: DataFrame,
    emotions: Mapping[str, str] = rulesets.EMOTION_RULES,
    positive=rulesets.POSITIVE_WORDS,
    negative=rulesets.NEGATIVE_WORDS,
) -> DataFrame:
    """Cleaned text, sentiment score and label, and emotion of each comment."""
    out = comments.withColumn("comment_text_clean", clean_text(F.col("text")))
    lowered = F.col("_lowered")
    out = out.withColumn("_lowered", F.lower("comment_text_clean")).withColumns(
        {"sentiment_score": sentiment_score(lowered, positive, negative), "emotion_label": emotion_label(lowered, emotions)}
    )
    return out.drop("_lowered").withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    keys = ["sentiment_label", "emotion_label"]
    return summarise(
        keep_present(scored, (*keys, "comment_id", "digg_count", "mins_since_post")),
        keys,
        [F.count("comment_id").alias("comments"), F.avg("digg_count").alias("avg_comment_likes")],
        {"median_mins_since_post": "mins_since_post"},
    ).orderBy(*descending("comments", ties=keys))


def post_sentiment(scored: DataFrame, post_metrics: DataFrame) -> DataFrame:
    """Per post: comments scored, mean score, shares of positive and negative, top emotion."""
    partial = scored.groupBy("video_id", "emotion_label").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("comment_id").alias("_comments"),
        F.sum("sentiment_score").alias("_score"),
        F.count_if(F.col("sentiment_label") == "positive").alias("_positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("_negative"),
    )
    rows = F.sum("_rows")
    per_post = partial.groupBy("video_id").agg(
        F.sum("_comments").alias("comments_scored"),
        (F.sum("_score") / rows).alias("avg_sentiment_score"),
        (F.sum("_positive") / rows).alias("pct_positive"),
        (F.sum("_negative") / rows).alias("pct_negative"),
        _top_label("emotion_label", "_rows").alias("top_emotion"),
    )
    return _with_post_columns(per_post, post_metrics).orderBy(
        *descending("comments_scored", "avg_sentiment_score", ties=["video_id"])
    )


def comment_sentiment_tables(
    comments: DataFrame, post_metrics: DataFrame, emotions: Mapping[str, str] = rulesets.EMOTION_RULES
) -> dict[str, DataFrame]:
    if lacks(comments, "text"):
        return {
            "comment_sentiment_emotion": empty_table(
                comments, "video_id string, comment_id string, sentiment_label string, sentiment_score double, emotion_label string"
            ),
            "comment_sentiment_summary": empty_table(
                comments, "sentiment_label string, emotion_label string, comments long, avg_comment_likes double, median_mins_since_post double"
            ),
            "post_comment_sentiment": empty_table(
                comments,
                "video_id string, comments_scored long, avg_sentiment_score double, pct_positive double, pct_negative double, top_emotion string",
            ),
        }
    scored = stored(keep_present(score_sentiment(comments, emotions), SCORED_COLUMNS), "scored-comments")
    return {
        "comment_sentiment_emotion": scored,
        "comment_sentiment_summary": sentiment_summary(scored),
        "post_comment_sentiment": post_sentiment(scored, post_metrics),
    }


def emotion_by_sentiment(summary: DataFrame) -> DataFrame:
    """Comments per emotion, one column per sentiment."""
    labels = ["negative", "neutral", "positive"]
    return summary.groupBy("emotion_label").pivot("sentiment_label", labels).sum("comments").fillna(0, labels)
