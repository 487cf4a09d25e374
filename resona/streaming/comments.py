"""Comment labels on a file stream: the batch column expressions, run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.comments import SCORED_COLUMNS, label_intents, score_sentiment


def label_comments(comments: DataFrame) -> DataFrame:
    """Intent, sentiment and emotion of each comment; works on batch and streaming tables alike."""
    scored = score_sentiment(label_intents(comments))
    return scored.select(*[c for c in (*SCORED_COLUMNS, "rough_intent") if c in scored.columns])


def stream_comment_labels(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Label the comment files that are new since the last run, then stop."""
    comments = spark.readStream.schema(schema).format(fmt).load(source)
    return (
        label_comments(comments)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
