"""Review pages as a stream of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions.scalars import collapse
from decidra.schemas import REVIEW_PAGE


def page_stream(spark: SparkSession, path: str, pages_per_batch: int = 100) -> DataFrame:
    """Pages that arrive as JSON files under `path`/product=<id>/."""
    return spark.readStream.schema(REVIEW_PAGE.add("product", "string")).option("maxFilesPerTrigger", pages_per_batch).json(path)


def new_reviews(pages: DataFrame, delay: str = "7 days", time: str = "_metadata.file_modification_time") -> DataFrame:
    """product, review_key, content, at: each review once, by its id or else its content.

    Keys are forgotten once they are older than `delay`, so the state does not grow without end."""
    each = pages.select("product", F.col(time).cast("timestamp").alias("at"), F.explode("contents").alias("r"))
    clean = each.select("product", "at", F.col("r.contentsId").alias("id"), collapse(F.col("r.reviewContent")).alias("content")).filter("content <> ''")
    keyed = clean.select("product", F.coalesce("id", "content").alias("review_key"), "content", "at")
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["product", "review_key"])


def distinct_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events, each event_id once within the delay."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
