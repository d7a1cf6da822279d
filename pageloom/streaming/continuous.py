"""A stream of crawled pages, scored as it arrives (an extension: the batch plan is the semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.kernels.features import with_features
from pageloom.plans.scores import finish, pillar_columns
from pageloom.operators import pillars, scoring

PAGES = "page_id long, url string, html string, crawled_at timestamp"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored_stream(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Each page once within the watermark, scored; the state is bounded by ``late``."""
    rows = pages.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["url"])
    rows = with_features(rows).select("page_id", "url", "crawled_at", F.col("html").isNull().alias("failed"), scoring.classify(F.col("url")).alias("class"), F.lit("raw").alias("render_mode"), pillars.evidence().alias("evidence"), F.lit(None).cast("string").alias("preview"), *(c.alias(k) for k, c in pillar_columns(False).items()))
    return finish_stream(rows)


def finish_stream(rows: DataFrame) -> DataFrame:
    """``finish`` keeps only its own columns, so the event time travels with page_id in a struct."""
    packed = rows.withColumn("page_id", F.struct("page_id", "crawled_at"))
    out = finish(packed)
    return out.select(F.col("page_id.page_id").alias("page_id"), F.col("page_id.crawled_at").alias("crawled_at"), *out.columns[1:])


def daily_scores(scored: DataFrame) -> DataFrame:
    """Pages and mean score of each day."""
    return scored.groupBy(F.window("crawled_at", "1 day")).agg(F.count("*").alias("pages"), F.avg("parseability_score").alias("mean_score"))


def event_windows(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user by a gap, in event time."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("events"))
