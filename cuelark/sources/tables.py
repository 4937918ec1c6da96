"""Frame tables from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY_EVERY = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str, threshold: float = 40.0) -> DataFrame:
    """Events as frames: a user is a video, microseconds are ticks, a value over the threshold is dialog."""
    # The clock time's microseconds, whatever the session's time zone.
    clock = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(clock).alias("pts"))
    order = Window.partitionBy("user_id").orderBy("pts", "event_id")
    return e.select(
        F.col("user_id").alias("video_id"),
        "pts",
        (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        (F.col("value") > threshold).alias("dialog"),
        F.col("value").alias("feat"),
        "event_type",
    ).withColumn("is_key", F.col("frame_idx") % KEY_EVERY == 0)


def embedding_frames(spark: SparkSession, sf_dir: str, ticks: int = 40_000) -> DataFrame:
    """Embeddings as frames with vector features: a label is a video, one frame follows the other."""
    v = table(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = v.select(F.col("label").cast("long").alias("video_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), "embedding")
    return rows.select("video_id", (F.col("frame_idx") * ticks).alias("pts"), "frame_idx", (F.col("frame_idx") % KEY_EVERY == 0).alias("is_key"), (F.element_at("embedding", 1) > 0).alias("dialog"), F.col("embedding").alias("feat"))
