"""Domain tables over the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOUR = 3_600_000_000
CLIPS = 720  # one-hour clips in 30 days
SPAN = CLIPS * HOUR
TOLERANCES = (HOUR, 3 * HOUR, 6 * HOUR)
#: Event types in alphabetical order: their places are the token codes.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BLOCK = 50  # clips a video in embeddings
CODES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(column, names: tuple[str, ...]) -> F.Column:
    return (F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1).cast("int")


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video_id, t (µs since 2024-01-01), event_type, token, value."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")
    return e.select("event_id", F.col("user_id").alias("video_id"), t.alias("t"), "event_type", code_of("event_type", EVENT_TYPES).alias("token"), "value")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, pos, token: a user's event types in order of time."""
    order = W.partitionBy("video_id").orderBy("t", "event_id")
    return event_times(spark, sf_dir).select("video_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "token")


def narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, video_id, start, stop (µs), verb: an event lasts its value times ten minutes."""
    stop = F.col("t") + F.round(F.col("value") * 100).cast("long") * 6_000_000
    return event_times(spark, sf_dir).select(F.col("event_id").alias("id"), "video_id", F.col("t").alias("start"), stop.alias("stop"), F.col("token").alias("verb"))


def boundaries(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """video_id, t of the events of one kind."""
    return event_times(spark, sf_dir).where(F.col("event_type") == kind).select("video_id", "t")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, clip_idx, participant, verb, embedding (double)."""
    video = F.floor(F.col("vec_id") / BLOCK)
    return table(spark, sf_dir, "embeddings").select(
        video.alias("video_id"), (F.col("vec_id") % BLOCK).alias("clip_idx"), (video % 5).alias("participant"), F.col("label").alias("verb"), F.col("embedding").cast("array<double>").alias("embedding")
    )
