"""What stages leave for one another: ground truth, tokens, splits, checkpoints, training logs.

A stage's result is a folder of Parquet and JSON tables, each written atomically.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.learning import Quantiser
from strandline.sources import schemas


def _read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as missing:
        raise FileNotFoundError(path) from missing


def write_ground_truth(labels: DataFrame, boundaries: DataFrame, path: str) -> None:
    """Labels (video_id, clip_idx, verb) and boundaries (video_id, t_sec)."""
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    boundaries.write.mode("overwrite").parquet(f"{path}/boundaries")


def ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, f"{path}/labels", schemas.CLIP_LABELS), _read(spark, f"{path}/boundaries", schemas.BOUNDARIES)


def write_tokens(tokens: DataFrame, stats: DataFrame, path: str) -> None:
    """Streams (video_id, pos, token), and their statistics as JSON."""
    tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    stats.write.mode("overwrite").json(f"{path}/stats")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/tokens", schemas.TOKENS)


def token_stats(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/stats", schemas.TOKEN_STATS, "json")


def write_split(split: DataFrame, path: str) -> None:
    """The held-out videos (video_id, is_test); the others follow as a difference."""
    split.where("is_test").select(F.col("video_id").cast("string").alias("video_id")).write.mode("overwrite").parquet(path)


def recover_split(spark: SparkSession, path: str, videos: DataFrame) -> DataFrame:
    """``videos`` with ``is_test`` as the stored split has it."""
    held = _read(spark, path, "video_id string").select("video_id", F.lit(True).alias("held"))
    return videos.join(held, videos["video_id"].cast("string") == held["video_id"], "left").select(videos["*"], F.coalesce("held", F.lit(False)).alias("is_test"))


def write_checkpoint(spark: SparkSession, model: Quantiser, settings: dict[str, float], path: str) -> None:
    """Weights as rows (name, shape, data); sizes and ``settings`` (lag, copy_mse, ...) as JSON."""
    rows = [(name, list(x.shape), x.reshape(-1).tolist()) for name, x in model.named()]
    spark.createDataFrame(rows, schemas.PARAMETERS).write.mode("overwrite").parquet(f"{path}/parameters")
    sizes = [(k, float(v)) for k, v in (model.sizes() | settings).items()]
    spark.createDataFrame(sizes, "name string, value double").write.mode("overwrite").json(f"{path}/settings")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[Quantiser, dict[str, float]]:
    """The model rebuilt from its sizes, and the settings; a missing checkpoint is an error."""
    rows = _read(spark, f"{path}/parameters", schemas.PARAMETERS).collect()  # a row a layer
    settings = {r["name"]: r["value"] for r in _read(spark, f"{path}/settings", "name string, value double", "json").collect()}
    return Quantiser.restored({r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in rows}, settings), settings


def write_train_log(spark: SparkSession, history: list[tuple[int, float, float]], path: str) -> None:
    spark.createDataFrame(history, schemas.TRAIN_LOG).write.mode("overwrite").json(path)


def train_log(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.TRAIN_LOG, "json")


def write_metrics(report: DataFrame, path: str) -> None:
    """A report as (target, representation, split, model, metric, value), overwritten."""
    report.select(*[c.split()[0] for c in schemas.METRICS.split(", ")]).write.mode("overwrite").json(path)
