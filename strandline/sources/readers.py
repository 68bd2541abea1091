"""Readers of the stages' files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import schemas


def feature_folder(model: str, n_clip_frame: int, stride: int) -> str:
    """The name of a feature cache: settings that change content are in its path."""
    return f"{model}_clip{n_clip_frame}_stride{stride}"


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, participant, path of ``folder/*/*.mp4``, one level down exactly."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(f"{folder}/*/").select("path")
    name = F.regexp_extract("path", r"([^/]+)\.mp4$", 1)
    return files.select(name.alias("video_id"), F.substring_index(name, "-", 1).alias("participant"), "path").orderBy("path")


def features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEATURES).parquet(path)


def numpy_features(spark: SparkSession, folder: str) -> DataFrame:
    """Import (n_clips, D) ``.npy`` matrices as feature rows; pickled arrays are refused."""

    def load(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                name = path.rsplit("/", 1)[1].removesuffix(".npy")
                yield pd.DataFrame({"video_id": name, "clip_idx": np.arange(len(matrix), dtype=np.int32), "embedding": list(matrix)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    return files.select("path", "content").mapInPandas(load, schemas.FEATURES)


def clip_meta(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar JSON, today's fields and the older ones merged."""
    rows = spark.read.schema(schemas.CLIP_META_OLD).json(path, multiLine=True)
    rows = rows.withColumn("n_clip_frame", F.coalesce("n_clip_frame", "delta_min")).withColumn("model", F.coalesce("model", "vjepa_model"))
    return rows.drop("delta_min", "vjepa_model")


def narrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NARRATION).parquet(path)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """id, key, category; of repeated ids the last line wins."""
    rows = spark.read.schema(schemas.TAXONOMY).csv(path, header=True)
    return rows.withColumn("line", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(F.struct("key", "category"), "line").alias("r")).select("id", "r.*")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines, with their order."""
    lines = spark.read.text(path).select(F.trim("value").alias("video_id"), F.monotonically_increasing_id().alias("rank"))
    return lines.where("video_id <> ''")


def require_ids(wanted: DataFrame, known: DataFrame, key: str = "video_id") -> DataFrame:
    """``known`` restricted to ``wanted``; an unknown id is an error."""
    missing = wanted.join(known, key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise ValueError(f"unknown ids: {[r[0] for r in missing]}")
    return known.join(wanted.select(key).distinct(), key, "left_semi")
