"""Operators over feature vectors (video_id, clip_idx, embedding)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators.sequences import transitions


def normalised(features: DataFrame) -> DataFrame:
    return features.withColumn("embedding", V.l2_normalise(F.col("embedding")))


def copy_mse(features: DataFrame, lag: int) -> DataFrame:
    """Mean squared error per element of predicting a clip by the one ``lag`` before."""
    pairs = transitions(features, lag)
    error = V.squared_distance(F.col("embedding"), F.col("later"))
    return pairs.agg((F.sum(error) / F.sum(F.size("embedding"))).alias("copy_mse"), F.count(F.lit(1)).alias("n_pairs"))


def change_scores(features: DataFrame) -> DataFrame:
    """video_id, clip_idx, change: one minus the cosine to the clip before; a video's first clip has none."""
    unit = normalised(features)
    before = F.lag("embedding").over(W.partitionBy("video_id").orderBy("clip_idx"))
    scored = unit.withColumn("before", before).where("before is not null")
    return scored.select("video_id", "clip_idx", (1 - V.dot(F.col("embedding"), F.col("before"))).alias("change"))


def top_changes(scores: DataFrame, k: int) -> DataFrame:
    """The k largest changes of each video as boundaries; ties go to the later clip."""
    order = W.partitionBy("video_id").orderBy(F.desc("change"), F.desc("clip_idx"))
    return scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("video_id", "clip_idx", "change")


def group_means(features: DataFrame, key: str) -> DataFrame:
    """key, mean (array): partial sums per dimension are merged before the shuffle."""
    cells = features.select(key, F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy(key, "dim").agg(F.avg("x").alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def residuals(features: DataFrame, key: str) -> DataFrame:
    """Features minus their group's mean."""
    return features.join(group_means(features, key), key).withColumn("embedding", V.minus(F.col("embedding"), F.col("mean"))).drop("mean")


def dimension_stats(features: DataFrame) -> DataFrame:
    """dim, mean, sd (sample)."""
    cells = features.select(F.posexplode("embedding").alias("dim", "x"))
    return cells.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def standardised(features: DataFrame, train: DataFrame) -> DataFrame:
    """(x - mean) / (sd + 1e-6) by the training rows' statistics: one short row, whose size is the dimension."""
    s = dimension_stats(train).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("s")).first()["s"]
    mean, sd = F.array(*[F.lit(x["mean"]) for x in s]), F.array(*[F.lit((x["sd"] or 0.0) + 1e-6) for x in s])
    return features.withColumn("embedding", F.zip_with(V.minus(F.col("embedding"), mean), sd, lambda a, b: a / b))


def nearest_code(features: DataFrame, codebook: DataFrame) -> DataFrame:
    """Add ``code``: the nearest row of codebook (code, vec); ties go to the lowest code.

    A codebook is a parameter of a few hundred rows; it travels as a broadcast.
    """
    rows = sorted(codebook.select("code", "vec").collect(), key=lambda r: r["code"])
    shared = features.sparkSession.sparkContext.broadcast((np.array([r["code"] for r in rows]), np.array([r["vec"] for r in rows], float)))

    @F.pandas_udf("int")
    def find(x: pd.Series) -> pd.Series:
        codes, table = shared.value
        data = np.stack(x.to_numpy())
        out = np.empty(len(data), np.int32)
        for k in range(0, len(data), 1024):
            part = data[k : k + 1024]
            out[k : k + 1024] = codes[((part[:, None, :] - table[None]) ** 2).sum(2).argmin(1)]
        return pd.Series(out)

    return features.withColumn("code", find("embedding"))


def code_usage(coded: DataFrame) -> DataFrame:
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def dead_codes(codebook: DataFrame, coded: DataFrame) -> DataFrame:
    return codebook.select("code").join(code_usage(coded), "code", "left_anti")


def group_subspace(features: DataFrame, key: str, keep: float = 1e-3) -> np.ndarray:
    """Orthonormal rows spanning the groups' means around the global mean; a row a group reaches the driver."""
    means = np.array([r["mean"] for r in group_means(features, key).orderBy(key).collect()])
    overall = np.array(group_means(features.withColumn("all", F.lit(0)), "all").first()["mean"])
    _, sizes, rows = np.linalg.svd(means - overall, full_matrices=False)
    return rows[sizes > keep * sizes[0]]


def project_out(features: DataFrame, basis: np.ndarray) -> DataFrame:
    """Features without their part in the span of ``basis``."""
    shared = features.sparkSession.sparkContext.broadcast(basis)

    @F.pandas_udf("array<double>")
    def remove(x: pd.Series) -> pd.Series:
        data, q = np.stack(x.to_numpy()), shared.value
        return pd.Series(list(data - (data @ q.T) @ q))

    return features.withColumn("embedding", remove("embedding"))
