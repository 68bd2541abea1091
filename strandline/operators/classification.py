"""Metrics of classifiers over prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Mean F1 over the labels seen in truth or prediction; a label without hits counts 0."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    cells = rows.select(F.explode(F.array(F.struct(F.col("y_true").alias("y"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("h")), F.struct(F.col("y_pred").alias("y"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("h")))).alias("c"))
    per = cells.select("c.*").groupBy("y").agg(F.sum("h").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    return per.agg(F.avg(2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def top_k_accuracy(rows: DataFrame, k: int) -> DataFrame:
    """Share of rows whose y_true is among the k largest ``scores`` (array by class); ties go to the lower class."""
    ranked = F.array_sort(F.transform("scores", lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    top = F.transform(F.slice(ranked, 1, k), lambda x: x["i"])
    return rows.agg(F.avg(F.array_contains(top, F.col("y_true")).cast("double")).alias("top_k"))


def majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """majority (of train, the smallest label of equals), and its accuracy on test."""
    counts = train.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max_by("y_true", F.struct("n", -F.col("y_true"))).alias("majority")).first()["majority"]
    return test.agg(F.lit(best).alias("majority"), F.avg((F.col("y_true") == best).cast("double")).alias("accuracy"))


def chance(rows: DataFrame) -> DataFrame:
    """One over the number of classes, which is the largest label plus one."""
    return rows.agg((1 / (F.max("y_true") + 1)).alias("chance"))
