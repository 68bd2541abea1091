"""Operators over token sequences (video_id, pos, token)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order():
    return W.partitionBy("video_id").orderBy("pos")


def change_flags(tokens: DataFrame) -> DataFrame:
    """``changed``: whether a token differs from the one before; false for the first."""
    before = F.lag("token").over(_order())
    return tokens.withColumn("changed", F.coalesce(F.col("token") != before, F.lit(False)))


def run_length_encode(tokens: DataFrame) -> DataFrame:
    """video_id, run_idx, symbol, start, length of maximal runs; one sort serves flags and runs."""
    island = change_flags(tokens).withColumn("run_idx", F.sum(F.col("changed").cast("int")).over(_order()))
    runs = island.groupBy("video_id", "run_idx").agg(F.min("token").alias("symbol"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.select("video_id", "run_idx", "symbol", "start", "length")


def run_boundaries(runs: DataFrame) -> DataFrame:
    """Starts of all runs but a sequence's first."""
    return runs.where("run_idx > 0").select("video_id", F.col("start").alias("pos"))


def token_stats(tokens: DataFrame, codebook_size: int) -> DataFrame:
    """Per sequence: n_tokens, n_unique, codebook_size, n_changes, mean and longest run."""
    runs = run_length_encode(tokens)
    per = runs.groupBy("video_id").agg(
        F.sum("length").alias("n_tokens"), F.countDistinct("symbol").alias("n_unique"), (F.count(F.lit(1)) - 1).alias("n_changes"), F.avg("length").alias("mean_run_length"), F.max("length").alias("max_run_length")
    )
    return per.withColumn("codebook_size", F.lit(codebook_size))


def perplexity(tokens: DataFrame, column: str = "token") -> DataFrame:
    """exp of the entropy of all tokens: one row. Only one count per symbol is shuffled."""
    counts = tokens.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return total.select(F.exp(F.log("t") - F.col("s") / F.col("t")).alias("perplexity"))


def transitions(features: DataFrame, lag: int, column: str = "embedding") -> DataFrame:
    """Each clip with the one ``lag`` later in its video, as ``later``; the last ``lag`` clips have none and go."""
    ahead = F.lead(column, lag).over(W.partitionBy("video_id").orderBy("clip_idx"))
    return features.withColumn("later", ahead).where("later is not null")


def count_windows(items: DataFrame, n_frames: str, width: int, stride: int) -> DataFrame:
    """clip_idx, start of windows of ``width`` frames every ``stride``; a tail that doesn't fill one is dropped."""
    n = F.col(n_frames).cast("long")
    starts = F.when(n >= width, F.sequence(F.lit(0).cast("long"), n - width, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return items.select("*", F.posexplode(starts).alias("clip_idx", "start"))


def contingency(rows: DataFrame, token: str, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(F.col(token).alias("token"), F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def purity(rows: DataFrame, token: str, label: str) -> DataFrame:
    """Share of rows with their token's commonest label; NaN without rows."""
    per = contingency(rows, token, label).groupBy("token").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return per.agg(F.coalesce(F.sum("m") / F.sum("s"), F.lit(float("nan"))).alias("purity"))


def mutual_information(rows: DataFrame, token: str, label: str) -> DataFrame:
    """Mutual information over the mean of both entropies; NaN under two rows, or with one symbol on a side.

    Only the contingency counts are shuffled further; sums of n ln n give all three entropies.
    """
    cells = contingency(rows, token, label)
    x = lambda c: F.sum(F.col(c) * F.log(c))
    a = cells.groupBy("token").agg(F.sum("n").alias("n")).agg(x("n").alias("sa"), F.count(F.lit(1)).alias("ka"))
    b = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(x("n").alias("sb"), F.count(F.lit(1)).alias("kb"))
    both = cells.agg(x("n").alias("sc"), F.sum("n").alias("t"))
    one = F.lit(1).alias("one")
    all_ = both.select("*", one).join(a.select("*", one), "one").join(b.select("*", one), "one")  # one row each
    ha, hb, hc = (F.log("t") - F.col(s) / F.col("t") for s in ("sa", "sb", "sc"))
    value = F.when((F.col("ka") > 1) & (F.col("kb") > 1) & (F.col("t") > 1), (ha + hb - hc) / ((ha + hb) / 2)).otherwise(F.lit(float("nan")))
    return all_.select(value.alias("nmi"))
