"""Writers: idempotent caches, shard lists, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Items without a stored result; all of them with ``overwrite``."""
    return items if overwrite else items.join(done.select(key), key, "left_anti")


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` has and no others; commits are atomic."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_shards(shards: DataFrame, path: str, n_shards: int) -> None:
    """Id lists, one folder per shard, its number padded to the width of the last."""
    name = F.lpad(F.col("shard").cast("string"), len(str(n_shards - 1)), "0").alias("shard")
    out = shards.select(name, "rank", F.col("video_id").cast("string").alias("value")).repartition("shard").sortWithinPartitions("shard", "rank")
    out.select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)
