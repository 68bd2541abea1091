"""Structured Streaming forms of the sequence operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream with a time column that watermarks accept."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n per window; late rows are taken up to the watermark."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n")


def online_runs(tokens: DataFrame) -> DataFrame:
    """video_id, symbol, start, length of closed runs, as tokens (video_id, pos, token) arrive in order.

    The state of a sequence is its open run alone.
    """

    def update(key: tuple, frames, state: GroupState):
        symbol, start, length = state.get if state.exists else (None, 0, 0)
        closed = []
        for row in pd.concat(list(frames)).sort_values("pos").itertuples():
            if row.token == symbol:
                length += 1
                continue
            if symbol is not None:
                closed.append((key[0], symbol, start, length))
            symbol, start, length = int(row.token), int(row.pos), 1
        if symbol is not None:
            state.update((symbol, start, length))
        yield pd.DataFrame(closed, columns=["video_id", "symbol", "start", "length"])

    return tokens.groupBy("video_id").applyInPandasWithState(update, "video_id long, symbol int, start long, length long", "symbol int, start long, length long", "append", GroupStateTimeout.NoTimeout)
