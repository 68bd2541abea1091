"""Labelled intervals against a grid of clips, and the boundaries they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_boundaries(intervals: DataFrame, duration: int) -> DataFrame:
    """Distinct starts and stops strictly inside the covered span."""
    ends = intervals.select("video_id", F.explode(F.array("start", "stop")).alias("t"))
    return ends.where((F.col("t") > 0) & (F.col("t") < duration)).distinct()


def snapped_boundaries(bounds: DataFrame, clip: int, n_clips: int) -> DataFrame:
    """Boundaries as clip numbers, truncated, distinct, 1 to n_clips - 1."""
    snapped = bounds.select("video_id", F.floor(F.col("t") / clip).cast("int").alias("clip_idx")).distinct()
    return snapped.where(F.col("clip_idx").between(1, n_clips - 1))


def covered_clips(intervals: DataFrame, clip: int, n_clips: int) -> DataFrame:
    """Intervals once per clip whose centre lies in [start, stop).

    The centres are a grid, so the clips of an interval follow from arithmetic:
    the range join becomes an explode, and what follows is an equality.
    """
    half = clip // 2
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - half) / clip))
    last = F.least(F.lit(n_clips - 1), F.ceil((F.col("stop") - half) / clip) - 1)
    some = intervals.withColumn("first", first).withColumn("last", last).where("first <= last")
    return some.select("*", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("clip_idx")).drop("first", "last")


def clip_labels(videos: DataFrame, intervals: DataFrame, clip: int, n_clips: int) -> DataFrame:
    """video_id, clip_idx, label of every clip: the covering interval that starts last, -1 if none.

    Equal starts are settled by stop, then id.  Intervals without a verb give no label.
    The join is on videos; clips are laid out after it.  A joined grid of clips would
    be broadcast by the size of the videos it comes from, as soon as a filter on
    labels made that join an inner one.
    """
    cover = covered_clips(intervals.where("verb is not null"), clip, n_clips)
    best = cover.groupBy("video_id", "clip_idx").agg(F.max_by("verb", F.struct("start", "stop", "id")).alias("label"))
    hits = best.groupBy("video_id").agg(F.collect_list(F.struct("clip_idx", "label")).alias("hits"))  # n_clips at most
    clips = F.sequence(F.lit(0), F.lit(n_clips - 1))
    rest = lambda taken: F.transform(F.array_except(clips, taken), lambda c: F.struct(c.alias("clip_idx"), F.lit(-1).cast(best.schema["label"].dataType).alias("label")))
    every = F.when(F.col("hits").isNull(), rest(F.array().cast("array<int>"))).otherwise(F.concat("hits", rest(F.transform("hits", lambda h: h["clip_idx"]))))
    return videos.join(hits, "video_id", "left").select("video_id", F.explode(every).alias("c")).select("video_id", "c.clip_idx", "c.label")


def background_fraction(labels: DataFrame) -> DataFrame:
    return labels.groupBy("video_id").agg(F.avg((F.col("label") == -1).cast("double")).alias("background"))


def top_labels(labels: DataFrame, k: int) -> DataFrame:
    """The k commonest labels of each video; ties go to the larger label."""
    counts = labels.where("label >= 0").groupBy("video_id", "label").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("video_id").orderBy(F.desc("n"), F.desc("label"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def labelled(rows: DataFrame, labels: DataFrame, position: str = "clip_idx") -> DataFrame:
    """``rows`` (video_id, position) with the label of the clip at the same position; positions only one side has are dropped."""
    return rows.join(labels.select("video_id", F.col("clip_idx").alias(position), "label"), ["video_id", position])


def category_codes(taxonomy: DataFrame) -> DataFrame:
    """id, code: categories (id, category) numbered in order of their names."""
    names = taxonomy.select("category").distinct()
    return taxonomy.join(names.select("category", (F.dense_rank().over(W.orderBy("category")) - 1).alias("code")), "category").select("id", "code")  # a row a category


def coded(rows: DataFrame, column: str, taxonomy: DataFrame) -> DataFrame:
    """``rows`` with the ``code`` of their category, -1 where the taxonomy has none."""
    return rows.join(category_codes(taxonomy).withColumnRenamed("id", column), column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def video_codes(videos: DataFrame) -> DataFrame:
    """video_id, code: videos numbered in order of their ids."""
    return videos.select("video_id", (F.row_number().over(W.orderBy("video_id")) - 1).alias("code"))  # a row a video


def annotated(videos: DataFrame, intervals: DataFrame) -> DataFrame:
    """Videos with at least one interval; those without are left out."""
    return videos.join(intervals.select("video_id"), "video_id", "left_semi")
