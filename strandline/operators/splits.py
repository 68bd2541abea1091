"""Splits and matched random baselines, by ranks of md5 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.metrics import md5_key
from strandline.session import shuffle_width


def heldout_video(videos: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``is_test`` for max(1, floor(fraction * n)) videos of each participant: one with a single video is held out whole."""
    key = md5_key(F.lit(seed), F.col("video_id"))
    rank = F.row_number().over(W.partitionBy("participant").orderBy(key, "video_id"))
    n = F.count(F.lit(1)).over(W.partitionBy("participant"))
    return videos.withColumn("is_test", rank <= F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction)))))


def random_clip(rows: DataFrame, ids: list[str], fraction: float, seed: int) -> DataFrame:
    """``is_test`` for exactly floor(fraction * n) rows: those with the smallest keys.

    The cut is found from counts per key prefix, a longer prefix within the one
    in which it falls, so no task sorts all rows: rows of lower prefixes are in, of
    higher ones out, and only one row in 16 million is ranked.
    """
    keyed = rows.withColumn("k", md5_key(F.lit(seed), *[F.col(c) for c in ids]))
    left, cut = None, ""
    for size in (3, 6):
        within = keyed.where(F.substring("k", 1, len(cut)) == cut) if cut else keyed
        n = within.groupBy(F.substring("k", 1, size).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # 4096 rows at most
        left, cut = int(float(fraction) * sum(r["n"] for r in n)) if left is None else left, None
        for r in n:
            if r["n"] > left:
                cut = r["p"]
                break
            left -= r["n"]
        if cut is None:
            return keyed.withColumn("is_test", F.lit(True)).drop("k")
    prefix = F.substring("k", 1, len(cut))
    edge = keyed.where(prefix == cut).withColumn("is_test", F.row_number().over(W.orderBy("k", *ids)) <= left)
    rest = keyed.where(prefix != cut).withColumn("is_test", prefix < cut)
    return rest.unionByName(edge).drop("k")


def heldout_participant(rows: DataFrame, names: list) -> DataFrame:
    return rows.withColumn("is_test", F.col("participant").isin(names))


def drawn_lists(counts: DataFrame, keys: list[str], trials: int, seed: int, *also: str) -> DataFrame:
    """keys, trial, ts, also: for counts (keys, n_pred, n_pos), min(n_pred, n_pos - 1) distinct positions of 1 .. n_pos - 1 per trial, as a list.

    Positions are drawn one after another from md5 keys, repeats skipped; where
    over a quarter of all positions is wanted, all are ranked by their keys
    instead.  Both happen within a row.  A few more draws than wanted are made
    first, the others only if too many of those were repeats.  The counts are dealt
    over all partitions, as few bytes of them make much work.
    """
    some = counts.where("n_pred > 0 and n_pos > 1").repartition(shuffle_width(counts.sparkSession), *keys)
    most, k = F.col("most"), F.col("k")
    each = some.select(*keys, *also, (F.col("n_pos") - 1).cast("int").alias("most"), F.least("n_pred", F.col("n_pos") - 1).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    each = each.withColumn("stem", F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in keys], F.col("trial").cast("string")))
    key = lambda x: md5_key(F.col("stem"), x)
    drawn = lambda last: F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda j: (F.conv(F.substring(key(j), 1, 8), 16, 10).cast("long") % most + 1).cast("int")))
    ranked = F.transform(F.sort_array(F.transform(F.sequence(F.lit(1), most), lambda t: F.struct(key(t).alias("key"), t.alias("t")))), lambda x: x["t"])
    first = each.withColumn("first", F.when(4 * k <= most, drawn(F.least(k + F.floor(k / 4).cast("int") + 8, 2 * k + 39))))
    ts = F.when(4 * k > most, ranked).when(F.size("first") >= k, F.col("first")).otherwise(drawn(2 * k + 39))
    return first.select(*keys, "trial", F.slice(ts, 1, k).alias("ts"), *also)


def drawn_positions(counts: DataFrame, keys: list[str], trials: int, seed: int) -> DataFrame:
    """keys, trial, t: ``drawn_lists``, one row a position."""
    return drawn_lists(counts, keys, trials, seed).select(*keys, "trial", F.explode("ts").alias("t"))


def random_boundaries(counts: DataFrame, n_pos: int, trials: int, seed: int) -> DataFrame:
    """video_id, trial, t: ``drawn_positions`` of videos (video_id, n_pred) that all have ``n_pos`` positions."""
    return drawn_positions(counts.withColumn("n_pos", F.lit(n_pos)), ["video_id"], trials, seed)
