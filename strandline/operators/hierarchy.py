"""Hierarchical merging of token streams, pair by pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import matching, splits
from strandline.operators.sequences import run_length_encode
from strandline.scratch import drop, materialise

_ITEM = "array<struct<s:int,st:int>>"


class Flat:
    """The symbols of a batch's sequences, end to end: row, symbol, start."""

    def __init__(self, sequences: pa.ListArray):
        offsets, items = np.asarray(sequences.offsets, dtype=np.int64), sequences.flatten()
        self.rows = len(sequences)
        self.row = np.repeat(np.arange(self.rows), np.diff(offsets))
        self.s, self.st = (np.asarray(items.field(k), dtype=np.int64).copy() for k in (0, 1))

    def merge(self, a: int, b: int, new: int) -> None:
        """Replace (a, b) from left to right without overlap; a merged symbol keeps its first start."""
        at = np.flatnonzero((self.s[:-1] == a) & (self.s[1:] == b) & (self.row[:-1] == self.row[1:]))
        if a == b and len(at):  # of pairs that follow one another every second one
            first = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
        self.s[at] = new
        keep = np.ones(len(self.s), bool)
        keep[at + 1] = False
        self.row, self.s, self.st = self.row[keep], self.s[keep], self.st[keep]

    def lists(self) -> pa.ListArray:
        items = pa.StructArray.from_arrays([pa.array(self.s, pa.int32()), pa.array(self.st, pa.int32())], ["s", "st"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(self.row, np.arange(self.rows + 1)), pa.int32()), items)


Merge = tuple[int, int, int]


def rewritten(streams: DataFrame, merges: list[Merge]) -> DataFrame:
    """The streams after these merges, one after another."""
    if not merges:
        return streams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat(batch.column("sy"))
            for merge in merges:
                flat.merge(*merge)
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), flat.lists()], ["video_id", "sy"])

    return streams.select("video_id", "sy").mapInArrow(run, f"video_id {streams.schema['video_id'].dataType.simpleString()}, sy {_ITEM}")


def rewrite(streams: DataFrame, a: int, b: int, new: int) -> DataFrame:
    return rewritten(streams, [(a, b, new)])


def pair_counts(streams: DataFrame, merges: list[Merge] = ()) -> DataFrame:
    """a, b, n, first: adjacent symbols after these merges, overlaps counted, and where each pair is met first; a batch's pairs are counted before the shuffle."""
    kind = streams.schema["video_id"].dataType.simpleString()
    names = ["a", "b", "n", "video_id", "i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat(batch.column("sy"))
            for merge in merges:
                flat.merge(*merge)
            inner = np.flatnonzero(flat.row[:-1] == flat.row[1:])
            ids = batch.column("video_id")
            place = np.empty(len(ids), np.int64)
            place[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
            row, i = flat.row[inner], inner - np.searchsorted(flat.row, flat.row[inner])
            order = np.lexsort((i, place[row], flat.s[inner + 1], flat.s[inner]))
            a, b, row, i = flat.s[inner][order], flat.s[inner + 1][order], row[order], i[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(a[at], pa.int32()), pa.array(b[at], pa.int32()), pa.array(np.diff(np.append(at, len(a)))), ids.take(pa.array(row[at])), pa.array(i[at])], names)

    each = streams.select("video_id", "sy").mapInArrow(run, f"a int, b int, n long, video_id {kind}, i long")
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("video_id", "i")).alias("first"))


def best_pair(streams: DataFrame, merges: list[Merge] = ()):
    """The commonest pair as a row (a, b, n), the one met first of equals; None if none occurs twice."""
    row = pair_counts(streams, merges).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "a", "b")).alias("r")).first()["r"]
    return None if row is None or -row["m"] < 2 else (row["a"], row["b"], -row["m"])


def run_streams(tokens: DataFrame) -> DataFrame:
    """(video_id, sy): a sequence's runs as symbols with their starts."""
    runs = run_length_encode(tokens)
    items = F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("st"), F.col("symbol").cast("int").alias("s"))))  # one sequence
    return runs.groupBy("video_id").agg(F.transform(items, lambda x: F.struct(x["s"].alias("s"), x["st"].alias("st"))).cast(_ITEM).alias("sy"))


@dataclass
class Hierarchy:
    """The merge table and the boundaries of the levels asked for."""

    merges: list[tuple[int, int, int, int, int]]  # step, a, b, new, count
    boundaries: DataFrame  # merges, video_id, pos


def boundaries_of(streams: DataFrame, merges: int) -> DataFrame:
    starts = F.expr("transform(slice(sy, 2, greatest(size(sy) - 1, 0)), x -> x.st)")
    return streams.where(F.size("sy") > 1).select(F.lit(merges).alias("merges"), "video_id", F.explode(starts).alias("pos"))


def geometric_levels(most: int, points: int) -> list[int]:
    """0 and geometrically spaced merge counts up to ``most``, whole and distinct."""
    if most < 1 or points < 1:
        return [0]
    steps = [most ** (i / max(1, points - 1)) for i in range(points)] if points > 1 else [1.0]
    return sorted({0, *(int(round(s)) for s in steps)})


def merge_hierarchy(tokens: DataFrame, levels: list[int], store_every: int = 16) -> Hierarchy:
    """Merge the commonest pair again and again, keeping boundaries at ``levels``; levels past the last merge are missing.

    A step is one pass over the streams as last stored, which applies the merges
    since then and counts pairs; the driver sees one pair a step.  Streams are
    stored anew every ``store_every`` merges, and deleted if no level reads them.
    """
    streams = materialise(run_streams(tokens), "streams")
    symbol = streams.agg(F.max(F.expr("array_max(transform(sy, x -> x.s))")).alias("m")).first()["m"]
    merges, kept, since, needed = [], [], [], 0 in levels
    if needed:
        kept.append(boundaries_of(streams, 0))
    for step in range(1, max(levels) + 1):
        pair = best_pair(streams, since)
        if pair is None:
            break
        a, b, n = pair
        symbol += 1
        since.append((a, b, symbol))
        merges.append((step, a, b, symbol, n))
        if len(since) == store_every:
            last, streams = streams, materialise(rewritten(streams, since), "streams")
            if not needed:
                drop(last)
            since, needed = [], False
        if step in levels:
            kept.append(boundaries_of(rewritten(streams, list(since)), step))
            needed = True
    out = kept[0]
    for level in kept[1:]:
        out = out.unionByName(level)
    return Hierarchy(merges, out)


def eligible(tokens: DataFrame, truth: DataFrame, meta: DataFrame) -> DataFrame:
    """video_id, n_pos, n_gt, cps of videos with two tokens or more, a true boundary and clip meta (video_id, fps, n_clip_frame); others are left out of the corpus and of all means."""
    n_pos = tokens.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_pos")).where("n_pos >= 2")
    n_gt = truth.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_gt"))
    return n_pos.join(n_gt, "video_id").join(meta.select("video_id", (F.col("fps") / F.col("n_clip_frame")).alias("cps")), "video_id")


def level_report(tokens: DataFrame, truth: DataFrame, meta: DataFrame, levels: list[int], tolerance: float, trials: int, seed: int) -> DataFrame:
    """merges, n_videos, model_f1, random_f1, n_boundaries: means over all eligible videos, one without boundaries at a level scoring 0.

    ``truth`` has video_id, t in seconds; a position counts as position / cps
    seconds.  The baseline of a video and level is the mean over ``trials`` draws of
    as many positions.
    """
    videos = materialise(eligible(tokens, truth, meta), "eligible")
    some = tokens.join(videos.select("video_id"), "video_id", "left_semi")
    found = materialise(merge_hierarchy(some, levels).boundaries, "boundaries")
    keys = ["video_id", "merges"]
    reached = found.select("merges").distinct()
    base = videos.join(reached, how="cross")  # a row a level on one side: at most len(levels)
    counts = materialise(base.join(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred")), keys, "left").na.fill(0, ["n_pred"]), "counts")
    tol = F.lit(float(tolerance)).alias("tol")
    truth = truth.join(videos.select("video_id"), "video_id", "left_semi").select("video_id", F.col("t").cast("double").alias("t"), tol)
    seconds = lambda df, by: df.join(videos.select("video_id", "cps"), "video_id").select(*by, (F.col("t") / F.col("cps")).alias("t"), tol)
    own = seconds(found.withColumnRenamed("pos", "t"), keys)
    model = matching.greedy_matches(matching.candidates(own, truth.join(reached, how="cross"), keys), keys)
    lists = truth.groupBy("video_id").agg(F.sort_array(F.collect_list("t")).alias("true"))  # one video
    drawn = splits.drawn_lists(counts.join(lists, "video_id"), keys, trials, seed, "cps", "true")
    chance = matching.drawn_hits(drawn, keys, float(tolerance)).groupBy(*keys).agg((F.sum("tp") / trials).alias("tp"))
    for name, hits in (("model_f1", model), ("random_f1", chance)):
        f1 = F.when(F.col("n_pred") > 0, 2 * F.col("tp") / (F.col("n_pred") + F.col("n_gt"))).otherwise(F.lit(0.0))
        counts = counts.join(hits, keys, "left").na.fill(0, ["tp"]).withColumn(name, f1).drop("tp")
    return counts.groupBy("merges").agg(F.count(F.lit(1)).alias("n_videos"), F.avg("model_f1").alias("model_f1"), F.avg("random_f1").alias("random_f1"), F.avg("n_pred").alias("n_boundaries"))


def best_level(scores: DataFrame) -> DataFrame:
    """The level (merges, model_f1, random_f1) with the largest gain; the fewest merges of equals."""
    gain = F.col("model_f1") - F.col("random_f1")
    pick = F.max_by(F.struct("merges", "model_f1", "random_f1", gain.alias("gain")), F.struct(F.round(gain, 9), -F.col("merges")))
    return scores.agg(pick.alias("r")).select("r.*")


def balanced_shards(items: DataFrame, n_shards: int, ident: str, weight: str) -> DataFrame:
    """shard, rank, id, weight by longest processing time: heaviest first, each to the lightest shard, the lowest of equals.

    Only weights and their counts are placed one after another, that stream being
    sequential by nature: items of one weight go round the lightest shards in a
    fixed order until the next shard is as light, so a weight is at most as many
    runs as there are shards.  Items take their place in a run by their rank within
    the weight, which is counted from per-cell totals, so no task sorts all items
    of one weight.
    """
    from strandline.session import shuffle_width

    clean = items.select(F.col(ident).alias("id"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("weight"))
    counts = clean.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))

    def place(frames):
        import pandas as pd

        totals, taken = [0] * n_shards, [0] * n_shards
        for frame in frames:
            rows = [(int(w), placed_runs(totals, taken, int(w), int(n))) for w, n in zip(frame["weight"], frame["n"], strict=True)]
            yield pd.DataFrame(rows, columns=["weight", "runs"])

    run = "struct<lo:long,n:long,shards:array<int>,ranks:array<long>>"
    choices = counts.coalesce(1).sortWithinPartitions(F.desc("weight")).mapInPandas(place, f"weight long, runs array<{run}>")
    width = shuffle_width(items.sparkSession)
    lowest = clean.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    span = max(1, ((lowest["b"] or 0) - (lowest["a"] or 0)) // width + 1)
    cells = clean.withColumn("cell", F.floor((F.col("id") - F.lit(lowest["a"] or 0)) / span))
    before = cells.groupBy("weight", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("base", F.sum("n").over(W.partitionBy("weight").orderBy("cell")) - F.col("n")).drop("n")
    ranked = cells.join(before, ["weight", "cell"]).withColumn("k", F.col("base") + F.row_number().over(W.partitionBy("weight", "cell").orderBy("id")) - 1)
    found = ranked.join(choices, "weight").withColumn("r", F.expr("filter(runs, x -> x.lo <= k and k < x.lo + x.n)[0]"))
    at = F.expr("cast((k - r.lo) % size(r.shards) as int)")
    return found.withColumn("at", at).select(F.expr("r.shards[at]").alias("shard"), F.expr("r.ranks[at] + (k - r.lo) div size(r.shards)").alias("rank"), "id", "weight")


def placed_runs(totals: list[int], taken: list[int], w: int, n: int) -> list[dict]:
    """Put ``n`` items of weight ``w`` on the lightest shards one after another; updates both lists.

    A run is its first item, its items, the shards they go round, and the rank
    that the first item on each of those shards has there.
    """
    runs, lo = [], 0
    while n:
        order = sorted(range(len(totals)), key=lambda s: (totals[s], s))
        first = order[0]
        active = [s for s in order if s == first or (totals[s], s) < (totals[first] + w, first)]
        count = n
        if len(active) < len(order) and w:  # until the next shard is before the first again
            nxt = order[len(active)]
            gap = totals[nxt] - totals[first]
            rounds = -(-gap // w) - 1 if nxt < first else gap // w
            count = min(n, rounds * len(active))
        runs.append({"lo": lo, "n": count, "shards": active, "ranks": [taken[s] for s in active]})
        for k, s in enumerate(active):
            got = count // len(active) + (k < count % len(active))
            totals[s] += got * w
            taken[s] += got
        lo, n = lo + count, n - count
    return runs
