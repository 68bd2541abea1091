"""Greedy one-to-one matching of boundaries within a tolerance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.metrics import precision_recall_f1


def candidates(pred: DataFrame, true: DataFrame, keys: list[str], tolerance: str = "tol") -> DataFrame:
    """keys, block, d, i, j of pairs at most ``tolerance`` apart (inclusive).

    ``pred`` and ``true`` have keys, t and the tolerance.  Both sides are binned
    by the tolerance, so the join is an equality on (keys, bin): no pair outside
    three neighbouring bins is formed.  A gap wider than the tolerance ends a
    block: no pair reaches over it.
    """
    both = pred.select(*keys, "t", F.col(tolerance).alias("most"), F.lit(0).alias("kind")).unionByName(true.select(*keys, "t", F.col(tolerance).alias("most"), F.lit(1).alias("kind")))
    line = W.partitionBy(*keys).orderBy("t", "kind")
    so_far = line.rowsBetween(W.unboundedPreceding, 0)
    apart = (F.col("t") - F.lag("t").over(line) > F.col("most")).cast("int")
    placed = both.withColumn("apart", F.coalesce(apart, F.lit(0))).select(
        *keys, "t", "most", "kind", F.sum("apart").over(so_far).alias("block"), (F.sum(1 - F.col("kind")).over(so_far) - 1).cast("int").alias("i"), (F.sum("kind").over(so_far) - 1).cast("int").alias("j"), F.floor(F.col("t") / F.col("most")).alias("cell")
    )
    p = placed.where("kind = 0").select(*keys, "block", F.col("t").alias("pt"), "i", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    g = placed.where("kind = 1").select(*keys, "block", F.col("t").alias("gt"), "j", "most", "cell")
    near = p.join(g, [*keys, "block", "cell"]).withColumn("d", F.abs(F.col("pt") - F.col("gt")))
    return near.where("d <= most").select(*keys, "block", "d", "i", "j")


def greedy_matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp: pairs taken in order of (d, i, j), each side at most once.  Greedy, not optimal.

    Blocks share no boundary, so each is folded on its own and their hits are added.
    """
    ordered = F.array_sort(F.collect_list(F.struct("d", "i", "j")))  # as many as a block has near boundaries
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("p"), none.alias("g"))

    def take(a, x):
        used = F.array_contains(a["p"], x["i"]) | F.array_contains(a["g"], x["j"])
        more = F.struct(F.array_append(a["p"], x["i"]).alias("p"), F.array_append(a["g"], x["j"]).alias("g"))
        return F.when(used, a).otherwise(more)

    each = pairs.groupBy(*keys, "block").agg(ordered.alias("c")).select(*keys, F.aggregate("c", start, take, lambda a: F.size(a["p"])).cast("long").alias("tp"))
    return each.groupBy(*keys).agg(F.sum("tp").alias("tp"))


def list_hits(row_p: np.ndarray, p: np.ndarray, row_g: np.ndarray, g: np.ndarray, rows: int, tolerance: float, rounds: int = 64) -> np.ndarray:
    """``greedy_matches`` of ``rows`` rows at once: times ``p`` and ``g`` with their rows, ascending within each row.

    A pair that comes first of all that share a side with it is taken, whatever the
    others do, so all such pairs are taken in one round.  Chains that outlast the
    rounds are gone through pair by pair.
    """
    hits = np.zeros(rows, np.int64)
    if not len(p) or not len(g):
        return hits
    least = min(p.min(), g.min())
    wide = max(p.max(), g.max()) - least + 2 * tolerance + 1
    at_p, at_g = row_p * wide + (p - least), row_g * wide + (g - least)
    slack = 4 * np.spacing(rows * wide)  # what the row's part costs in precision; settled by the distances below
    lo, hi = np.searchsorted(at_g, at_p - tolerance - slack), np.searchsorted(at_g, at_p + tolerance + slack, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(p)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
    d = np.abs(p[i] - g[j])
    near = (d <= tolerance) & (row_p[i] == row_g[j])
    i, j, d = i[near], j[near], d[near]
    order = np.argsort(d, kind="stable")  # i and j ascend already
    i, j = i[order], j[order]
    best_p, best_g = np.empty(len(p), np.int64), np.empty(len(g), np.int64)
    used_p, used_g = np.zeros(len(p), bool), np.zeros(len(g), bool)
    for _ in range(rounds):
        if not len(i):
            return hits
        rank = np.arange(len(i))
        best_p[i[::-1]], best_g[j[::-1]] = rank[::-1], rank[::-1]  # of equal places the last one stays: the first pair
        take = (best_p[i] == rank) & (best_g[j] == rank)
        used_p[i[take]], used_g[j[take]] = True, True
        hits += np.bincount(row_p[i[take]], minlength=rows)
        left = ~(used_p[i] | used_g[j])
        i, j = i[left], j[left]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if not used_p[a] and not used_g[b]:
            used_p[a] = used_g[b] = True
            hits[row_p[a]] += 1
    return hits


def drawn_hits(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """keys, tp of every row (keys, ts, cps, true): its positions ``ts`` / cps greedily matched with the ascending times ``true``.  Nothing is shuffled."""

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets, dtype=np.int64))), np.asarray(lists.flatten(), dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_p, ts = flat(batch.column("ts"))
            row_g, true = flat(batch.column("true"))
            p = ts / np.asarray(batch.column("cps"))[row_p]
            order = np.lexsort((p, row_p))
            tp = list_hits(row_p, p[order], row_g, true, len(batch), tolerance)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(tp)], [*keys, "tp"])

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "ts", F.col("cps").cast("double").alias("cps"), F.col("true").cast("array<double>").alias("true")).mapInArrow(run, f"{types}, tp long")


def boundary_scores(videos: DataFrame, pred: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pred, n_gt, tp, precision, recall, f1 of every row of ``videos`` (keys, tol); videos without boundaries score 0."""
    tp = greedy_matches(candidates(pred.join(videos, keys[:1]) if "tol" not in pred.columns else pred, true.join(videos, keys[:1]) if "tol" not in true.columns else true, keys), keys)
    count = lambda df, name: df.groupBy(keys[0]).agg(F.count(F.lit(1)).alias(name))
    out = videos.join(count(pred, "n_pred"), keys[0], "left").join(count(true, "n_gt"), keys[0], "left").join(tp, keys, "left").na.fill(0, ["n_pred", "n_gt", "tp"])
    p, r, f = precision_recall_f1(F.col("tp"), F.col("n_pred"), F.col("n_gt"))
    return out.select(*keys, "n_pred", "n_gt", "tp", p.alias("precision"), r.alias("recall"), f.alias("f1"))
