import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import classification, hierarchy, intervals, learning, matching, sequences, splits, vectors


def tokens(spark, *streams):
    return spark.createDataFrame([(v, p, t) for v, s in enumerate(streams) for p, t in enumerate(s)], "video_id long, pos long, token int")


def match(spark, pred, true, tol):
    one = lambda xs: spark.createDataFrame([(1, float(x), tol) for x in xs], "video_id long, t double, tol double")
    videos = spark.createDataFrame([(1, tol)], "video_id long, tol double")
    return matching.boundary_scores(videos, one(pred).drop("tol"), one(true).drop("tol"), ["video_id", "tol"]).first()


@pytest.mark.parametrize(
    ("pred", "true", "tol", "tp", "f1"),
    [([1, 2], [1.4, 2.4], 1.0, 2, 1.0), ([0, 1], [0.9, 1.9], 1.0, 1, 0.5), ([0], [1], 1.0, 1, 1.0), ([], [1], 1.0, 0, 0.0), ([1], [], 1.0, 0, 0.0), ([], [], 1.0, 0, 0.0)],
)
def test_greedy_match(spark, pred, true, tol, tp, f1):
    row = match(spark, pred, true, tol)
    assert (row.tp, row.f1) == (tp, f1)


def test_greedy_match_against_brute_force(spark):
    rng = random.Random(1)
    for _ in range(4):
        pred, true = (sorted({rng.randrange(100) for _ in range(15)}) for _ in range(2))
        found, p, g = 0, set(), set()
        for _, i, j in sorted((abs(a - b), i, j) for i, a in enumerate(pred) for j, b in enumerate(true) if abs(a - b) <= 5):
            if i not in p and j not in g:
                found, p, g = found + 1, p | {i}, g | {j}
        assert match(spark, pred, true, 5.0).tp == found


@pytest.mark.parametrize("rounds", [0, 1, 64])
def test_list_hits_against_brute_force(rounds):
    """Many rows at once, short of rounds or not: the same hits as pair by pair, with chains of equal distances and empty rows."""
    rng = random.Random(3)
    rows = [(sorted({rng.randrange(40) / 2 for _ in range(rng.randrange(12))}), sorted({rng.randrange(40) / 2 for _ in range(rng.randrange(12))})) for _ in range(60)]
    rows.append(([0.0, 2.0, 4.0, 6.0, 8.0], [1.0, 3.0, 5.0, 7.0]))
    want = []
    for pred, true in rows:
        p, g = set(), set()
        for _, i, j in sorted((abs(a - b), i, j) for i, a in enumerate(pred) for j, b in enumerate(true) if abs(a - b) <= 1):
            if i not in p and j not in g:
                p, g = p | {i}, g | {j}
        want.append(len(p))
    flat = lambda side: (np.repeat(np.arange(len(rows)), [len(r[side]) for r in rows]), np.array([t for r in rows for t in r[side]]))
    assert matching.list_hits(*flat(0), *flat(1), len(rows), 1.0, rounds).tolist() == want


def test_random_draws_are_matched_within_rows(spark):
    """No window, and no trial or draw as a key of a shuffle: the lists of a row meet in place."""
    counts = spark.createDataFrame([(1, 5, 30, 1.0, [2.0, 9.0]), (2, 25, 30, 2.0, [4.0])], "video_id long, n_pred long, n_pos long, cps double, true array<double>")
    hits = matching.drawn_hits(splits.drawn_lists(counts, ["video_id"], 8, 5, "cps", "true"), ["video_id"], 1.0)
    plain = splits.drawn_positions(counts, ["video_id"], 8, 5).join(counts.select("video_id", "cps"), "video_id").select("video_id", "trial", (F.col("t") / F.col("cps")).alias("t"), F.lit(1.0).alias("tol"))
    true = counts.select("video_id", F.explode("true").alias("t"), F.lit(1.0).alias("tol"))
    each = true.crossJoin(spark.range(8).select(F.col("id").cast("int").alias("trial")))
    keys = ["video_id", "trial"]
    want = matching.greedy_matches(matching.candidates(plain, each, keys), keys).groupBy("video_id").agg(F.sum("tp"))
    assert sorted(map(tuple, hits.groupBy("video_id").agg(F.sum("tp")).collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_runs_and_stats(spark):
    t = tokens(spark, [5, 5, 7, 5])
    runs = sequences.run_length_encode(t).orderBy("start").collect()
    assert [(r.symbol, r.start, r.length) for r in runs] == [(5, 0, 2), (7, 2, 1), (5, 3, 1)]
    assert sorted(r.pos for r in sequences.run_boundaries(sequences.run_length_encode(t)).collect()) == [2, 3]
    s = sequences.token_stats(t, 9).first()
    assert (s.n_tokens, s.n_unique, s.n_changes, s.max_run_length, s.codebook_size) == (4, 2, 2, 2, 9)
    assert s.mean_run_length == pytest.approx(4 / 3)


def test_perplexity_purity_information(spark):
    assert sequences.perplexity(tokens(spark, [0, 1, 2, 3])).first()[0] == pytest.approx(4)
    assert sequences.perplexity(tokens(spark, [3, 3])).first()[0] == pytest.approx(1)
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "t string, l int")
    assert sequences.purity(rows, "t", "l").first()[0] == 0.75
    same = spark.createDataFrame([("a", 1), ("b", 2)], "t string, l int")
    assert sequences.mutual_information(same, "t", "l").first()[0] == pytest.approx(1)
    assert math.isnan(sequences.mutual_information(rows.where("l = 1"), "t", "l").first()[0])
    assert math.isnan(sequences.purity(rows.limit(0), "t", "l").first()[0])


def test_windows_and_lag(spark):
    items = spark.createDataFrame([(1, 10)], "id long, n long")
    starts = lambda stride: [r.start for r in sequences.count_windows(items, "n", 4, stride).orderBy("start").collect()]
    assert (starts(4), starts(2), starts(6)) == ([0, 4], [0, 2, 4, 6], [0, 6])
    assert sequences.count_windows(items, "n", 11, 1).count() == 0
    f = spark.createDataFrame([(1, k, [float(k)]) for k in range(5)], "video_id long, clip_idx long, embedding array<double>")
    assert sequences.transitions(f, 3).count() == 2
    assert sequences.transitions(f, 5).count() == 0
    assert vectors.copy_mse(f, 3).first().copy_mse == 9


def test_interval_labels(spark):
    videos = spark.createDataFrame([(1,)], "video_id long")
    rows = [(1, 1, 0, 200, 1), (2, 1, 100, 300, 2)]
    make = lambda x: spark.createDataFrame(x, "id long, video_id long, start long, stop long, verb int")
    labels = lambda x: [r.label for r in intervals.clip_labels(videos, make(x), 100, 4).orderBy("clip_idx").collect()]
    assert labels(rows) == [1, 2, 2, -1]
    more = [*rows, (3, 1, 0, 400, None)]
    assert labels(more) == [1, 2, 2, -1]
    bounds = intervals.interval_boundaries(make(more), 400)
    assert sorted(r.t for r in bounds.collect()) == [100, 200, 300]
    assert sorted(r.clip_idx for r in intervals.snapped_boundaries(bounds, 100, 4).collect()) == [1, 2, 3]


def plain_merges(streams, steps):
    """The merge procedure over lists of (symbol, start)."""
    runs = [[(x, k) for k, x in enumerate(s) if not k or s[k - 1] != x] for s in streams]
    new, out = max(x for s in runs for x, _ in s), []
    for _ in range(steps):
        counts = Counter()
        for s in runs:
            counts.update((a, b) for (a, _), (b, _) in zip(s, s[1:], strict=False))
        if not counts or counts.most_common(1)[0][1] < 2:
            break
        (a, b), n = counts.most_common(1)[0]
        new += 1
        for s in runs:
            k = 0
            while k < len(s) - 1:
                if (s[k][0], s[k + 1][0]) == (a, b):
                    s[k : k + 2] = [(new, s[k][1])]
                k += 1
        out.append((a, b, new, n))
    return out, [[p for _, p in s] for s in runs]


def test_merges_against_lists(spark):
    rng = random.Random(6)
    streams = [[rng.randrange(3) for _ in range(40)] for _ in range(4)]
    h = hierarchy.merge_hierarchy(tokens(spark, *streams), [0, 3, 12])
    want, ends = plain_merges(streams, 12)
    assert [m[1:] for m in h.merges] == want
    got = {}
    for r in h.boundaries.where("merges = 12").collect():
        got.setdefault(r.video_id, []).append(r.pos)
    assert {v: sorted(p) for v, p in got.items()} == {v: p[1:] for v, p in enumerate(ends) if len(p) > 1}
    low, high = ({(r.video_id, r.pos) for r in h.boundaries.where(f"merges = {m}").collect()} for m in (3, 12))
    assert high <= low


def test_self_pairs(spark):
    make = lambda *s: spark.createDataFrame([(1, [(x, k) for k, x in enumerate(s)])], f"video_id long, sy {hierarchy._ITEM}")
    for n in range(2, 8):
        out = hierarchy.rewrite(make(*[4] * n), 4, 4, 5).first().sy
        assert [(x.s, x.st) for x in out] == [(5, k) for k in range(0, n - 1, 2)] + ([(4, n - 1)] if n % 2 else [])
    assert hierarchy.best_pair(make(4, 4, 4)) == (4, 4, 2)
    out = hierarchy.rewrite(make(1, 2, 1, 2, 3), 1, 2, 4).first().sy
    assert [(x.s, x.st) for x in out] == [(4, 0), (4, 2), (3, 4)]


def test_levels():
    assert hierarchy.geometric_levels(1500, 25) == [0, 1, 2, 3, 5, 6, 8, 11, 16, 21, 29, 39, 53, 71, 97, 131, 178, 241, 327, 443, 601, 815, 1106, 1500]


def test_shards(spark):
    items = spark.createDataFrame([(k, w) for k, w in enumerate([5, 4, 3, 3])], "id long, w long")
    rows = hierarchy.balanced_shards(items, 2, "id", "w").collect()
    assert sorted((r.shard, r.id) for r in rows) == [(0, 0), (0, 3), (1, 1), (1, 2)]


def test_placed_runs_against_a_heap():
    rng = random.Random(7)
    for _ in range(300):
        n_shards, totals = rng.randrange(1, 6), None
        totals, taken = [0] * n_shards, [0] * n_shards
        plain, ranks = [0] * n_shards, [0] * n_shards
        for w in sorted({rng.randrange(0, 12) for _ in range(4)}, reverse=True):
            n = rng.randrange(1, 40)
            runs = hierarchy.placed_runs(totals, taken, w, n)
            assert len(runs) <= 2 * n_shards
            for k in range(n):
                s = min(range(n_shards), key=lambda x: (plain[x], x))
                r = next(r for r in runs if r["lo"] <= k < r["lo"] + r["n"])
                at, turn = (k - r["lo"]) % len(r["shards"]), (k - r["lo"]) // len(r["shards"])
                assert (r["shards"][at], r["ranks"][at] + turn) == (s, ranks[s])
                plain[s] += w
                ranks[s] += 1
            assert (totals, taken) == (plain, ranks)


def test_drawn_boundaries_are_uniform(spark):
    drawn = splits.random_boundaries(spark.createDataFrame([(1, 20)], "video_id long, n_pred long"), 101, 400, 5)
    n = {r.t: r["count"] for r in drawn.groupBy("t").count().collect()}
    assert sum(n.values()) == 8000 and set(n) <= set(range(1, 101)) and len(n) == 100
    assert sum((x - 80) ** 2 / 80 for x in n.values()) < 150  # chi square with 99 degrees of freedom, at most


def test_splits(spark):
    one = splits.heldout_video(spark.createDataFrame([("p", 1)], "participant string, video_id long"), 0.2, 1)
    assert one.first().is_test
    rows = splits.random_clip(spark.range(100).withColumnRenamed("id", "k"), ["k"], 0.29, 3)
    assert rows.where("is_test").count() == 28 and rows.count() == 100
    drawn = splits.random_boundaries(spark.createDataFrame([(1, 5), (2, 0), (3, 99)], "video_id long, n_pred long"), 10, 3, 1)
    assert {(r.video_id, r.trial): r.n for r in drawn.groupBy("video_id", "trial").agg(F.countDistinct("t").alias("n")).collect()} == {(v, t): n for v, n in ((1, 5), (3, 9)) for t in range(3)}


def test_classification(spark):
    rows = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y_true int, y_pred int")
    assert classification.macro_f1(rows).first().macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    train = spark.createDataFrame([(3,), (1,), (1,), (3,)], "y_true int")
    assert classification.majority_baseline(train, rows).first().majority == 1
    assert classification.chance(train).first().chance == 0.25


def test_vectors(spark):
    f = spark.createDataFrame([(1, k, [float(1 + 2 * k), 4.0]) for k in range(2)], "video_id long, clip_idx long, embedding array<double>")
    s = vectors.dimension_stats(f).where("dim = 0").first()
    assert (s["mean"], s["sd"]) == (2, pytest.approx(math.sqrt(2)))
    assert vectors.standardised(f, f).orderBy("clip_idx").first().embedding[0] == pytest.approx(-1 / (math.sqrt(2) + 1e-6))
    left = vectors.residuals(f, "video_id").agg(F.sum(F.col("embedding")[0]), F.sum(F.col("embedding")[1])).first()
    assert tuple(left) == (0, 0)
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 4.0]), (2, [1.0, 4.0])], "code int, vec array<double>")
    coded = vectors.nearest_code(f, book)
    assert {r.code for r in coded.collect()} == {1}
    assert {r.code for r in vectors.dead_codes(book, coded).collect()} == {0, 2}


def test_projection_is_idempotent(spark):
    rng = np.random.default_rng(0)
    f = spark.createDataFrame([(k % 3, k, [float(x) for x in rng.normal(size=5) + k % 3]) for k in range(30)], "participant long, clip_idx long, embedding array<double>")
    q = vectors.group_subspace(f, "participant")
    once = vectors.project_out(f, q)
    twice = vectors.project_out(once, q)
    a, b = ({r.clip_idx: r.embedding for r in x.collect()} for x in (once, twice))
    assert all(np.allclose(a[k], b[k]) for k in a)
    assert np.allclose(np.array(list(a.values())) @ q.T, 0)


def test_probe_learns_and_quantiser_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    hidden = learning.Probe(hidden=32, epochs=150, batch=64, rate=1e-2).fit(x, y)
    assert (hidden.scores(x).argmax(1) == y).mean() > 0.9
    q = learning.Quantiser(3, latent=2, codes=4, hidden=(5, 4), decoder_hidden=(4, 5), seed=2)
    now, later, noise = rng.normal(size=(7, 3)), rng.normal(size=(7, 3)), rng.normal(size=(7, 2))
    _, grads, _ = q.loss_and_grads(now, later, noise)
    for p, g in zip(q.params, grads, strict=True):
        at = tuple(int(rng.integers(n)) for n in p.shape)
        keep = p[at]
        p[at] = keep + 1e-6
        up = q.loss_and_grads(now, later, noise)[0]
        p[at] = keep - 1e-6
        down = q.loss_and_grads(now, later, noise)[0]
        p[at] = keep
        assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def test_quantiser_beats_copying():
    rng = np.random.default_rng(3)
    moves = rng.normal(size=(4, 5))
    now = rng.normal(size=(800, 5))
    later = now + moves[rng.integers(4, size=800)]
    q = learning.Quantiser(5, latent=8, codes=8, hidden=32, seed=1)
    assert q.fit(now, later, epochs=40, batch=64)[-1] < 0.5 * ((later - now) ** 2).mean()


def test_samples_send_no_more_than_they_hold(spark):
    """The smallest keys, without an ordered limit, which sends the driver as many rows of every task."""
    rows = spark.range(3000).select("id", (F.col("id") * 2).alias("y"))
    order = [r.y for r in rows.orderBy(learning.md5_key(F.lit("fit"), F.col("id"))).collect()]
    ran = []
    collect = type(rows).toPandas
    type(rows).toPandas = lambda self: ran.append((collect(self), self._jdf.queryExecution().optimizedPlan().toString())) or ran[-1][0]
    try:
        for most in (0, 1, 100, 2999, 3000, 5000):
            assert learning.sampled(rows, ["id"], ["y"], most)["y"].tolist() == order[:most]
            got, plan = ran.pop()
            assert "Limit" not in plan and len(got) <= most + 10
    finally:
        type(rows).toPandas = collect


def test_probe_report_against_numpy(spark):
    """Every metric of a fit from the model's own scores, computed by hand; an empty test split is skipped."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 7, 300)
    x[:, 0] += y
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]], int(y[k]), bool(k % 4 == 0), False) for k in range(300)], "id long, embedding array<double>, y int, s boolean, none boolean")
    got = {(r.split, r.model, r.metric): r.value for r in learning.probe_report(rows, ["id"], [learning.Fit("y", s, m) for s in ("s", "none") for m in ("linear", "mlp")], hidden=16, epochs=60).collect()}
    assert {s for s, *_ in got} == {"s"} and len(got) == 2 * len(learning.METRIC_NAMES)
    train, test = np.arange(300) % 4 != 0, np.arange(300) % 4 == 0
    order = [r.id for r in rows.where("not s").orderBy(learning.md5_key(F.lit("fit"), F.col("id"))).collect()]
    for kind, hidden in (("linear", None), ("mlp", 16)):
        score = learning.Probe(hidden, 60).fit(x[order], y[order]).scores(x[test])
        said, true = score.argmax(1), y[test]
        f1 = [2 * ((said == c) & (true == c)).sum() / ((said == c).sum() + (true == c).sum()) for c in sorted({*said, *true})]
        top5 = np.mean([t in np.argsort(-s)[:5] for s, t in zip(score, true, strict=True)])
        common = np.bincount(y[train]).argmax()
        want = {"top1": (said == true).mean(), "top5": top5, "macro_f1": np.mean(f1), "majority_top1": (true == common).mean(), "chance_top1": 1 / 7, "n_train": 225, "n_test": 75, "n_classes": 7}
        for metric, value in want.items():
            assert got["s", kind, metric] == pytest.approx(value, abs=1e-6), metric


def test_scene_projection_against_numpy(spark):
    rng = np.random.default_rng(4)
    x, part = rng.normal(size=(60, 6)), np.arange(60) % 4
    x += rng.normal(size=(4, 6))[part]
    f = spark.createDataFrame([(int(part[k]), k, [float(v) for v in x[k]]) for k in range(60)], "participant long, clip_idx long, embedding array<double>")
    got = {r.clip_idx: r.embedding for r in vectors.project_out(f, vectors.group_subspace(f, "participant")).collect()}
    means = np.stack([x[part == p].mean(0) for p in range(4)]) - x.mean(0)
    values, basis = np.linalg.eigh(means.T @ means)
    q = basis[:, np.sqrt(np.maximum(values, 0)) > 1e-3 * np.sqrt(values.max())]
    want = x - x @ q @ q.T
    assert all(np.allclose(got[k], want[k], atol=1e-8) for k in got)


def test_training_streams_all_pairs_and_scores_held_out_videos(spark):
    rng = np.random.default_rng(3)
    moves = rng.normal(size=(4, 5))
    now = rng.normal(size=(900, 5))
    later = now + moves[rng.integers(4, size=900)]
    rows = spark.createDataFrame([(k, now[k].tolist(), later[k].tolist()) for k in range(900)], "id long, embedding array<double>, later array<double>")
    held = rows.where("id % 5 = 0")
    done = learning.train_quantiser(rows.where("id % 5 <> 0"), held, ["id"], epochs=25, batch=64, latent=8, codes=8, hidden=32)
    at = np.arange(900) % 5 == 0
    assert done.copy_mse == pytest.approx(((later - now)[at] ** 2).mean())
    assert done.history[-1][1] == pytest.approx(((done.model.reconstruct(now[at], later[at]) - later[at]) ** 2).mean())
    assert len(done.history) == 25 and done.percent_better() > 40 and 1 <= done.history[-1][2] <= 8
