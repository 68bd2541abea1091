"""All queries over the reference tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators import classification, hierarchy, intervals, learning, matching, sequences, splits, vectors
from strandline.plans import oracles
from strandline.sources import bindings as B
from strandline.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES = oracles.ORACLES

LAG, TOP, SEED, FRACTION, TRIALS, SHARDS = 3, 5, 7, 0.2, 200, 8
LEVELS, BASELINES = hierarchy.geometric_levels(64, 25), 20


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# --- boundaries -------------------------------------------------------------


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    tol = F.explode(F.array(*[F.lit(t) for t in B.TOLERANCES])).alias("tol")
    return matching.boundary_scores(B.videos(spark, sf).select("video_id", tol), B.boundaries(spark, sf, "purchase"), B.boundaries(spark, sf, "error"), ["video_id", "tol"])


@query
def boundary_f1_by_tolerance(spark, sf):
    return _scores(spark, sf).select("video_id", "tol", "n_pred", "n_gt", "tp", *_r("precision", "recall", "f1"))


@query
def boundary_macro_f1(spark, sf):
    return _scores(spark, sf).groupBy("tol").agg(F.avg("f1").alias("macro_f1")).select("tol", *_r("macro_f1"))


@query
def boundary_micro_f1(spark, sf):
    from strandline.functions.metrics import precision_recall_f1

    pooled = _scores(spark, sf).groupBy("tol").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gt").alias("n_gt"))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("n_pred"), F.col("n_gt"))
    return pooled.select("tol", "tp", "n_pred", "n_gt", p.alias("precision"), r.alias("recall"), f.alias("f1")).select("tol", "tp", "n_pred", "n_gt", *_r("precision", "recall", "f1"))


@query
def random_boundary_f1(spark, sf):
    """Matched random baseline: as many random clips as a video has distinct predicted ones, per trial; F1 averaged over trials."""
    clip = lambda kind: B.boundaries(spark, sf, kind).select("video_id", F.floor(F.col("t") / B.HOUR).alias("t")).distinct()
    true, counts = clip("error"), clip("purchase").groupBy("video_id").agg(F.count(F.lit(1)).alias("n_pred"))
    lists = true.groupBy("video_id").agg(F.sort_array(F.collect_list("t")).alias("true"), F.count(F.lit(1)).alias("n_gt"))  # a clip each
    both = counts.join(lists, "video_id").select("*", F.lit(B.CLIPS).alias("n_pos"), F.lit(1.0).alias("cps"))
    tp = matching.drawn_hits(splits.drawn_lists(both, ["video_id"], TRIALS, SEED, "n_pred", "n_gt", "cps", "true"), ["video_id", "n_pred", "n_gt"], 3.0)
    f1 = 2 * F.col("tp") / (F.least(F.col("n_pred"), F.lit(B.CLIPS - 1)) + F.col("n_gt"))
    means = tp.groupBy("video_id").agg((F.sum(f1) / TRIALS).alias("random_f1"))
    rows = B.videos(spark, sf).join(counts, "video_id", "left").join(means, "video_id", "left").na.fill(0)
    return rows.select("video_id", "n_pred", *_r("random_f1"))


# --- sequences --------------------------------------------------------------


@query
def rle_runs(spark, sf):
    return sequences.run_length_encode(B.tokens(spark, sf))


@query
def change_flags(spark, sf):
    return sequences.change_flags(B.tokens(spark, sf))


@query
def token_stats(spark, sf):
    s = sequences.token_stats(B.tokens(spark, sf), len(B.EVENT_TYPES))
    return s.select("video_id", "n_tokens", "n_unique", "codebook_size", "n_changes", *_r("mean_run_length"), "max_run_length")


@query
def mean_run_length(spark, sf):
    s = sequences.token_stats(B.tokens(spark, sf), len(B.EVENT_TYPES))
    return s.agg(F.avg("mean_run_length").alias("mean_run_length"), F.count(F.lit(1)).alias("n_videos")).select(*_r("mean_run_length"), "n_videos")


@query
def token_perplexity(spark, sf):
    return sequences.perplexity(B.event_times(spark, sf)).select(*_r("perplexity"))


@query
def token_label_purity(spark, sf):
    return sequences.purity(B.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(*_r("purity"))


@query
def token_label_nmi(spark, sf):
    return sequences.mutual_information(B.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(*_r("nmi"))


def _windows(spark: SparkSession, sf: str, width: int, stride: int) -> DataFrame:
    return sequences.count_windows(B.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", width, stride).select("doc_id", "clip_idx", "start")


@query
def clip_windows_tumbling(spark, sf):
    return _windows(spark, sf, 512, 512)


@query
def clip_windows_sliding(spark, sf):
    return _windows(spark, sf, 512, 256)


@query
def clip_windows_gapped(spark, sf):
    return _windows(spark, sf, 512, 768)


# --- intervals --------------------------------------------------------------


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.clip_labels(B.videos(spark, sf), B.narrations(spark, sf), B.HOUR, B.CLIPS)


@query
def narration_boundaries(spark, sf):
    return intervals.interval_boundaries(B.narrations(spark, sf), B.SPAN)


@query
def narration_boundaries_snapped(spark, sf):
    return intervals.snapped_boundaries(intervals.interval_boundaries(B.narrations(spark, sf), B.SPAN), B.HOUR, B.CLIPS)


@query
def clip_labels(spark, sf):
    return _labels(spark, sf)


@query
def clip_labels_unlabelled_signups(spark, sf):
    """Sign-ups count as narrations without a verb: they give boundaries, never labels."""
    some = B.narrations(spark, sf).withColumn("verb", F.when(F.col("verb") != B.EVENT_TYPES.index("signup"), F.col("verb")))
    return intervals.clip_labels(B.videos(spark, sf), some, B.HOUR, B.CLIPS).where("label >= 0")


@query
def background_fraction(spark, sf):
    return intervals.background_fraction(_labels(spark, sf)).select("video_id", *_r("background"))


@query
def top_labels(spark, sf):
    return intervals.top_labels(_labels(spark, sf), TOP)


@query
def labelled_features(spark, sf):
    """Features of clips that a narration covers, by position."""
    f = intervals.labelled(B.features(spark, sf), _labels(spark, sf)).where("label >= 0")
    return f.select("video_id", "clip_idx", "label", F.col("embedding")[0].alias("x")).select("video_id", "clip_idx", "label", *_r("x"))


@query
def token_clip_purity(spark, sf):
    """Purity of tokens against the label of the clip at their position, background left out."""
    rows = intervals.labelled(B.tokens(spark, sf), _labels(spark, sf), "pos").where("label >= 0")
    return sequences.purity(rows, "token", "label").select(*_r("purity"))


@query
def video_codes(spark, sf):
    return intervals.video_codes(intervals.annotated(B.videos(spark, sf), B.event_times(spark, sf).where("event_type = 'purchase' and value > 60")))


@query
def annotated_videos(spark, sf):
    return intervals.annotated(B.videos(spark, sf), B.event_times(spark, sf).where("event_type = 'signup' and value > 60"))


@query
def taxonomy_categories(spark, sf):
    """Customers by the category of their nation, its region; nations of the last residue modulo six are unknown."""
    nation, region = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    taxonomy = nation.where("n_nationkey % 6 <> 5").join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("category"))
    return intervals.coded(B.table(spark, sf, "customer"), "c_nationkey", taxonomy).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- vectors ----------------------------------------------------------------


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("embedding").alias("dim", "x")).select(*keys, "dim", *_r("x"))


@query
def l2_normalize(spark, sf):
    return _flat(vectors.normalised(B.features(spark, sf)), "video_id", "clip_idx")


@query
def transition_pairs(spark, sf):
    p = sequences.transitions(B.features(spark, sf), LAG)
    return p.select("video_id", "clip_idx", V.dot(F.col("embedding"), F.col("later")).alias("cosine")).select("video_id", "clip_idx", *_r("cosine"))


@query
def pair_concat(spark, sf):
    p = sequences.transitions(B.features(spark, sf), LAG)
    return _flat(p.select("video_id", "clip_idx", F.concat("embedding", "later").alias("embedding")), "video_id", "clip_idx")


@query
def copy_mse(spark, sf):
    return vectors.copy_mse(B.features(spark, sf), LAG).select(*_r("copy_mse"), "n_pairs")


@query
def change_score(spark, sf):
    return vectors.change_scores(B.features(spark, sf)).select("video_id", "clip_idx", *_r("change"))


@query
def change_topk_boundaries(spark, sf):
    return vectors.top_changes(vectors.change_scores(B.features(spark, sf)), TOP).select("video_id", "clip_idx", *_r("change"))


@query
def video_mean(spark, sf):
    means = vectors.group_means(B.features(spark, sf), "video_id")
    return _flat(means.withColumnRenamed("mean", "embedding"), "video_id")


@query
def video_residual(spark, sf):
    return _flat(vectors.residuals(B.features(spark, sf), "video_id"), "video_id", "clip_idx")


@query
def zscore_train_stats(spark, sf):
    return vectors.dimension_stats(B.features(spark, sf).where("participant <> 0")).select("dim", *_r("mean", "sd"))


@query
def zscore_features(spark, sf):
    f = B.features(spark, sf)
    return _flat(vectors.standardised(f, f.where("participant <> 0")), "video_id", "clip_idx")


def _codebook(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "embeddings").where(F.col("vec_id") < B.CODES)
    return e.select(F.col("vec_id").cast("int").alias("code"), F.col("embedding").cast("array<double>").alias("vec"))


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.nearest_code(B.features(spark, sf), _codebook(spark, sf))


@query
def nearest_code(spark, sf):
    return _coded(spark, sf).select("video_id", "clip_idx", "code")


@query
def code_usage(spark, sf):
    return vectors.code_usage(_coded(spark, sf))


@query
def code_perplexity(spark, sf):
    return sequences.perplexity(_coded(spark, sf), "code").select(*_r("perplexity"))


@query
def dead_codes(spark, sf):
    """Codes that no clip uses."""
    return vectors.dead_codes(_codebook(spark, sf), _coded(spark, sf))


@query
def participant_codes(spark, sf):
    """Participants numbered by their first video among those with a labelled clip; background clips are dropped."""
    from pyspark.sql import Window as W

    first = B.features(spark, sf).where("verb >= 0").groupBy("participant").agg(F.min("video_id").alias("first"))
    return first.select("participant", (F.row_number().over(W.orderBy("first", "participant")) - 1).alias("code"))  # a row a participant


@query
def verb_categories(spark, sf):
    """Verbs looked up in a category table, unknown ones as -1."""
    table = spark.createDataFrame([(0, "browse"), (1, "fault"), (2, "trade"), (4, "browse")], "verb int, category string")
    rows = intervals.coded(B.event_times(spark, sf), "token", table.withColumnRenamed("verb", "id"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- splits -----------------------------------------------------------------


@query
def heldout_video_split(spark, sf):
    videos = B.videos(spark, sf).withColumn("participant", F.col("video_id") % 5)
    return splits.heldout_video(videos, FRACTION, SEED)


@query
def random_clip_split(spark, sf):
    return splits.random_clip(B.features(spark, sf).select("video_id", "clip_idx"), ["video_id", "clip_idx"], FRACTION, SEED)


@query
def random_event_split(spark, sf):
    return splits.random_clip(B.table(spark, sf, "events").select("event_id"), ["event_id"], FRACTION, SEED)


@query
def heldout_participant_split(spark, sf):
    return splits.heldout_participant(B.features(spark, sf).select("video_id", "clip_idx", "participant"), [1, 3])


@query
def train_videos(spark, sf):
    """All videos but the held-out ones: a set difference."""
    split = heldout_video_split(spark, sf)
    return B.videos(spark, sf).join(split.where("is_test"), "video_id", "left_anti")


# --- hierarchy and sharding ---------------------------------------------------


@query
def bpe_pair_counts(spark, sf):
    return hierarchy.pair_counts(hierarchy.run_streams(B.tokens(spark, sf))).select("a", "b", "n")


@query
def bpe_first_merge(spark, sf):
    h = hierarchy.merge_hierarchy(B.tokens(spark, sf), [1])
    return h.boundaries.select("video_id", F.col("pos").cast("long").alias("pos"))


def _hierarchy(spark: SparkSession, sf: str) -> hierarchy.Hierarchy:
    return hierarchy.merge_hierarchy(B.tokens(spark, sf), LEVELS)


@query
def bpe_merges(spark, sf):
    return spark.createDataFrame(_hierarchy(spark, sf).merges, "step int, a int, b int, new int, n long")


@query
def bpe_level_boundaries(spark, sf):
    return _hierarchy(spark, sf).boundaries.groupBy("merges", "video_id").agg(F.count(F.lit(1)).alias("n_boundaries"))


def _level_report(spark: SparkSession, sf: str, meta: DataFrame, tolerance: float) -> DataFrame:
    """True boundaries are the places of errors among a user's events."""
    tokens = B.tokens(spark, sf)
    truth = tokens.where(F.col("token") == B.EVENT_TYPES.index("error")).join(meta, "video_id").select("video_id", (F.col("pos") / (F.col("fps") / F.col("n_clip_frame"))).alias("t"))
    return hierarchy.level_report(tokens, truth, meta, LEVELS, tolerance, BASELINES, SEED)


@query
def bpe_level_report(spark, sf):
    """Every level against the true boundaries in seconds; users of the last residue modulo seven lack clip meta and stay out."""
    meta = B.videos(spark, sf).where("video_id % 7 <> 6").select("video_id", (5.0 * (1 + F.col("video_id") % 2)).alias("fps"), F.lit(10).alias("n_clip_frame"))
    return _level_report(spark, sf, meta, 2.0).select("merges", "n_videos", *_r("model_f1", "random_f1", "n_boundaries"))


@query
def bpe_best_level(spark, sf):
    """The level with the largest gain over the matched random baseline, a mean of ``BASELINES`` draws; one clip a second."""
    meta = B.videos(spark, sf).select("video_id", F.lit(10.0).alias("fps"), F.lit(10).alias("n_clip_frame"))
    return hierarchy.best_level(_level_report(spark, sf, meta, 1.0)).select("merges", *_r("model_f1", "random_f1", "gain"))


@query
def lpt_shards(spark, sf):
    return hierarchy.balanced_shards(B.table(spark, sf, "documents"), SHARDS, "doc_id", "n_chars").select("shard", F.col("id").alias("doc_id"), "weight")


@query
def shard_spread(spark, sf):
    totals = lpt_shards(spark, sf).groupBy("shard").agg(F.sum("weight").alias("total"))
    return totals.agg(F.count(F.lit(1)).alias("n_shards"), F.min("total").alias("least"), F.max("total").alias("most"), (F.max("total") - F.min("total")).alias("spread"))


@query
def pending_items(spark, sf):
    """Customers without an urgent open order: what an idempotent writer of those would have left to do."""
    done = B.table(spark, sf, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
    return writers.pending(B.table(spark, sf, "customer").select("c_custkey"), done.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# --- classification -----------------------------------------------------------


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = B.table(spark, sf, "documents"), B.table(spark, sf, "labels")
    pred = (F.col("n_chars") >= 1500).cast("int").alias("y_pred")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").cast("int").alias("y_true"), pred)


@query
def macro_f1(spark, sf):
    return classification.macro_f1(_predictions(spark, sf)).select(*_r("macro_f1"), "n_classes")


@query
def accuracy(spark, sf):
    return classification.accuracy(_predictions(spark, sf)).select(*_r("accuracy"))


@query
def topk_accuracy(spark, sf):
    """Scores of class c are the dimensions 0 to 9 of an embedding."""
    rows = B.features(spark, sf).select(F.col("verb").alias("y_true"), F.slice("embedding", 1, 10).alias("scores"))
    return classification.top_k_accuracy(rows, TOP).select(*_r("top_k"))


@query
def majority_baseline(spark, sf):
    rows = B.event_times(spark, sf).select("video_id", F.col("token").alias("y_true"))
    return classification.majority_baseline(rows.where("video_id % 5 <> 0"), rows.where("video_id % 5 = 0")).select("majority", *_r("accuracy"))


@query
def chance_baseline(spark, sf):
    return classification.chance(B.event_times(spark, sf).select(F.col("token").alias("y_true"))).select(*_r("chance"))


# --- learning -----------------------------------------------------------------


@query
def scene_projection(spark, sf):
    """Features without the span of participants' means: what is left per participant and dimension."""
    f = B.features(spark, sf)
    out = vectors.project_out(f, vectors.group_subspace(f, "participant"))
    means = vectors.group_means(out, "participant")
    return _flat(means.withColumnRenamed("mean", "embedding"), "participant")


def _labelled(spark: SparkSession, sf: str, representation: str = "raw") -> DataFrame:
    """Labelled clips with one column per target and one per split; ``representation`` says what the features are."""
    f = B.features(spark, sf).where("verb >= 0")
    if representation == "scene_removed":
        f = vectors.project_out(f, vectors.group_subspace(f, "participant"))
    elif representation == "residual":
        f = vectors.residuals(f, "video_id")
    elif representation == "videomean":
        f = f.drop("embedding").join(vectors.group_means(f, "video_id").withColumnRenamed("mean", "embedding"), "video_id")
    f = f.withColumn("category", (F.col("verb") / 3).cast("int")).withColumn("participant", F.col("participant").cast("int"))
    videos = splits.heldout_video(f.select("video_id", "participant").distinct(), FRACTION, SEED).select("video_id", F.col("is_test").alias("heldout_video"))
    f = splits.random_clip(f, ["video_id", "clip_idx"], FRACTION, SEED).withColumnRenamed("is_test", "random_clip").join(videos, "video_id")
    return splits.heldout_participant(f, [1, 3]).withColumnRenamed("is_test", "heldout_participant")


SPLITS, KINDS = ("random_clip", "heldout_video", "heldout_participant"), ("linear", "mlp")


def _report(spark: SparkSession, sf: str, representation: str, tasks: list[tuple[str, str]]) -> DataFrame:
    fits = [learning.Fit(target, split, kind) for target, split in tasks for kind in KINDS]
    report = learning.probe_report(_labelled(spark, sf, representation), ["video_id", "clip_idx"], fits)
    return report.select("target", F.lit(representation).alias("representation"), "split", "model", "metric", *_r("value"))


def _reports(spark: SparkSession, sf: str, representations: tuple[str, ...], tasks: list[tuple[str, str]]) -> DataFrame:
    out = [_report(spark, sf, r, tasks) for r in representations]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query
def probe_suite(spark, sf):
    """Verbs and categories on three splits, participants on random clips, each by both models: fourteen fits."""
    return _report(spark, sf, "raw", [*((t, s) for t in ("verb", "category") for s in SPLITS), ("participant", "random_clip")])


@query
def scene_factor_report(spark, sf):
    """Features as they are against features without the span of participants' means, on three tasks."""
    return _reports(spark, sf, ("raw", "scene_removed"), [("participant", "random_clip"), ("category", "heldout_video"), ("category", "heldout_participant")])


@query
def temporal_split_report(spark, sf):
    """Features, their video's mean, and what is left of it: categories on three splits, participants on random clips."""
    return _reports(spark, sf, ("raw", "videomean", "residual"), [*(("category", s) for s in SPLITS), ("participant", "random_clip")])


def _probe(spark: SparkSession, sf: str, hidden: int | None) -> DataFrame:
    f, rows = _labelled(spark, sf), []
    for name in ("heldout_participant", "heldout_video"):
        scored = learning.probe_scores(f.where(~F.col(name)), f.where(name), "verb", ["video_id", "clip_idx"], hidden=hidden).withColumn("y_true", F.col("verb"))
        rows.append(scored.agg(F.lit(name).alias("split"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("top1"), F.count(F.lit(1)).alias("n_test")))
    return rows[0].unionByName(rows[1])


@query
def linear_probe(spark, sf):
    return _probe(spark, sf, None)


@query
def mlp_probe(spark, sf):
    return _probe(spark, sf, 512)


@query
def residual_probe(spark, sf):
    """Both probes on participants, over features without their video's mean."""
    return _report(spark, sf, "residual", [("participant", "random_clip")])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.transitions(vectors.normalised(B.features(spark, sf)), LAG).select("video_id", "participant", "clip_idx", "embedding", "later")


@query
def nsvq_tokens(spark, sf):
    out, _ = learning.transition_tokens(_pairs(spark, sf).drop("participant"), ["video_id", "clip_idx"])
    return out.select("video_id", F.col("clip_idx").alias("pos"), "token")


@query
def nsvq_training(spark, sf):
    """Validation error and perplexity of each epoch on held-out videos, and how far below copying the error is."""
    pairs = _pairs(spark, sf)
    split = splits.heldout_video(pairs.select("video_id", "participant").distinct(), FRACTION, SEED).select("video_id", "is_test")
    both = pairs.join(split, "video_id")
    done = learning.train_quantiser(both.where("not is_test"), both.where("is_test"), ["video_id", "clip_idx"])
    log = [(e, mse, p, done.copy_mse, learning.percent_against(mse, done.copy_mse)) for e, mse, p in done.history]
    return spark.createDataFrame(log, "epoch int, val_mse double, perplexity double, copy_mse double, percent_better double")
