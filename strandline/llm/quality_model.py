"""Quality classifier by co-training over two views of a document.

The text view is what a document says: its distinct words, and how dense capitals,
signs, digits and repeated words are in it.  The metadata view is what is known of
it without reading: language, source, characters, lines, characters a line and a
word, the share of blank and of repeated lines.  Per target (quality, toxicity) a
model of each view is fitted on labelled rows.  In every round each view marks the
rows of an unlabelled pool about which it is most sure, and the other view is
fitted again with those pseudo-labels.  How sure a view has to be is measured: it
marks a class down to the score beyond which at least ``SURE`` of the labelled rows
kept out of the fit belong to it.  At the end each view's margin is calibrated on
those rows (Platt), and the calibrated log-odds are added, weighted by the views'
held-out quality.

Fitting reads a bounded sample, by smallest hash of the id and hence the same at
any partitioning.  Its bounds are parameters of ``fit``: ``LABELLED`` labelled rows,
``POOL`` unlabelled ones, and of a document with more than ``FIT_WORDS`` distinct
words those of the smallest hashes; so the driver gets at most (LABELLED + POOL) *
FIT_WORDS ids of eight bytes.  Rows of the sample that share ``SHARED`` of their
``SKETCH`` smallest rare word hashes with an earlier one are copies of it and are
left out of the fit, since copies would count one accident many times.
Scoring reads every whole text and all its words.

A document is kept if it is likely good and not likely toxic.

Defined cases: null text is empty; null metadata are a value of their own; null
labels don't train that target; a null id is scored and never trains; rows that
repeat an id are scored alike; without labels of both classes a target's score is
one half and rejects nothing; an empty table gives an empty result; further
columns are carried by ``keep_good`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import coded_words, slices
from strandline.llm.hashing import mix

LABELLED, POOL, FIT_WORDS = 8_000, 4_000, 4_000
ROUNDS, CONFIDENT, SURE = 3, 0.1, 0.9
TELLING = 1.0
SKETCH, SHARED, COMMON = 24, 5, 0.02
REJECT = {"quality": 0.35, "toxic": 0.5}
SAMPLE_SEED = 41
_SLICE = 4_000_000

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # offsets, feature ids, values


Words = tuple[np.ndarray, np.ndarray, pa.Array]  # as of coded_words


def _id(name: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(name)).view(np.int64))


def text_features(texts: pa.Array, coded: Words, only: np.ndarray | None = None) -> Rows:
    """Presence of each distinct word, signs around it dropped, by 64-bit hash, of those in the sorted ``only``, if given; then the densities."""
    offsets, codes, words = coded
    stems = pc.ascii_trim(pc.utf8_lower(words), ".,;:!?|#$%&*()[]\"'<>").dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in stems.dictionary.to_pylist()] or [0], np.uint64).view(np.int64)
    stem = np.asarray(stems.indices, dtype=np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    if only is not None:
        wanted = np.zeros(0, bool) if not len(stem) else _lookup(only, np.ones(len(only)), names)[stem][codes] > 0
        row, codes = row[wanted], codes[wanted]
    key = np.unique(row * len(names) + stem[codes]) if len(codes) else np.zeros(0, np.int64)
    bins = _binned(densities(texts, coded), DENSITIES, "density")
    row, feature = np.concatenate([key // len(names), np.repeat(np.arange(len(size)), bins.shape[1])]), np.concatenate([names[key % len(names)], bins.reshape(-1)])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(len(size) + 1)), feature[order], np.ones(len(row))


def _lookup(keys: np.ndarray, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The value of each id, 0 where it is not among the sorted keys."""
    if not len(keys):
        return np.zeros(len(ids))
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    return np.where(keys[at] == ids, values[at], 0.0)


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(float)


def _length(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)


def _binned(columns: np.ndarray, edges: tuple[tuple[float, ...], ...], kind: str) -> np.ndarray:
    """One feature id a row and column: the column's bin."""
    out = np.empty(columns.shape, np.int64)
    for k, cuts in enumerate(edges):
        out[:, k] = np.array([_id(f"{kind}{k}={b}") for b in range(len(cuts) + 1)])[np.searchsorted(cuts, columns[:, k])]
    return out


#: Bins of capitals, signs and digits a character, and of words like the one before a word.
DENSITIES = ((0.02, 0.05, 0.1, 0.2, 0.4), (0.002, 0.01, 0.03, 0.06, 0.1), (0.005, 0.02, 0.05, 0.1, 0.2), (0.01, 0.05, 0.1, 0.3, 0.6))


def densities(texts: pa.Array, coded: Words) -> np.ndarray:
    each = np.stack([_count(texts, p) for p in ("[A-Z]", r"[#*$%&|<>!]", "[0-9]")], 1) / np.maximum(_length(texts), 1)[:, None]
    offsets, codes, _ = coded
    same = np.zeros(len(codes) + 1)
    same[1:-1] = codes[1:] == codes[:-1]
    sums = np.concatenate([[0.0], np.cumsum(same)])
    again = (sums[offsets[1:]] - sums[np.minimum(offsets[:-1] + 1, offsets[1:])]) / np.maximum(np.diff(offsets), 1)
    return np.column_stack([each, again])


#: Bins of the logs of characters and lines, of characters a line (log) and a word, and of the shares of blank and repeated lines.
LAYOUT = ((4, 5, 6, 7, 8), (0.7, 1.5, 2.5, 3.5, 4.5), (3, 4, 4.5, 5, 6), (4, 5, 6, 7, 9), (0.01, 0.1, 0.3), (0.01, 0.05, 0.1, 0.3, 0.6))


def layout(texts: pa.Array, n_words: np.ndarray) -> np.ndarray:
    n = _length(texts)
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    lines = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(count)), count)
    coded = lines.dictionary_encode()
    full = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code = np.asarray(coded.indices, dtype=np.int64)
    filled = full[code] if len(code) else np.zeros(0, bool)
    with_text = np.bincount(row[filled], minlength=len(count))
    distinct = np.bincount(np.unique(row[filled] * (len(full) + 1) + code[filled]) // (len(full) + 1), minlength=len(count))
    return np.column_stack([np.log1p(n), np.log(count), np.log1p(n / count), n / np.maximum(n_words, 1), 1 - with_text / count, (with_text - distinct) / np.maximum(with_text, 1)])


def meta_features(lang: pa.Array, source: pa.Array, texts: pa.Array, coded: Words) -> Rows:
    """Language, source and binned layout, one feature each."""
    columns = [np.array([_id(f"{k}={v}") for v in x.to_pylist()], np.int64).reshape(-1, 1) for k, x in (("lang", lang), ("source", source))]
    ids = np.hstack([*columns, _binned(layout(texts, np.diff(coded[0])), LAYOUT, "layout")])
    return np.arange(len(ids) + 1) * ids.shape[1], ids.reshape(-1), np.ones(ids.size)


def features(lang: pa.Array, source: pa.Array, texts: pa.Array, only: np.ndarray | None = None) -> tuple[Rows, Rows]:
    """Both views of the rows."""
    coded = coded_words(texts)
    return text_features(texts, coded, only), meta_features(lang, source, texts, coded)


def _take(x: Rows, rows: np.ndarray) -> Rows:
    offsets, ids, values = x
    size = np.diff(offsets)[rows]
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1][rows] - bounds[:-1], size)
    return bounds, ids[at], values[at]


def margins(x: Rows, keys: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    offsets, ids, values = x
    sums = np.concatenate([[0.0], np.cumsum(_lookup(keys, weights, ids) * values)])
    return np.round(sums[offsets[1:]] - sums[offsets[:-1]] + bias, 9)  # rows with the same features tie, wherever they stand


def fit_linear(x: Rows, y: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch AdaGrad, classes weighted alike: (keys, weights, bias)."""
    offsets, ids, values = x
    keys, at = np.unique(ids, return_inverse=True)
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    w, g2, bias, b2 = np.zeros(len(keys)), np.full(len(keys), 1e-12), 0.0, 1e-12
    for _ in range(steps):
        m = np.bincount(row, w[at] * values, len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) * share
        grad = np.bincount(at, error[row] * values, len(keys)) + ridge * w
        g2 += grad**2
        w -= 0.3 * grad / np.sqrt(g2)
        b = error.sum()
        b2 += b * b
        bias -= 0.3 * b / np.sqrt(b2)
    return keys, w, bias


def telling(x: Rows, y: np.ndarray) -> np.ndarray:
    """Features whose log ratio of document frequencies, brought towards 0 by 2.5 standard errors, is still ``TELLING``."""
    offsets, ids, _ = x
    keys, at = np.unique(ids, return_inverse=True)
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    yes, no = np.bincount(at[y[row]], minlength=len(keys)), np.bincount(at[~y[row]], minlength=len(keys))
    ratio = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / ((~y).sum() + 1))
    return keys[np.abs(ratio) - 2.5 * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)) >= TELLING]


def fit_telling(x: Rows, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression over the telling features alone; the many others would fit accidents."""
    offsets, ids, values = x
    keys = telling(x, y)
    use = _lookup(keys, np.ones(len(keys)), ids) > 0
    return fit_linear((np.concatenate([[0], np.cumsum(use)])[offsets], ids[use], values[use]), y)


def calibrate(m: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Platt's (slope, offset) by Newton steps on log loss with a small ridge."""
    centre, scale = float(m.mean()), float(m.std()) or 1.0
    z = np.column_stack([(m - centre) / scale, np.ones(len(m))])
    w = np.zeros(2)
    for _ in range(min(steps, 40)):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, z.T @ (p - y) + 1e-2 * w)
    return w[0] / scale, w[1] - w[0] * centre / scale


@dataclass
class View:
    """A linear model over one view, its calibration and its weight in the vote."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    share: float = 0.5

    def log_odds(self, x: Rows) -> np.ndarray:
        return self.slope * margins(x, self.keys, self.weights, self.bias) + self.offset


@dataclass
class CoTrained:
    """Two views per target; a target without both classes is None."""

    targets: dict[str, tuple[View, View] | None]
    report: dict[str, dict[str, float]]

    def words(self) -> np.ndarray:
        """The text features that count."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(v[0].keys for v in self.targets.values() if v)]))

    def probability(self, target: str, text: Rows, meta: Rows) -> np.ndarray:
        views = self.targets[target]
        if views is None:
            return np.full(len(text[0]) - 1, 0.5)
        odds = sum(v.share * v.log_odds(x) for v, x in zip(views, (text, meta), strict=True))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def distinct_rows(x: Rows, sketch: int = SKETCH, shared: int = SHARED, common: float = COMMON) -> np.ndarray:
    """Row numbers without copies of earlier rows: copies share ``shared`` of their ``sketch`` smallest rare features.

    Copies would count one accident many times over and make any of their words look telling.
    """
    offsets, ids, _ = x
    keys, at, count = np.unique(ids, return_inverse=True, return_counts=True)
    rare = (count <= max(2, common * (len(offsets) - 1)))[at]
    owner: dict[int, list[int]] = {}
    kept = []
    for i in range(len(offsets) - 1):
        own = slice(offsets[i], offsets[i + 1])
        least = np.sort(at[own][rare[own]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:sketch].tolist()
        met: dict[int, int] = {}
        for h in least:
            for j in owner.get(h, ()):
                met[j] = met.get(j, 0) + 1
        if met and max(met.values()) >= min(shared, max(2, len(least) // 3)):
            continue
        kept.append(i)
        for h in least:
            owner.setdefault(h, []).append(i)
    return np.array(kept, np.int64)


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    if y.all() or not y.any():
        return 0.5
    values, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    return float((rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()))


def sure_below(score: np.ndarray, right: np.ndarray) -> float:
    """The largest score up to which at least ``SURE`` of the rows are ``right``, and at least one in fifty are concerned; minus infinity if there is none."""
    order = np.argsort(score, kind="stable")
    value, hits = score[order], np.cumsum(right[order])
    last = np.append(value[1:] != value[:-1], True)  # equal scores stand together
    n = np.arange(1, len(value) + 1)
    good = np.flatnonzero(last & (hits >= SURE * n) & (n >= max(2, len(n) / 50)))
    return float(value[good[-1]]) if len(good) else -np.inf


def co_train(text: Rows, meta: Rows, y: np.ndarray, labelled: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS) -> tuple[tuple[View, View], dict[str, float]]:
    """``labelled`` and ``pool`` are row numbers; ``y`` holds the labels of the former."""
    check = labelled[np.arange(len(labelled)) % 4 == 3]
    fit = np.setdiff1d(labelled, check)
    sides = ((text, fit_telling), (meta, fit_linear))
    told: list[dict[int, bool]] = [{}, {}]
    models = [None, None]
    for r in range(rounds + 1):
        for k, (x, fitter) in enumerate(sides):
            extra = np.array(sorted(told[k]), np.int64)
            rows = np.concatenate([fit, extra])
            goal = np.concatenate([y[fit], np.array([told[k][i] for i in extra.tolist()], bool)])
            models[k] = fitter(_take(x, rows), goal)
        if r == rounds:
            break
        most = int(CONFIDENT * len(pool))
        for k, (x, _) in enumerate(sides):
            free = np.array([i for i in pool.tolist() if i not in told[1 - k]], np.int64)
            if not len(free):
                continue
            known, score, share = margins(_take(x, check), *models[k]), margins(_take(x, free), *models[k]), max(y[fit].mean(), 1e-3)
            order = np.argsort(score, kind="stable")
            low, high = sure_below(known, ~y[check]), -sure_below(-known, y[check])
            told[1 - k] |= {int(free[i]): True for i in order[::-1][: int(most * share) + 1] if score[i] >= high}
            told[1 - k] |= {int(free[i]): False for i in order[: int(most * (1 - share)) + 1] if score[i] <= low}
    views, marks = [], []
    for (x, _), model in zip(sides, models, strict=True):
        at = margins(_take(x, check), *model)
        views.append(View(*model, *calibrate(at, y[check])))
        marks.append(_auc(at, y[check]))
    chance = 1 / np.sqrt(12 * max(1, min(y[check].sum(), (~y[check]).sum())))  # standard error of the AUC of a view that knows nothing
    gain = np.maximum(np.array(marks) - 0.5 - chance, 0) ** 2
    for v, s in zip(views, gain / gain.max() if gain.max() else np.ones(2), strict=True):
        v.share = float(s)
    return (views[0], views[1]), {"auc_text": marks[0], "auc_meta": marks[1], "auc_both": _auc(sum(v.share * v.log_odds(_take(x, check)) for v, (x, _) in zip(views, sides, strict=True)), y[check]), "told_text": len(told[0]), "told_meta": len(told[1]), "held_out": len(check)}


def _fewest(x: Rows, most: int) -> Rows:
    """Of each row the ``most`` features with the smallest mixed ids."""
    offsets, ids, values = x
    if (np.diff(offsets) <= most).all():
        return x
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((mix(ids.view(np.uint64)), row))
    kept = order[np.arange(len(order)) - offsets[:-1][row] < most]
    return np.searchsorted(row[kept], np.arange(len(offsets))), ids[kept], values[kept]


def sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, words: int = FIT_WORDS) -> pa.Table:
    """At most ``labelled`` + ``pool`` rows: both views' features, quality, toxic; the driver's only data."""
    mark = F.xxhash64(F.col("doc_id").cast("string"), F.lit(SAMPLE_SEED)).alias("mark")
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.where("doc_id is not null").select("doc_id")
    chosen = ids.join(known, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "quality", "toxic", mark).orderBy("mark", "doc_id").limit(labelled)
    others = ids.join(known.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    others = others.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), mark).orderBy("mark", "doc_id").limit(pool)
    wanted = chosen.unionByName(others)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = rows.join(F.broadcast(wanted), "doc_id").select("mark", "text", "lang", "source", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))  # at most labelled + pool rows
    names = ["mark", "words", "meta", "quality", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                views = features(part.column("lang"), part.column("source"), part.column("text"))
                views = (_fewest(views[0], words), views[1])
                lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(i.astype(np.int64))) for o, i, _ in views]
                yield pa.RecordBatch.from_arrays([part.column("mark"), *lists, part.column("quality"), part.column("toxic")], names)

    found = rows.mapInArrow(run, "mark long, words array<bigint>, meta array<bigint>, quality int, toxic int").toArrow()
    marks = found.column("mark").to_numpy()
    return found.take(pa.array(np.sort(np.unique(marks, return_index=True)[1]))).sort_by("mark").combine_chunks()


def _rows(lists: pa.ChunkedArray) -> Rows:
    chunk = lists.combine_chunks()
    chunk = chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) and chunk.num_chunks else chunk
    if not len(chunk):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    offsets = np.asarray(chunk.offsets, dtype=np.int64)
    ids = np.asarray(chunk.values, dtype=np.int64)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], ids, np.ones(len(ids), np.float32)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, words: int = FIT_WORDS) -> CoTrained:
    rows = sample(docs, labels, labelled, pool, words)
    text, meta = _rows(rows.column("words")), _rows(rows.column("meta"))
    told = {t: np.array([-1 if x is None else x for x in rows.column(t).to_pylist()], np.int64) for t in REJECT}
    everything = distinct_rows(text)
    unlabelled = np.all([x < 0 for x in told.values()], axis=0)
    targets: dict[str, tuple[View, View] | None] = {}
    report: dict[str, dict[str, float]] = {}
    for target in REJECT:
        has, y = told[target] >= 0, told[target] == 1
        both = min(y[has].sum(), (~y[has]).sum()) if has.any() else 0
        targets[target], report[target] = None, {}
        if both >= 4:
            targets[target], report[target] = co_train(text, meta, y, everything[has[everything]], everything[unlabelled[everything]], rounds)
    return CoTrained(targets, report)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, quality_score, toxic_score, kept of every row of (doc_id, text, lang, source)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors a target, fixed sizes
    names = ["doc_id", "quality_score", "toxic_score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts = part.column("text")
                text, meta = features(part.column("lang"), part.column("source"), texts, model.words())
                good, toxic = (model.probability(t, text, meta) for t in ("quality", "toxic"))
                kept = (good >= REJECT["quality"]) & (toxic <= REJECT["toxic"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(good), pa.array(toxic), pa.array(kept)], names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality_score double, toxic_score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def kept(text, lang, source):
        import pandas as pd

        out = []
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string(), from_pandas=True) for c in (text, lang, source)], ["text", "lang", "source"])
        for part in slices(batch, "text", _SLICE):
            texts = pc.fill_null(part.column("text"), "")
            x, m = features(part.column("lang"), part.column("source"), texts, model.value.words())
            good, toxic = (model.value.probability(t, x, m) for t in ("quality", "toxic"))
            out.append((good >= REJECT["quality"]) & (toxic <= REJECT["toxic"]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(kept(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string")))
