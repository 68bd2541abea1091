import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import ngram, quality_model
from strandline.llm.elias_fano import EliasFano


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200), st.sampled_from([5001, 1 << 20, 1 << 45]))
def test_elias_fano_successor(values, universe):
    spread = universe // 5001
    values = np.sort(np.array([v * spread for v in values], np.uint64))
    ef = EliasFano.build(values, universe)
    assert np.array_equal(ef.access(np.arange(len(values))), values)
    asked = np.array(sorted({0, 1, universe - 1, *(int(v) for v in values), *(int(v) + 1 for v in values if int(v) + 1 < universe)}), np.uint64)
    at, found = ef.successor(asked)
    assert np.array_equal(at, np.searchsorted(values, asked))
    assert np.array_equal(found, np.isin(asked, values))
    cut = len(values) // 2
    for first, end in ((0, cut), (cut, len(values)), (cut, min(len(values), cut + 3))):
        part = values[first:end]
        at, found = ef.successor(asked, np.full(len(asked), first), np.full(len(asked), end))
        assert np.array_equal(found, np.isin(asked, part)) and np.array_equal(at[found], first + np.searchsorted(part, asked[found]))


def lower(text):
    return [w.lower() for w in (text or "").encode().split()]


def plain_scores(pairs, order):
    """Interpolated absolute discounting from dictionaries of counts."""
    train = [[*lower(t), b""] for i, t in pairs if ngram.in_training(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    grams, discount = {}, {}

    def history(words, i, m):
        """The m - 1 words before place i, the first of which may be the end before the text."""
        return tuple([b"", *words][i + 2 - m : i + 1]) if i >= m - 2 else None

    for m in range(2, order + 1):
        grams[m] = Counter((h, t[i]) for t in train for i in range(len(t)) if (h := history(t, i, m)) is not None)
        k = [max(1, sum(1 for x in grams[m].values() if x == q)) for q in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        discount[m] = np.clip([1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2]], 0.05, [0.99, 1.98, 2.97])
    total, mass = {m: Counter() for m in grams}, {m: defaultdict(float) for m in grams}
    for m, each in grams.items():
        for (h, _), count in each.items():
            total[m][h] += count
            mass[m][h] += discount[m][min(count, 3) - 1]

    def score(words):
        out = 0.0
        for i, w in enumerate(words):
            p = (c[w] + 1) / (n + v + 1)
            for m in range(2, order + 1):
                h = history(words, i, m)
                if h is not None and total[m][h]:
                    count = grams[m][h, w]
                    p = (count - discount[m][min(count, 3) - 1] if count else 0) / total[m][h] + mass[m][h] / total[m][h] * p
            out += math.log10(p)
        return out

    for i, t in pairs:
        words = [*lower(t), b""]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        yield str(i), not ngram.in_training(i), len(words), sum(c[w] > 0 for w in words), n, base, score(words)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_brute_force(make_docs, hard_pairs, monkeypatch, order):
    monkeypatch.setattr(ngram, "TOKENS_A_SHARD", 700)
    rows = ngram.score_documents(make_docs(hard_pairs), order=order).collect()
    assert len(rows) == len(hard_pairs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    for g, w in zip(got, sorted(plain_scores(hard_pairs, order)), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=3e-4 * w[2])


def test_scores_need_the_pointers(make_docs, hard_pairs, monkeypatch):
    """With all of a level given to its last node, known n-grams are no longer found."""
    rows = ngram.id_text(make_docs(hard_pairs)).withColumn("held_out", ngram.F.lit(False))
    trie = ngram.build_trie(rows)
    score = lambda: {i: s for i, s in ngram.score_with(rows.where("doc_id >= 20"), trie).select("doc_id", "score").collect()}
    right = score()
    for k in range(len(trie.starts)):
        n, nodes = int(trie.entries[3][k]), int(trie.entries[2][k])
        ngram._save_sequence(trie.words.folder, f"level3-{k}", "pointer", np.repeat(np.array([0, n], np.uint64), [nodes, 1]), n + 1)
    trie.words.folder += "/"  # past the caches
    wrong = score()
    assert sum(wrong[i] < right[i] - 1 for i in right) > len(right) / 2


def test_pointers_list_a_context(make_docs):
    docs = ngram.id_text(make_docs([(k, "a b a c a b") for k in range(20)]))
    trie = ngram.build_trie(docs)
    ids = trie.words.find(np.array([*ngram.word_hashes(pa.array(["a", "b", "c"]))[0], ngram.END_HASH, 12345], np.uint64))
    words, logs = trie.successors(int(ids[0]))
    assert set(words) == {ids[1], ids[2]} and ids[4] == -1
    assert logs[list(words).index(ids[1])] > logs[list(words).index(ids[2])]


def test_scoring_an_empty_table(make_docs):
    assert ngram.score_documents(make_docs([])).count() == 0


def test_scoring_without_training_rows(make_docs):
    held = next(i for i in range(1000) if not ngram.in_training(i))
    row = ngram.score_documents(make_docs([(held, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


# --- classifier ---------------------------------------------------------------


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "foul", "rotten"])
        text = " ".join(words)
        docs.append((i, text.upper() + " !!" * 30 if junk else text))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def judged(spark, make_docs):
    docs, labels = corpus()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, frame, {r.doc_id: r for r in quality_model.classify(make_docs(docs), frame).collect()}


def test_held_out_accuracy(judged):
    docs, _, _, rows = judged
    bad = {i: "!!" in t or any(w in t.lower().split() for w in ("vile", "foul", "rotten")) for i, t in docs}
    unseen = [i for i, _ in docs if i % 2 == 0]
    assert np.mean([rows[i].kept != bad[i] for i in unseen]) > 0.97
    assert sum(not rows[i].kept for i in unseen if not bad[i]) <= 1


def test_keep_good_agrees_and_keeps_columns(judged, make_docs):
    docs, _, labels, rows = judged
    frame = make_docs(docs)
    out = quality_model.keep_good(frame, labels)
    assert out.columns == frame.columns
    assert {r.doc_id for r in out.collect()} == {i for i, r in rows.items() if r.kept}


def test_classifier_edge_cases(spark, make_docs, hard_pairs):
    docs = make_docs(hard_pairs).withColumn("lang", quality_model.F.lit(None).cast("string"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_model.classify(docs, none).collect()
    assert len(rows) == len(hard_pairs) and all(r.kept and r.quality_score == 0.5 for r in rows)
    some = spark.createDataFrame([(None, 1, 0), (20, None, None), (21, 1, None), (21, 1, 0), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(docs, some).count() == len(hard_pairs)
    assert quality_model.classify(make_docs([]), some).count() == 0


def test_fit_does_not_depend_on_partitioning(judged, make_docs):
    docs, _, labels, rows = judged
    again = {r.doc_id: r for r in quality_model.classify(make_docs(docs[::-1], 9), labels).collect()}
    assert all(abs(again[i].quality_score - r.quality_score) < 1e-9 for i, r in rows.items())


def test_views_of_no_text():
    text, meta = quality_model.features(pa.array([None, "e"], pa.string()), pa.array([None, "s"], pa.string()), pa.array(["", "a a b"]))
    assert text[0].tolist() == [0, 4, 10] and len(meta[0]) == 3 and np.isfinite(quality_model.layout(pa.array(["", "a\n\na"]), np.array([0, 2]))).all()


def plain_views(lang, source, text):
    """Both views of one document, from the definition."""
    words, bins = text.encode().split(), lambda kind, edges, values: {f"{kind}{k}={sum(v > c for c in cuts)}" for k, (cuts, v) in enumerate(zip(edges, values, strict=True))}
    share = lambda chars: sum(c in chars for c in text) / max(len(text), 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)
    dense = [share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("#*$%&|<>!"), share("0123456789"), again]
    lines = text.split("\n")
    full = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    lay = [math.log1p(len(text)), math.log(len(lines)), math.log1p(len(text) / len(lines)), len(text) / max(len(words), 1), 1 - len(full) / len(lines), (len(full) - len(set(full))) / max(len(full), 1)]
    own = {w.decode().lower().strip(".,;:!?|#$%&*()[]\"'<>") for w in words} | bins("density", quality_model.DENSITIES, dense)
    return own, {f"lang={lang}", f"source={source}"} | bins("layout", quality_model.LAYOUT, lay)


def plain_fit(rows, y):
    pos, neg = 0.5 / max(sum(y), 1), 0.5 / max(len(y) - sum(y), 1)
    keys = sorted(set().union(*rows))
    w, g2, bias, b2 = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 1e-12), 0.0, 1e-12
    for _ in range(120):
        error = [(1 / (1 + math.exp(-(sum(w[f] for f in r) + bias))) - t) * (pos if t else neg) for r, t in zip(rows, y, strict=True)]
        grad = {f: 1e-4 * w[f] for f in keys}
        for r, e in zip(rows, error, strict=True):
            for f in r:
                grad[f] += e
        for f, g in grad.items():
            g2[f] += g * g
            w[f] -= 0.3 * g / math.sqrt(g2[f])
        b2 += sum(error) ** 2
        bias -= 0.3 * sum(error) / math.sqrt(b2)
    return lambda r: round(sum(w.get(f, 0.0) for f in r) + bias, 9)


def plain_telling(rows, y):
    yes, no = Counter(f for r, t in zip(rows, y, strict=True) if t for f in r), Counter(f for r, t in zip(rows, y, strict=True) if not t for f in r)
    ratio = {f: math.log((yes[f] + 0.5) / (sum(y) + 1)) - math.log((no[f] + 0.5) / (len(y) - sum(y) + 1)) for f in yes | no}
    keep = {f for f, r in ratio.items() if abs(r) - 2.5 * math.sqrt(1 / (yes[f] + 0.5) + 1 / (no[f] + 0.5)) >= quality_model.TELLING}
    return plain_fit([r & keep for r in rows], y)


def plain_auc(scores, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, t in zip(scores, y, strict=True) if t for b, u in zip(scores, y, strict=True) if not u]
    return sum(pairs) / len(pairs) if pairs else 0.5


def plain_co_train(views, y, labelled, pool):
    check, fit = labelled[3::4], [i for k, i in enumerate(labelled) if k % 4 != 3]
    fit, told = sorted(fit), [{}, {}]
    for turn in range(quality_model.ROUNDS + 1):
        models = []
        for k, learn in enumerate((plain_telling, plain_fit)):
            rows = fit + sorted(told[k])
            models.append(learn([views[i][k] for i in rows], [y[i] if i in y else told[k][i] for i in rows]))
        if turn == quality_model.ROUNDS:
            break
        for k, m in enumerate(models):
            free, share = [i for i in pool if i not in told[1 - k]], max(sum(y[i] for i in fit) / len(fit), 1e-3)
            least = max(2, len(check) / 50)

            def cut(sign, wanted, m=m, k=k, least=least):
                held, best = sorted((sign * m(views[i][k]), y[i] == wanted) for i in check), -math.inf
                for value in {v for v, _ in held}:
                    below = [h for v, h in held if v <= value]
                    if len(below) >= least and sum(below) >= quality_model.SURE * len(below):
                        best = max(best, value)
                return best

            low, high, most = cut(1, False), -cut(-1, True), int(quality_model.CONFIDENT * len(pool))
            order = sorted(free, key=lambda i, m=m, k=k: m(views[i][k]))
            told[1 - k] |= {i: True for i in order[::-1][: int(most * share) + 1] if m(views[i][k]) >= high}
            told[1 - k] |= {i: False for i in order[: int(most * (1 - share)) + 1] if m(views[i][k]) <= low}
    odds, gains = [], []
    for k, m in enumerate(models):
        at = np.array([m(views[i][k]) for i in check])
        slope, offset = quality_model.calibrate(at, np.array([y[i] for i in check]))
        odds.append(lambda r, m=m, slope=slope, offset=offset: slope * m(r) + offset)
        n = sum(y[i] for i in check)
        gains.append(max(0, plain_auc(at.tolist(), [y[i] for i in check]) - 0.5 - 1 / math.sqrt(12 * max(1, min(n, len(check) - n)))) ** 2)
    shares = [g / max(gains) for g in gains] if max(gains) else [1.0, 1.0]
    return (lambda v: 1 / (1 + math.exp(-sum(s * o(x) for s, o, x in zip(shares, odds, v, strict=True))))), told


def test_against_a_plain_refit(spark, make_docs):
    """Every document's scores as a straight reading of the method gives them, dictionaries and sums alone."""
    docs, labels = corpus(160, 9)
    docs += [(900, None), (901, ""), (902, "vile " * 40), (903, "Ä ö\n\nÄ ö")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_model.classify(make_docs(docs), frame).collect()}
    views = {i: plain_views("en", "s", t or "") for i, t in docs}
    order = [r.i for r in spark.createDataFrame([(i,) for i, _ in docs], "i long").orderBy(quality_model.F.xxhash64(quality_model.F.col("i").cast("string"), quality_model.F.lit(quality_model.SAMPLE_SEED))).collect()]
    rank = {i: k for k, i in enumerate(order)}
    ranked = {rank[i]: v for i, v in views.items()}
    for place, target in ((1, "quality_score"), (2, "toxic_score")):
        y = {rank[x[0]]: bool(x[place]) for x in labels}
        kept = [rank[i] for i in (order[k] for k in quality_model.distinct_rows(quality_model.features(*[pa.array([c] * len(order)) for c in ("en", "s")], pa.array([dict(docs)[i] or "" for i in order]))[0]))]
        probability, told = plain_co_train(ranked, y, [k for k in kept if k in y], [k for k in kept if k not in y])
        assert all(told) or target == "toxic_score"
        for i, v in views.items():
            assert getattr(rows[i], target) == pytest.approx(probability(v), abs=1e-6)


def test_labels_pass_both_ways_and_help():
    """Two views that each know half: each marks rows for the other, and together they know more than either."""
    rng = np.random.default_rng(5)
    n = 3000
    y = rng.random(n) < 0.4
    bit = lambda p: np.where(rng.random(n) < p, y, rng.random(n) < 0.5)
    view = lambda m, shift: (np.arange(n + 1) * m, (np.stack([2 * j + bit(0.45) for j in range(m)], 1) + shift).reshape(-1).astype(np.int64), np.ones(n * m))
    _, report = quality_model.co_train(view(6, 0), view(6, 100), y, np.arange(800), np.arange(800, n))
    assert report["told_text"] > 50 and report["told_meta"] > 50
    assert report["auc_both"] > max(report["auc_text"], report["auc_meta"]) > 0.7


def test_long_documents_train_too(spark, make_docs):
    long = [(k, " ".join([f"q{j}" for j in range(k, 30_000 + k)] + (["vile"] if k % 2 else []))) for k in range(24)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(24)], "doc_id long, quality int, toxic int")
    table = quality_model.sample(make_docs(long), labels)
    assert table.num_rows == 24 and max(len(x) for x in table.column("words").to_pylist()) == quality_model.FIT_WORDS
