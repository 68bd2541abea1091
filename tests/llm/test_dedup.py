import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import exact_dedup, near_dedup, shards, substring_dedup


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_against_brute_force(make_docs, hard_pairs):
    rows = exact_dedup.exact_dedup(make_docs(hard_pairs, 7), fan_in=2).collect()
    groups = defaultdict(list)
    for i, t in hard_pairs:
        groups[squeezed(t)].append(i)
    want = []
    for i, t in hard_pairs:
        g = groups[squeezed(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((str(i), str(keep), len(g), i == keep, hashlib.sha256(squeezed(t).encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rows) == sorted(want)


def test_exact_drop_keeps_columns_and_one_row_a_group(make_docs, hard_pairs):
    docs = make_docs(hard_pairs)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    texts = [squeezed(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({squeezed(t) for _, t in hard_pairs})


def test_runs_are_merged_in_order(make_docs, monkeypatch):
    """Digests are aggregated over sorted rows on both sides of every exchange, never by hashing."""
    plans = []
    stored = exact_dedup.materialise
    monkeypatch.setattr(exact_dedup, "materialise", lambda df, name, *k: (name == "runs" and plans.append(df._jdf.queryExecution().sparkPlan().toString()), stored(df, name, *k))[1])
    exact_dedup.exact_dedup(make_docs([(k, f"t{k % 9}") for k in range(60)], 20)).collect()
    assert len(plans) > 2 and all("SortAggregate" in p and "HashAggregate" not in p for p in plans)


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, substring_dedup.removal_digest, near_dedup.near_duplicates])
def test_empty_table(make_docs, operator):
    assert operator(make_docs([])).count() == 0


def removal(pairs, width):
    first = {}
    ordered = sorted((i is None, i or 0, (t or "").encode().split()) for i, t in pairs)
    for none, i, w in ordered:
        if not none:
            for k in range(len(w) - width + 1):
                first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for none, i, w in ordered:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            source = first.get(tuple(w[k : k + width]))
            if source is not None and (none or source < i):
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((str(None if none else i), len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "kmer"), [(50, 16), (6, 3)])
def test_substring_against_brute_force(make_docs, hard_pairs, width, kmer):
    known = [(i, t) for i, t in hard_pairs if i is not None]
    rows = substring_dedup.removal_digest(make_docs(known), width, kmer).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removal(known, width)


def test_substring_null_ids_are_no_source_and_keep_everything(make_docs):
    text = " ".join(f"v{k}" for k in range(80))
    rows = substring_dedup.removal_digest(make_docs([(None, text), (4, text), (9, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (4, 0), (9, 80)]


def test_substring_removes_from_texts_and_keeps_columns(make_docs, hard_pairs):
    docs = make_docs(hard_pairs)
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    want = {i: s for i, _, _, s in removal([p for p in hard_pairs if p[0] is not None], 50)}
    for r in out.where("doc_id is not null").collect():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[str(r.doc_id)]


def test_paths_cover_every_window_once():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 5, 49, 50, 51, 300)]
    row, start, n, edge, content, count = substring_dedup.super_edges_of(pa.array(texts), 50, 16)
    seen = Counter((r, s + k) for r, s, m in zip(row, start, n, strict=True) for k in range(m))
    assert seen == Counter((r, k) for r, c in enumerate(count) for k in range(max(0, c - 49)))


def test_substring_tells_rows_of_one_id_apart(make_docs):
    """Shorter, longer and unrelated texts under one id: no crash, and unique text stays."""
    long, unique = [f"v{k}" for k in range(300)], [f"u{k}" for k in range(300)]
    pairs = [(1, " ".join(long)), (2, "p q " * 40 + " ".join(long)), (2, "short text"), (2, " ".join(long)), (2, " ".join(unique)), (2, " ".join(unique)), (3, " ".join(unique[:80]))]
    docs = make_docs(pairs)
    rows = substring_dedup.removal_digest(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removal(pairs, 50)
    texts = sorted((r.text or "") for r in substring_dedup.remove_repeats(docs).collect())
    assert texts.count(" ".join(unique)) == 2 and "short text" in texts and texts.count("") == 2


def test_a_repeated_passage_compacts_to_one_path(spark, make_docs, monkeypatch):
    """A passage of 400 words in three documents is many super-edges, one chain, and one run for each copy."""
    rng = random.Random(3)
    passage = words(rng, 400)
    pairs = [(k, " ".join([*words(rng, 70), *passage, *words(rng, 70)])) for k in range(3)]
    seen = []
    compact = substring_dedup.compact_paths
    monkeypatch.setattr(substring_dedup, "compact_paths", lambda told: seen.append(compact(told)) or seen[-1])
    rows = substring_dedup.materialise(substring_dedup.id_text(make_docs(pairs)).withColumn("row", substring_dedup.F.monotonically_increasing_id()), "rows")
    runs = substring_dedup.repeated_runs(rows, 50, 16).collect()
    assert len(runs) == 2 and {r.n for r in runs} == {351} and len({(r.source, r.source_start) for r in runs}) == 1
    chain = seen[0].collect()
    assert len(chain) > 5 and len({r.root for r in chain}) == 1
    assert sorted(r.dist + r.own for r in chain)[:-1] == sorted(r.dist for r in chain)[1:]


def test_spans_that_differ_at_their_coordinates_are_an_error(spark, make_docs):
    rows = substring_dedup.materialise(substring_dedup.id_text(make_docs([(1, "a " * 60), (2, "b " * 60)])).withColumn("row", substring_dedup.F.monotonically_increasing_id()), "rows")
    one, two = (r.row for r in rows.orderBy("doc_id").collect())
    runs = lambda of: spark.createDataFrame([(two, 0, 3, of, 0)], "row long, start int, n int, source long, source_start int")
    with pytest.raises(RuntimeError):
        substring_dedup.verify(rows, runs(one), 50)


def words(rng, n):
    return [f"z{rng.randrange(100_000)}" for _ in range(n)]


def test_substring_hot_keys_are_salted(make_docs, monkeypatch):
    """One passage in most documents, each time between other words, with every repeated key taken for hot."""
    monkeypatch.setattr(substring_dedup, "hot_values", lambda counts, key, *_: [r[0] for r in counts.select(key).collect()])
    rng = random.Random(4)
    passage = words(rng, 70)
    pairs = [(k, " ".join([*words(rng, 30), *(passage if k % 4 else []), *words(rng, 30)])) for k in range(60)]
    rows = substring_dedup.removal_digest(make_docs(pairs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removal(pairs, 50)


def plain_similarity(texts):
    """Weighted Jaccard similarity over five-word shingles with (1 + ln tf) * idf, from dictionaries."""
    bags = []
    for t in texts:
        w = (t or "").encode().split()
        bags.append(Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    df = Counter(s for b in bags for s in b)
    n = len(texts)
    idf = {s: 1 + 0.25 * math.log((n + 1) / (c + 1)) / math.log(n + 1) for s, c in df.items()}
    weights = [{s: (1 + math.log(c)) * idf[s] for s, c in b.items()} for b in bags]

    def similar(i, j):
        a, b = weights[i], weights[j]
        both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        every = sum(a.values()) + sum(b.values()) - both
        return both / every if every else 1.0

    return similar


def plain_classes(pairs):
    """The smallest id of each row's class, by every pair of rows; null ids have none."""
    known = [k for k, (i, _) in enumerate(pairs) if i is not None]
    similar, parent = plain_similarity([t for _, t in pairs]), list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in known:
        for b in known:
            if a < b and find(a) != find(b) and similar(a, b) >= 0.8:
                parent[find(b)] = find(a)
    least = {}
    for k in known:
        least[find(k)] = min(least.get(find(k), pairs[k][0]), pairs[k][0])
    return [None if i is None else least[find(k)] for k, (i, _) in enumerate(pairs)]


def test_near_against_brute_force(make_docs, hard_pairs):
    docs = make_docs(hard_pairs)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(hard_pairs)
    assert sorted(map(str, zip((i for i, _ in hard_pairs), plain_classes(hard_pairs), strict=True))) == sorted(str((r.doc_id, r.class_id)) for r in rows)
    assert all(r.kept <= (r.doc_id is None or r.doc_id == r.class_id) for r in rows)
    classes = [r.class_id for r in rows if r.kept and r.class_id is not None]
    assert len(classes) == len(set(classes)) == len({r.class_id for r in rows} - {None})
    got = {r.doc_id: r.class_id for r in rows}
    assert got[21] == got[22] == got[23] == 20


def test_document_frequencies_are_exact_at_any_load(make_docs, hard_pairs, monkeypatch):
    """Many more distinct shingles than the sketch of 2^20 counters had, in small shards."""
    monkeypatch.setattr(near_dedup, "CHARS_A_SHARD", 500_000)
    rng = np.random.default_rng(12)
    many = [(1000 + k, " ".join([*(f"m{x}" for x in rng.integers(0, 10**6, 9000)), *(["five words in many documents"] if k < 3 else [])])) for k in range(150)]
    pairs = hard_pairs + many
    want = Counter()
    for _, t in pairs:
        want.update(set(near_dedup.shingles(pa.array([t or ""]))[1].tolist()))
    idf = near_dedup._frequencies(near_dedup.id_text(make_docs(pairs)))
    hashes = np.array(list(want), np.uint64)
    df = np.array(list(want.values()))
    assert len(want) > 1 << 20 and idf.documents == len(pairs)
    assert (idf.df(hashes) == df).all()
    n = len(pairs)
    assert np.allclose(idf.of(hashes), 1 + near_dedup.SPREAD * np.log((n + 1) / (df + 1)) / np.log(n + 1))


def test_near_tells_rows_of_one_id_apart(make_docs):
    rng = random.Random(21)
    a, b = (" ".join(words(rng, 200)) for _ in range(2))
    docs = make_docs([(1, a), (2, b), (2, a + " more"), (3, b + " more"), (2, b)])
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2)]
    kept = near_dedup.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (2, b)]


@pytest.mark.parametrize("plain", [3, 1000])
def test_near_hot_bucket_of_many_classes(make_docs, monkeypatch, plain):
    """One bucket holds all documents: 30 classes of near copies, all with a common half, which two turns of stand-ins can't settle; no link is lost."""
    signatures, sizes = near_dedup._signatures, []
    monkeypatch.setattr(near_dedup, "_signatures", lambda docs, known: signatures(docs, known).withColumn("bands", near_dedup.F.expr("transform(bands, (x, i) -> if(i = 0, 7L, x))")))
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *more: sizes.append(pairs.count()) or verified(pairs, *more))
    monkeypatch.setattr(near_dedup, "STAND_INS", 2)
    monkeypatch.setattr(near_dedup, "PLAIN", plain)
    rng = random.Random(22)
    common, pairs = words(rng, 150), []
    for k in range(30):
        own = words(rng, 150)
        for j in range(4):
            text = common + own
            text[160 + 30 * j] = f"changed{k}"
            pairs.append((k + 40 * ((j * 7 + k) % 4), " ".join(text)))
    rows = near_dedup.near_duplicates(make_docs(pairs)).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == sorted(zip((i for i, _ in pairs), plain_classes(pairs), strict=True))
    assert len({r.class_id for r in rows}) == 30
    assert sizes[-1] < 30 * 12 or plain == 1000  # the last turn pairs no two documents that share the common half alone


def test_near_loose_copies_of_one_text_are_not_all_paired(make_docs, monkeypatch):
    """120 copies of one text in one bucket, each with five of 300 changes that two of them have: pairs grow with the copies, not with their square."""
    signatures, sizes = near_dedup._signatures, []
    monkeypatch.setattr(near_dedup, "_signatures", lambda docs, known: signatures(docs, known).withColumn("bands", near_dedup.F.expr("transform(bands, (x, i) -> if(i = 0, 7L, hash(doc_id, i)))")))
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *more: sizes.append(pairs.count()) or verified(pairs, *more))
    rng = random.Random(24)
    base, texts = [f"b{rng.randrange(5000)}" for _ in range(150)], []
    partner = [rng.sample(range(120), 120) for _ in range(5)]
    for k in range(120):
        text = list(base)
        for j in range(5):
            change = partner[j][k] // 2 + 60 * j
            text[5 + 30 * j + 5 * (change % 5)] = f"c{change}"
        texts.append(text)
    for k in range(0, 120, 10):  # links that only the last turn may find
        texts.append([*texts[k][:-1], f"last{k}"])
    pairs = [((7 * k) % 132, " ".join(t)) for k, t in enumerate(texts)]
    rows = near_dedup.near_duplicates(make_docs(pairs)).collect()
    want = plain_classes(pairs)
    assert 100 < len(set(want)) <= 120
    assert sorted((r.doc_id, r.class_id) for r in rows) == sorted(zip((i for i, _ in pairs), want, strict=True))
    assert sum(sizes) < 10 * len(pairs)


def test_rarest_shingles_meet_for_all_similar_texts(make_docs):
    rng = random.Random(23)
    base, pairs = words(rng, 60), []
    for k in range(30):
        text = list(base)
        for _ in range(k % 4):
            text[rng.randrange(60)] = rng.choice(base[:9] + [f"n{rng.randrange(6)}"])
        pairs.append((k, " ".join(text)))
    docs = near_dedup.id_text(make_docs(pairs))
    idf = docs.sparkSession.sparkContext.broadcast(near_dedup._frequencies(docs))
    rare = defaultdict(set)
    for r in near_dedup._sizes(docs, idf)[1].collect():
        rare[r.doc_id].add(r.hash)
    similar = plain_similarity([t for _, t in pairs])
    near = [(a, b) for a in range(30) for b in range(a) if similar(a, b) >= 0.8]
    assert len(near) > 20 and all(rare[a] & rare[b] for a, b in near)


def test_near_chain_is_one_class(make_docs):
    rng = random.Random(2)
    text = [f"u{rng.randrange(10**6)}" for _ in range(400)]
    chain = []
    for k in range(12):
        text = list(text)
        for j in range(4):
            text[(k * 31 + j * 90) % 400] = f"n{k}_{j}"
        chain.append((k, " ".join(text)))
    rows = near_dedup.near_duplicates(make_docs(chain)).collect()
    assert {r.class_id for r in rows} == {0}


def test_near_drop_keeps_one_row_a_class(make_docs, hard_pairs):
    docs = make_docs([p for p in hard_pairs if p[0] != 5])
    out = near_dedup.drop_near_duplicates(docs)
    kept = near_dedup.near_duplicates(docs).where("kept").count()
    assert out.columns == docs.columns
    assert out.count() == kept


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(4)
    hashes = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    weights = rng.uniform(0.5, 3, 300).astype(np.float32)
    other = weights.copy()
    other[::4] *= 0.3
    s = [near_dedup.samples(np.array([0, 300]), hashes, w, 4000)[0] for w in (weights, other)]
    assert abs((s[0] == s[1]).mean() - np.minimum(weights, other).sum() / np.maximum(weights, other).sum()) < 0.03


def test_isolated_pairs_at_the_threshold_share_a_band():
    """20,000 pairs of similarity 0.8, 40 shingles of 50 in common: at most one in a thousand is no candidate."""
    rng, n = np.random.default_rng(8), 20_000
    shared, own = rng.integers(0, 2**63, (n, 40)), rng.integers(0, 2**63, (2, n, 5))
    bounds, weights = np.arange(n + 1) * 45, np.ones(n * 45, np.float32)
    bands = []
    for x in own:
        hashes = np.sort(np.hstack([shared, x]), 1).astype(np.uint64).reshape(-1)
        bands.append(near_dedup.samples(bounds, hashes, weights, near_dedup.BANDS * near_dedup.ROWS).reshape(n, near_dedup.BANDS, near_dedup.ROWS))
    missed = ~(bands[0] == bands[1]).all(2).any(1)
    assert missed.mean() < 0.001


def test_components_of_random_graph(spark):
    rng = random.Random(9)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(120)) if a != b}
    found = {r.node: r.root for r in near_dedup._components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    parent = list(range(200))
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == {i: p for i, p in enumerate(parent) if p != i}


def test_rows_are_chosen_by_number_without_moving_them(spark, monkeypatch):
    """Numbers far apart, a range without any that is wanted, numbers named twice, and no number at all."""
    monkeypatch.setattr(shards, "RANGE_BITS", 3)
    numbers = [0, 5, 7, 8, 9, 64, 70, 1 << 33, (1 << 33) + 1]
    rows = shards.materialise(spark.createDataFrame([(n, f"text {n}", {"x": n}) for n in numbers], "row long, text string, box struct<x:long>"), "rows")
    for wanted in ([5, 8, 8, 9, 1 << 33], numbers, []):
        out = shards.chosen(rows, "row", spark.createDataFrame([(n,) for n in wanted], "row long"))
        assert out.schema.simpleString() == rows.schema.simpleString()
        assert sorted((r.row, r.text, r.box.x) for r in out.collect()) == [(n, f"text {n}", n) for n in sorted(set(wanted))]
        rest = shards.chosen(rows, "row", spark.createDataFrame([(n,) for n in wanted], "row long"), others=True)
        assert sorted(r.row for r in rest.collect()) == sorted(set(numbers) - set(wanted))
