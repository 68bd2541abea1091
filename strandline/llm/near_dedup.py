"""Near duplicates by improved consistent weighted sampling (ICWS).

A document is its set of five-word shingles (all its words, if fewer) with weight
``(1 + ln tf) * idf``.  ``idf`` runs from 1 (in all documents) to ``1 + SPREAD``
(in one), so that a text's copies, which make its own shingles common, can't talk
it out of being a duplicate.  Document frequencies are exact: every distinct shingle
hash is counted over all documents, in hash-range shards whose number grows with
the corpus.  Shingles in two documents or more are kept in sorted files in the
shared folder that executors memory-map; all others are in one.

1. Documents of equal word sequences are one node, the smallest id standing for it.
2. ``BANDS`` x ``ROWS`` consistent samples per document, banded into buckets.
3. Each node is first compared with the smallest id of its buckets alone.  Pointer
   jumping over the verified pairs gives classes.
4. A bucket whose members are still in several classes compares the members
   outside its largest class with a few of that class, other ones each turn.
5. What is unsettled even then is worked out in full: a member outside its
   bucket's largest class meets every member of another class of any such bucket
   with which it shares one of the rarest shingles of both, without which the rest
   weighs too little for similar texts.  Documents that share common passages, or
   are loose copies of one text, are thus not all paired.  No other candidate pair
   is skipped unless it is within one class already, so classes are those of all
   candidate pairs.

Pairs are verified by exact weighted Jaccard similarity over the whole texts.

Defined cases: null text is empty, texts without words are one class; a null id
is a class of its own; rows that repeat an id are told apart, each is compared by
its own text, and of a class with several rows of the smallest id one is kept; an
empty table gives an empty result; further columns are not read
(``drop_near_duplicates`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import coded_words, id_text, slices
from strandline.llm.hashing import Rolling, mix, word_hashes
from strandline.llm.shards import Gathered, chosen, load, merge, save, squeeze, unsqueeze
from strandline.scratch import drop, materialise, new_path

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 14, 4
TURNS, STAND_INS, PLAIN = 3, 8, 1000
SPREAD = 0.25
CHARS_A_SHARD = 8_000_000
_SLICE, _CHUNK = 3_000_000, 80_000


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashes, counts, keys): distinct shingles of row i, ascending, and a 128-bit key of its word sequence."""
    offsets, codes, dictionary = coded_words(texts)
    table = word_hashes(dictionary)
    one, two = Rolling(codes, table, 0), Rolling(codes, table, 1)
    size = np.diff(offsets)
    n = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(row)) + np.repeat(offsets[:-1] - np.cumsum(n) + n, n)
    hashes = one.of(at, np.minimum(at + words, offsets[1:][row]))
    order = _by_row(row, hashes)
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    keys = np.stack([one.of(offsets[:-1], offsets[1:]), two.of(offsets[:-1], offsets[1:])], 1)
    return np.searchsorted(row[first], np.arange(len(size) + 1)), hashes[first], np.diff(np.append(first, len(row))), keys


def _by_row(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by row, then by the upper 44 bits of the hash: one sort of machine words.

    A batch has under 2^20 rows.  Equal hashes come together unless a third one
    of the same row shares their upper bits and falls between.
    """
    return np.argsort(row.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20), kind="stable" if len(row) < 64 else None)


class Frequencies:
    """Document frequencies as a function from shingles to idf; ``sizes`` are the shingles stored in each hash-range shard."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...], documents: int):
        self.folder, self.bits, self.sizes, self.documents = folder, bits, sizes, documents

    def df(self, hashes: np.ndarray) -> np.ndarray:
        """Documents that hold each shingle, 1 for those not stored."""
        out = np.ones(len(hashes), np.int64)
        order = np.argsort(hashes)
        ranked = hashes[order]
        cut = _cut(ranked, self.bits)
        for k in np.flatnonzero(np.diff(cut)):
            if self.sizes[k]:
                keys, counts = (load(self.folder, f"df-{k}", x) for x in ("key", "count"))
                wanted = ranked[cut[k] : cut[k + 1]]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == wanted)
                out[order[cut[k] + hit]] = counts[at[hit]]
        return out

    def of(self, hashes: np.ndarray) -> np.ndarray:
        scale = np.log(self.documents + 1) or 1.0
        return (1 + SPREAD * np.log((self.documents + 1) / (self.df(hashes) + 1)).clip(0) / scale).astype(np.float32)

    def weights(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return ((1 + np.log(counts)) * self.of(hashes)).astype(np.float32)


def _cut(ranked: np.ndarray, bits: int) -> np.ndarray:
    """Where each of ``2^bits`` hash ranges starts among ascending hashes, and the end."""
    return np.append(np.searchsorted(ranked, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(ranked))


def _survey(docs: DataFrame) -> DataFrame:
    """(shard, bits, first, keys, counts) of a task's distinct shingles, block by block."""
    names = ["shard", "bits", "first", "keys", "counts"]
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    bits = max(3, (chars // CHARS_A_SHARD).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()

        def out() -> pa.RecordBatch:
            keys, counts = held.take()
            cut = _cut(keys, bits)
            rows = [(k, bits, int(keys[a : a + 1].view(np.int64)[0]), squeeze(np.diff(keys[a:b], prepend=keys[a])), squeeze(counts[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                _, hashes, _, _ = shingles(part.column("text"))
                if held.add(*merge([hashes], [np.ones(len(hashes), np.int64)])):
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "shard int, bits int, first long, keys binary, counts binary")


def _frequencies(docs: DataFrame) -> Frequencies:
    """Merge the tasks' blocks shard by shard; the driver gets a row a shard."""
    folder = new_path(docs.sparkSession, "frequencies")

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["shard"].iloc[0])
        firsts = frame["first"].to_numpy(np.int64).view(np.uint64)
        keys, counts = merge([np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64) + f for f, b in zip(firsts, frame["keys"], strict=True)], [unsqueeze(b, np.int64) for b in frame["counts"]])
        often = counts > 1
        if often.any():
            save(folder, f"df-{k}", key=keys[often], count=counts[often])
        return pd.DataFrame({"shard": [k], "bits": [int(frame["bits"].iloc[0])], "n": [int(often.sum())]})

    rows = materialise(_survey(docs).groupBy("shard").applyInPandas(joined, "shard int, bits int, n long"), "shards").collect()  # a row a shard
    bits = rows[0]["bits"] if rows else 3
    sizes = [0] * (1 << bits)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    return Frequencies(folder, bits, tuple(sizes), docs.count())


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1): values at 2^12 levels, logs at 2^16."""

    def quantiles(bits: int) -> np.ndarray:
        p = (np.arange(1 << bits) + 0.5) / (1 << bits)
        lo, hi = np.zeros(len(p)), np.full(len(p), 60.0)
        for _ in range(60):
            x = (lo + hi) / 2
            below = 1 - np.exp(-x) * (1 + x) < p
            lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        return (lo + hi) / 2

    return quantiles(12).astype(np.float32), np.log(quantiles(16)).astype(np.float32)


_R, _LOG_C = _tables()


def samples(bounds: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """ICWS: an int64 per (row, sample); two rows agree on a sample with the probability of their weighted Jaccard similarity.

    Rows must not be empty.  Work is done in chunks that stay in the cache.
    """
    out = np.empty((len(bounds) - 1, n), np.uint64)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _CHUNK, "right")) - 1)
        lo, hi = bounds[first], bounds[last]
        h, lw = hashes[lo:hi], np.log(weights[lo:hi])
        starts, size = bounds[first:last] - lo, np.diff(bounds[first : last + 1])
        for k in range(n):
            x = (h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            r = _R[(x & np.uint64(0xFFF)).astype(np.int32)]
            c = _LOG_C[((x >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.int32)]
            beta = ((x >> np.uint64(28)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(lw / r + beta)
            a = c - r * (t + np.float32(1) - beta)
            least = np.minimum.reduceat(a, starts)
            hit = np.flatnonzero(a == np.repeat(least, size))
            at = hit[np.searchsorted(hit, starts)]
            out[first:last, k] = mix(h[at] ^ t[at].astype(np.int64).view(np.uint64) * np.uint64(0xA0761D6478BD642F))
        first = last
    return out


def _signatures(docs: DataFrame, known: Broadcast) -> DataFrame:
    """doc_id, id, k1, k2 (the key of the word sequence), bands array<long>, which is empty for documents without words."""
    names = ["doc_id", "id", "k1", "k2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = known.value
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                bounds, hashes, counts, keys = shingles(part.column("text"))
                some = np.diff(bounds) > 0
                full = np.flatnonzero(some)
                s = samples(np.append(bounds[:-1][full], bounds[-1]), hashes, idf.weights(hashes, counts), BANDS * ROWS).reshape(len(full), BANDS, ROWS)
                mixed = np.zeros((len(full), BANDS), np.uint64)
                for k in range(ROWS):
                    mixed = mix(mixed * np.uint64(0xE7037ED1A0B428DB) + s[:, :, k])
                columns = [pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in (0, 1)]
                ends = np.append(0, np.cumsum(some * BANDS)).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(mixed.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), *columns, bands], names)

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "id")]
    return docs.select("doc_id", "id", "text").mapInArrow(run, f"{', '.join(kinds)}, k1 long, k2 long, bands array<bigint>")


def similarity(left: pa.Array, right: pa.Array, idf: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 1 where both have no words."""
    rows, hashes, weights = [], [], []
    for texts in (left, right):
        bounds, h, counts, _ = shingles(texts)
        rows.append(np.repeat(np.arange(len(texts)), np.diff(bounds)))
        hashes.append(h)
        weights.append(idf.weights(h, counts).astype(float))
    row, h, w = np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights)
    order = _by_row(row, h)
    row, h, w = row[order], h[order], w[order]
    twice = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(row[twice], np.minimum(w[twice], w[twice + 1]), len(left))
    total = np.bincount(row, w, len(left))
    return np.where(total > 0, both / np.maximum(total - both, 1e-12), 1.0)


def _sizes(texts: DataFrame, known: Broadcast) -> tuple[DataFrame, DataFrame]:
    """(doc_id, total, own): a document's weight, and the weight of shingles that no other of ``texts`` has; (doc_id, hash, before) of its rarest shingles.

    Two of these documents share at most ``total - own`` of either, and their
    union holds the total of the one and what is the other's own: an exact upper
    bound of their similarity.  The rarest shingles are those, by frequency and
    hash, after which less than ``SIMILAR`` of the weight is left: of two similar
    documents the one whose rarest shingles end first has one in common with the
    rarest of the other, or else they share too little.  ``before`` is the weight
    of the document's shingles rarer than this one, for a closer bound on a pair.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                bounds, hashes, counts, _ = shingles(part.column("text"))
                rows = pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds)))
                weight = known.value.weights(hashes, counts).astype(float)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                order = np.lexsort((hashes, known.value.df(hashes), row))
                sums = np.concatenate([[0.0], np.cumsum(weight[order])])
                begin, total = sums[bounds[:-1]], sums[bounds[1:]] - sums[bounds[:-1]]
                ahead = sums[:-1] - begin[row]
                before = np.empty(len(order))
                before[order] = np.where(ahead <= (1 - SIMILAR) * total[row] + 1e-3, ahead, np.nan)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), pa.array(hashes.view(np.int64)), pa.array(weight), pa.array(before, from_pandas=True)], ["doc_id", "hash", "w", "before"])

    each = materialise(texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hash long, w double, before double"), "shingles")
    single = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("w").alias("w")).where("n = 1")
    total = each.groupBy("doc_id").agg(F.sum("w").alias("total"))
    own = single.groupBy("doc_id").agg(F.sum("w").alias("own"))
    sizes = materialise(total.join(own, "doc_id", "left").na.fill(0.0, ["own"]), "sizes")
    rare = materialise(each.where("before is not null").select("doc_id", "hash", "before"), "rare")
    drop(each)
    return sizes, rare


def _verified(pairs: DataFrame, texts: DataFrame, known: Broadcast) -> DataFrame:
    """The pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1_000_000):
                near = similarity(part.column("text_a"), part.column("text_b"), known.value) >= SIMILAR
                yield part.select(["a", "b"]).filter(pa.array(near))

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose parents have smaller ids, by pointer jumping."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        parents = materialise(parents.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        moved = parents.agg(F.max("moved").alias("m")).first()["m"]
        parents = parents.select("node", "root")
        if not moved:
            return parents


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b) that isn't the smallest of its component.

    Each node points at its smallest neighbour; paths are contracted, edges
    renamed to their ends' roots, until no edge is left between two roots.
    """
    out = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        forest = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a").select(F.col("a").alias("node"), F.col("b").alias("root"))
        step = _roots(materialise(forest, "forest"))
        out = step if out is None else _follow(out, step).unionByName(step.join(out, "node", "left_anti"))
        edges = materialise(_renamed(edges, step).distinct(), "edges")
        if edges.isEmpty():
            return out


def _unsettled(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """band, bucket, doc_id, root, main: members of buckets that hold several classes; ``main`` is a bucket's largest."""
    of = classes.select(F.col("node").alias("doc_id"), "root")
    placed = materialise(shared.join(of, "doc_id", "left").select("band", "bucket", "doc_id", F.coalesce("root", "doc_id").alias("root")), "placed")
    per = placed.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    several = per.groupBy("band", "bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return materialise(placed.join(materialise(several.select("band", "bucket", F.col("most.root").alias("main")), "several"), ["band", "bucket"]), "open")


def _follow(classes: DataFrame, step: DataFrame) -> DataFrame:
    up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return materialise(classes.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "classes")


def _renamed(edges: DataFrame, step: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, loops dropped, smaller id first."""
    a, b = (step.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    found = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _meetings(open_: DataFrame, rare: DataFrame, side) -> DataFrame:
    """Members outside their bucket's largest class with the members they may be similar to.

    Similar documents share ``SIMILAR / (1 + SIMILAR)`` of their summed totals.  The
    first shingle that both have, by frequency and hash, must thus leave either as
    much from there on.  Members meet by such shingles alone, whatever their buckets,
    so what a bucket's members all have makes no pairs; pairs that share no band are
    candidates the bands have missed.  Each document brings its rarest shingles once.
    A shingle of more than ``PLAIN`` members is dealt over several keys: a member
    outside goes to each of them, and meets any other at one.
    """
    docs = open_.groupBy("doc_id", "root", "total", "own").agg(F.max(F.expr("root <> main")).alias("outside"))
    members = materialise(rare.join(docs, "doc_id"), "rarest")
    hashes = members.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("outside").alias("some"), F.min("root").alias("least"), F.max("root").alias("most"))
    members = members.join(hashes.where("some and least < most").select("hash", F.ceil(F.col("n") / PLAIN).alias("parts")), "hash")
    x = members.where("outside").select("hash", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), *side("x"), F.col("before").alias("bx"))
    y = members.select("hash", F.expr("pmod(xxhash64(doc_id), parts)").alias("part"), *side("y"), F.col("before").alias("by"), (~F.col("outside")).alias("inner"))
    shared = SIMILAR / (1 + SIMILAR) * (F.col("tx") + F.col("ty")) - 1e-3
    first = (F.col("tx") - F.col("bx") >= shared) & (F.col("ty") - F.col("by") >= shared)
    return x.join(y, ["hash", "part"]).where((F.col("rx") != F.col("ry")) & first & (F.col("inner") | (F.col("x") < F.col("y"))))


def near_classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, class_id, kept of (row, doc_id, text), a stored table in which ``row`` is each row's own number.

    ``class_id`` is the smallest id of the class; the row that stays is the one
    with the smallest id and number.
    """
    numbered = docs.select(F.col("row").alias("doc_id"), "text")  # all steps tell documents apart by their numbers
    idf = docs.sparkSession.sparkContext.broadcast(_frequencies(numbered))
    named = docs.where("doc_id is not null").select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"), "text")
    signed = materialise(_signatures(named, idf), "signed")
    rows = signed.select(F.col("doc_id").alias("row"), "id", "k1", "k2")
    first = F.min(F.struct("id", "row")).alias("least")
    nodes = materialise(rows.groupBy("k1", "k2").agg(F.min("row").alias("node"), first), "nodes")
    members = signed.join(nodes.select(F.col("node").alias("doc_id")), "doc_id").select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    members = materialise(members, "members")
    leaders = materialise(members.groupBy("band", "bucket").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leaders")
    shared = materialise(members.join(leaders, ["band", "bucket"]).select("band", "bucket", "doc_id", "leader"), "shared")
    drop(members, leaders)
    texts = materialise(chosen(numbered, "doc_id", shared), "texts", codec="zstd")
    pairs = shared.groupBy("doc_id").agg(F.min("leader").alias("a")).where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    links = materialise(_verified(pairs, texts, idf), "links")
    classes = _roots(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    tried, sizes, rare = pairs, None, None
    for turn in range(TURNS):
        open_ = _unsettled(shared, classes)
        if sizes is None:
            sizes, rare = _sizes(chosen(texts, "doc_id", open_), idf)
        open_ = materialise(open_.join(sizes.where(F.col("total") - F.col("own") >= SIMILAR * F.col("total") - 1e-3), "doc_id"), "bounded")
        side = lambda x: [F.col("doc_id").alias(x), F.col("root").alias(f"r{x}"), F.col("total").alias(f"t{x}"), F.col("own").alias(f"o{x}")]
        near = F.least(F.expr("tx - ox"), F.expr("ty - oy")) >= SIMILAR * F.greatest(F.expr("tx + oy"), F.expr("ty + ox")) - 1e-3
        if turn < TURNS - 1:  # a few members of the largest class, others each turn
            draw = F.xxhash64("doc_id", F.lit(turn))
            few = open_.where("root = main").groupBy("band", "bucket", F.pmod(draw, F.lit(STAND_INS)).alias("s"))
            few = few.agg(F.min(F.struct(draw.alias("m"), "doc_id", "root", "total", "own")).alias("y"))
            met = open_.where("root <> main").select("band", "bucket", *side("x")).join(few.select("band", "bucket", "y.*").select("band", "bucket", *side("y")), ["band", "bucket"])
        else:
            met = _meetings(open_, rare, side)
        left = met.where((F.col("rx") != F.col("ry")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = materialise(left.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        drop(open_)
        if left.isEmpty():
            continue
        tried = tried.unionByName(left)
        merged = materialise(_renamed(_verified(left, texts, idf), classes).distinct(), "edges")
        if not merged.isEmpty():
            step = _components(merged)
            classes = _follow(classes, step).unionByName(step.join(classes, "node", "left_anti"))
    rooted = nodes.join(classes, "node", "left").select("k1", "k2", "least", F.coalesce("root", "node").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("least").alias("stays"))
    top = rooted.join(stays, "root").select("k1", "k2", "stays")
    found = rows.join(top, ["k1", "k2"]).select("row", F.col("id").alias("doc_id"), F.col("stays.id").alias("class_id"), (F.col("row") == F.col("stays.row")).alias("kept"))
    return found.unionByName(docs.where("doc_id is null").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept, one row per row."""
    return near_classes(materialise(id_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "documents", codec="zstd")).drop("row")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id, columns as they are; rows with a null id stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("box")
    stored = materialise(docs.select(whole, F.monotonically_increasing_id().alias("row")), "documents", codec="zstd")
    known = stored.select("row", F.col("box.doc_id").alias("doc_id"), F.coalesce("box.text", F.lit("")).alias("text"))
    return chosen(stored, "row", near_classes(known).where("kept")).select("box.*")
