"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the vocabulary of the training texts as 64-bit word hashes, sharded
by hash range; a word's id is its rank.  Level m holds the last words of all m-grams
in order of the (m-1)-grams they follow, their nodes on the level above.  A node's
words are a range of the level: monotone pointers, an Elias-Fano sequence, give its
ends.  The words, each range raised by the end of the one before, are an
Elias-Fano sequence too, so a word is meaningful only with its node's pointers, and
is found by a successor search within the node's range.  Log probabilities and
back-off weights are quantised to 16 bits.  Shards are files in the shared folder
that executors memory-map; neither the driver nor any task holds a level.

Probabilities: interpolated absolute discounting, on each level with three
discounts estimated from its counts of counts, over the add-one unigram
distribution.  Level 2 stores the smoothed probability, the levels below it the
discounted share of their own count, to which a query adds the node's back-off
weight times the probability one word shorter.  The end of the previous text is
the context of a text's first token.

Counting is pre-aggregated per task in sorted blocks; a block row is a shard's
part of a task's distinct n-grams, delta coded and compressed.  The shards of all
levels from 2 on are ranges of an n-gram's first two words, cut at equal shares of
the training tokens, inside a first word if need be, so a word that is a third of
all tokens is spread over many shards.

Defined cases: null text is empty, one end token; a null id counts as the empty
text when rows are held out; words whose 64-bit hashes agree count as one; an
empty training set scores every text by the base alone; more than 2^32 - 1
distinct words are an error; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import coded_words, id_text, slices
from strandline.llm.elias_fano import EliasFano
from strandline.llm.hashing import word_hashes
from strandline.llm.shards import Gathered, load, remove, save, squeeze, unsqueeze
from strandline.scratch import drop, materialise, new_path

ORDER = 3
FOLDS, HELD_OUT = 7, 2
WORDS_A_SHARD, TOKENS_A_SHARD = 1 << 20, 3_000_000
_SLICE = 8_000_000
_STEP = 4096.0  # 16-bit codes are multiples of 1/4096 in -log10
END_HASH = 0  # of the empty word


def fold(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, codes, hashes): tokens of row i are ``hashes[codes[bounds[i]:bounds[i + 1]]]``, the last an end."""
    offsets, codes, words = coded_words(texts, lower=True)
    hashes = np.append(word_hashes(words, 1)[0, : len(words)], np.uint64(END_HASH))
    bounds = offsets + np.arange(len(offsets))
    out = np.full(int(bounds[-1]), len(hashes) - 1, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = codes
    return bounds, out, hashes


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * _STEP), 0, 65535).astype(np.uint16)


def _save_sequence(folder: str, name: str, key: str, values: np.ndarray, universe: int) -> None:
    ef = EliasFano.build(values, universe)
    save(folder, name, **{f"{key}_low": ef.low, f"{key}_bits": ef.bits, f"{key}_zeros": ef.zeros})


def _load_sequence(folder: str, name: str, key: str, n: int) -> EliasFano:
    return EliasFano(*(load(folder, name, f"{key}_{x}") for x in ("low", "bits", "zeros")), n)


class Vocabulary:
    """Level 1.  ``sizes`` are the words of each hash-range shard."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...], tokens: int):
        self.folder, self.bits, self.sizes, self.tokens = folder, bits, sizes, tokens
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.size = int(self.bases[-1])
        self.width = 64 - bits

    def _shard(self, k: int):
        name = f"words-{k}"
        return _load_sequence(self.folder, name, "hash", self.sizes[k]), load(self.folder, name, "count")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        shard = (hashes >> np.uint64(self.width)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for k in np.unique(shard):
            if self.sizes[k]:
                at = np.flatnonzero(shard == k)
                index, found = self._shard(int(k))[0].successor(hashes[at] & np.uint64((1 << self.width) - 1))
                out[at[found]] = index[found] + self.bases[k]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.bases, ids, "right") - 1
        for k in np.unique(shard[ids >= 0]):
            at = np.flatnonzero((shard == k) & (ids >= 0))
            out[at] = self._shard(int(k))[1][ids[at] - self.bases[k]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability."""
        return np.log10((counts + 1) / (self.tokens + self.size + 1))


class Trie:
    """All levels.  ``starts`` are the first keys (first word * vocabulary + second) of the shards, ``entries[m]`` their sizes on level m."""

    def __init__(self, words: Vocabulary, starts: np.ndarray, entries: dict[int, np.ndarray]):
        self.words, self.starts, self.entries, self.order = words, starts, entries, max(entries)

    def contexts(self, k: int) -> tuple[int, int]:
        """The first and the last word of which shard ``k`` may have successors."""
        return span_of(self.starts, k, self.words.size)

    def _shard(self, level: int, k: int) -> Level:
        first, last = self.contexts(k)
        nodes = last - first + 1 if level == 2 else int(self.entries[level - 1][k])
        return Level(self.words.folder, level, k, nodes, int(self.entries[level][k]))

    def pairs(self, context: np.ndarray, word: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 p(word | context), shard, node or -1) for distinct pairs of ids in ascending order; -1 is unknown, ``base`` the word's own."""
        out, node = base.copy(), np.full(len(base), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        shard = np.zeros(len(base), np.int64)
        shard[known] = np.searchsorted(self.starts, context[known].astype(np.uint64) * np.uint64(self.words.size) + np.maximum(word[known], 0).astype(np.uint64), "right") - 1
        for k in np.unique(shard[known]):
            at = known[shard[known] == k]
            level, relative = self._shard(2, int(k)), context[at] - self.contexts(int(k))[0]
            index = level.find(relative, word[at])
            node[at] = index
            out[at] = np.where(index >= 0, -(level.prob[np.maximum(index, 0)] / _STEP) if level.n else 0.0, base[at] - level.backoff[relative] / _STEP)
        return out, shard, node

    def extend(self, level: int, shard: np.ndarray, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own share, back-off weight, node or -1) of words after nodes of the level above; 0 and 1 after an unknown node."""
        share, weight, node = np.zeros(len(parent)), np.ones(len(parent)), np.full(len(parent), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        for k in np.unique(shard[known]):
            at = known[shard[known] == k]
            data = self._shard(level, int(k))
            index = data.find(parent[at], word[at])
            node[at] = index
            hit = np.flatnonzero(index >= 0)
            share[at[hit]] = 10 ** -(data.prob[index[hit]] / _STEP)
            weight[at] = 10 ** -(data.backoff[parent[at]] / _STEP)
        return share, weight, node

    def successors(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, log10 probabilities) stored for a word, by its pointers."""
        words, probs = [], []
        for k in range(len(self.starts)):
            first, last = self.contexts(k)
            if self.entries[2][k] and first <= context <= last:
                level = self._shard(2, k)
                a, b, base = (int(x[0]) for x in level.range_of(np.array([context - first])))
                words.append(level.next.access(np.arange(a, b)).astype(np.int64) - base)
                probs.append(-(np.asarray(level.prob[a:b]) / _STEP))
        return (np.concatenate(words), np.concatenate(probs)) if words else (np.zeros(0, np.int64), np.zeros(0))


def span_of(starts: np.ndarray, k: int, v: int) -> tuple[int, int]:
    return int(starts[k]) // v, (int(starts[k + 1]) - 1) // v if k + 1 < len(starts) else v - 1


class Level:
    """One shard of a level: the words after each of ``nodes`` nodes."""

    def __init__(self, folder: str, level: int, k: int, nodes: int, n: int):
        name, self.n = f"level{level}-{k}", n
        self.pointers = _load_sequence(folder, name, "pointer", nodes + 1)
        self.next = _load_sequence(folder, name, "next", n)
        self.prob, self.backoff = load(folder, name, "prob"), load(folder, name, "backoff")

    @staticmethod
    def write(folder: str, level: int, k: int, pointers: np.ndarray, word: np.ndarray, prob: np.ndarray, backoff: np.ndarray) -> None:
        size = np.diff(pointers)
        step = np.zeros(len(size), np.int64)  # one more than the last word of each range
        step[size > 0] = word[pointers[1:][size > 0] - 1] + 1
        base = np.cumsum(step) - step
        name = f"level{level}-{k}"
        _save_sequence(folder, name, "next", (word + np.repeat(base, size)).astype(np.uint64), int(step.sum()) + 1)
        _save_sequence(folder, name, "pointer", pointers.astype(np.uint64), len(word) + 1)
        save(folder, name, prob=quantise(np.log10(np.minimum(prob, 1))), backoff=quantise(np.log10(np.clip(backoff, 1e-15, 1))))

    def range_of(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First index, end, and what the words in between are raised by."""
        a, b = (self.pointers.access(node + x).astype(np.int64) for x in (0, 1))
        before = np.flatnonzero(a > 0)
        base = np.zeros(len(a), np.int64)
        base[before] = self.next.access(a[before] - 1).astype(np.int64) + 1
        return a, b, base

    def find(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The index of each word after its node, -1 where there is none."""
        out = np.full(len(node), -1, np.int64)
        each, inverse = np.unique(node, return_inverse=True)
        a, b, base = (x[inverse] for x in self.range_of(each))
        at = np.flatnonzero((word >= 0) & (a < b))
        if len(at):
            index, found = self.next.successor((base[at] + word[at]).astype(np.uint64), a[at], b[at])
            out[at[found]] = index[found]
        return out


def _cuts(counts: np.ndarray) -> tuple[list[int], list[float]]:
    """Where a level-1 shard is cut into equal shares of tokens: at which of its words, how far into its successors."""
    ends = np.cumsum(counts)
    parts = max(1, -(-int(ends[-1]) // TOKENS_A_SHARD))
    marks = np.arange(1, parts) * (ends[-1] / parts)
    at = np.searchsorted(ends, marks, "right")
    begin = ends[at] - counts[at]
    return at.tolist(), ((marks - begin) / counts[at]).tolist()


def build_vocabulary(training: DataFrame, folder: str) -> tuple[Vocabulary, np.ndarray]:
    """Level 1, and the first keys of the level-2 shards: equal shares of tokens, by context and then by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()

        def out() -> pa.RecordBatch:
            keys, counts = held.take()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["hash", "n"])

        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                _, codes, hashes = token_hashes(part.column("text"))
                n = np.bincount(codes, minlength=len(hashes))
                if held.add(hashes[n > 0], n[n > 0]):
                    yield out()
        yield out()

    table = materialise(training.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "unigrams")
    total = table.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    bits = max(3, (max(total["v"], 1) // WORDS_A_SHARD).bit_length())

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["shard"].iloc[0])
        hashes = frame["hash"].to_numpy(np.int64).view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
        order = np.argsort(hashes)
        counts = frame["n"].to_numpy(np.int64)[order]
        _save_sequence(folder, f"words-{k}", "hash", hashes[order], 1 << (64 - bits))
        save(folder, f"words-{k}", count=counts)
        at, share = _cuts(counts)
        return pd.DataFrame({"shard": [k], "words": [len(frame)], "at": [at], "share": [share]})

    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("shard")
    written = materialise(table.select(shard, "hash", "n").groupBy("shard").applyInPandas(write, "shard int, words long, at array<bigint>, share array<double>"), "words")
    rows = written.collect()  # a row a shard
    drop(table, written)
    sizes = [0] * (1 << bits)
    for r in rows:
        sizes[r["shard"]] = r["words"]
    words = Vocabulary(folder, bits, tuple(sizes), int(total["n"] or 0))
    if words.size >> 32:
        raise ValueError("more than 2^32 - 1 distinct words")
    starts = {int(words.bases[k]) * words.size for k in range(1 << bits)}
    for r in rows:
        starts |= {(int(words.bases[r["shard"]]) + i) * words.size + int(s * words.size) for i, s in zip(r["at"], r["share"], strict=True)}
    return words, np.array(sorted(s for s in starts if s < words.size**2) or [0], np.uint64)


def previous(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The token before each, or the end of another text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1]] = end
    return out


def deep_enough(bounds: np.ndarray, level: int) -> np.ndarray:
    """Places of the tokens that have an n-gram of ``level`` words, the first of which may be the end before the text."""
    at = np.arange(int(bounds[-1]))
    return np.flatnonzero(at - np.repeat(bounds[:-1], np.diff(bounds)) >= level - 2)


def distinct_ngrams(ids: np.ndarray, bounds: np.ndarray, end: int, order: int, v: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(level, first two words as one key, further words, counts) of the distinct n-grams, ascending, level by level from 2 on."""
    first, code, count = np.unique(previous(ids, bounds, end).astype(np.uint64) * np.uint64(v) + ids.astype(np.uint64), return_inverse=True, return_counts=True)
    columns: list[np.ndarray] = []
    yield 2, first, columns, count
    for level in range(3, order + 1):
        at = deep_enough(bounds, level)
        found = np.unique(code[at - 1] * v + ids[at], return_inverse=level < order, return_counts=True)
        key, count, up = found[0], found[-1], found[0] // v
        first, columns = first[up], [*(c[up] for c in columns), key % v]
        yield level, first, columns, count
        if level < order:
            code = np.zeros(len(ids), np.int64)
            code[at] = found[1]


_BLOCK = "level int, shard int, first long, keys binary, words array<binary>, counts binary"


def blocks(training: DataFrame, words: Vocabulary, starts: np.ndarray, order: int) -> DataFrame:
    """A task's distinct n-grams of every level from 2 on, block by block."""
    shared = training.sparkSession.sparkContext.broadcast((words, starts))  # a number a shard
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary())
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def cut(level: int, keys: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        edge = np.append(np.searchsorted(keys, starts), len(keys))
        signed = keys.view(np.int64)
        rows = [(level, k, int(signed[a]), squeeze(np.diff(keys[a:b], prepend=keys[a])), [squeeze(c[a:b]) for c in columns], squeeze(counts[a:b])) for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, starts), held = shared.value, Gathered()
        v = words.size
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                bounds, codes, hashes = token_hashes(part.column("text"))
                ids = words.find(hashes)
                end, ids = int(ids[-1]), ids[codes]
                for level, keys, columns, counts in distinct_ngrams(ids, bounds, end, order, v):
                    if level > 2:
                        yield cut(level, keys, columns, counts, starts)
                    elif held.add(keys, counts):
                        keys, counts = held.take()
                        yield cut(2, keys, [], counts, starts)
        keys, counts = held.take()
        yield cut(2, keys, [], counts, starts)

    return training.select("text").mapInArrow(run, _BLOCK)


def _merged(keys: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted distinct n-grams and their summed counts."""
    span, wide = int(keys.max() - keys.min()) + 1, int(columns[0].max()) + 1 if columns else 1
    if len(columns) < 2 and span * wide < 1 << 64:  # one sort of machine words, which merges the blocks' ascending pieces
        both = (keys - keys.min()) * np.uint64(wide) + (columns[0].astype(np.uint64) if columns else np.uint64(0))
        order = np.argsort(both, kind="stable")
    else:
        order = np.lexsort((*reversed(columns), keys))
    keys, columns, counts = keys[order], [c[order] for c in columns], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return keys[at], [c[at] for c in columns], np.add.reduceat(counts, at)


def build_trie(training: DataFrame, folder: str | None = None, order: int = ORDER) -> Trie:
    """Count the training texts (doc_id, text) and write all levels."""
    folder = folder or new_path(training.sparkSession, "trie")
    words, starts = build_vocabulary(training, folder)
    v, spark = words.size, training.sparkSession
    if not v:
        return Trie(words, starts, {m: np.zeros(len(starts), np.int64) for m in range(2, order + 1)})
    shared = spark.sparkContext.broadcast((words, starts))
    kinds = "level int, shard int, n long, n1 long, n2 long, n3 long, n4 long, a1 long, a2 long, a3 long, z1 long, z2 long, z3 long"
    names = [x.split()[0] for x in kinds.split(", ")]

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        """Merge a shard's blocks of one level and store its counts; how often each count is met, also after the first and last word."""
        level, k, starts = int(frame["level"].iloc[0]), int(frame["shard"].iloc[0]), shared.value[1]
        keys = np.concatenate([np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64) + np.uint64(f & (1 << 64) - 1) for f, b in zip(frame["first"].tolist(), frame["keys"], strict=True)])
        columns = [np.concatenate([unsqueeze(w[j], np.int64) for w in frame["words"]]) for j in range(level - 2)]
        keys, columns, counts = _merged(keys, columns, np.concatenate([unsqueeze(b, np.int64) for b in frame["counts"]]))
        packed = {f"word{j}": c for j, c in enumerate(columns)} | {"count": counts, "key": np.diff(keys, prepend=np.uint64(0))}
        save(folder, f"counts{level}-{k}", **{n: np.frombuffer(squeeze(x), np.uint8) for n, x in packed.items()})
        context = (keys // np.uint64(v)).astype(np.int64)
        ends = [[int(((counts == 1) & at).sum()), int(((counts == 2) & at).sum()), int(((counts >= 3) & at).sum())] if level == 2 else [0, 0, 0] for at in (context == c for c in span_of(starts, k, v))]
        return pd.DataFrame([[level, k, len(keys), *(int((counts == c).sum()) for c in (1, 2, 3, 4)), *ends[0], *ends[1]]], columns=names)

    table = materialise(blocks(training, words, starts, order).groupBy("level", "shard").applyInPandas(join, kinds), "merged")
    found = table.collect()  # a row a shard and level
    discounts, entries = {}, {}
    for m in range(2, order + 1):
        own = [r for r in found if r["level"] == m]
        n1, n2, n3, n4 = (max(1, sum(r[f"n{c}"] for r in own)) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[m] = np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.99, 1.98, 2.97])
        entries[m] = np.zeros(len(starts), np.int64)
        entries[m][[r["shard"] for r in own]] = [r["n"] for r in own]
    edges: dict[int, np.ndarray] = {}  # a word at the edge of a shard may go on in the next one
    for r in found:
        if r["level"] == 2:
            first, last = span_of(starts, r["shard"], v)
            edges[first] = edges.get(first, 0) + np.array([r["a1"], r["a2"], r["a3"]])
            if last != first:
                edges[last] = edges.get(last, 0) + np.array([r["z1"], r["z2"], r["z3"]])
    todo = []
    for k in range(len(starts)):
        both = [np.asarray(edges.get(c, np.zeros(3, np.int64))).tolist() for c in span_of(starts, k, v)]
        todo.append((k, [int(entries[m][k]) for m in range(2, order + 1)], *both))

    def read(level: int, k: int, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        if not n:
            return np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * (level - 2), np.zeros(0, np.int64)
        get = lambda x, t: unsqueeze(np.asarray(load(folder, f"counts{level}-{k}", x)).tobytes(), t)
        return np.cumsum(get("key", np.uint64), dtype=np.uint64), [get(f"word{j}", np.int64) for j in range(level - 2)], get("count", np.int64)

    def write_shard(k: int, sizes: list[int], a: list[int], z: list[int]) -> None:
        words, starts = shared.value
        first, last = span_of(starts, k, v)
        above: list[np.ndarray] = []  # keys of the levels done
        for level, n in enumerate(sizes, 2):
            keys, columns, counts = read(level, k, n)
            kind = np.minimum(counts, 3) - 1
            if level == 2:
                node, word, nodes = (keys // np.uint64(v)).astype(np.int64) - first, (keys % np.uint64(v)).astype(np.int64), last - first + 1
                above.append(keys)
            else:
                node = np.searchsorted(above[0], keys)
                for j, c in enumerate(columns[:-1]):
                    node = np.searchsorted(above[j + 1], node.astype(np.uint64) * np.uint64(v) + c.astype(np.uint64))
                word, nodes = columns[-1], sizes[level - 3]
                above.append(node.astype(np.uint64) * np.uint64(v) + word.astype(np.uint64))
            seen = np.stack([np.bincount(node[kind == c], minlength=nodes) for c in range(3)], 1)
            if level == 2:
                seen[0], seen[last - first] = a, z
                total = np.maximum(words.counts(np.arange(first, last + 1)), 1)
            else:
                total = np.maximum(np.bincount(node, counts, nodes), 1)
            weight = np.where(seen.any(1), (seen @ discounts[level]) / total, 1.0)
            share = (counts - discounts[level][kind]) / total[node]
            if level == 2:
                share = share + weight[node] * 10 ** words.base(words.counts(word))
            Level.write(folder, level, k, np.searchsorted(node, np.arange(nodes + 1)), word, share, weight)
        for level in range(2, order + 1):
            remove(folder, f"counts{level}-{k}", "key", "count", *(f"word{j}" for j in range(level - 2)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                write_shard(row["shard"], row["sizes"], row["a"], row["z"])
            yield batch.select(["shard"])

    work = spark.createDataFrame(todo, "shard int, sizes array<long>, a array<long>, z array<long>").repartition(len(todo), "shard")
    drop(table, materialise(work.mapInArrow(write, "shard int"), "written"))
    return Trie(words, starts, entries)


def score_with(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, held_out, text)."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    shared = docs.sparkSession.sparkContext.broadcast(trie)  # a few numbers a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        words = trie.words
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                bounds, codes, hashes = token_hashes(part.column("text"))
                ids = words.find(hashes)
                counts = words.counts(ids)
                base = words.base(counts)
                n, context = len(hashes), previous(codes, bounds, len(hashes) - 1)
                # n-grams of codes in order of ids, so that the levels are read in order
                order = np.argsort(ids, kind="stable")
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                pairs, gram = np.unique(place[context] * n + place[codes], return_inverse=True)
                a, b = order[pairs // n], order[pairs % n]
                score, shard, node = trie.pairs(ids[a], ids[b], base[b]) if words.size else (base[b], np.zeros(len(b), np.int64), np.full(len(b), -1))
                score = score[gram]
                for level in range(3, trie.order + 1):
                    at = deep_enough(bounds, level)
                    grams, inverse = np.unique(gram[at - 1] * n + place[codes[at]], return_inverse=True)
                    parent, word = grams // n, ids[order[grams % n]]
                    share, weight, found = trie.extend(level, shard[parent], node[parent], word)
                    score[at] = np.log10(share[inverse] + weight[inverse] * 10 ** score[at])
                    shard, node = shard[parent], found
                    gram = np.zeros(len(codes), np.int64)
                    gram[at] = inverse
                each = lambda x: pa.array(np.add.reduceat(x, bounds[:-1]))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds)), each((counts > 0)[codes].astype(np.int64)), pa.array(np.full(part.num_rows, words.tokens, np.int64)), each(base[codes]), each(score)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Train on the rows that are not held out, and score every row."""
    rows = id_text(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)
    return score_with(rows, build_trie(rows.where(~F.col("held_out")), order=order))


def in_training(doc_id) -> bool:
    """``fold`` for one id, outside Spark."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS != HELD_OUT
