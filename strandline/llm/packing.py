"""Packing by the length histogram, shortest pack first.

Documents are tokenised and cut into pieces of at most ``capacity`` ids.  The
histogram of piece lengths (at most ``capacity`` rows, the only thing the driver
sees) is packed: lengths are placed longest first, each into the packs with the
least in them that still have room, as counts of packing patterns.  A pattern is
a multiset of lengths with a count, so the work does not grow with the corpus.
Pieces then take their places by their rank within their length: the r-th piece
of a length has one slot of one instance of one pattern.

Ranks are dealt by (length, salt), the salt from a number that each stored piece
has of its own, so a length that a third of all pieces share is counted by as many
tasks as the session shuffles into, also if those pieces are copies of one row.

Defined cases: null and empty text are the closing id alone; a null id stays
null; repeated rows are packed as often as they occur; an empty table gives no
pieces; columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import coded_words, id_text, shuffle_width, slices
from strandline.scratch import materialise

CAPACITY = 4096
END = 2
_CACHE = 250_000
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_SIMPLE = re.compile(f"([{_LETTERS}]*)([.,;:!?|#$%&*]*)")


class WordTokens:
    """Token ids of words, each word encoded once; exact because this tokenizer never looks across white space.

    A word of Latin letters with signs after it is two pre-tokens at most, which
    go to the model alone; any other word takes the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.printed = str.maketrans({c: self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LETTERS.lower()})
        self.parts: dict[str, tuple[int, ...]] = {"": ()}
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        if (got := self.parts.get(text)) is None:
            got = tuple([t.id for t in self.model.tokenize(text.translate(self.printed))])
            if len(self.parts) > _CACHE:
                self.parts = {"": ()}
            self.parts[text] = got
        return got

    def words(self, new: list[str]) -> list[tuple[int, ...]]:
        out, odd = [], []
        for w in new:
            if m := _SIMPLE.fullmatch(w):
                letters, signs = m.groups()
                out.append(self.part(letters.lower()) + self.part(signs))
            else:
                odd.append(len(out))
                out.append(w)
        for k, e in zip(odd, self.library.encode_batch_fast([out[k] for k in odd], add_special_tokens=False) if odd else (), strict=True):
            out[k] = e.ids
        return out

    def slots(self, words: list[str]) -> np.ndarray:
        """The place of each word in ``starts`` and ``lengths``."""
        if len(self.slot) > _CACHE:
            self.reset()
        known = self.slot
        new = [w for w in words if w not in known]
        if new:
            ids = self.words(new)
            n = np.array(list(map(len, ids)), np.int64)
            flat = np.array(list(chain.from_iterable(ids)), np.uint32)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(n) - n])
            self.lengths = np.concatenate([self.lengths, n])
            self.pool = np.concatenate([self.pool, flat])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return np.array([known[w] for w in words], np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): ids of row i are ``ids[bounds[i]:bounds[i + 1]]``, each row closed by ``end``."""
        offsets, codes, words = coded_words(texts)
        at = self.slots(words.to_pylist())[codes]
        n = self.lengths[at]
        total = np.concatenate([[0], np.cumsum(n)])
        bounds = total[offsets] + np.arange(len(offsets))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        place = np.arange(int(total[-1]))
        ids = self.pool[place + np.repeat(self.starts[at] - total[:-1], n)]
        out = np.full(int(bounds[-1]), end, np.uint32)
        out[place + np.repeat(row, n)] = ids
        return bounds, out


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        for batch in batches:
            for part in slices(batch, "text", 3_000_000):
                bounds, ids = words.encode(part.column("text"), end)
                total = np.diff(bounds)
                k = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), k)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * capacity
                length = np.minimum(capacity, total[row] - start)
                raw, at = ids.astype("<u4", copy=False).tobytes(), bounds[:-1][row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row]))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = id_text(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (count, [(length, times), ...]), lengths longest first.

    Packs wait in a heap by what they hold.  A length goes into the packs that
    hold least; new packs open when none has room.
    """
    waiting: list[tuple[int, int, int, tuple]] = []  # held, order, count, pattern
    order = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        placed = []
        while n:
            if waiting and waiting[0][0] + length <= capacity:
                held, _, count, pattern = heapq.heappop(waiting)
            else:
                held, count, pattern = 0, 0, ()
            if count:
                take, times = min(n, count), 1
                if take < count:
                    order += 1
                    heapq.heappush(waiting, (held, order, count - take, pattern))
            else:
                times = min(n, max(1, capacity // length) if len(counts) == 1 else 1)
                take = n // times
            n -= take * times
            placed.append((held + length * times, take, (*pattern, (length, times))))
            if not waiting or placed[0][0] < waiting[0][0]:  # a pack just filled may again hold least
                order += 1
                for item in placed:
                    order += 1
                    heapq.heappush(waiting, (item[0], order, item[1], item[2]))
                placed = []
        for item in placed:
            order += 1
            heapq.heappush(waiting, (item[0], order, item[1], item[2]))
    merged: dict[tuple, int] = {}
    for _, _, count, pattern in waiting:
        runs: list[tuple[int, int]] = []
        for length, times in pattern:
            if runs and runs[-1][0] == length:
                runs[-1] = (length, runs[-1][1] + times)
            else:
                runs.append((length, times))
        merged[tuple(runs)] = merged.get(tuple(runs), 0) + count
    return [(n, list(p)) for p, n in sorted(merged.items(), reverse=True)]


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """One row per (pattern, length): the ranks it takes, and where they go."""
    taken: dict[int, int] = {}
    rows, sequences = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            lo = taken.get(length, 0)
            rows.append((length, lo, times, sequences, offset))
            taken[length] = lo + times * count
            offset += length * times
        sequences += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "times", "first", "offset"), table.T, strict=True))


def ranked(pieces: DataFrame, number: str) -> DataFrame:
    """``pieces`` with ``rank``, counted from 0 within each length over all tasks; ``number`` differs on every row, also on rows that repeat."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(number), F.lit(shuffle_width(pieces.sparkSession))).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy(number)) - 1
    return salted.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + own).drop("salt", "base")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, start, length, ids_crc32, ...)."""
    names = pieces.columns
    pieces = materialise(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = slot_table(pack_histogram(counts, capacity))
    shift = 1 << 42
    starts = slots["length"] * shift + slots["lo"]
    shared = pieces.sparkSession.sparkContext.broadcast((starts, slots))  # at most capacity patterns times 90 lengths
    ordered = ranked(pieces, "piece").select(*names, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, slots = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(starts, length * shift + rank, "right") - 1
            at = rank - slots["lo"][row]
            times = slots["times"][row]
            where = [pa.array(slots["first"][row] + at // times, pa.int64()), pa.array(slots["offset"][row] + length * (at % times), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *where], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "piece")
    return ordered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut, store and pack all documents."""
    return pack(token_pieces(docs, path, capacity, end, with_ids), capacity)
