"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be spanned by a
merge: between two such bytes a cut is certain.  Each pre-token is cut there,
the fragments are encoded on their own, each once per worker as long as it stays
in a bounded cache, and the ids are concatenated.

Pre-tokens come from the tokenizer's published pattern.  Python's ``regex`` and
the library know slightly different Unicode versions; a text with characters
outside the ranges where both agree is split by the library's pre-tokenizer.

Defined cases: null and empty text give no ids; special tokens spelled out in a
text are matched as the library does by default; a null id stays null; repeated
rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.llm.common import id_text, slices

#: Ranges in which the pattern engine and the library classify every character alike.
_AGREED = regex.compile(r"[\u0000-՗Ḁ-⁯₠-₿℀-⏿─-➿　-鿿가-힣＀-￯\U0001F300-\U0001FAFF]*+")
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CACHE, _LONG = 300_000, 64  # cached entries, and the longest of them in characters


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder over one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in to_byte for c in s)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s in self.special:
            vocab.pop(s.encode(), None)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((vocab[raw(a)], vocab[raw(b)]), (rank, vocab[raw(a) + raw(b)]))
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.token = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in vocab.items():
            self.token[i] = b
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.text = [str(i) for i in range(len(self.token))]
        #: Byte pairs inside some token; any other pair is a forced boundary.
        self.inside = {t[i : i + 2] for t in vocab for i in range(len(t) - 1)}
        self.splits = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.fragments: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def cut(self, data: bytes) -> list[bytes]:
        """``data`` at its forced boundaries."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(data)):
            if data[i - 1 : i + 1] not in inside:
                out.append(data[start:i])
                start = i
        out.append(data[start:])
        return out

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Lowest-rank-first merging over a linked list; leftmost of equal ranks first."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return tuple(x for x in ids if x >= 0)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        out: list[int] = []
        for part in self.cut(word.encode()):
            if (got := self.fragments.get(part)) is None:
                if len(self.fragments) > _CACHE:
                    self.fragments.clear()
                got = self.merge(part)
                if len(part) < 64:
                    self.fragments[part] = got
            out += got
        return tuple(out)

    def pretokens(self, text: str) -> list[str]:
        if _AGREED.fullmatch(text):
            return _PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        if self.splits and (found := list(self.splits.finditer(text))):
            out, start = [], 0
            for m in found:
                out += self._plain(text[start : m.start()])
                out.append(self.special[m[0]])
                start = m.end()
            return out + self._plain(text[start:])
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        words = self.pretokens(text)
        if len(self.words) > _CACHE:
            self.words.clear()
        known, long = self.words, {}
        for w in set(words).difference(known):
            (known if len(w) <= _LONG else long)[w] = self.word(w)
        return list(chain.from_iterable([known[w] for w in words] if not long else [long[w] if w in long else known[w] for w in words]))

    def decode(self, ids: list[int]) -> str:
        token = self.token
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                text = [bpe.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = tokenizer(path), lambda b: hashlib.sha256(b).hexdigest()
        text_of = bpe.text
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                n, ids_sha, text_sha = [], [], []
                for text in part.column("text").to_pylist():
                    ids = bpe.encode(text)
                    n.append(len(ids))
                    ids_sha.append(sha(",".join([text_of[i] for i in ids]).encode()))
                    text_sha.append(sha(bpe.decode(ids).encode()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
