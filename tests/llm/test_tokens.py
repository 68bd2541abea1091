import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import byte_bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aA1 '\t\nsé日́ |<>endoftx", max_size=60))
def test_byte_bpe_equals_library(text):
    own, lib = byte_bpe.tokenizer(BYTE), Tokenizer.from_file(BYTE) if not hasattr(test_byte_bpe_equals_library, "lib") else test_byte_bpe_equals_library.lib
    test_byte_bpe_equals_library.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_byte_bpe_specials_and_long_runs(library):
    own = byte_bpe.tokenizer(BYTE)
    for text in ("a<|endoftext|>b <|endoftext|>", "x" * 3000, " " * 500 + "a", "0123456789" * 50, "<|endoftext|>" * 3):
        assert own.encode(text) == library[0].encode(text, add_special_tokens=False).ids


def test_agreed_ranges_classify_alike(library):
    """Every character that takes the fast way is split as the library splits it."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and byte_bpe._AGREED.fullmatch(chr(c))]
    for k in range(0, len(chars), 500):
        text = "".join(f"a{c}1{c}! " for c in chars[k : k + 500])
        assert byte_bpe._PATTERN.findall(text) == [text[a:b] for _, (a, b) in library[0].pre_tokenizer.pre_tokenize_str(text)]


def test_forced_boundaries_are_never_inside_a_token():
    bpe = byte_bpe.tokenizer(BYTE)
    data = "forcéd   bounðaries 日本 \x00\x7f".encode()
    cuts, at = set(), 0
    for part in bpe.cut(data):
        at += len(part)
        cuts.add(at)
    assert cuts and all(t[k - 1 : k + 1] in bpe.inside for t in bpe.token[:5000] for k in range(1, len(t)))


def test_round_trip_query(make_docs, hard_pairs, library):
    rows = byte_bpe.round_trip(make_docs(hard_pairs), BYTE).collect()
    want = []
    for i, t in hard_pairs:
        ids = library[0].encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)


def test_encode_then_decode_documents(make_docs, hard_pairs):
    docs = make_docs([p for p in hard_pairs if p[0] is not None and p[0] != 5])
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, BYTE), BYTE)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in hard_pairs if i is not None and i != 5}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50) | st.text(alphabet="aÀ1 '\t\nsÉß.,!日́İ|<>startoftxend", max_size=50))
def test_word_tokens_equal_library(text):
    import numpy as np
    import pyarrow as pa

    lib = test_word_tokens_equal_library.__dict__.setdefault("lib", Tokenizer.from_file(WORD))
    bounds, ids = packing.word_tokens(WORD).encode(pa.array([text, "b"]), 2)
    assert np.array_equal(ids[: bounds[1]], [*lib.encode(text, add_special_tokens=False).ids, 2])


def check_packed(rows, pairs, library, capacity):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in dict(pairs).items():
        ids = [*library[1].encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_is_whole_and_gapless(make_docs, hard_pairs, library):
    pairs = [p for p in hard_pairs if p[0] is not None and p[0] != 5]
    for capacity in (64, 4096):
        rows = packing.pack_documents(make_docs(pairs), WORD, capacity, with_ids=capacity == 64).collect()
        check_packed(rows, pairs, library, capacity)
    assert packing.pack_documents(make_docs([]), WORD).count() == 0


def test_packing_of_null_ids_and_repeats(make_docs):
    rows = packing.pack_documents(make_docs([(None, "a"), (None, "a"), (5, "b c"), (5, "b c")]), WORD).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == {(None, 2): 2, (5, 3): 2}
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_packing_with_ids_gives_the_sequences(make_docs, library):
    pairs = [(k, "some words here " * k) for k in range(1, 9)]
    rows = packing.pack_documents(make_docs(pairs), WORD, 32, with_ids=True).collect()
    for i, t in pairs:
        got = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert got == [*library[1].encode(t, add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=40))
def test_histogram_packs_every_piece(counts):
    patterns = packing.pack_histogram(counts, 64)
    placed = Counter()
    for n, pattern in patterns:
        assert sum(length * times for length, times in pattern) <= 64
        for length, times in pattern:
            placed[length] += n * times
    assert placed == counts


def test_histogram_is_tight():
    rng = random.Random(1)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(50_000))
    patterns = packing.pack_histogram(counts, 4096)
    fill = sum(k * n for k, n in counts.items()) / (4096 * sum(n for n, _ in patterns))
    assert fill > 0.99
    assert len(patterns) < 20_000


def test_slots_follow_ranks(spark):
    pieces = spark.createDataFrame([(k, 0, 10 if k % 3 else 7, k) for k in range(500)], "doc_id long, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, 32).collect()
    assert len(rows) == 500
    taken = [(r.sequence_id, r.offset + k) for r in rows for k in range(r.length)]
    assert len(taken) == len(set(taken))
    assert packing.ranked(pieces, "doc_id").groupBy("length").agg((F.max("rank") + 1 == F.count("*")).alias("ok"), (F.countDistinct("rank") == F.count("*")).alias("d")).where("ok and d").count() == 2


def test_rows_that_repeat_are_ranked_by_many_tasks(spark, make_docs):
    pieces = packing.materialise(packing.token_pieces(make_docs([(None, "one text")] * 4000, 2), WORD).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    width = packing.shuffle_width(spark)
    salts = pieces.groupBy(F.pmod(F.xxhash64("piece"), F.lit(width))).count().collect()
    assert len(salts) == width and max(r["count"] for r in salts) < 2 * 4000 / width
    assert packing.ranked(pieces, "piece").select("rank").distinct().count() == 4000


def test_long_pretokens_are_not_kept():
    bpe = byte_bpe.ByteBPE(BYTE)
    bpe.encode("short " + "x" * 1000)
    assert all(len(w) <= 64 for w in bpe.words) and "short" in bpe.words
