"""Substring dedup over a compacted de Bruijn graph of token k-mers.

A window of ``width`` consecutive words of one document is an edge of the graph.
Edges are kept as super-edges: windows that follow one another and have the same
anchor (the ``kmer``-word run with the smallest hash in the window) are one row
(anchor, content hash, row, first word, number of windows), about a tenth as
many rows as windows.  Equal windows have equal anchors, so all occurrences of an
edge meet under one anchor.

1. Anchors met under one doc_id alone are dropped: none of their edges repeats.
2. An anchor with one content doesn't branch: its edges occur in that super-edge
   only.  Two such super-edges are linked if every occurrence of the first is
   followed by the second and every one of the second preceded by the first.
   Chains of links are the nonbranching paths; they compact by pointer jumping,
   joins in as many rounds as the binary logarithm of the longest chain.  A path
   has one verdict: all its windows start in the same documents.
3. Under a branching anchor one source per content is read again by its
   coordinates and its edges are compared one by one, by 128 bits.
4. What a row repeats becomes runs (row, first window, windows, source row, source
   start).  The words of every run are read again at both coordinates, and their
   SHA-256 digests must agree; a difference is an error.

A word goes if a window over it also starts in a row with a smaller doc_id.

Skew: groups are pre-aggregated before their shuffle, and joins deal the rows of
a hot key by a salt.

Defined cases: null and empty text have no words, and the hash of the empty text;
texts under ``width`` words keep everything; rows with a null id keep everything
and are no source; rows that repeat an id are each judged by their own words and
are no source for one another; an empty table gives an empty result; other columns
are not read (``remove_repeats`` carries them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import coded_words, hot_values, id_text, salted_join, slices
from strandline.llm.hashing import Rolling, word_hashes
from strandline.llm.shards import chosen
from strandline.scratch import drop, materialise

WIDTH, KMER = 50, 16
_BATCH, _LIST = 3_000_000, 4096


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _windows(offsets: np.ndarray, width: int) -> np.ndarray:
    """First words of all windows that stay within a row."""
    n = int(offsets[-1])
    inside = np.zeros(n + 1, np.int8)
    size = np.diff(offsets)
    wide = size >= width
    np.add.at(inside, offsets[:-1][wide], 1)
    np.add.at(inside, offsets[1:][wide] - width + 1, -1)
    return np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))


def super_edges_of(texts: pa.Array, width: int, kmer: int) -> tuple[np.ndarray, ...]:
    """(row, first word, windows, anchor, content hash) of every super-edge, and words per row."""
    offsets, codes, words = coded_words(texts)
    count = np.diff(offsets)
    at = _windows(offsets, width)
    if not len(at):
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)), count)
    table = word_hashes(words)
    one, two = Rolling(codes, table, 0), Rolling(codes, table, 1)
    every = np.arange(len(codes) - kmer + 1)
    anchor = sliding_min(one.of(every, every + kmer), width - kmer + 1)[at]
    row = np.searchsorted(offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    return row[first], start - offsets[row[first]], n, anchor[first], two.of(start, start + n + width - 1), count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def super_edges(rows: DataFrame, width: int, kmer: int) -> DataFrame:
    """row, doc_id, start, n, anchor, content."""
    names = ["row", "doc_id", "start", "n", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BATCH):
                row, start, n, anchor, content, _ = super_edges_of(part.column("text"), width, kmer)
                own = [part.column(c).take(pa.array(row)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), _signed(anchor), _signed(content)], names)

    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {_kind(rows)}, start int, n int, anchor long, content long")


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def opened(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """row, doc_id, start, h1, h2 of single windows; ``wanted`` has row and spans of (start, n)."""
    names = ["row", "doc_id", "start", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BATCH):
                offsets, codes, words = coded_words(part.column("text"))
                table = word_hashes(words)
                one, two = Rolling(codes, table, 0), Rolling(codes, table, 1)
                spans, flat = part.column("spans"), part.column("spans").flatten()
                per = np.diff(np.asarray(spans.offsets))
                row = np.repeat(np.arange(part.num_rows), per)
                start, n = (np.asarray(flat.field(k), dtype=np.int64) for k in (0, 1))
                at_row, base = np.repeat(row, n), np.repeat(start, n)
                at = base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
                place = offsets[at_row] + at
                own = [part.column(c).take(pa.array(at_row)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), _signed(one.of(place, place + width)), _signed(two.of(place, place + width))], names)

    both = chosen(rows, "row", wanted).join(wanted, "row").select("row", "doc_id", "text", "spans")
    return both.mapInArrow(run, f"row long, doc_id {_kind(rows)}, start int, h1 long, h2 long")


def compact_paths(told: DataFrame) -> DataFrame:
    """path, root, dist, own, occ of every super-edge that follows another on a nonbranching path.

    ``root`` is the path's first super-edge, ``dist`` the windows from its start,
    ``own`` its own windows, ``occ`` the occurrences of the whole path.  ``told``
    has row, start, n, path, branching, occ.  No path is a cycle: its last
    occurrence in a row has no successor.
    """
    ahead = W.partitionBy("row").orderBy("start")
    coming = [F.lead(c).over(ahead).alias(f"next_{c}") for c in ("path", "start", "n", "branching", "occ")]
    steps = told.select("row", "path", "start", "n", "branching", "occ", *coming).where("not branching and not next_branching and next_start = start + n and occ = next_occ")
    links = steps.groupBy("path", "next_path", "n", "next_n", "occ").agg(F.count(F.lit(1)).alias("c")).where("c = occ")
    found = materialise(links.select(F.col("next_path").alias("path"), F.col("path").alias("root"), F.col("n").alias("dist"), F.col("next_n").alias("own"), "occ"), "links")
    while True:
        up = found.select(F.col("path").alias("root"), F.col("root").alias("higher"), F.col("dist").alias("more"))
        jumped = found.join(up, "root", "left").select("path", F.coalesce("higher", "root").alias("root"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), "own", "occ", F.col("higher").isNotNull().alias("moved"))
        before, found = found, materialise(jumped, "paths")
        drop(before)
        if not found.where("moved").limit(1).count():
            return found.drop("moved")


def repeated_runs(rows: DataFrame, width: int = WIDTH, kmer: int = KMER) -> DataFrame:
    """row, start, n, source, source_start: runs of n windows of a row that also start in ``source``, of a smaller doc_id.

    ``rows`` is a stored table of row (a number of its own for each), doc_id, text.
    """
    known = rows.where("doc_id is not null")
    spread = F.xxhash64("row", "start")
    every = materialise(super_edges(known, width, kmer), "super-edges")
    total = every.count()
    seen = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("content") != F.max("content")).alias("branching"))
    seen = materialise(seen.where("a < b").select("anchor", "c", "branching"), "anchors")
    often = F.col("anchor").isin(hot_values(seen, "anchor", "c", total))
    shared = materialise(salted_join(every, seen.drop("c"), ["anchor"], often, often, spread), "shared")
    drop(every)
    first = F.min(F.struct("doc_id", "row", "start")).alias("s")
    distinct = shared.groupBy("anchor", "content").agg(first, F.count(F.lit(1)).alias("occ"))
    distinct = materialise(distinct.withColumn("path", F.monotonically_increasing_id()), "distinct")
    told = salted_join(shared, distinct, ["anchor", "content"], often, often, spread)
    told = materialise(told.select("row", "doc_id", "start", "n", "path", "branching", "occ", F.col("s.doc_id").alias("s_doc"), F.col("s.row").alias("source"), F.col("s.start").alias("source_start")), "told")
    drop(shared, distinct)

    paths = compact_paths(told)
    whole = paths.groupBy(F.col("root").alias("path")).agg(F.max(F.col("dist") + F.col("own")).alias("windows"), F.max("occ").alias("n_occ"))
    verdict = materialise(whole.unionByName(paths.select("path", F.lit(0).alias("windows"), F.col("occ").alias("n_occ"))), "verdicts")
    later, most = told.where("s_doc < doc_id"), max(1000, total // 1000)
    compact = salted_join(later.where("not branching"), verdict, ["path"], F.col("occ") > most, F.col("n_occ") > most, spread, "left")
    compact = compact.where("windows is null or windows > 0").withColumn("n", F.coalesce("windows", "n").cast("int"))

    spans = F.collect_set(F.struct("start", "n")).alias("spans")  # no more than a document has words
    sources = materialise(told.where("branching and not s_doc < doc_id").groupBy("row").agg(spans), "sources")
    windows = materialise(opened(known, sources, width), "windows")
    least = windows.groupBy("h1", "h2").agg(first, F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("c")).where("s.doc_id < b")
    least = materialise(least.select("h1", "h2", "c", F.col("s.doc_id").alias("s_doc"), F.col("s.row").alias("source"), F.col("s.start").alias("source_start")), "least")
    often = F.col("h1").isin(hot_values(least, "h1", "c", windows.count()))
    single = salted_join(windows, least.drop("c"), ["h1", "h2"], often, often, spread).where("s_doc < doc_id").withColumn("n", F.lit(1))

    names = ["row", "start", "n", "source", "source_start"]
    claims = compact.select(names).unionByName(later.where("branching").select(names)).unionByName(single.select(names))
    line = W.partitionBy("row", "source", "shift").orderBy("start")  # a row's claims on one source at one distance
    claims = claims.withColumn("shift", F.col("start") - F.col("source_start")).withColumn("stop", F.col("start") + F.col("n"))
    reached = F.max("stop").over(line.rowsBetween(W.unboundedPreceding, -1))
    claims = claims.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    runs = claims.groupBy("row", "source", "shift", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = materialise(runs.select("row", "start", (F.col("stop") - F.col("start")).alias("n"), "source", (F.col("start") - F.col("shift")).alias("source_start")), "runs")
    drop(told, verdict, windows, least)
    return runs


def verify(rows: DataFrame, runs: DataFrame, width: int) -> None:
    """Read the words of every run at both coordinates; raise if any two differ.

    A run and its source are one group (source, source_start, n), whose digests
    must all be equal; a source is read once for all its copies.
    """
    copies = runs.groupBy("row").agg(F.collect_list(F.struct("start", "n", "source", "source_start")).alias("spans"))  # no more than a document has words
    read = runs.select(F.col("source").alias("row"), F.col("source_start").alias("start"), "n").distinct()
    part = F.floor((F.row_number().over(W.partitionBy("row").orderBy("start", "n")) - 1) / _LIST).alias("part")
    read = read.select("*", part).groupBy("row", "part").agg(F.collect_list(F.struct("start", "n", F.col("row").alias("source"), F.col("start").alias("source_start"))).alias("spans"))
    names = ["source", "source_start", "n", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split()
                for s in spans.as_py():
                    held = b" ".join(words[s["start"] : s["start"] + s["n"] + width - 1])
                    out.append((s["source"], s["source_start"], s["n"], hashlib.sha256(held).digest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names)

    spans = materialise(copies.unionByName(read.select("row", "spans")), "spans")
    both = chosen(rows, "row", spans).join(spans, "row").select("text", "spans")
    digests = both.mapInArrow(run, "source long, source_start int, n int, digest binary")
    told = digests.groupBy("source", "source_start", "n").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.count(F.lit(1)).alias("c"))
    bad = materialise(told.where("a <> b or c < 2").limit(1), "differences")
    if bad.count():
        raise RuntimeError(f"spans differ from their source: {bad.first()}")


def removed_spans(rows: DataFrame, width: int, kmer: int) -> DataFrame:
    """row, spans array<struct<start, n>>: verified runs of n windows to remove; rows without any are absent."""
    runs = repeated_runs(rows, width, kmer)
    verify(rows, runs, width)
    return runs.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("spans"))  # no more than a document has words


def keep_mask(n_words: int, spans: list[dict], width: int) -> np.ndarray:
    """True for words that no removed window covers."""
    edge = np.zeros(n_words + 1, np.int32)
    for s in spans:
        edge[s["start"]] += 1
        edge[min(n_words, s["start"] + s["n"] + width - 1)] -= 1
    return np.cumsum(edge[:-1]) == 0


def removal_digest(docs: DataFrame, width: int = WIDTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows = materialise(id_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "rows", codec="zstd")
    marked = rows.join(removed_spans(rows, width, kmer), "row", "left")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split()  # bytes split at exactly the six ASCII spaces
                kept = words
                if found := spans.as_py():
                    kept = [words[i] for i in np.flatnonzero(keep_mask(len(words), found, width))]
                for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names)

    return marked.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {_kind(rows)}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, kmer: int = KMER) -> DataFrame:
    """``docs`` with repeated windows cut from ``text``; untouched texts stay as they are, all rows stay.

    A cut text keeps the white space between words that stay side by side; where
    words went, one space joins the rest.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("box")
    stored = materialise(docs.select(whole, F.monotonically_increasing_id().alias("row")), "rows", codec="zstd")
    rows = stored.select("row", F.col("box.doc_id").alias("doc_id"), F.coalesce("box.text", F.lit("")).alias("text"))
    spans = materialise(removed_spans(rows, width, kmer), "removed")
    whole_rows = chosen(stored, "row", spans, others=True)

    @F.pandas_udf("string")
    def cut(text, spans):
        import re

        out = []
        for t, found in zip(text, spans, strict=True):
            if t is None or found is None or not len(found):
                out.append(t)
                continue
            places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            keep = keep_mask(len(places), list(found), width)
            parts, last = [], None
            for i in np.flatnonzero(keep):
                a, b = places[i]
                if last is not None:
                    parts.append(t[places[last][1] : a] if last == i - 1 else " ")
                parts.append(t[a:b])
                last = i
            out.append("".join(parts))
        import pandas as pd

        return pd.Series(out, dtype=object)

    marked = chosen(stored, "row", spans).join(spans, "row")
    box = F.col("box").withField("text", cut(F.col("box.text"), F.col("spans")))
    return whole_rows.select("box").unionByName(marked.select(box.alias("box"))).select("box.*")
