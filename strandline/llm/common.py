"""Shared pieces: table access, ASCII word splitting over Arrow, batch slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space, and code points 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no further column can clash; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about ``most_bytes``; a longer row comes alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    trim()


def trim() -> None:
    """Give freed memory back, so that idle Python workers of earlier steps don't hold it."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library
        return None


_LIBC = _libc()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): words of row i are ``words[offsets[i]:offsets[i + 1]]``; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        words = words.filter(pa.array(full))
    return offsets, words


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, dictionary) of the words of all rows."""
    offsets, words = split_words(pc.ascii_lower(texts) if lower else texts)
    coded = words.dictionary_encode()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def boxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): all columns kept in one struct, so that no working column can clash with them."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row.alias("row"))


def hot_values(counts: DataFrame, key: str, n: str, total: int, share: int = 1000) -> list:
    """Values of ``key`` with more than one in ``share`` of ``total`` rows (at least ``share`` rows): under ``share`` of them, whatever the input."""
    return [r[0] for r in counts.where(F.col(n) > max(share, total // share)).select(key).distinct().collect()]


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], hot_many: F.Column, hot_few: F.Column, spread: F.Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few`` (one row a key); where hot, ``many`` is dealt by ``spread`` too, and ``few`` repeated as often as the session shuffles into."""
    width = shuffle_width(many.sparkSession)
    salt = F.when(hot_many, F.pmod(spread, F.lit(width)).cast("int")).otherwise(F.lit(0))
    every = F.when(hot_few, F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0)))
    return many.withColumn("salt", salt).join(few.withColumn("salt", F.explode(every)), [*keys, "salt"], how).drop("salt")
