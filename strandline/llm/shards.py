"""Sorted counts gathered by tasks and merged by shard, arrays in files of the shared folder, and choices by row number."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.scratch import materialise, new_path

HELD = 2_500_000
RANGE_BITS = 20
_CACHE_BYTES, _CACHE_FILES = 200_000_000, 20_000


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write a shard to a name of its own and move it into place; a repeated attempt writes the same bytes."""
    system, where = fs.FileSystem.from_uri(folder)
    system.create_dir(where, recursive=True)
    for key, value in arrays.items():
        part = f"{where}/{name}.{key}.{uuid.uuid4().hex}"
        with system.open_output_stream(part, compression=None) as out:
            np.lib.format.write_array(out, np.ascontiguousarray(value), allow_pickle=False)
        system.move(part, f"{where}/{name}.{key}.npy")


def remove(folder: str, name: str, *keys: str) -> None:
    system, where = fs.FileSystem.from_uri(folder)
    for key in keys:
        path = f"{where}/{name}.{key}.npy"
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)


class _Cache(OrderedDict):
    """The arrays used last: files mapped into memory up to a number, arrays read whole up to a size."""

    size = 0

    def get_or(self, key: tuple, make) -> np.ndarray:
        if key in self:
            self.move_to_end(key)
            return self[key]
        self[key] = value = make()
        self.size += self._bytes(value)
        while len(self) > 1 and (self.size > _CACHE_BYTES or len(self) > _CACHE_FILES):
            self.size -= self._bytes(self.popitem(last=False)[1])
        return value

    @staticmethod
    def _bytes(value: np.ndarray) -> int:
        return 0 if isinstance(value.base, np.memmap) else value.nbytes


_LOADED = _Cache()


def load(folder: str, name: str, key: str) -> np.ndarray:
    """Memory-mapped where the shared folder is a mounted one; else read whole, as much as the cache holds."""

    def read() -> np.ndarray:
        system, where = fs.FileSystem.from_uri(folder)
        path = f"{where}/{name}.{key}.npy"
        if isinstance(system, fs.LocalFileSystem):
            return np.load(path, mmap_mode="r", allow_pickle=False).view(np.ndarray)
        with system.open_input_stream(path, compression=None) as f:
            return np.lib.format.read_array(f, allow_pickle=False)

    return _LOADED.get_or((folder, name, key), read)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(count, first) if len(first) else count)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


class Gathered:
    """Counts of a task so far, handed out whenever there are ``HELD`` distinct ones."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        if self.n > HELD:
            key, count = merge(self.keys, self.counts)
            self.keys, self.counts, self.n = [key], [count], len(key)
        return self.n > HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merge(self.keys, self.counts)
        self.keys, self.counts, self.n = [], [], 0
        return out


def squeeze(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def chosen(stored: DataFrame, key: str, wanted: DataFrame, others: bool = False) -> DataFrame:
    """The rows of a stored table whose number ``key`` (a long, no null) is in ``wanted``, which has no other numbers; with ``others`` those whose number isn't.

    Only numbers are shuffled: those wanted go to one sorted file for each range of
    2^20 numbers, and the task that reads a row looks its number up there.  A task
    that writes a file holds one range at most.
    """
    folder = new_path(stored.sparkSession, "wanted")

    def listed(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["range"].iloc[0])
        save(folder, f"range-{k}", wanted=np.sort(frame["number"][frame["yes"]].to_numpy(np.int64)))
        return pd.DataFrame({"range": [k]})

    yes = wanted.select(F.col(key).alias("number")).distinct().withColumn("yes", F.lit(True))
    numbers = stored.select(F.col(key).alias("number")).join(yes, "number", "left")
    ranged = numbers.select(F.shiftright("number", RANGE_BITS).alias("range"), "number", F.coalesce("yes", F.lit(False)).alias("yes"))
    materialise(ranged.groupBy("range").applyInPandas(listed, "range long"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(key).to_numpy()
            keep = np.zeros(len(number), bool)
            for k in np.unique(number >> RANGE_BITS):
                here = np.flatnonzero(number >> RANGE_BITS == k)
                listing = load(folder, f"range-{k}", "wanted")
                at = np.searchsorted(listing, number[here])
                found = at < len(listing)
                found[found] = listing[at[found]] == number[here][found]
                keep[here] = found != others
            yield batch.filter(pa.array(keep))

    return stored.mapInArrow(run, stored.schema)
