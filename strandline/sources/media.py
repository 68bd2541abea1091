"""Videos: container metadata, clips of frames, and frozen extractors."""

from __future__ import annotations

import struct
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources import schemas


def _boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, body) of the boxes of an ISO base media file that are there in whole."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif size == 0:
            size = len(data) - at
        if size < head:
            return
        yield kind, data[at + head : at + size]
        at += size


def _clock(body: bytes) -> tuple[int, int]:
    """(units a second, duration) of a movie or media header."""
    return struct.unpack(">IQ", body[20:32]) if body[0] else struct.unpack(">II", body[12:20])


def _movie(system: fs.FileSystem, path: str) -> bytes:
    """The movie box, found by the sizes of the boxes before it; frames are not read."""
    with system.open_input_file(path) as f:
        at, end = 0, f.size()
        while at + 8 <= end:
            size, kind = struct.unpack(">I4s", f.read_at(8, at))
            head = 8
            if size == 1:
                size, head = struct.unpack(">Q", f.read_at(8, at + 8))[0], 16
            size = size or end - at
            if kind == b"moov":
                return f.read_at(size - head, at + head)
            if size < head:
                break
            at += size
    raise ValueError(f"no movie header in {path}")


def probe(movie: bytes) -> tuple[float | None, float]:
    """(average frames a second of the first video track, seconds) from a movie box."""
    fps, seconds = None, 0.0
    for kind, body in _boxes(movie):
        if kind == b"mvhd":
            units, duration = _clock(body)
            seconds = duration / units
        if kind == b"trak" and fps is None:
            media = dict(_boxes(next((b for k, b in _boxes(body) if k == b"mdia"), b"")))
            if media.get(b"hdlr", b"")[8:12] != b"vide":
                continue
            table = dict(_boxes(dict(_boxes(media[b"minf"]))[b"stbl"]))[b"stts"]
            pairs = np.frombuffer(table[8 : 8 + 8 * struct.unpack(">I", table[4:8])[0]], ">u4").reshape(-1, 2).astype(np.int64)
            lasted = int((pairs[:, 0] * pairs[:, 1]).sum())
            fps = float(pairs[:, 0].sum() * _clock(media[b"mdhd"])[0] / lasted) if lasted else None
    return fps, seconds


def videos(files: DataFrame) -> DataFrame:
    """Media files (video_id, participant, path) with fps and duration_sec from their headers."""
    names = [c.split()[0] for c in schemas.VIDEO.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                system, where = fs.FileSystem.from_uri(path)
                found.append(probe(_movie(system, where)))
            fps, seconds = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(fps, pa.float64()), pa.array(seconds, pa.float64())], names)

    return files.select(*names[:3]).mapInArrow(run, schemas.VIDEO)


def stream_clips(frames: Iterator, width: int, stride: int) -> Iterator[list]:
    """Runs of ``width`` frames every ``stride``; holds ``width`` frames at most, a tail that doesn't fill one is dropped."""
    held: deque = deque(maxlen=width)
    for k, frame in enumerate(frames):
        held.append(frame)
        first = k - width + 1
        if first >= 0 and first % stride == 0:
            yield list(held)


def mean_pool(x: np.ndarray) -> np.ndarray:
    """Mean over all axes but the last; a vector stays as it is."""
    return x.mean(tuple(range(x.ndim - 1))) if x.ndim > 1 else x


class Extractor(ABC):
    """Turns a clip, an array of its frames, into one vector; weights are loaded on first use, in the worker."""

    @abstractmethod
    def extract(self, clip: np.ndarray) -> np.ndarray: ...


class MeanExtractor(Extractor):
    """The mean over frames and patches: features that need no weights."""

    def extract(self, clip: np.ndarray) -> np.ndarray:
        return mean_pool(clip)


EXTRACTORS: dict[str, type[Extractor]] = {"mean": MeanExtractor}


def extractor(name: str) -> Extractor:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name}; known are {sorted(EXTRACTORS)}")
    return EXTRACTORS[name]()


def clip_features(frames: DataFrame, model: str, width: int, stride: int) -> DataFrame:
    """video_id, clip_idx, embedding of the clips of frames (video_id, frame_idx, pixels array<double>).

    A video's frames come to one task in order and pass through a buffer of one
    clip; videos shorter than a clip give nothing.
    """
    extractor(model)  # an unknown name fails here and not in a worker
    rows = frames.select("video_id", "frame_idx", "pixels").repartition("video_id").sortWithinPartitions("video_id", "frame_idx")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import groupby

        model_ = extractor(model)
        each = ((v, np.asarray(p, float)) for part in parts for v, p in zip(part["video_id"], part["pixels"], strict=True))
        for video, own in groupby(each, key=lambda x: x[0]):
            for k, clip in enumerate(stream_clips((p for _, p in own), width, stride)):
                yield pd.DataFrame({"video_id": [video], "clip_idx": [k], "embedding": [model_.extract(np.stack(clip)).astype(np.float32)]})

    return rows.mapInPandas(run, schemas.FEATURES.replace("video_id string", f"video_id {frames.schema['video_id'].dataType.simpleString()}"))


def clip_meta(videos: DataFrame, features: DataFrame, model: str, weights: str, width: int, stride: int) -> DataFrame:
    """The sidecar rows of features just written."""
    n = features.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("n_clips"), F.max(F.size("embedding")).alias("feature_dim"))
    named = [F.lit(x).alias(c) for c, x in (("model", model), ("model_weight", weights), ("n_clip_frame", width), ("stride", stride))]
    return videos.join(n, "video_id").select("video_id", "fps", "n_clips", "feature_dim", *named)
