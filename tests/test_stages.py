import struct

import numpy as np
import pytest

from strandline.operators import intervals, learning
from strandline.sources import config, media, readers, stages, writers


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie(frames, units, delta):
    head = lambda: bytes(12) + struct.pack(">II", units, frames * delta)
    stts = box(b"stts", bytes(4) + struct.pack(">III", 1, frames, delta))
    track = lambda kind: box(b"trak", box(b"mdia", box(b"mdhd", head()) + box(b"hdlr", bytes(8) + kind + bytes(12)) + box(b"minf", box(b"stbl", stts))))
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(5000)) + box(b"moov", box(b"mvhd", head()) + track(b"soun") + track(b"vide"))


def test_fps_and_duration_from_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "P01-x.mp4").write_bytes(movie(300, 30000, 1001))
    row = media.videos(readers.media_files(spark, str(tmp_path))).first()
    assert (row.video_id, row.participant) == ("P01-x", "P01")
    assert row.fps == pytest.approx(30000 / 1001) and row.duration_sec == pytest.approx(10.01)
    (tmp_path / "bad.mp4").write_bytes(box(b"ftyp", b"isom"))
    with pytest.raises(ValueError, match="no movie header"):
        media._movie(media.fs.LocalFileSystem(), str(tmp_path / "bad.mp4"))


def test_clips_hold_a_bounded_buffer():
    for stride, starts in ((4, [0, 4]), (2, [0, 2, 4, 6]), (6, [0, 6])):
        assert [c[0] for c in media.stream_clips(iter(range(10)), 4, stride)] == starts
    assert list(media.stream_clips(iter(range(3)), 4, 1)) == []


def test_extractors(spark):
    with pytest.raises(ValueError, match="unknown extractor"):
        media.extractor("none")
    assert media.mean_pool(np.arange(12.0).reshape(3, 2, 2)).tolist() == [5, 6] and media.mean_pool(np.ones(2)).tolist() == [1, 1]
    frames = spark.createDataFrame([(v, k, [float(k), float(v)]) for v, n in ((1, 6), (2, 2)) for k in range(n)], "video_id long, frame_idx long, pixels array<double>").repartition(5)
    found = media.clip_features(frames, "mean", 3, 3)
    assert sorted((r.video_id, r.clip_idx, r.embedding) for r in found.collect()) == [(1, 0, [1, 1]), (1, 1, [4, 1])]
    meta = media.clip_meta(spark.createDataFrame([(1, 30.0), (2, 30.0)], "video_id long, fps double"), found, "mean", "", 3, 3).collect()
    assert [(r.video_id, r.n_clips, r.feature_dim, r.n_clip_frame) for r in meta] == [(1, 2, 2, 3)]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert config.load_config(str(tmp_path / "c.json")) == {"a": {"b": 1}}
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.yaml"))


def test_ground_truth_tokens_and_split(spark, tmp_path):
    labels = spark.createDataFrame([("a", 0, 3), ("a", 1, -1)], "video_id string, clip_idx int, verb bigint")
    bounds = spark.createDataFrame([("a", 1.5)], "video_id string, t_sec double")
    stages.write_ground_truth(labels, bounds, str(tmp_path / "gt"))
    assert [x.count() for x in stages.ground_truth(spark, str(tmp_path / "gt"))] == [2, 1]
    tokens = spark.createDataFrame([("a", 0, 7), ("a", 1, 8)], "video_id string, pos int, token int")
    stats = spark.createDataFrame([("a", 2, 2, 9, 1, 1.0, 1)], stages.schemas.TOKEN_STATS)
    stages.write_tokens(tokens, stats, str(tmp_path / "tok"))
    assert sorted(stages.tokens(spark, str(tmp_path / "tok")).collect()) == sorted(tokens.collect()) and stages.token_stats(spark, str(tmp_path / "tok")).collect() == stats.collect()
    split = spark.createDataFrame([(k, k % 3 == 0) for k in range(7)], "video_id long, is_test boolean")
    stages.write_split(split, str(tmp_path / "split"))
    again = stages.recover_split(spark, str(tmp_path / "split"), split.select("video_id"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))
    with pytest.raises(FileNotFoundError):
        stages.tokens(spark, str(tmp_path / "none"))


def test_checkpoint_gives_the_same_tokens(spark, tmp_path):
    model = learning.Quantiser(4, latent=3, codes=5, hidden=(6, 7), decoder_hidden=(7, 6), seed=2)
    stages.write_checkpoint(spark, model, {"lag": 3, "copy_mse": 0.5}, str(tmp_path / "m"))
    again, settings = stages.load_checkpoint(spark, str(tmp_path / "m"))
    now, later = np.random.default_rng(1).normal(size=(2, 50, 4))
    assert np.array_equal(model.encode(now, later), again.encode(now, later)) and np.array_equal(model.reconstruct(now, later), again.reconstruct(now, later))
    assert settings["lag"] == 3 and settings["copy_mse"] == 0.5
    stages.write_train_log(spark, [(1, 0.5, 3.0), (2, 0.25, 4.0)], str(tmp_path / "log"))
    assert sorted(map(tuple, stages.train_log(spark, str(tmp_path / "log")).collect())) == [(1, 0.5, 3.0), (2, 0.25, 4.0)]
    with pytest.raises(FileNotFoundError):
        stages.load_checkpoint(spark, str(tmp_path / "none"))


def test_metrics_report(spark, tmp_path):
    rows = spark.createDataFrame([("verb", "raw", "random_clip", "linear", "top1", 0.5)], stages.schemas.METRICS)
    stages.write_metrics(rows, str(tmp_path / "r"))
    assert spark.read.schema(stages.schemas.METRICS).json(str(tmp_path / "r")).collect() == rows.collect()


def test_codes_and_guards(spark):
    videos = spark.createDataFrame([(4,), (9,), (6,)], "video_id long")
    notes = spark.createDataFrame([(9,), (4,), (9,)], "video_id long")
    assert sorted((r.video_id, r.code) for r in intervals.video_codes(intervals.annotated(videos, notes)).collect()) == [(4, 0), (9, 1)]
    taxonomy = spark.createDataFrame([(1, "b"), (2, "a"), (5, "b")], "id long, category string")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "verb long")
    assert sorted((r.verb, r.code) for r in intervals.coded(rows, "verb", taxonomy).collect()) == [(1, 1), (2, 0), (3, -1)]
    assert writers.pending(videos, notes, "video_id").count() == 1
