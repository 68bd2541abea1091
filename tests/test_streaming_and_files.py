import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import streaming
from strandline.operators import sequences
from strandline.sources import readers, writers


def test_tumbling_counts_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 5} 03:00:00", "ab"[k % 2]) for k in range(40)], "id long, t string, event_type string")
    rows = rows.select("event_type", F.to_timestamp("t").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    out = streaming.tumbling_counts(streaming.read_events(spark, str(tmp_path / "in"), rows.schema), late="0 seconds")
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.start)[:10], r.event_type): r.n for r in spark.table("counts").collect()} == {(f"2024-01-0{1 + d}", "ab"[p]): 4 for d in range(5) for p in range(2)}


def test_online_runs_are_the_closed_runs(spark, tmp_path):
    rows = [(v, p, (p * (v + 1)) // 3 % 4) for v in range(5) for p in range(50)]
    t = spark.createDataFrame(rows, "video_id long, pos long, token int")
    for k in range(2):  # in order of arrival
        t.where((F.col("pos") < 25) if k == 0 else (F.col("pos") >= 25)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = streaming.online_runs(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("append").format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("runs").collect()}
    runs = [(r.video_id, r.symbol, r.start, r.length) for r in sequences.run_length_encode(t).collect()]
    last = {v: max(s for w, _, s, _ in runs if w == v) for v in range(5)}
    assert got == {r for r in runs if r[2] < last[r[0]]}


def test_writers(spark, tmp_path):
    items, done = spark.range(5), spark.range(3)
    assert sorted(r.id for r in writers.pending(items, done, "id").collect()) == [3, 4]
    assert writers.pending(items, done, "id", overwrite=True).count() == 5
    path = str(tmp_path / "cache")
    row = lambda v, x: spark.createDataFrame([(v, x)], "video_id string, x int")
    writers.write_partitioned(row("a", 1).union(row("b", 2)), path, "video_id")
    writers.write_partitioned(row("b", 3), path, "video_id")
    assert {(r.video_id, r.x) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    shards = spark.createDataFrame([(s, r, f"v{s}{r}") for s in range(12) for r in range(2)], "shard int, rank int, video_id string")
    writers.write_shards(shards, str(tmp_path / "shards"), 12)
    ids = readers.id_list(spark, str(tmp_path / "shards" / "shard=03"))
    assert [r.video_id for r in ids.orderBy("rank").collect()] == ["v30", "v31"]
    writers.write_report(items, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 5


def test_readers(spark, tmp_path):
    np.save(tmp_path / "P01-x.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    f = readers.numpy_features(spark, str(tmp_path)).orderBy("clip_idx").collect()
    assert [(r.video_id, r.clip_idx, r.embedding) for r in f] == [("P01-x", k, [2.0 * k, 2.0 * k + 1]) for k in range(3)]
    for name, d in (("new", {"n_clip_frame": 10, "model": "m"}), ("old", {"delta_min": 8, "vjepa_model": "o"})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"video_id": name, **d}))
    assert {(r.video_id, r.n_clip_frame, r.model) for r in readers.clip_meta(spark, str(tmp_path / "*.json")).collect()} == {("new", 10, "m"), ("old", 8, "o")}
    (tmp_path / "t.csv").write_text("id,key,category\n1,a,x\n2,b,y\n1,c,z\n")
    assert {(r.id, r.category) for r in readers.taxonomy(spark, str(tmp_path / "t.csv")).collect()} == {(1, "z"), (2, "y")}
    (tmp_path / "v" / "u").mkdir(parents=True)
    (tmp_path / "v" / "u" / "P02-1.mp4").write_bytes(b"x")
    assert [(r.video_id, r.participant) for r in readers.media_files(spark, str(tmp_path / "v")).collect()] == [("P02-1", "P02")]
    known = spark.createDataFrame([("a",), ("b",)], "video_id string")
    assert readers.require_ids(known.limit(1), known).count() == 1
    with pytest.raises(ValueError, match="unknown ids"):
        readers.require_ids(spark.createDataFrame([("q",)], "video_id string"), known)
    assert readers.feature_folder("m", 10, 5) == "m_clip10_stride5"
