import hashlib
from datetime import datetime, timedelta

import pytest

from strandline.plans import catalogue
from strandline.plans.catalogue import QUERIES


def test_dead_codes_looks_at_every_clip(spark, tmp_path):
    """Codes 14 and 15 are equal, so the second is never nearest."""
    rows = [(k, 0, [float(j == min(k, 14)) for j in range(16)]) for k in range(16)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.code for r in QUERIES["dead_codes"](spark, str(tmp_path)).collect()] == [15]


def test_hierarchy_goes_to_the_depth_of_the_survey():
    assert catalogue.LEVELS[0] == 0 and catalogue.LEVELS[-1] == 64


def test_best_level_averages_the_random_baseline(spark, tmp_path, monkeypatch):
    """One video, no merges: every position is random by the keys of 20 draws, matched here by hand."""
    monkeypatch.setattr(catalogue, "LEVELS", [0])
    kinds = ["click"] * 6 + ["error"] + ["view"] * 7
    rows = [(k, 5, datetime(2024, 1, 1) + timedelta(hours=k), x, 1.0) for k, x in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["bpe_best_level"](spark, str(tmp_path)).first()
    tp = 0
    for trial in range(20):
        drawn = dict.fromkeys(int(hashlib.md5(f"7:5:0:{trial}:{j}".encode()).hexdigest()[:8], 16) % 13 + 1 for j in range(44))
        tp += any(abs(t - 6) <= 1 for t in list(drawn)[:2])
    assert (got.merges, got.model_f1) == (0, pytest.approx(2 / 3, abs=1e-6))
    assert got.random_f1 == pytest.approx(2 * tp / 20 / 3, abs=1e-6) and 0 < tp < 20


@pytest.mark.parametrize("name", ["token_clip_purity", "top_labels", "labelled_features", "clip_labels_unlabelled_signups"])
def test_labelled_clips_join_no_grid(spark, tmp_path, name):
    """A filter on labels must not turn the join into an inner one with a grid of clips, which is broadcast by the size of its videos."""
    rows = [(k, k % 3, datetime(2024, 1, 1) + timedelta(hours=k % 50), "view", 60.0) for k in range(90)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    vectors = [(k, 0, [float(k)]) for k in range(150)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert found.count() > 0 and not any("Join Inner" in a and "Generate" in b for a, b in zip(plan, plan[1:], strict=False))
