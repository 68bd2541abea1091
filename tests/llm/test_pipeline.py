import os

import duckdb
import pytest

import corpus_pipeline
from strandline.llm import exact_dedup, near_dedup, queries, quality_model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages_keep_columns_and_take_effect(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["classify", "exact", "near", "substring", "pack"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    ids = {n: {r.doc_id for r in stages[n].select("doc_id").collect()} for n in ("documents", *names)}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids["classify"] == {r.doc_id for r in quality_model.classify(stages["documents"], labels).where("kept").collect()}
    assert ids["exact"] == {r.doc_id for r in exact_dedup.exact_dedup(stages["classify"]).where("kept").collect()}
    assert ids["near"] == {r.doc_id for r in near_dedup.near_duplicates(stages["exact"]).where("kept").collect()}
    assert ids["substring"] == ids["near"] == ids["pack"]


def test_run_gives_the_same_rows(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages["pack"].collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall()))


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
