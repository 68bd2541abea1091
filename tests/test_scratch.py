import os

import pytest

from strandline import scratch


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "root", lambda _: f"file://{tmp_path}")
    return tmp_path


def test_release_empties_the_shared_folder(spark, folder):
    with scratch.Owner(spark) as made:
        one = scratch.materialise(spark.range(10), "one")
        with scratch.Owner(spark) as inner:
            two = scratch.materialise(one.selectExpr("id + 1 as id"), "two", "id")
        two.scratch_owner = made
    assert two.count() == 10 and len(os.listdir(folder)) == 2 and len(inner.paths) == 1
    scratch.release(two)
    assert os.listdir(folder) == []


def test_drop_deletes_one_table_and_no_other_owner_s(spark, folder):
    with scratch.Owner(spark) as a:
        one, two = (scratch.materialise(spark.range(k), "t") for k in (1, 2))
    with scratch.Owner(spark) as b:
        three = scratch.materialise(spark.range(3), "t")
    scratch.drop(one)
    assert a.paths == [two.scratch_path]
    a.drop()
    assert b.paths == [three.scratch_path] and three.count() == 3
    b.drop()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scratch.root(Session)
