"""Scratch tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation of earlier
steps.  The folder is read from the session; only a local session without one
(tests, a laptop) gets a temporary folder of its own.

An ``Owner`` holds the tables of one query or stage.  Whoever writes the query's
result calls ``release`` afterwards; owners still alive when the process ends are
emptied then.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CURRENT: contextvars.ContextVar[Owner | None] = contextvars.ContextVar("owner", default=None)
_OWNERS: weakref.WeakSet[Owner] = weakref.WeakSet()
_UNOWNED: dict[str, Owner] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a temporary one if it is unset in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="strandline-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = f"file://{_OWN[app]}"
    return base.rstrip("/")


class Owner:
    """The scratch tables made inside ``with Owner(spark):``, until ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.within, self._tokens = spark, [], [], []
        _OWNERS.add(self)
        if outer := _CURRENT.get():
            outer.within.append(self)

    def __enter__(self) -> Owner:
        self._tokens.append(_CURRENT.set(self))
        return self

    def __exit__(self, *_) -> None:
        _CURRENT.reset(self._tokens.pop())

    def new_path(self, name: str) -> str:
        self.paths.append(f"{root(self.spark)}/strandline-{uuid.uuid4().hex}/{name}")
        return self.paths[-1]

    def drop(self, paths: set[str] | None = None) -> None:
        """Delete these of its tables, by default all, also those of owners made within it; frames that read them become unusable."""
        for each in self.within:
            each.drop(paths)
        for path in [p for p in self.paths if paths is None or p in paths]:
            self.paths.remove(path)
            delete(self.spark, path.rsplit("/", 1)[0])


def owner(spark: SparkSession) -> Owner:
    """The owner of what is made now; one for the whole application outside of any ``with``."""
    return _CURRENT.get() or _UNOWNED.setdefault(spark.sparkContext.applicationId, Owner(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which the current owner deletes."""
    return owner(spark).new_path(name)


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go with it: its result is a table, nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, *keys: str, partitions: int | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a scratch table and read it back.

    With ``keys`` the rows are first dealt by them (``partitions`` ways, or as
    many as the session shuffles into).  ``codec`` is worth changing for tables of texts.
    """
    spark = df.sparkSession
    if keys:
        df = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    path = new_path(spark, name)
    with _shuffles_end(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._gateway.jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration() if spark.sparkContext._jsc else jvm.org.apache.hadoop.conf.Configuration()
    where.getFileSystem(conf).delete(where, True)


def drop(*tables: DataFrame | str) -> None:
    """Delete scratch tables, given as frames of ``materialise`` or as paths."""
    gone = {t if isinstance(t, str) else t.scratch_path for t in tables}
    for each in list(_OWNERS):
        each.drop(gone)


def release(result: DataFrame) -> None:
    """Delete what a registered query left for its result, once that is written."""
    result.scratch_owner.drop()


@atexit.register
def _at_end() -> None:
    for each in list(_OWNERS):
        with contextlib.suppress(Exception):  # the gateway may be gone
            each.drop()
