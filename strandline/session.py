"""Sessions, and the package's way to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution."""
    builder = SparkSession.builder.master(master).appName("strandline")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"}
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that would not find it on their own path."""
    app = spark.sparkContext.applicationId
    paths = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(ROOT) in (os.path.realpath(os.getcwd()), *paths):
        return
    with tempfile.TemporaryDirectory() as folder:
        target = Path(folder) / "strandline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in (ROOT / "strandline").rglob("*.py"):
                z.write(f, f.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
