"""Exact dedup by a tree-merge of sorted digest runs; DataFrame operations only.

Each input partition forms one sorted run of (digest, smallest id, count).  In
every round ``fan_in`` neighbouring runs (``log2(fan_in)`` binomial rounds at once)
are merged, each digest keeping its smallest identifier, until one run is left.
The smallest identifier is a struct, which Spark aggregates over sorted rows: a
run is sorted before it is sent, the receiver merges what comes in already sorted
pieces (its sort finds ascending pieces and merges them), and equal digests then
stand side by side.  A run is dealt by (run, digest), so that no task ever holds a
whole run.  The way back down the tree hands each
level the verdict of the level above; the last join is by (run, digest), so that
a text which makes up a third of all rows is spread over as many keys as the
input has partitions.

Digests are SHA-256.  Rows only merge when digest, byte length and an
independent 64-bit hash of the text agree, at every level.

Defined cases: null text is the empty text; a null id never becomes ``keep_id``
while its group has another, and sorts after all ids; rows that repeat an id and
its text share one verdict; an empty table gives an empty result; columns other
than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, boxed, id_text
from strandline.scratch import materialise

_KEY = ["digest", "n_bytes", "witness"]


def normalised(text) -> F.Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("witness"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digest_columns(id_text(docs, id_col, text_col)).withColumn("run", F.spark_partition_id()), "digests")

    def merge(runs: DataFrame, run, count) -> DataFrame:
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
        merged = runs.groupBy(run.alias("run"), *_KEY).agg(least, count.alias("n"))
        return materialise(merged.select("run", *_KEY, F.col("least.doc_id").alias("doc_id"), "n"), "runs")

    levels = [merge(rows, F.col("run"), F.count(F.lit(1)))]
    top = rows.agg(F.max("run").alias("m")).first()["m"] or 0
    while top > 0:
        levels.append(merge(levels[-1], F.floor(F.col("run") / fan_in).cast("int"), F.sum("n")))
        top //= fan_in

    def verdicts(run_level: DataFrame) -> DataFrame:
        return run_level.select(F.col("run").alias("up"), *_KEY, "keep_id", "group_size")

    down = levels[-1].select("run", *_KEY, F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    for level in reversed(levels[:-1]):
        step = level.select("run", *_KEY, F.floor(F.col("run") / fan_in).cast("int").alias("up"))
        down = step.join(verdicts(down), ["up", *_KEY]).select("run", *_KEY, "keep_id", "group_size")
    found = rows.join(down, ["run", *_KEY])
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies, columns as they are.

    The row with the smallest doc_id of each group stays; of rows that repeat its
    id and text, one.
    """
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    rows = boxed(docs).select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha"), "row")
    same = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha") == F.col("sha")))
    first = same.withColumn("n", F.row_number().over(W.partitionBy("id", "sha").orderBy(F.lit(1))))
    return first.where("n = 1").select("row.*")
