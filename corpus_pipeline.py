"""The corpus pipeline: quality classifier, exact dedup, near dedup, substring dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a frame that is to be written and read again before the next stage is
called.  A stage deletes the scratch tables of the stage before it, whose result
is on disk by then; ``scratch.release`` deletes what is behind the last result.

All stages but the last return the columns of ``documents``.  Null texts are
empty texts; of rows with a null id, exact dedup leaves one of each text that no
other row has, and near and substring dedup leave all; rows that repeat an id are
told apart; empty tables pass through.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import scratch
from strandline.llm.common import table
from strandline.llm.exact_dedup import drop_exact_duplicates
from strandline.llm.near_dedup import drop_near_duplicates
from strandline.llm.packing import pack_documents
from strandline.llm.quality_model import keep_good
from strandline.llm.substring_dedup import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class Tidy:
    """Deletes what a stage left when the next stage of the same pipeline begins, that is, of the same thread, session and folder."""

    def __init__(self):
        self.left: dict[tuple[int, str, str], scratch.Owner] = {}

    def __call__(self, stage: Stage) -> Stage:
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            key = (threading.get_ident(), spark.sparkContext.applicationId, sf_dir)
            if key in self.left:
                self.left.pop(key).drop()
            with scratch.Owner(spark) as made:
                out = stage(spark, docs, sf_dir)
            out.scratch_owner = made
            if stage is not pack:  # nothing follows it that could delete
                self.left[key] = made
            return out

        return run_stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates."""
    return drop_near_duplicates(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without windows of 50 words that an earlier one has; ``n_chars`` follows the text."""
    out = remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


tidy = Tidy()
STAGES: list[tuple[str, Stage]] = [(f.__name__, tidy(f)) for f in (classify, exact, near, substring, pack)]
#: The classifier's and the packer's results are beyond SQL; ``tests/llm`` holds each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.materialise(stage(spark, docs, sf_dir), name)
        if hasattr(before, "scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
