"""Ratios with the zero rules of boundary scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def precision_recall_f1(tp: Column, n_pred: Column, n_true: Column) -> tuple[Column, Column, Column]:
    """0 wherever a denominator is 0."""
    p, r = ratio(tp, n_pred), ratio(tp, n_true)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def md5_key(*parts: Column) -> Column:
    """A sampling key that any engine can recompute."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
