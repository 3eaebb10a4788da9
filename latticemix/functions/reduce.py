"""Reductions over one row's array of per-cell values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logsumexp(values: Column) -> Column:
    """ln(sum(exp(v))) of an array column, shifted by its maximum."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return top + F.ln(total)


def argmax_first(values: Column) -> Column:
    """0-based position of the maximum; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def exp_all(values: Column) -> Column:
    return F.transform(values, F.exp)
