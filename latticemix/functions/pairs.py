"""Functions of two labelled items or two clusters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_notation(true_a: Column, pred_a: Column, true_b: Column, pred_b: Column) -> Column:
    """Two letters: same true class?  same predicted class?  (y or n each)"""
    letter = lambda same: F.when(same, F.lit("y")).otherwise(F.lit("n"))
    return F.concat(letter(true_a == true_b), letter(pred_a == pred_b))

