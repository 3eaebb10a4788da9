"""Geometry of the cell grid and the annealing schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import KERNEL_RATE, T_MAX, T_MIN


def cell_index(row: Column, col: Column, cols: int) -> Column:
    return (row * cols + col).cast("int")


def cell_row(cell: Column, cols: int) -> Column:
    return F.floor(cell / cols).cast("int")


def cell_col(cell: Column, cols: int) -> Column:
    return F.pmod(cell, F.lit(cols)).cast("int")


def grid_distance(row_a: Column, col_a: Column, row_b: Column, col_b: Column) -> Column:
    """Manhattan distance on the grid."""
    return F.abs(row_a - row_b) + F.abs(col_a - col_b)


def kernel(distance: Column, temperature: Column | float) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return F.exp(-KERNEL_RATE * distance / t)


def temperature(
    iteration: Column, max_iter: int, t_min: float = T_MIN, t_max: float = T_MAX
) -> Column:
    """Temperature of iteration 1..max_iter."""
    if max_iter < 2:
        raise ValueError("max_iter must be at least 2")
    return t_max * F.pow(F.lit(t_min / t_max), iteration / F.lit(max_iter - 1.0))
