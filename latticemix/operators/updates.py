"""Single parameter updates from scored rows.

Scalars are one aggregate over ``cell``: rows explode to their K cells inside the
map task and are summed there before the shuffle, which carries K groups per
task whatever the data or its skew.  Vectors are summed as one K x width array
per task, so that the plan does not grow with their width.  ``plans.em`` fuses all of them in one pass;
these are the separate operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import CellModel, constant
from ..functions import vectors as V
from .partials import rows_from_sums
from .posterior import matrix, with_posterior


def _by_cell(scored: DataFrame, vector: str, *keep: str) -> DataFrame:
    return scored.select(*keep, F.posexplode(vector).alias("cell", "log_p")).withColumn(
        "p", F.exp("log_p")
    )


def update_prior(scored: DataFrame) -> DataFrame:
    """(cell, prob): mean of p(winner | x) over all rows."""
    return _by_cell(scored, "log_p_winner").groupBy("cell").agg(F.avg("p").alias("prob"))


def _weighted_sums(vector: str, width: int, parts: Callable[[np.ndarray], list[np.ndarray]]):
    """Per cell its weight, then weighted sums of what ``parts`` makes of a block of vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(vector), width)
            log_p = batch.column("log_p_cell")
            p = np.exp(matrix(log_p, len(log_p[0])))
            found = np.column_stack([p.sum(axis=0), *(p.T @ part for part in parts(v.astype(float)))])
            total = found if total is None else total + found
        return total

    return partial


def _cells(total: np.ndarray, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], ["cell", name])


def _lists(values: np.ndarray, alive: np.ndarray | None = None) -> pa.Array:
    mask = None if alive is None else np.repeat(~alive, values.shape[1])
    flat = pa.array(values.ravel(), mask=mask)
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)[: len(values) + 1], flat)


def update_cont_mean(scored: DataFrame, width: int) -> DataFrame:
    """(cell, cont_mean): weighted mean; NULL entries where a cell has no weight."""

    def finish(total: np.ndarray) -> pa.RecordBatch:
        alive = total[:, 0] != 0
        return _cells(total, "cont_mean", _lists(total[:, 1:] / np.where(alive, total[:, 0], 1)[:, None], alive))

    sums = _weighted_sums("x", width, lambda v: [v])
    return rows_from_sums(scored.select("log_p_cell", "x"), sums, finish, "cell int, cont_mean array<double>")


def _of_cell(matrix: list[list[float]]) -> Column:
    """The current cell's vector out of a constant K-row table; NULL entries stay."""
    rows = [[None if v is None else float(v) for v in row] for row in matrix]
    return constant(rows, T.ArrayType(T.ArrayType(T.DoubleType())))[F.col("cell")]


def update_cont_variance(scored: DataFrame, means: list[list[float]]) -> DataFrame:
    """(cell, cont_variance) around the new ``means``, per dimension.

    NULL for a cell without weight, whose mean has NULL entries.
    """
    d = len(means[0])
    sq = V.squared_distance(F.col("x"), _of_cell(means), d)
    return (
        _by_cell(V.with_width(scored, x=d), "log_p_cell", "x")
        .groupBy("cell")
        .agg(F.try_divide(F.sum(F.col("p") * sq), d * F.sum("p")).alias("cont_variance"))
    )


def _bit_sums(scored: DataFrame, width: int, finish, schema: str) -> DataFrame:
    """Per cell its weight, and that of its rows with each bit off, then on."""
    sums = _weighted_sums("b", width, lambda v: [1 - v, v])
    return rows_from_sums(scored.select("log_p_cell", "b"), sums, finish, schema)


def update_bin_prototype(scored: DataFrame, width: int) -> DataFrame:
    """(cell, bin_mean): weighted majority bit; a tie gives 0."""

    def finish(total: np.ndarray) -> pa.RecordBatch:
        zero, one = total[:, 1 : 1 + width], total[:, 1 + width :]
        return _cells(total, "bin_mean", _lists((zero < one).astype(np.int32)))

    return _bit_sums(scored, width, finish, "cell int, bin_mean array<int>")


def update_bin_epsilon(scored: DataFrame, width: int) -> DataFrame:
    """(cell, bin_epsilon): weighted share of bits off the new prototype.

    The new prototype takes the heavier bit, so what is off it is the lighter
    side of each bit: no second pass over the rows.
    """

    def finish(total: np.ndarray) -> pa.RecordBatch:
        off = np.minimum(total[:, 1 : 1 + width], total[:, 1 + width :]).sum(axis=1)
        alive = total[:, 0] != 0
        return _cells(total, "bin_epsilon", pa.array(off / np.where(alive, width * total[:, 0], 1), mask=~alive))

    return _bit_sums(scored, width, finish, "cell int, bin_epsilon double")


def items_per_cell(scored: DataFrame) -> DataFrame:
    """(cell, num_items): rows whose best winner is the cell; ties count for each."""
    top = scored.select(
        F.array_max("log_p_winner").alias("top"), F.posexplode("log_p_winner").alias("cell", "v")
    )
    return top.groupBy("cell").agg(
        F.sum(F.when(F.col("v") == F.col("top"), 1.0).otherwise(0.0)).alias("num_items")
    )


def score_for_updates(
    points: DataFrame, model: CellModel, temperature: float, components: str = "mixed"
) -> DataFrame:
    """Rows with both posteriors, the input of the updates above."""
    return with_posterior(
        points,
        model,
        temperature,
        components=components,
        want=("log_p_cell", "log_p_winner", "log_px"),
    )
