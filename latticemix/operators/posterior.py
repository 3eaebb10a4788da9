"""Per-row posteriors.

Each row needs reductions over its K cells.  In long form those would shuffle
N * K rows by id; here one Arrow function returns the row's K-vectors as array
columns, so scoring is a narrow step: no shuffle, other columns stay in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import CellModel, constant
from ..constants import EPSILON_CEILING, EPSILON_FLOOR, KERNEL_RATE, VARIANCE_FLOOR
from ..functions import lattice as L
from ..functions.reduce import argmax_first
from ..functions.vectors import width_message
from .density import COMPONENTS

VECTORS = ("log_px_cell", "log_px_winner", "log_p_cell", "log_p_winner")
FIELDS = {name: "array<double>" for name in VECTORS} | {"log_px": "double"}


# -- numpy inside tasks ------------------------------------------------------


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow list column -> n x width array; every row must have that width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    if column.null_count or values.null_count or len(values) != len(column) * width:
        raise ValueError(width_message(width))
    offsets = column.offsets.to_numpy()
    if width and not (np.diff(offsets) == width).all():
        raise ValueError(width_message(width))
    return values.to_numpy(zero_copy_only=False).reshape(len(column), width)


# Rows per numpy call: K x CHUNK stays in a core's cache.
CHUNK = 1024


def squared_distances(a: np.ndarray, b_t: np.ndarray) -> np.ndarray:
    """len(a) x n, from rows ``a`` and the n columns of ``b_t``.

    Summed from differences, so equal vectors are at exactly 0.
    """
    out = None
    for j in range(a.shape[1]):
        off = b_t[j] - a[:, j, None]
        off *= off
        out = off if out is None else np.add(out, off, out=out)
    return np.zeros((len(a), b_t.shape[1])) if out is None else out


def task_values(model: CellModel, temperature: float, components: str) -> dict:
    """What a task needs of the model (bounded by the grid, not the data)."""
    if components not in COMPONENTS:
        raise ValueError(f"components is one of {COMPONENTS}")
    use_x, use_b = components != "bin", components != "cont"
    by_row, by_col = model.neighborhood_factors(temperature)
    # chance of each cell over all winners
    q = (by_row.T @ model.prob.reshape(model.rows, model.cols) @ by_col).reshape(-1)
    log_scale = np.zeros(model.size)  # the part of the log-density without x or b
    values = {"use_x": use_x, "use_b": use_b, "by_row": by_row, "by_col": by_col, "q": q, "prior": model.prob}
    if use_x:
        variance = np.maximum(model.cont_variance, VARIANCE_FLOOR)
        values["mean"] = model.cont_mean
        values["per_sq"] = (-0.5 / variance)[:, None]
        log_scale = log_scale - 0.5 * model.cont_size * np.log(2 * np.pi * variance)
    if use_b:
        proto = model.bin_mean.astype(float)
        eps = np.clip(model.bin_epsilon, EPSILON_FLOOR, EPSILON_CEILING)
        odds = np.log(eps) - np.log1p(-eps)  # log-density change per differing bit
        values["per_bit"] = (1 - 2 * proto) * odds[:, None]
        log_scale = log_scale + proto.sum(axis=1) * odds + model.bin_size * np.log1p(-eps)
    values["log_scale"] = log_scale[:, None]
    with np.errstate(divide="ignore"):
        values["log_prior"], values["log_q"] = np.log(model.prob)[:, None], np.log(q)[:, None]
    return values | {"cont_size": model.cont_size, "bin_size": model.bin_size}


def chunks(x, b):
    """(rows, x transposed, bits as doubles) per chunk of one batch."""
    n = len(x if x is not None else b)
    for start in range(0, n, CHUNK):
        part = slice(start, min(start + CHUNK, n))
        yield (
            part,
            None if x is None else np.ascontiguousarray(x[part].T),
            None if b is None else b[part].astype(float),
        )


def log_density(x_t, bits, p: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """K x n log-density under each cell, and squared distances to the means."""
    sq = None
    out = p["log_scale"]
    if bits is not None:
        out = p["per_bit"] @ bits.T + out
    if x_t is not None:
        sq = squared_distances(p["mean"], x_t)
        out = out + p["per_sq"] * sq
    return out, sq


def _along(factor: np.ndarray, v: np.ndarray, axis: int) -> np.ndarray:
    """``factor`` applied along the grid's rows (0) or columns (1) of R x C x n values."""
    out = np.zeros_like(v)
    for j in range(len(factor)):
        out += factor[:, j, None, None] * v[None, j] if axis == 0 else factor[None, :, j, None] * v[:, None, j]
    return out


def over_winners(v: np.ndarray, p: dict) -> np.ndarray:
    """For each winner the mean of ``v`` (K x n) over the cells it may emit from.

    The neighbourhood is a row factor times a column factor, so no K x K matrix
    is formed.  Both orders are averaged, plain sums each: a pattern and its
    transpose then give equal values, and ties stay ties.
    """
    grid = v.reshape(len(p["by_row"]), len(p["by_col"]), -1)
    rows_first = _along(p["by_col"], _along(p["by_row"], grid, 0), 1)
    cols_first = _along(p["by_row"], _along(p["by_col"], grid, 1), 0)
    return (0.5 * (rows_first + cols_first)).reshape(v.shape)


def weights(log_d: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K x n p(cell | x) and p(winner | x), and log p(x); one exp per value."""
    top = log_d.max(axis=0)
    p_cell = np.exp(log_d - top)
    total = p["q"] @ p_cell
    p_winner = over_winners(p_cell, p)
    p_winner *= p["prior"][:, None]
    p_winner /= total
    p_cell *= p["q"][:, None]
    p_cell /= total
    return p_cell, p_winner, top + np.log(total)


def log_posterior(log_d: np.ndarray, p: dict) -> dict:
    """The same in logs, K x n each (``log_px`` has n)."""
    top = log_d.max(axis=0)
    scaled = np.exp(log_d - top)
    log_px = top + np.log(p["q"] @ scaled)
    log_winner = top + np.log(over_winners(scaled, p))
    return {
        "log_px_cell": log_d,
        "log_px_winner": log_winner,
        "log_px": log_px,
        "log_p_cell": log_d + p["log_q"] - log_px,
        "log_p_winner": log_winner + p["log_prior"] - log_px,
    }


# -- DataFrame operators -------------------------------------------------------


def with_posterior(
    points: DataFrame,
    model: CellModel,
    temperature: float,
    *,
    components: str = "mixed",
    want: tuple[str, ...] = ("log_p_cell",),
) -> DataFrame:
    """Add the wanted columns of ``FIELDS`` to ``points`` (x and/or b).

    log_px_cell   log p(x | cell)         log_px_winner  log p(x | winner)
    log_p_cell    log p(cell | x)         log_p_winner   log p(winner | x)
    log_px        log p(x)
    """
    p = task_values(model, temperature, components)
    returns = "struct<" + ",".join(f"{name}:{FIELDS[name]}" for name in want) + ">"

    k = model.size

    def score(*columns: pa.Array) -> pa.Array:
        columns = list(columns)
        n = len(columns[0])
        x = matrix(columns.pop(0), p["cont_size"]) if p["use_x"] else None
        b = matrix(columns.pop(0), p["bin_size"]) if p["use_b"] else None
        out = {name: np.empty((n, k) if name in VECTORS else n) for name in want}
        for rows, x_t, bits in chunks(x, b):
            got = log_posterior(log_density(x_t, bits, p)[0], p)
            for name in want:
                out[name][rows] = got[name].T
        ends = np.arange(0, n * k + 1, k, dtype=np.int32)
        arrays = [
            pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) if v.ndim == 2 else pa.array(v)
            for v in out.values()
        ]
        return pa.StructArray.from_arrays(arrays, list(want))

    inputs = [name for name, used in (("x", p["use_x"]), ("b", p["use_b"])) if used]
    # Marked so that the optimizer does not copy it into a pushed-down filter,
    # which would score every row twice.
    scored = F.arrow_udf(score, returnType=returns).asNondeterministic()(*inputs)
    return points.withColumn("_scored", scored).select(
        *points.columns, *[F.col(f"_scored.{name}").alias(name) for name in want]
    )


def long_form(scored: DataFrame, vector: str, cell: str = "cell") -> DataFrame:
    """(id, cell, value) from an array column of per-cell values."""
    return scored.select("id", F.posexplode(vector).alias(cell, "value"))


def joint_posterior(
    points: DataFrame, model: CellModel, temperature: float, components: str = "mixed"
) -> DataFrame:
    """(id, cell_star, cell, log_p): K * K rows per input row, only on request.

    A narrow step: both indexes are exploded from number ranges, the weight of a
    pair follows from its cells' places, and the rest is looked up in the row's
    own vectors.
    """
    k, cols = model.size, model.cols
    by_row, by_col = model.neighborhood_factors(temperature)
    # ln of a winner's prior and of its normaliser, which is its chance of emitting from itself
    with np.errstate(divide="ignore"):
        own = np.log(model.prob) + np.log(np.repeat(by_row.diagonal(), cols) * np.tile(by_col.diagonal(), model.rows))
    own = constant([None if np.isneginf(v) else float(v) for v in own], T.ArrayType(T.DoubleType()))
    scored = with_posterior(
        points, model, temperature, components=components, want=("log_px_cell", "log_px")
    )
    cells = F.sequence(F.lit(0), F.lit(k - 1))
    pairs = scored.withColumn("_own", own).select(
        "id", "_own", "log_px_cell", "log_px", F.explode(cells).alias("cell_star")
    ).withColumn("cell", F.explode(cells))
    distance = L.grid_distance(
        *(at(F.col(c), cols) for c in ("cell_star", "cell") for at in (L.cell_row, L.cell_col))
    )
    weight = F.coalesce(F.col("_own")[F.col("cell_star")], F.lit(float("-inf"))) - KERNEL_RATE * distance / temperature
    return pairs.select(
        "id",
        "cell_star",
        "cell",
        (weight + F.col("log_px_cell")[F.col("cell")] - F.col("log_px")).alias("log_p"),
    )


def _assigned(points, model, temperature, components, vector: str) -> DataFrame:
    scored = with_posterior(points, model, temperature, components=components, want=(vector,))
    return scored.withColumn("cell", argmax_first(F.col(vector))).drop(vector)


def assign_by_cell(
    points: DataFrame, model: CellModel, temperature: float, components: str = "mixed"
) -> DataFrame:
    """``points`` plus ``cell``, the most probable emitting cell (first on a tie)."""
    return _assigned(points, model, temperature, components, "log_p_cell")


def assign_by_winner(
    points: DataFrame, model: CellModel, temperature: float, components: str = "mixed"
) -> DataFrame:
    """``points`` plus ``cell``, the most probable winner (first on a tie)."""
    return _assigned(points, model, temperature, components, "log_p_winner")


def log_likelihood(
    points: DataFrame, model: CellModel, temperature: float, components: str = "mixed"
) -> DataFrame:
    """One row: number of rows and the sum of log p(x)."""
    scored = with_posterior(
        points, model, temperature, components=components, want=("log_px",)
    )
    return scored.agg(F.count("*").alias("n"), F.sum("log_px").alias("log_likelihood"))
