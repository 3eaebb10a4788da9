"""Row by cell densities in long form.

The K cells are a constant array that each row explodes: no join and no
shuffle, and every expression is Spark's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cells import CellModel
from ..constants import T_MAX, T_MIN
from ..functions import density as D
from ..functions import lattice as L
from ..functions import vectors as V

COMPONENTS = ("mixed", "cont", "bin")


def with_cells(df: DataFrame, model: CellModel) -> DataFrame:
    """One row per input row and cell; the cell's values as struct ``c``.

    Vectors of another width than the model's fail the job.
    """
    widths = {"x": model.cont_size, "b": model.bin_size}
    df = V.with_width(df, **{c: w for c, w in widths.items() if c in df.columns})
    return df.withColumn("c", F.explode(model.as_literal()))


def hamming_to_cells(points: DataFrame, model: CellModel) -> DataFrame:
    """(id, cell, distance): differing bits between the row and each prototype."""
    return with_cells(points.select("id", "b"), model).select(
        "id",
        F.col("c.cell").alias("cell"),
        V.hamming(F.col("b"), F.col("c.bin_mean"), model.bin_size).alias("distance"),
    )


def _sq_dist(model: CellModel):
    return V.squared_distance(F.col("x"), F.col("c.cont_mean"), model.cont_size)


def log_gaussian_cells(points: DataFrame, model: CellModel, form: str = "normal") -> DataFrame:
    """(id, cell, value) under each cell's Gaussian.

    ``form``: "normal" (the model's log-density), "scaled_norm" (log) or
    "density" (not log, ``cont_variance`` read as the deviation's square).
    """
    variance, d = F.col("c.cont_variance"), model.cont_size
    if form == "normal":
        value = D.log_gaussian(_sq_dist(model), d, variance)
    elif form == "scaled_norm":
        value = D.log_gaussian_scaled(_sq_dist(model), d, variance)
    elif form == "density":
        value = D.gaussian_density(_sq_dist(model), d, F.sqrt(variance))
    else:
        raise ValueError(f"unknown form {form!r}")
    return with_cells(points.select("id", "x"), model).select(
        "id", F.col("c.cell").alias("cell"), value.alias("value")
    )


def log_bernoulli_cells(points: DataFrame, model: CellModel) -> DataFrame:
    """(id, cell, value): log-density of the bits under each cell."""
    s = model.bin_size
    distance = V.hamming(F.col("b"), F.col("c.bin_mean"), s)
    return with_cells(points.select("id", "b"), model).select(
        "id",
        F.col("c.cell").alias("cell"),
        D.log_bernoulli(distance, s, F.col("c.bin_epsilon")).alias("value"),
    )


def log_mixed_density(
    points: DataFrame, model: CellModel, components: str = "mixed"
) -> DataFrame:
    """(id, cell, value): sum of the chosen parts; one row carries both vectors."""
    if components not in COMPONENTS:
        raise ValueError(f"components is one of {COMPONENTS}")
    parts = []
    if components != "bin":
        parts.append(D.log_gaussian(_sq_dist(model), model.cont_size, F.col("c.cont_variance")))
    if components != "cont":
        distance = V.hamming(F.col("b"), F.col("c.bin_mean"), model.bin_size)
        parts.append(D.log_bernoulli(distance, model.bin_size, F.col("c.bin_epsilon")))
    needed = {"mixed": ["x", "b"], "cont": ["x"], "bin": ["b"]}[components]
    return with_cells(points.select("id", *needed), model).select(
        "id", F.col("c.cell").alias("cell"), V.tree_sum(parts).alias("value")
    )


def neighborhood(spark, rows: int, cols: int, temperature: float) -> DataFrame:
    """(cell_star, cell, distance, weight): chance of each cell given the winner.

    K * K rows for the fixed grid, independent of the data.
    """
    k = rows * cols
    pair = spark.range(0, k * k, 1, 1).select(
        F.floor(F.col("id") / k).cast("int").alias("cell_star"),
        F.pmod("id", F.lit(k)).cast("int").alias("cell"),
    )
    distance = L.grid_distance(
        L.cell_row(F.col("cell_star"), cols),
        L.cell_col(F.col("cell_star"), cols),
        L.cell_row(F.col("cell"), cols),
        L.cell_col(F.col("cell"), cols),
    )
    weighted = pair.withColumn("distance", distance).withColumn(
        "k", L.kernel(F.col("distance"), temperature)
    )
    total = weighted.groupBy("cell_star").agg(F.sum("k").alias("total"))
    return weighted.join(total, "cell_star").select(
        "cell_star", "cell", "distance", (F.col("k") / F.col("total")).alias("weight")
    )


def annealing_schedule(
    spark, max_iter: int, t_min: float = T_MIN, t_max: float = T_MAX
) -> DataFrame:
    """(iteration, temperature) of every iteration."""
    steps = spark.range(1, max_iter + 1, 1, 1).select(F.col("id").cast("int").alias("iteration"))
    return steps.withColumn(
        "temperature", L.temperature(F.col("iteration"), max_iter, t_min, t_max)
    )
