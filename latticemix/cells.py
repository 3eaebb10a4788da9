"""The model: one small record per grid cell.

K = rows * cols cells hold K * (d + s + 5) numbers.  That count does not depend
on the data, so the model lives on the driver as numpy arrays, and tasks get it
with their closure.  ``CellModel`` refuses to grow past ``MAX_MODEL_VALUES``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import KERNEL_RATE, MAX_MODEL_VALUES, T_MAX, T_MIN, VARIANCE_SHARE
from .functions.random import uniform, uniform_table

CELL_SCHEMA = T.StructType(
    [
        T.StructField("cell", T.IntegerType(), False),
        T.StructField("row", T.IntegerType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("prob", T.DoubleType(), False),
        T.StructField("num_items", T.DoubleType(), False),
        T.StructField("cont_mean", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("cont_variance", T.DoubleType(), False),
        T.StructField("bin_mean", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("bin_epsilon", T.DoubleType(), False),
    ]
)


# Streams of random numbers of a start.
MEANS, BITS, EPSILONS = 0, 1, 2


def random_cells(spark: SparkSession, k: int, cont_size: int, bin_size: int, seed: int = 1) -> DataFrame:
    """(cell, cont_mean, bin_mean, bin_epsilon): the numbers that ``CellModel.initial`` draws, as columns."""

    def drawn(stream: int, width: int) -> Column:
        if not width:
            return F.array().cast("array<double>")
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: uniform(seed, stream, F.col("cell"), j))

    cells = spark.range(k).select(F.col("id").cast("int").alias("cell"))
    return cells.select(
        "cell",
        drawn(MEANS, cont_size).alias("cont_mean"),
        F.transform(drawn(BITS, bin_size), lambda u: (u >= 0.5).cast("int")).alias("bin_mean"),
        uniform(seed, EPSILONS, F.col("cell"), 0).alias("bin_epsilon"),
    )


def constant(value, kind: T.DataType) -> Column:
    """A nested constant, parsed by the optimizer when it folds constants."""
    return F.from_json(F.lit(json.dumps(value)), kind, {"mode": "FAILFAST"})


@dataclass(frozen=True)
class CellModel:
    rows: int
    cols: int
    prob: np.ndarray  # K
    num_items: np.ndarray  # K
    cont_mean: np.ndarray  # K x d
    cont_variance: np.ndarray  # K
    bin_mean: np.ndarray  # K x s
    bin_epsilon: np.ndarray  # K

    def __post_init__(self):
        k = self.rows * self.cols
        if self.cont_mean.shape[0] != k or self.bin_mean.shape[0] != k:
            raise ValueError(f"expected {k} cells")
        if k * (self.cont_size + self.bin_size + 5) > MAX_MODEL_VALUES:
            raise ValueError("the grid and its vectors are too large for one model")

    @property
    def size(self) -> int:
        return self.rows * self.cols

    @property
    def cont_size(self) -> int:
        return self.cont_mean.shape[1]

    @property
    def bin_size(self) -> int:
        return self.bin_mean.shape[1]

    def with_values(self, **values) -> CellModel:
        return replace(self, **values)

    def same_as(self, other: CellModel) -> bool:
        """Whether both have the same grid and values."""
        names = ("prob", "num_items", "cont_mean", "cont_variance", "bin_mean", "bin_epsilon")
        same = all(np.array_equal(getattr(self, n), getattr(other, n)) for n in names)
        return (self.rows, self.cols) == (other.rows, other.cols) and same

    # -- construction ----------------------------------------------------

    @classmethod
    def initial(
        cls,
        rows: int,
        cols: int,
        *,
        cont_size: int = 2,
        bin_size: int = 0,
        cont_mean=None,
        bin_mean=None,
        bin_epsilon=None,
        cont_variance=None,
        seed: int = 1,
    ) -> CellModel:
        """Starting cells: even priors, grid means, small variance.

        Without ``cont_mean`` two continuous features start at the cell centres
        of the unit square; any other number is drawn from [0, 1).  Missing
        prototypes and epsilons are drawn too, each from its own stream of
        ``seed``: ``functions.random`` gives the same numbers as columns.
        """
        k = rows * cols
        if cont_mean is None and cont_size != 2:
            cont_mean = uniform_table(seed, MEANS, k, cont_size)
        elif cont_mean is None:
            at = np.arange(k)
            cont_mean = np.column_stack(
                [(at // cols) / rows + 1 / (2 * rows), (at % cols) / cols + 1 / (2 * cols)]
            )
        if bin_mean is None:
            bin_mean = uniform_table(seed, BITS, k, bin_size) >= 0.5
        if bin_epsilon is None:
            bin_epsilon = uniform_table(seed, EPSILONS, k, 1)[:, 0]
        if cont_variance is None:
            cont_variance = 1.0 / (VARIANCE_SHARE * k)
        return cls(
            rows,
            cols,
            prob=np.full(k, 1.0 / k),
            num_items=np.zeros(k),
            cont_mean=np.asarray(cont_mean, dtype=float).reshape(k, -1),
            cont_variance=np.broadcast_to(np.asarray(cont_variance, float), (k,)).copy(),
            bin_mean=np.asarray(bin_mean, dtype=np.int64).reshape(k, -1),
            bin_epsilon=np.broadcast_to(np.asarray(bin_epsilon, float), (k,)).copy(),
        )

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> CellModel:
        """Read a cells table back.  One row per cell, checked before collecting."""
        shape = df.agg(
            F.count("*").alias("n"),
            F.countDistinct("cell").alias("distinct"),
            (F.max("row") + 1).alias("rows"),
            (F.max("col") + 1).alias("cols"),
        ).first()
        if not shape.n == shape.distinct == shape.rows * shape.cols:
            raise ValueError("a cells table holds each grid cell exactly once")
        if shape.n > MAX_MODEL_VALUES:
            raise ValueError("the grid is too large for one model")
        got = df.select(*CELL_SCHEMA.names).orderBy("cell").collect()
        column = lambda name, kind: np.array([r[name] for r in got], dtype=kind)
        return cls(
            shape.rows,
            shape.cols,
            prob=column("prob", float),
            num_items=column("num_items", float),
            cont_mean=column("cont_mean", float).reshape(len(got), -1),
            cont_variance=column("cont_variance", float),
            bin_mean=column("bin_mean", np.int64).reshape(len(got), -1),
            bin_epsilon=column("bin_epsilon", float),
        )

    # -- as Spark data -----------------------------------------------------

    def to_rows(self) -> list[tuple]:
        return [
            (
                c,
                c // self.cols,
                c % self.cols,
                float(self.prob[c]),
                float(self.num_items[c]),
                self.cont_mean[c].tolist(),
                float(self.cont_variance[c]),
                self.bin_mean[c].tolist(),
                float(self.bin_epsilon[c]),
            )
            for c in range(self.size)
        ]

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.to_rows(), CELL_SCHEMA).coalesce(1)

    def as_literal(self) -> Column:
        """All cells as one constant array of structs (folded once per plan)."""
        rows = [dict(zip(CELL_SCHEMA.names, values)) for values in self.to_rows()]
        return constant(rows, T.ArrayType(CELL_SCHEMA))

    # -- grid ---------------------------------------------------------------

    def neighborhood_factors(self, temperature: float) -> tuple[np.ndarray, np.ndarray]:
        """R x R and C x C chances whose product over rows and columns is ``neighborhood``.

        The kernel falls with the sum of row and column distance, so it and its
        normaliser are products.
        """

        def factor(n: int) -> np.ndarray:
            at = np.arange(n)
            weight = np.exp(-KERNEL_RATE * np.abs(at[:, None] - at) / temperature)
            return weight / weight.sum(axis=1, keepdims=True)

        return factor(self.rows), factor(self.cols)

    def grid_distances(self) -> np.ndarray:
        at = np.arange(self.size)
        r, c = at // self.cols, at % self.cols
        return np.abs(r[:, None] - r[None, :]) + np.abs(c[:, None] - c[None, :])

    def neighborhood(self, temperature: float) -> np.ndarray:
        """K x K matrix, [winner, cell] = chance the winner emits from the cell."""
        weight = np.exp(-KERNEL_RATE * self.grid_distances() / temperature)
        return weight / weight.sum(axis=1, keepdims=True)


def temperature_at(
    iteration: int, max_iter: int, t_min: float = T_MIN, t_max: float = T_MAX
) -> float:
    """Temperature of iteration 1..max_iter (the same rule as the column form)."""
    if max_iter < 2:
        raise ValueError("max_iter must be at least 2")
    return t_max * (t_min / t_max) ** (iteration / (max_iter - 1))
