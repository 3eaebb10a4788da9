"""Feature preparation and joins by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BITS_JITTER, BITS_STEP, BITS_WIDTH
from ..functions.vectors import UNROLL_LIMIT, with_width


def column_min_max(points: DataFrame, width: int, column: str = "x") -> DataFrame:
    """One row: arrays ``lo`` and ``hi`` over all rows; wide vectors by position."""
    rows = with_width(points, **{column: width})
    if width <= UNROLL_LIMIT:
        v = F.col(column)
        return rows.agg(
            F.array(*[F.min(v[j]) for j in range(width)]).alias("lo"),
            F.array(*[F.max(v[j]) for j in range(width)]).alias("hi"),
        )
    bounds = rows.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    placed = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    return bounds.agg(
        F.transform(placed, lambda p: p["lo"]).alias("lo"), F.transform(placed, lambda p: p["hi"]).alias("hi")
    )


def minmax_normalize(points: DataFrame, width: int, column: str = "x") -> DataFrame:
    """Each column to (v - min) / (max - min) over all rows; constant -> NULL.

    The bounds enter as a scalar subquery: one aggregate, no join.
    """
    bounds = column_min_max(points, width, column).select(F.struct("lo", "hi").alias("b")).scalar()
    v, lo, hi = F.col(column), F.col("_bounds.lo"), F.col("_bounds.hi")
    if width <= UNROLL_LIMIT:
        scaled = F.array(*[F.try_divide(v[j] - lo[j], hi[j] - lo[j]) for j in range(width)])
    else:
        minus = lambda a, b: F.zip_with(a, b, lambda u, w: u - w)
        scaled = F.zip_with(minus(v, lo), minus(hi, lo), lambda u, w: F.try_divide(u, w))
    return (
        with_width(points, **{column: width})
        .withColumn("_bounds", bounds)
        .withColumn(column, scaled)
        .select(*points.columns)
    )


def vector_width(df: DataFrame, column: str = "x") -> DataFrame:
    """One row: rows, NULL vectors, narrowest and widest vector."""
    return df.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(column).isNull(), 1)).alias("n_null"),
        F.min(F.size(column)).alias("narrowest"),
        F.max(F.size(column)).alias("widest"),
    )


def checked_widths(df: DataFrame, *columns: str) -> dict[str, int]:
    """The common width of each column's vectors, from one pass, or an error."""
    sizes = [f(F.size(c)).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_null") for c in columns]
    got = df.agg(F.count("*").alias("n"), *sizes, *nulls).first().asDict()
    for c in columns:
        if got["n"] == 0 or got[f"{c}_null"] or got[f"{c}_low"] != got[f"{c}_high"]:
            raise ValueError(f"every {c} must be a vector of one width: {got}")
    return {c: got[f"{c}_high"] for c in columns}


def checked_width(df: DataFrame, column: str = "x") -> int:
    """The common width of all rows' vectors, or an error."""
    return checked_widths(df, column)[column]


def first_n(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Rows whose id is below n: a predicate, so it reaches the scan."""
    return df.filter(F.col(key) < n)


def join_features(continuous: DataFrame, binary: DataFrame) -> DataFrame:
    """(id, x, b) of the ids found on both sides."""
    return continuous.join(binary, "id").select("id", "x", "b")


def concat_features(points: DataFrame, name: str = "x") -> DataFrame:
    """(id, x): continuous values followed by the bits as doubles."""
    return points.select("id", F.concat("x", F.col("b").cast("array<double>")).alias(name))


def points_with_labels(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``points`` with their label, matched by id."""
    return points.join(labels, "id")


def to_bits(value: Column, width: int = BITS_WIDTH) -> Column:
    """Zero-padded binary text of a non-negative integer; never cut shorter."""
    digits = F.conv(value.cast("string"), 10, 2)
    padded = F.lpad(digits, width, "0")
    checked = F.when(F.length(digits) <= width, padded).otherwise(digits)
    return F.when(value >= 0, checked).otherwise(
        F.raise_error(F.lit("only non-negative integers have a bit encoding"))
    )


def int_to_bits(
    df: DataFrame, column: str, *, jitter: bool = False, seed: int = 1, width: int = BITS_WIDTH
) -> DataFrame:
    """Adds ``b``: the bits of ``column * BITS_STEP``, plus seeded noise if asked."""
    value = F.col(column).cast("long") * BITS_STEP
    if jitter:
        noise = F.floor(F.rand(seed) * (2 * BITS_JITTER + 1)) - BITS_JITTER
        value = value + noise.cast("long")
    bits = F.transform(F.split(to_bits(value, width), ""), lambda c: c.cast("int"))
    return df.withColumn("b", bits)


def one_hot(column: Column, values: list) -> Column:
    """0/1 array marking which of ``values`` the column holds."""
    return F.array(*[(column == F.lit(v)).cast("int") for v in values])


def labels_sorted(labels: DataFrame) -> DataFrame:
    """(id, label) in id order, for output; a range-partitioned sort."""
    return labels.orderBy("id")
