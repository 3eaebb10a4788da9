"""Whitening of vectors by the covariance of their distinct grid points.

Entries become whole numbers on a grid.  Identical vectors are grouped once, and
each distinct vector enters the fit with its count, or with one, as its weight.
Sums are exact; the covariance is a weighted product of centred matrices, one
partial product per task.  Every distinct vector is whitened once, and rows get
their vector's values by a join.  Vectors that hold over 1/1000 of the rows are
fewer than 1000 and are joined by broadcast, so no vector's rows meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

GRID = 256
COMPONENTS = 4
# A vector with more than one in so many rows is joined by broadcast.
HOT_SHARE = 1000
# Values of a centred block of rows.
BLOCK_VALUES = 4_000_000
_MARGIN = 1 << 62


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: the width of a number, then the numbers, as narrow as the row allows."""
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(1, initial=0), x.max(1, initial=0)
    need = np.full(len(x), 8)
    for width in (4, 2, 1):
        info = np.iinfo(f"i{width}")
        need[(low >= info.min) & (high <= info.max)] = width
    for width in np.unique(need).tolist():
        at = np.flatnonzero(need == width)
        data = x[at].astype(f"<i{width}")
        for i, row in zip(at.tolist(), data):
            out[i] = bytes([width]) + row.tobytes()
    return out


def _unpack(keys: list[bytes]) -> np.ndarray:
    """The whole numbers of packed rows; rows of unequal length fail."""
    sizes = {(len(k) - 1) // k[0] for k in keys}
    if len(sizes) > 1:
        raise ValueError(f"vectors have unequal widths: {sorted(sizes)[:5]}")
    out = np.empty((len(keys), sizes.pop()), np.int64)
    widths = np.array([k[0] for k in keys])
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at), f"<i{width}").reshape(len(at), -1)
    return out


def grid_points(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, point): the vector's grid point as bytes, for rows whose entries are all there and finite.

    An entry c is floor(GRID * c), held to the range of a long.
    """
    kind = vectors.select(F.col(key).cast("long").alias(key)).schema

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            column = column.cast(pa.list_(pa.float64()))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            good = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
            values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
            row = np.repeat(np.arange(len(column)), sizes)
            good[row[~np.isfinite(values)]] = False
            with np.errstate(over="ignore"):
                scaled = np.floor(values * GRID)
            limit = np.iinfo(np.int64)
            inside = (scaled >= -(2.0**63)) & (scaled < 2.0**63)
            whole = np.where(inside, scaled, 0).astype(np.int64)
            whole[~inside] = np.where(values[~inside] > 0, limit.max, limit.min)
            starts = np.cumsum(sizes) - sizes
            points: list[bytes] = [b""] * len(column)
            for size in np.unique(sizes[good]).tolist():
                at = np.flatnonzero(good & (sizes == size))
                rows = whole[(starts[at][:, None] + np.arange(size)).ravel()].reshape(len(at), size)
                for i, p in zip(at.tolist(), _pack(rows)):
                    points[i] = p
            at = np.flatnonzero(good)
            keys = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([keys, pa.array([points[i] for i in at.tolist()], pa.binary())], [key, "point"])

    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(floor, f"`{kind[0].name}` long, point binary")


def distinct_points(points: DataFrame, counted: bool) -> DataFrame:
    """(point, copies, weight): each distinct point once; its weight is its count, or one."""
    grouped = points.groupBy("point").agg(F.count("*").alias("copies"))
    return grouped.withColumn("weight", F.col("copies") if counted else F.lit(1).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, points, weights) in blocks of bounded size."""
    for batch in batches:
        at = 0
        while at < len(batch):
            width = max(1, len(batch.column("point")[at].as_py()) - 1)
            part = batch.slice(at, max(1, BLOCK_VALUES // width))
            at += len(part)
            yield part, _unpack(part.column("point").to_pylist()), part.column("weight").to_numpy(zero_copy_only=False)


def _exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted sums of columns as whole numbers of any size."""
    most = int(max(x.max(initial=0), -int(x.min(initial=0)))) * int(w.sum())
    if most < _MARGIN:
        return (w @ x).tolist()
    return [sum(int(a) * int(b) for a, b in zip(w, column)) for column in x.T]


def sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums per dimension; no dimensions for no rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, by_dim = 0, None
        for _, x, w in _blocks(batches):
            if by_dim is not None and len(by_dim) != x.shape[1]:
                raise ValueError(f"vectors have unequal widths: {sorted((len(by_dim), x.shape[1]))}")
            found = _exact_sums(x, w)
            total += int(w.sum())
            by_dim = found if by_dim is None else [a + b for a, b in zip(by_dim, found)]
        if by_dim is not None:
            rows = [(-1, Decimal(total), len(by_dim)), *((i, Decimal(v), len(by_dim)) for i, v in enumerate(by_dim))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.decimal128(38, 0), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "total", "width"])

    parts = distinct.select("point", "weight").mapInArrow(add, "dim long, total decimal(38,0), width long")
    rows = parts.groupBy("dim").agg(F.sum("total").alias("total"), F.min("width").alias("low"), F.max("width").alias("high"))
    found = {r.dim: r for r in rows.collect()}  # a row per dimension
    if not found:
        return 0, []
    if found[-1].low != found[-1].high:
        raise ValueError(f"vectors have unequal widths: {[found[-1].low, found[-1].high]}")
    return int(found[-1].total), [int(found[i].total) for i in range(found[-1].low)]


def _centred(x: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, list[list[int]] | np.ndarray]:
    """x - s / n as doubles, and n * x - s exactly."""
    most = n * int(max(x.max(initial=0), -int(x.min(initial=0)))) + max(map(abs, s), default=0)
    if most < _MARGIN:
        exact = n * x - np.array(s, np.int64)
        return exact / n, exact
    exact = np.array([[n * int(v) - t for v, t in zip(row, s)] for row in x], object)
    return (exact / n).astype(float).reshape(x.shape), exact


def _deviations(exact: np.ndarray) -> list[int | None]:
    """Sums of squares of exact rows; null where they don't fit a long."""
    if exact.dtype != object:
        most = int(max(exact.max(initial=0), -int(exact.min(initial=0))))
        if most * most * max(1, exact.shape[1]) < _MARGIN:
            return (exact * exact).sum(1).tolist()
    found = [sum(int(v) * int(v) for v in row) for row in exact]
    return [v if v < 1 << 63 else None for v in found]


def covariance(distinct: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """Weighted covariance with divisor ``n`` of rows centred before they are multiplied."""
    d = len(s)

    def add_up(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["product"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def products():
            for _, x, w in _blocks(batches):
                centred, _ = _centred(x, n, s)
                yield (centred * w[:, None]).T @ centred

        yield from add_up(products())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add_up(np.frombuffer(p) for b in batches for p in b.column(0).to_pylist())

    parts = distinct.select("point", "weight").mapInArrow(multiply, "product binary")
    # one product per task, added up over two levels of bounded fan-in
    fan = max(1, math.isqrt(max(1, distinct.sparkSession.sparkContext.defaultParallelism)))
    merged = parts.repartition(fan * fan).mapInArrow(merge, "product binary").repartition(fan).mapInArrow(merge, "product binary")
    found = [np.frombuffer(r.product) for r in merged.collect()]  # at most ``fan`` products
    return sum(found, np.zeros(d * d)).reshape(d, d) / n


@dataclass(frozen=True)
class Whitening:
    """A fit: weights' total, sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dimension x component
    values: np.ndarray
    explained: np.ndarray


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of ``distinct`` points (point, weight), at most as many as dimensions."""
    n, s = sums(distinct)
    if not s:
        return Whitening(n, s, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    v = covariance(distinct, n, s)
    values, axes = np.linalg.eigh(v)
    k = min(components, len(s))
    values, axes = np.maximum(values[::-1][:k], 0), axes[:, ::-1][:, :k]
    # a direction whose spread is rounding noise has none
    values = np.where(values > np.trace(v) * len(s) * np.finfo(float).eps, values, 0)
    trace = float(np.trace(v))
    explained = values / trace if trace > 0 else np.full(k, np.nan)
    return Whitening(n, s, axes, values, explained)


def whiten(distinct: DataFrame, fitted: Whitening) -> DataFrame:
    """(point, copies, weight, deviation, whitened): each distinct point once.

    ``whitened`` has a value per component, null where the fit has no spread.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(fitted)  # dimensions x components

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        k = len(f.values)
        for part, x, _ in _blocks(batches):
            centred, exact = _centred(x, f.n, f.sums)
            with np.errstate(divide="ignore", invalid="ignore"):
                made = (centred @ f.axes) / np.sqrt(f.values)
            flat = pa.array(made.ravel(), mask=np.tile(f.values == 0, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)
            columns = [part.column(c) for c in ("point", "copies", "weight")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(_deviations(exact), pa.int64()), lists],
                ["point", "copies", "weight", "deviation", "whitened"],
            )

    schema = "point binary, copies long, weight long, deviation long, whitened array<double>"
    return distinct.select("point", "copies", "weight").mapInArrow(project, schema)


def identity_error(whitened: DataFrame, k: int, n: int) -> float | None:
    """Largest entry of the whitened covariance minus the identity, over components with spread."""
    parts = [F.col("whitened")[i] for i in range(k)]
    weight = F.col("weight").cast("double")
    means = whitened.agg(*[(F.sum(weight * p) / n).alias(f"m{i}") for i, p in enumerate(parts)]).first() if k else []
    spread = [i for i in range(k) if means[i] is not None]
    if not spread:
        return None
    off = {i: parts[i] - means[i] for i in spread}
    pairs = [(i, j) for i in spread for j in spread if i <= j]
    found = whitened.agg(*[(F.sum(weight * off[i] * off[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def _joined(points: DataFrame, values: DataFrame, n_rows: Column | int) -> DataFrame:
    """Rows with their point's values; frequent points by broadcast, the rest by a shuffle without hot keys."""
    hot = values.filter(F.col("copies") * HOT_SHARE > n_rows)  # fewer than HOT_SHARE rows
    rest = values.filter(F.col("copies") * HOT_SHARE <= n_rows)
    by_broadcast = points.join(F.broadcast(hot), "point")
    others = points.join(F.broadcast(hot.select("point")), "point", "left_anti")
    return by_broadcast.unionByName(others.join(rest, "point"))


def whiten_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, counted: bool = False
) -> DataFrame:
    """One row per vector and component: (key, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null or has null or non-finite entries are dropped;
    null and repeated keys stay, with their vectors' values; other columns are
    ignored; an empty table, or one of empty vectors, gives no rows.  With
    ``counted`` a distinct vector weighs as often as it occurs.  Vectors of
    unequal widths fail the job.  A component without spread has null
    ``whitened``, and without any spread ``explained`` is null too; a deviation
    that doesn't fit a long is null.  Equal eigenvalues leave the choice of their
    components open, as the sign is.
    """
    points = grid_points(vectors, key, vector)
    distinct = stored(distinct_points(points, counted), "distinct-points")
    fitted = fit(distinct, components)
    k = len(fitted.values)
    whitened = stored(whiten(distinct, fitted), "whitened")
    error = identity_error(whitened, k, fitted.n)
    n_rows = whitened.agg(F.sum("copies")).first()[0] or 0
    values = whitened.select("point", "copies", "deviation", "whitened")
    rows = _joined(points, values, n_rows)
    shares = [None if math.isnan(e) else float(e) for e in fitted.explained]
    explained = F.array(*[F.lit(e).cast("double") for e in shares]) if k else F.array().cast("array<double>")
    return rows.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
