"""Near-duplicate vectors by cosine: a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks of
``BLOCK`` dimensions.  Cosine >= c means a squared distance of at most 2 - 2c;
so in some block the squared distance is at most the block's share of that
budget.  Each block is range-joined: a grid over its first coordinates, with
cells as wide as the block's radius, brings each vector's row number and its
coordinates in the block together with those of its own and the adjoining cells,
in tiles of bounded size; rows of a tile are sorted by a further coordinate and
meet only those within the radius.  Pairs within the block's budget are
candidates and are verified exactly on the whole vectors, which lie in
memory-mapped files.  A pair counts in the first block that finds it, and a task
returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .components import components, forest
from .shared import map_file, stored, write_file

COSINE = 0.95
BLOCK = 8
GRID = 2
TILE = 1024
_SEED = 20240607
_SLACK = 1e-6  # rounding of rotated coordinates and their squares
_ROWS = 256
_PAIRS = 1 << 14
_ROW_BITS = 33


@functools.lru_cache(maxsize=8)
def _rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _blocks(width: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, width, max(1, width // BLOCK) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, whose square may lie outside the doubles."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _rotated(units: np.ndarray) -> np.ndarray:
    return units @ _rotation(units.shape[1])


def _budgets(width: int, cosine: float) -> np.ndarray:
    """Squared distance per block, in proportion to its dimensions."""
    return (2 - 2 * cosine) * np.array([b - a for a, b in _blocks(width)]) / width + _SLACK


def valid(vec: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, number) & F.exists(vec, lambda x: x != 0), F.lit(False))


# -- whole vectors in files --------------------------------------------------------


def _name(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part}.{kind}"


def with_files(distinct: DataFrame, folder: str) -> DataFrame:
    """``distinct`` (vec, ...) with row numbers ``rep``, its vectors written to a file per partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, flat, sizes = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            column = batch.column("vec")
            flat.append(column.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
            sizes.append(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            rep = (part << _ROW_BITS) + np.arange(n, n + len(batch))
            n += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rep)], [*batch.schema.names, "rep"])
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
        write_file(_name(folder, part, "flat"), flat)
        write_file(_name(folder, part, "ends"), [ends.astype("<i8").tobytes()])

    schema = distinct.withColumn("rep", F.lit(0).cast("long")).schema
    return distinct.mapInArrow(write, schema)


@functools.lru_cache(maxsize=64)
def _open(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    return map_file(_name(folder, part, "flat"), "<f8"), map_file(_name(folder, part, "ends"), "<i8")


def _vectors(folder: str, reps: np.ndarray, width: int) -> np.ndarray:
    """Whole unit vectors of sorted row numbers, all of one width."""
    out = np.empty((len(reps), width))
    parts = reps >> _ROW_BITS
    for part in np.unique(parts).tolist():
        mine = np.flatnonzero(parts == part)
        flat, ends = _open(folder, part)
        first = ends[reps[mine] & (1 << _ROW_BITS) - 1]
        out[mine] = flat[first[:, None] + np.arange(width)]
    return _units(out) if len(out) else out


# -- the join -----------------------------------------------------------------------


def _candidates(mine: np.ndarray, theirs: np.ndarray, same: bool, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of two tiles within a block's budget, from their coordinates there."""
    axis = min(GRID, mine.shape[1] - 1)  # a coordinate beyond the grid's, if there is one
    left, right = np.argsort(mine[:, axis], kind="stable"), np.argsort(theirs[:, axis], kind="stable")
    x, y = mine[left], theirs[right]
    xs, ys = (x * x).sum(1), (y * y).sum(1)
    radius = np.sqrt(budget + _SLACK)
    for at in range(0, len(x), _ROWS):
        rows = slice(at, min(at + _ROWS, len(x)))
        lo = int(np.searchsorted(y[:, axis], x[at, axis] - radius))
        hi = int(np.searchsorted(y[:, axis], x[rows.stop - 1, axis] + radius, "right"))
        gap = xs[rows, None] + ys[lo:hi] - 2 * (x[rows] @ y[lo:hi].T)
        i, j = np.nonzero(gap <= budget)
        i, j = left[i + at], right[j + lo]
        yield (i[i < j], j[i < j]) if same else (i, j)


def _first_found(block: int, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Pairs of unit vectors whose first block within its budget is ``block``.

    This decides where a pair counts, with sums that don't depend on what else is
    looked at; the join's budget has one more slack, so that it finds the pair there.
    """
    width = x.shape[1]
    turned = np.einsum("ij,jk->ik", x - y, _rotation(width))
    inside = [(turned[:, p:q] ** 2).sum(1) <= budget for (p, q), budget in zip(_blocks(width), _budgets(width, cosine))]
    return inside[block] & ~np.any(inside[:block], axis=0) if block else inside[0]


def _links(vectors: DataFrame, folder: str, cosine: float, tile: int) -> DataFrame:
    """(a, n, b): links counted for representative ``a``, and one it is connected to."""

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(batch.column("vec").value_lengths().to_pylist(), np.int64)
            for width in np.unique(widths).tolist():
                rows = batch.take(pa.array(np.flatnonzero(widths == width)))
                flat = rows.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float)
                x, budgets = _rotated(_units(flat.reshape(len(rows), width))).astype("<f4"), _budgets(width, cosine)
                for k, (lo, hi) in enumerate(_blocks(width)):
                    cell = np.zeros((len(rows), GRID), np.int64)
                    used = min(GRID, hi - lo)
                    cell[:, :used] = np.floor(x[:, lo : lo + used] / np.sqrt(budgets[k] + 2 * _SLACK))
                    keys = [np.full(len(rows), width), np.full(len(rows), k), cell[:, 0], cell[:, 1]]
                    at = pa.array([r.tobytes() for r in np.ascontiguousarray(x[:, lo:hi])], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("rep"), rows.column("copies"), at, *map(pa.array, keys)],
                        ["rep", "copies", "at", "width", "block", "u", "v"],
                    )

    placed = vectors.mapInArrow(
        coordinates, "rep long, copies long, at binary, width long, block long, u long, v long"
    )
    cell = ["width", "block", "u", "v"]
    # a cell is a square of the unit ball's grid: their number depends on widths and cosine alone
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = stored(sizes, "vector-cells")
    tiled = placed.join(F.broadcast(sizes), cell).withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int"))
    member = F.sort_array(F.collect_list(F.struct("rep", "copies", "at")))
    tiles = stored(tiled.groupBy(*cell, "tile").agg(member.alias("rows")), "vector-tiles")

    steps = [s for s in itertools.product((-1, 0, 1), repeat=2) if s >= (0, 0)]
    moves = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a, b in steps])
    still = (F.col("step.du") == 0) & (F.col("step.dv") == 0)
    moved = (
        tiles.withColumn("step", F.explode(moves))
        .withColumn("u", F.col("u") + F.col("step.du"))
        .withColumn("v", F.col("v") + F.col("step.dv"))
        .join(F.broadcast(sizes), cell)
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .filter(~still | (F.col("other") >= F.col("tile")))
        .select(*cell, "other", (still & (F.col("other") == F.col("tile"))).alias("same"), F.col("rows").alias("mine"))
    )
    home = tiles.select(*cell, F.col("tile").alias("other"), F.col("rows").alias("theirs"))
    pairs = moved.join(home, [*cell, "other"]).select("width", "block", "same", "mine", "theirs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                width, block, same = (batch.column(c)[at].as_py() for c in ("width", "block", "same"))
                mine, theirs = batch.column("mine")[at].values, batch.column("theirs")[at].values
                yield _linked_rows(folder, width, block, mine, theirs, same, cosine)

    return pairs.mapInArrow(compare, "a long, n long, b long")


def _linked_rows(folder: str, width: int, block: int, mine: pa.Array, theirs: pa.Array, same: bool, cosine: float) -> pa.RecordBatch:
    side = lambda rows, name: rows.field(name).to_numpy(zero_copy_only=False)
    blocks, budgets = _blocks(width), _budgets(width, cosine)
    size = blocks[block][1] - blocks[block][0]
    at = lambda rows: np.frombuffer(b"".join(rows.field("at").to_pylist()), "<f4").reshape(len(rows), size).astype(float)
    reps = np.concatenate([side(mine, "rep"), side(theirs, "rep")])
    copies = np.concatenate([side(mine, "copies"), side(theirs, "copies")])
    n, m = len(reps), len(mine)
    counts, label = np.zeros(n, np.int64), np.arange(n)
    for left, right in _candidates(at(mine), at(theirs), same, budgets[block] + _SLACK):
        right = right if same else right + m
        for start in range(0, len(left), _PAIRS):
            i, j = left[start : start + _PAIRS], right[start : start + _PAIRS]
            asked, back = np.unique(np.concatenate([reps[i], reps[j]]), return_inverse=True)
            whole = _vectors(folder, asked, width)
            a, b = back[: len(i)], back[len(i) :]
            linked = np.einsum("ij,ij->i", whole[a], whole[b]) >= cosine
            i, j, a, b = i[linked], j[linked], a[linked], b[linked]
            first = _first_found(block, whole[a], whole[b], cosine)
            i, j = i[first], j[first]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            known = np.flatnonzero(label != np.arange(n))
            label = forest(np.concatenate([i, known]), np.concatenate([j, label[known]]), n)
    found = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(reps[found]), pa.array(counts[found]), pa.array(reps[label[found]])], ["a", "n", "b"]
    )


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", cosine: float = COSINE, tile: int = TILE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors are compared with those of the same width.  Null and zero vectors and
    those with null or non-finite components have no links and are their own
    component.  Equal vectors are compared once and counted as often as they
    occur.  Repeated keys stay repeated rows; a null key takes part, and its
    component is the least key in reach.  Other columns are ignored, and an empty
    table gives no rows.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("vec"))
    rows = rows.withColumn("valid", valid(F.col("vec")))
    good = rows.filter("valid").select("vec_id", "vec", F.xxhash64("vec").alias("hash"))
    grouped = good.groupBy("hash", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # numbers for representatives: keys may be null or repeated, a place in a file is neither
    folder = new_path(vectors.sparkSession, "vector-files")
    reps = stored(with_files(grouped, folder), "distinct-vectors")
    links = stored(_links(reps.select("rep", "copies", "vec"), folder, cosine, tile), "vector-links")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    rooted = reps.join(labels, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").join(counts, "rep", "left").select(
        "hash", "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    linked = good.join(named, ["hash", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
