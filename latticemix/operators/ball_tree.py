"""The largest (S_i + S_j) / distance of every cluster, by a tree of balls around the centres.

Clusters are sorted along a space-filling curve and written once as files.  A leaf
is a short stretch of them, with the ball that holds its centres and its largest
scatter; so has every file.  For a cluster i no member of a ball can exceed
(S_i + largest S) / (distance to the ball), so balls whose bound is not above the
best found so far are passed over, and the maximum stays exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BLOCK_BYTES, TASKS_PER_CORE
from ..files import map_file, read_bytes, write_file
from ..session import materialize, new_path
from .label_files import distance_chunks, ipc_bytes, ipc_table, one_array
from .partials import add_up
from .posterior import matrix

LEAF_ROWS = 128
# Coordinates that the curve runs through, and its bits of each.
CURVE_AXES, CURVE_BITS = 4, 10
# A ball is taken this much nearer than it is, whatever the rounding.
MARGIN = 1e-9


def _curve(x: np.ndarray, axes: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Places on the curve: the leading bits of the coordinates in turn."""
    unit = np.clip((x[:, axes] - middle[axes]) / (6 * np.where(spread[axes] > 0, spread[axes], 1)) + 0.5, 0, 1)
    steps = np.minimum(unit * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1).astype(np.int64)
    key = np.zeros(len(x), np.int64)
    for bit in range(CURVE_BITS - 1, -1, -1):
        for axis in range(steps.shape[1]):
            key = key << 1 | steps[:, axis] >> bit & 1
    return key


def _balls(x: np.ndarray, scatter: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle, radius and largest scatter of each stretch."""
    sizes = np.diff(np.append(starts, len(x)))
    middle = np.add.reduceat(x, starts, axis=0) / sizes[:, None]
    off = np.sqrt(np.square(x - np.repeat(middle, sizes, axis=0)).sum(axis=1))
    return middle, np.maximum.reduceat(off, starts), np.maximum.reduceat(scatter, starts)


@dataclass(frozen=True)
class Tree:
    """Where the files are, and each file's ball; ``rows`` per file."""

    folder: str
    width: int
    leaf: int
    rows: tuple[int, ...]
    middle: np.ndarray
    radius: np.ndarray
    most: np.ndarray


def write_tree(scatters: DataFrame, leaf: int = LEAF_ROWS) -> Tree | None:
    """Files of the (label, scatter, center) rows; none for an empty table.  Keep ``scatters`` stored."""
    spark, folder = scatters.sparkSession, new_path(scatters.sparkSession, "ball-tree")
    kind = scatters.schema["label"].dataType.simpleString()
    size = scatters.agg(F.count("*").alias("n"), F.max(F.size("center")).alias("width")).first()
    if not size.n:
        return None
    n, width = size.n, size.width or 0
    centers = lambda batch: matrix(one_array(batch.column("center")), width).astype(float)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = centers(batch)
                found = np.stack([x.sum(axis=0), np.square(x).sum(axis=0)])
                total = found if total is None else total + found
        return total

    first, second = add_up(scatters.select("center"), moments, 1 + n * 8 * (width + 2) // BLOCK_BYTES) / n
    spread = np.sqrt(np.maximum(second - first**2, 0))
    axes = np.argsort(-spread, kind="stable")[:CURVE_AXES]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = pa.array(_curve(centers(batch), axes, first, spread))
                yield pa.RecordBatch.from_arrays([*batch.columns, key], [*batch.schema.names, "curve"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part, rows = TaskContext.get().partitionId(), pa.Table.from_batches(held).combine_chunks()
        x, scatter = centers(rows), rows["scatter"].to_numpy()
        starts = np.arange(0, len(x), leaf)
        middle, radius, most = _balls(x, scatter, starts)
        for name, values in (("x", x), ("scatter", scatter), ("middle", middle), ("radius", radius), ("most", most)):
            write_file(f"{folder}/{name}-{part}", [np.ascontiguousarray(values, float).tobytes()])
        write_file(f"{folder}/labels-{part}", [ipc_bytes({"label": rows["label"]})])
        whole = _balls(x, scatter, np.zeros(1, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([len(x)]), pa.array([whole[0][0].tobytes()]), pa.array(whole[1]), pa.array(whole[2])],
            ["part", "n", "middle", "radius", "most"],
        )

    keyed = scatters.select("label", "scatter", "center").mapInArrow(
        place, f"label {kind}, scatter double, center array<double>, curve long"
    )
    parts = max(1, -(-n * 8 * (width + 4) // BLOCK_BYTES))
    dealt = keyed.repartitionByRange(parts, "curve", "label").sortWithinPartitions("curve", "label")
    made = dealt.mapInArrow(write, "part long, n long, middle binary, radius double, most double")
    found = sorted(made.collect(), key=lambda r: r.part)  # a ball for every ``BLOCK_BYTES`` of clusters
    rows = [0] * (found[-1].part + 1)
    for r in found:
        rows[r.part] = r.n
    middle = np.array([np.frombuffer(r.middle) for r in found]).reshape(len(found), width)
    return Tree(folder, width, leaf, tuple(rows), middle, *(np.array([r[c] for r in found]) for c in ("radius", "most")))


class _Files:
    def __init__(self, tree: Tree):
        self.tree = tree
        self.parts = [p for p, n in enumerate(tree.rows) if n]
        self.array = functools.lru_cache(maxsize=320)(self._array)

    def _array(self, name: str, part: int) -> np.ndarray:
        values = map_file(f"{self.tree.folder}/{name}-{part}", float) if self.tree.width or name not in ("x", "middle") else np.empty(0)
        return values.reshape(-1, self.tree.width) if self.tree.width and name in ("x", "middle") else values

    def rows(self, part: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.tree.width:
            return np.zeros((stop - start, 0)), np.asarray(self.array("scatter", part)[start:stop])
        return np.asarray(self.array("x", part)[start:stop]), np.asarray(self.array("scatter", part)[start:stop])

    @staticmethod
    def bounds(x: np.ndarray, scatter: np.ndarray, middle: np.ndarray, radius: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What no member of each ball exceeds; infinite for balls that may hold the centre itself."""
        out = np.empty((len(x), len(radius)))
        for rows, dist in distance_chunks(x, middle):
            near = dist * (1 - MARGIN) - radius * (1 + MARGIN)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[rows] = np.where(near > 0, (scatter[rows, None] + most) / near, np.inf)
        return out * (1 + MARGIN)

    def largest(self, part: int, start: int, stop: int) -> tuple[np.ndarray, int]:
        """The largest ratio of each row of a stretch to another row, and the pairs looked at."""
        x, scatter = self.rows(part, start, stop)
        best, pairs = np.full(len(x), -np.inf), 0
        tree = self.tree
        above = lambda bound: (bound > best) | np.isinf(bound)
        files = self.bounds(x, scatter, tree.middle, tree.radius, tree.most)
        own = self.parts.index(part)
        for f in [own, *(i for i in np.argsort(-files.max(axis=0), kind="stable").tolist() if i != own)]:
            if not above(files[:, f]).any():
                continue
            other = self.parts[f]
            middle = np.asarray(self.array("middle", other)) if tree.width else np.zeros((len(self.array("radius", other)), 0))
            leaves = self.bounds(x, scatter, middle, np.asarray(self.array("radius", other)), np.asarray(self.array("most", other)))
            for leaf in np.argsort(-leaves.max(axis=0), kind="stable").tolist():
                rows = np.flatnonzero(above(leaves[:, leaf]))
                if not len(rows):
                    continue
                first = leaf * tree.leaf
                y, others = self.rows(other, first, min(first + tree.leaf, tree.rows[other]))
                pairs += len(rows) * len(y)
                for chunk, dist in distance_chunks(x[rows], y):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ratio = (scatter[rows][chunk][:, None] + others) / dist
                    if other == part:  # a row is not compared with itself
                        at = start + rows[chunk] - first
                        inside = np.flatnonzero((at >= 0) & (at < len(y)))
                        ratio[inside, at[inside]] = -np.inf
                    best[rows[chunk]] = np.maximum(best[rows[chunk]], ratio.max(axis=1))
        return best, pairs


def largest_ratios(scatters: DataFrame, leaf: int = LEAF_ROWS) -> DataFrame:
    """(label, similarity, pairs): the largest ratio of every cluster; -infinity without another, NaN for 0/0.

    ``pairs`` is the number of pairs looked at for the cluster's stretch, on the
    first row of the stretch.
    """
    spark = scatters.sparkSession
    kind = scatters.schema["label"].dataType.simpleString()
    schema = f"label {kind}, similarity double, pairs bigint"
    tree = write_tree(materialize(scatters), leaf)
    if tree is None:
        return spark.createDataFrame([], schema)
    stretches = [(p, i, min(i + leaf, n)) for p, n in enumerate(tree.rows) for i in range(0, n, leaf)]
    n_tasks = max(1, min(len(stretches), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    per = -(-len(stretches) // n_tasks)  # neighbours on the curve share a task and its open files
    tasks = [(i // per, *s) for i, s in enumerate(stretches)]
    dealt = spark.createDataFrame(tasks, "task int, part long, start long, stop long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, labels = None, functools.lru_cache(maxsize=4)(lambda part: one_array(ipc_table(f"{tree.folder}/labels-{part}")["label"]))
        for batch in batches:
            files = files or _Files(tree)
            for part, start, stop in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "stop"))):
                best, pairs = files.largest(part, start, stop)
                counted = np.zeros(len(best), np.int64)
                counted[0] = pairs
                yield pa.RecordBatch.from_arrays(
                    [labels(part).slice(start, stop - start), pa.array(best), pa.array(counted)], ["label", "similarity", "pairs"]
                )

    return dealt.repartitionById(tasks[-1][0] + 1, F.col("task")).mapInArrow(run, schema)
