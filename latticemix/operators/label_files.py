"""Labelled rows as column files in the shared folder, and distances from every row to whole clusters.

Rows are ranged by label and written once: per part the vectors (memory-mapped by
the readers), the ids, and the runs of equal labels, each long one in the order of
a tree of boxes (``distance_tree``) that is written with it.  A second, small set of
files holds every cluster's centre, size and runs.  Tasks take ranges of rows as targets
and read only the clusters they need, so the shuffle carries each row once however
many rows it is compared with.

The mean distance from a row to a cluster is never below its distance to the
cluster's centre (the norm is convex).  The nearest other cluster by mean distance
is therefore found exactly without the clusters whose centre is farther off than
the best mean so far.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BLOCK_BYTES, TASKS_PER_CORE
from ..files import map_file, read_bytes, write_file
from ..session import materialize, new_path
from . import distance_tree as D
from .posterior import matrix, squared_distances

# Distances per numpy call, sized for a core's cache.
CHUNK_DISTANCES = 1 << 16
# Up to this width distances are summed from differences.
NARROW = 8
# Wider ones come from a matrix product, except where that would cancel.
CLOSE = 1e-4
# Targets taken at once, and distances to centres held for them.
TARGET_ROWS = 1 << 15
TARGET_VALUES = 4_000_000
# Parts of a cluster's run whose means bound its mean distance.
PIECES = 32
# Source rows streamed at a time.
SOURCE_ROWS = 4096
# A centre this much farther than the best mean is out of reach, whatever the rounding.
MARGIN = 1e-9


def one_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def vectors(column) -> np.ndarray:
    """Arrow list column as n x width, the width being that of the first row."""
    column = one_array(column)
    width = len(column[0]) if len(column) and column[0].is_valid else 0
    return matrix(column, width).astype(float, copy=False)


def distance_chunks(a: np.ndarray, b: np.ndarray):
    """(slice of a, its Euclidean distances to all of b), a few rows at a time."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("every vector needs the same width")
    if a.shape[1] <= NARROW and len(a) and len(b):  # axes on which all agree add nothing
        differ = ~((a == a[0]).all(axis=0) & (b == a[0]).all(axis=0) & np.isfinite(a[0]))
        a, b = a[:, differ], b[:, differ]
    elif len(b):  # the matrix product cancels less around the block's mean
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
    b_t = np.ascontiguousarray(b.T)
    norm = np.square(b).sum(axis=1)
    step = max(1, CHUNK_DISTANCES // max(1, len(b)))
    for start in range(0, len(a), step):
        part = slice(start, min(start + step, len(a)))
        if a.shape[1] <= NARROW:
            sq = squared_distances(a[part], b_t)
        else:
            scale = np.square(a[part]).sum(axis=1)[:, None] + norm
            sq = scale - 2 * (a[part] @ b_t)
            i, j = np.nonzero(sq < CLOSE * scale)
            few = max(1, CHUNK_DISTANCES // a.shape[1])
            for at in range(0, len(i), few):
                p, q = i[at : at + few], j[at : at + few]
                sq[p, q] = np.square(a[part][p] - b[q]).sum(axis=1)
        yield part, np.sqrt(sq, out=sq)


def ipc_bytes(columns: dict) -> bytes:
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def ipc_table(uri: str) -> pa.Table:
    return pa.ipc.open_file(read_bytes(uri)).read_all()


@dataclass(frozen=True)
class LabelFiles:
    """Where the files are: rows per part of the rows, clusters per part of the clusters."""

    folder: str
    width: int
    rows: tuple[int, ...]
    clusters: tuple[int, ...]
    id_type: str
    label_type: str

    def ranges(self, most: int) -> list[tuple[int, int, int]]:
        """(part, first row, end) of at most ``most`` targets each."""
        return [(p, i, min(i + most, n)) for p, n in enumerate(self.rows) for i in range(0, n, most)]


def _trees(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, D.Boxes, np.ndarray]:
    """An order of the rows within their runs, the boxes of all runs, and each run's first box.

    Runs that no grid would serve have no boxes (-1).
    """
    order, roots = np.arange(len(x)), np.full(len(starts), -1)
    found, n, n_weights = [], 0, 0
    for run in np.flatnonzero(sizes > D.LEAF_ROWS).tolist() if x.shape[1] else ():
        start, end = int(starts[run]), int(starts[run] + sizes[run])
        own, boxes = D.build(x[start:end])
        if not len(boxes.weights):
            continue
        order[start:end] = start + own
        boxes.spans[:, :2] += start
        boxes.spans[:, 2] += np.where(boxes.spans[:, 2] > 0, n, 0)
        boxes.spans[:, 3] += np.where(boxes.spans[:, 3] >= 0, n_weights, 0)
        roots[run] = n
        found.append(boxes)
        n, n_weights = n + len(boxes.lo), n_weights + len(boxes.weights)
    if not found:
        empty = np.empty((0, x.shape[1]))
        return order, D.Boxes(empty, empty, np.empty((0, 4), np.int64), np.empty(0)), roots
    joined = (np.concatenate([getattr(b, name) for b in found]) for name in ("lo", "hi", "spans", "weights"))
    return order, D.Boxes(*joined), roots


def write_label_files(labelled: DataFrame, profile) -> LabelFiles:
    """Write the rows of ``labelled`` (id, x, label; checked) by label, and its clusters.

    ``profile(width)`` gives the (label, n, center) table.  Vectors of unequal
    widths fail the job.
    """
    spark, folder = labelled.sparkSession, new_path(labelled.sparkSession, "label-files")
    kinds = {f.name: f.dataType.simpleString() for f in labelled.schema}
    size = labelled.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    if not size.n:
        return LabelFiles(folder, 0, (), (), kinds["id"], kinds["label"])
    width = size.width or 0
    parts = max(1, -(-size.n * 8 * (width + 2) // BLOCK_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        labels = one_array(rows["label"])
        x = np.ascontiguousarray(matrix(one_array(rows["x"]), width), float)
        codes = labels.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        sizes = np.diff(starts, append=len(codes))
        order, trees, roots = _trees(x, starts, sizes)
        write_file(f"{folder}/x-{part}", [x[order].tobytes()])
        for name, values in (("lo", trees.lo), ("hi", trees.hi), ("spans", trees.spans), ("weights", trees.weights)):
            write_file(f"{folder}/{name}-{part}", [values.tobytes()])
        write_file(f"{folder}/ids-{part}", [ipc_bytes({"id": rows["id"].take(pa.array(order)), "label": labels})])
        yield pa.RecordBatch.from_arrays(
            [labels.take(pa.array(starts)), pa.array(np.full(len(starts), part)), *(pa.array(c) for c in (starts, sizes, roots))],
            ["label", "part", "start", "n", "root"],
        )

    # by vectors within a label: the boxes of its parts lie side by side
    place = ["label", "x", F.xxhash64("id")]
    dealt = labelled.select("id", "label", "x").repartitionByRange(parts, *place)
    schema = f"label {kinds['label']}, part long, start long, n long, root long"
    runs = materialize(dealt.sortWithinPartitions(*place).mapInArrow(write, schema))
    # rows per part: an entry for every ``BLOCK_BYTES`` of rows
    counted = dict(runs.groupBy("part").agg(F.sum("n").alias("n")).collect())
    rows = tuple(counted.get(p, 0) for p in range(max(counted) + 1))

    grouped = runs.groupBy("label").agg(F.collect_list(F.struct("part", "start", "n", "root")).alias("runs"))
    clusters = profile(width).join(grouped, "label")

    def write_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part, rows = TaskContext.get().partitionId(), pa.Table.from_batches(held).combine_chunks()
        write_file(f"{folder}/centers-{part}", [np.ascontiguousarray(matrix(one_array(rows["center"]), width), float).tobytes()])
        write_file(f"{folder}/clusters-{part}", [ipc_bytes({c: rows[c] for c in ("label", "n", "runs")})])
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([rows.num_rows])], ["part", "n"])

    n_labels = runs.select("label").distinct().count()
    cluster_parts = max(1, -(-n_labels * 8 * (width + 8) // BLOCK_BYTES))
    made = clusters.repartitionByRange(cluster_parts, "label").mapInArrow(write_clusters, "part long, n long")
    told = dict(made.collect())  # an entry for every ``BLOCK_BYTES`` of clusters
    made_rows = tuple(told.get(p, 0) for p in range(max(told) + 1))
    return LabelFiles(folder, width, rows, made_rows, kinds["id"], kinds["label"])


def _blocks(rows: np.ndarray, ranges: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """The rows in some ranges, about ``SOURCE_ROWS`` at a time."""
    held, n = [], 0
    for start, end in ranges:
        for i in range(start, end, SOURCE_ROWS):
            held.append(rows[i : min(i + SOURCE_ROWS, end)])
            n += len(held[-1])
            if n >= SOURCE_ROWS:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _measured(x: np.ndarray, points: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Summed distances, one by one."""
    total = np.zeros(len(x))
    for part, dist in distance_chunks(x, points):
        total[part] += dist.sum(axis=1) if weights is None else dist @ weights
    return total


class _Reader:
    """The files of one task, mapped as they are needed."""

    def __init__(self, files: LabelFiles):
        self.files = files
        self.x = functools.lru_cache(maxsize=64)(self._x)
        self.boxes = functools.lru_cache(maxsize=64)(self._boxes)
        self.pieces = functools.lru_cache(maxsize=1024)(self._pieces)
        self._last = None
        tables = [ipc_table(f"{files.folder}/clusters-{p}") for p, n in enumerate(files.clusters) if n]
        self.clusters = pa.concat_tables(tables).combine_chunks()
        self.sizes = self.clusters["n"].to_numpy()
        centers = [map_file(f"{files.folder}/centers-{p}", float).reshape(-1, files.width) for p, n in enumerate(files.clusters) if n]
        self.centers = centers if files.width else [np.zeros((len(self.sizes), 0))]

    def _x(self, part: int) -> np.ndarray:
        if not self.files.width:
            return np.zeros((self.files.rows[part], 0))
        return np.asarray(map_file(f"{self.files.folder}/x-{part}", float)).reshape(-1, self.files.width)

    def _boxes(self, part: int) -> D.Boxes:
        lo, hi, spans, weights = (
            map_file(f"{self.files.folder}/{name}-{part}", kind)
            for name, kind in (("lo", float), ("hi", float), ("spans", np.int64), ("weights", float))
        )
        # plain views of the mapped files, which are quicker to index
        shaped = lo.reshape(-1, self.files.width), hi.reshape(-1, self.files.width), spans.reshape(-1, 4), weights
        return D.Boxes(*(np.asarray(a) for a in shaped))

    def targets(self, part: int, start: int, stop: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, cluster numbers and vectors of some rows."""
        table = ipc_table(f"{self.files.folder}/ids-{part}").slice(start, stop - start)
        labels = one_array(table["label"])
        code = pc.index_in(labels, value_set=one_array(self.clusters["label"])).to_numpy(zero_copy_only=False)
        return one_array(table["id"]), code.astype(np.int64), np.asarray(self.x(part)[start:stop])

    def center_distances(self, x: np.ndarray) -> np.ndarray:
        out, at = np.empty((len(x), len(self.sizes))), 0
        for centers in self.centers:
            for i in range(0, len(centers), SOURCE_ROWS):
                block = np.asarray(centers[i : i + SOURCE_ROWS])
                for part, dist in distance_chunks(x, block):
                    out[part, at : at + len(block)] = dist
                at += len(block)
        return out

    def _tree(self, x: np.ndarray) -> D.Targets:
        """The boxes of a block of targets; those of the last block are kept."""
        if self._last is None or self._last[0] is not x:
            self._last = x, D.Targets(x)
        return self._last[1]

    def sums(self, x: np.ndarray, cluster: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Summed distances from each row of ``x`` (0 where not ``wanted``) to all rows of a cluster."""
        total = np.zeros(len(x))
        some = slice(None) if wanted is None else np.flatnonzero(wanted)
        for run in self.clusters["runs"][cluster].as_py():
            rows = self.x(run["part"])
            if run["root"] < 0:
                part = x[some]
                for block in _blocks(rows, [(run["start"], run["start"] + run["n"])]):
                    total[some] += _measured(part, block)
                continue
            total += self._tree(x).sums(self.boxes(run["part"]), run["root"], functools.partial(_blocks, rows), _measured, wanted)
        return total

    def own_sums(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for c in np.unique(code).tolist():
            mine = code == c
            out[mine] = self.sums(x, c, mine)[mine]
        return out

    def _pieces(self, cluster: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Means of parts of a cluster and their shares of its rows; none where some rows are in no grid."""
        runs = self.clusters["runs"][cluster].as_py()
        found = [D.pieces(self.boxes(r["part"]), r["root"], PIECES) if r["root"] >= 0 else None for r in runs]
        if any(f is None for f in found):
            return None
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]) / self.sizes[cluster]

    def nearest_means(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least mean distance to another cluster (infinite without one), and the clusters looked through."""
        bound = self.center_distances(x)
        bound[np.arange(len(x)), code] = np.inf
        best, looked = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        if len(self.sizes) < 2:
            return best, looked

        def look(wanted: np.ndarray, c: int) -> None:
            sums = self.sums(x, c, wanted)
            best[wanted] = np.fmin(best[wanted], sums[wanted] / self.sizes[c])
            bound[wanted, c] = np.inf
            looked[wanted] += 1

        first = bound.argmin(axis=1)
        for c in np.unique(first).tolist():
            look(first == c, c)
        for c in np.argsort(bound.min(axis=0, initial=np.inf), kind="stable").tolist():
            rows = np.flatnonzero(bound[:, c] < best * (1 + MARGIN))
            parts = self.pieces(c) if len(rows) else None
            if parts is not None:
                rows = rows[~(_measured(x[rows], *parts) >= best[rows] * (1 + MARGIN))]
            if len(rows):
                wanted = np.zeros(len(x), bool)
                wanted[rows] = True
                look(wanted, c)
        return best, looked


def _tasks(spark, files: LabelFiles, most: int) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism
    ranges = files.ranges(most)
    n = max(1, min(len(ranges), TASKS_PER_CORE * cores))
    rows = [(i % n, *r) for i, r in enumerate(ranges)]
    return spark.createDataFrame(rows, "task int, part long, start long, stop long").repartitionById(n, F.col("task"))


def _batches(reader: _Reader, batches, rows_at_once: int):
    for batch in batches:
        for part, start, stop in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "stop"))):
            for i in range(start, stop, rows_at_once):
                yield reader.targets(part, i, min(i + rows_at_once, stop))


def over_targets(spark, files: LabelFiles, measure, schema: str, target_rows: int | None = None) -> DataFrame:
    """Run ``measure(reader, ids, code, x)`` on blocks of targets; it yields record batches."""
    if not sum(files.rows):
        return spark.createDataFrame([], schema)
    cores = spark.sparkContext.defaultParallelism
    most = target_rows or max(1, min(TARGET_ROWS, -(-sum(files.rows) // (2 * cores))))
    at_once = max(1, min(most, TARGET_VALUES // max(1, sum(files.clusters))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or _Reader(files)
            for ids, code, x in _batches(reader, [batch], at_once):
                yield from measure(reader, ids, code, x)

    return _tasks(spark, files, most).mapInArrow(run, schema)
