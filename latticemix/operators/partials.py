"""Sums over all rows as one packed array per task, added up over a tree of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Arrays that reach the driver, or the last task.
FAN_IN = 32
_PACKED = "shape array<long>, sums binary"
Partial = Callable[[Iterator[pa.RecordBatch]], "np.ndarray | None"]


def _pack(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        shape = pa.array([list(total.shape)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([shape, pa.array([total.tobytes()], pa.binary())], ["shape", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """The sum of packed arrays, one of which is held beside it."""
    total = None
    for batch in batches:
        for shape, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            one = np.frombuffer(data.as_buffer()).reshape(shape)
            total = one.copy() if total is None else np.add(total, one, out=total)
    return total


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _pack(_merged(batches))


def _partials(rows: DataFrame, partial: Partial) -> DataFrame:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack(partial(batches))

    return rows.mapInArrow(reduce, _PACKED)


def add_up(rows: DataFrame, partial: Partial, partitions: int) -> np.ndarray | None:
    """The sum of ``partial`` (an array of doubles, one shape for all) over the partitions of ``rows``.

    A partition gives one array, or none if it has no rows.  Beyond ``FAN_IN``
    partitions, about the square root of their number of tasks merges them, until
    ``FAN_IN`` are left for the driver.
    """
    parts = _partials(rows, partial)
    while partitions > FAN_IN:
        partitions = max(FAN_IN, int(partitions**0.5))
        parts = parts.repartition(partitions).mapInArrow(_merge, _PACKED)
    total = None
    for row in parts.collect():  # at most FAN_IN arrays
        one = np.frombuffer(row.sums).reshape(row.shape)
        total = one if total is None else total + one
    return total


def rows_from_sums(rows: DataFrame, partial: Partial, finish: Callable[[np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """The rows that ``finish`` makes of the sum of ``partial``; none where there are no rows.  Not run until asked for."""

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _merged(batches)
        if total is not None:
            yield finish(total)

    dealt = _partials(rows, partial).withColumn("slot", F.spark_partition_id() % FAN_IN).repartition("slot")
    return dealt.drop("slot").mapInArrow(_merge, _PACKED).repartition(1).mapInArrow(end, schema)
