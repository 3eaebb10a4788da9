"""Files and tables that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import map_file, read_bytes, write_file  # noqa: F401  for the operators
from ..session import new_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The rows are computed once, the lineage ends at the files, and a lost
    executor costs no more than a rerun of its unfinished tasks.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a stored table with one more column, a number for each row, and that column's name."""
    row = "__row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    # the numbers hold once they are stored
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


# Bits of ``monotonically_increasing_id`` that count within a partition (fixed by Spark).
_ROW_BITS = 33


def without_rows(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``rows`` of ``numbered`` but for the numbers in ``dropped`` (one column, ``row``), and without their numbers.

    The numbers go to a sorted file for each partition that was numbered, and
    tasks map the files of the rows they read: texts are not shuffled.
    """
    folder = new_path(rows.sparkSession, "dropped-rows")
    name = lambda part: f"{folder}/part-{part}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def put() -> pa.RecordBatch:
            write_file(name(part), [np.concatenate(held).astype("<i8").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([part])], ["part"])

        for batch in batches:
            parts, numbers = (batch.column(i).to_numpy() for i in (0, 1))
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if a < b and parts[a] != part:
                    if held:
                        yield put()
                    part, held = int(parts[a]), []
                held.append(numbers[a:b])
        if held:
            yield put()

    placed = dropped.select(F.shiftrightunsigned(row, _ROW_BITS).alias("part"), F.col(row).alias("number"))
    dealt = placed.repartition("part").sortWithinPartitions("part", "number")
    written = frozenset(r.part for r in dealt.mapInArrow(write, "part long").collect())  # one per part
    at = rows.columns.index(row)
    kept = [i for i in range(len(rows.columns)) if i != at]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column(at).to_numpy()
            stay = np.ones(len(numbers), bool)
            for part in np.unique(numbers >> _ROW_BITS).tolist():
                if part in written:
                    if part not in opened:
                        opened = {part: map_file(name(part), "<i8")}
                    gone = opened[part]
                    place = np.minimum(np.searchsorted(gone, numbers), len(gone) - 1)
                    stay &= gone[place] != numbers
            yield batch.select(kept).filter(pa.array(stay))

    return rows.mapInArrow(keep, rows.drop(row).schema)


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, others for the letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
