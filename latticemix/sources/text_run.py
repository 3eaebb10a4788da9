"""The text layout of a run as a data source: one file per quantity and iteration.

    prob-<t>  items-<t>  epsilon<t>     the grid, a line per row of cells
    contCentroid<t>  binCentroid<t>     a line per cell

An iteration is one partition: a reading task opens its five files, and a writing
task makes them from the iteration's cells.  Files appear whole; an iteration
whose files are not all there fails the job.
"""

from __future__ import annotations

import json
import os
import re
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..constants import CENTROID_STEMS, GRID_STEMS
from ..files import names_in, read_bytes, write_file

FORMAT = "grid_text_run"
SCHEMA = (
    "iteration int, cell int, prob double, num_items double, bin_epsilon double, "
    "cont_mean array<double>, bin_mean array<int>"
)
_STEMS = {**GRID_STEMS, **CENTROID_STEMS}


def _lines(path: str, stem: str, t: int) -> list[list[str]]:
    text = read_bytes(f"{path}/{stem}{t}").decode()
    return [line.split(",") for line in text.splitlines() if line]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        pattern = re.compile(f"(?:{'|'.join(map(re.escape, _STEMS))})([0-9]+)")
        found = {int(m[1]) for m in map(pattern.fullmatch, names_in(self.path)) if m}
        return [InputPartition(t) for t in sorted(found)]

    def read(self, partition):
        t = partition.value
        values = {}
        for stem, name in GRID_STEMS.items():
            values[name] = [float(v) for line in _lines(self.path, stem, t) for v in line]
        for stem, name in CENTROID_STEMS.items():
            kind = float if name == "cont_mean" else int
            values[name] = [[kind(v) for v in line] for line in _lines(self.path, stem, t)]
        sizes = {name: len(v) for name, v in values.items()}
        if len(set(sizes.values())) != 1:
            raise ValueError(f"iteration {t} has unequal numbers of cells: {sizes}")
        names = [c.split()[0] for c in SCHEMA.split(", ")[2:]]
        for cell in range(sizes["prob"]):
            yield (t, cell, *(values[n][cell] for n in names))


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        for t, cells in groupby(rows, key=lambda r: r["iteration"]):
            cells = sorted(cells, key=lambda r: r["cell"])
            grid = [list(line) for _, line in groupby(cells, key=lambda r: r["row"])]
            for stem, name in GRID_STEMS.items():
                lines = (",".join(repr(float(c[name])) for c in line) + "\n" for line in grid)
                write_file(f"{self.path}/{stem}{t}", [line.encode() for line in lines])
            for stem, name in CENTROID_STEMS.items():
                lines = (",".join(map(repr, c[name])) + "\n" for c in cells)
                write_file(f"{self.path}/{stem}{t}", [line.encode() for line in lines])
        return WriterCommitMessage()

    def commit(self, messages):
        write_file(f"{self.path}/_SUCCESS", [json.dumps({"tasks": len(messages)}).encode()])


class GridTextRun(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def read_text_run(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, cell, prob, num_items, bin_epsilon, cont_mean, bin_mean) of every iteration in a folder."""
    spark.dataSource.register(GridTextRun)
    return spark.read.format(FORMAT).load(path)


def write_text_run(cells: DataFrame, path: str) -> None:
    """Write ``read_cells`` rows in the text layout; the folder must not exist."""
    if names_in(path):
        raise ValueError(f"{path} exists already")
    spark = cells.sparkSession
    spark.dataSource.register(GridTextRun)
    keep = ["iteration", "row", *(c.split()[0] for c in SCHEMA.split(", ")[1:])]
    dealt = cells.select(*keep).repartition("iteration").sortWithinPartitions("iteration", "cell")
    dealt.write.format(FORMAT).mode("append").save(path)
