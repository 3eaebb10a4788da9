"""The stored run: cells, labels and index values as partitioned tables.

    <path>/settings               one JSON row
    <path>/labels/iteration=t     id, coordinates, cell
    <path>/cells/iteration=t      K rows
    <path>/indices                kind, name, value (appended)

An iteration counts once its cells are completely written (Spark's ``_SUCCESS``
file), and its labels are written before them.  Iterations are only ever added;
writing one that exists fails, but for what an interrupted run left unfinished.
The text layout of one file per quantity and iteration can be read as well.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import CELL_SCHEMA, CellModel
from ..constants import CENTROID_STEMS, EXTERNAL_REPORT, GRID_STEMS, INTERNAL_REPORT, LABEL_STEM
from ..functions.vectors import with_width

STORED_CELLS = T.StructType([*CELL_SCHEMA, T.StructField("iteration", T.IntegerType())])
INDEX_SCHEMA = "kind string, name string, value double"


def cells_dataframe(spark: SparkSession, tables: list[tuple[int, CellModel]]) -> DataFrame:
    """Cells of several iterations (K rows each) as one DataFrame."""
    rows = [(*row, t) for t, model in tables for row in model.to_rows()]
    return spark.createDataFrame(rows, STORED_CELLS)


def write_cells(
    spark: SparkSession, path: str, iteration: int, model: CellModel, mode: str = "errorifexists"
) -> None:
    model.to_dataframe(spark).write.mode(mode).parquet(
        f"{path}/cells/iteration={iteration}"
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, cell, ...); an iteration filter prunes partitions."""
    return spark.read.schema(STORED_CELLS).parquet(f"{path}/cells")


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Names that match a path pattern in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found or []]


def committed_iterations(spark: SparkSession, path: str) -> list[int]:
    """Iterations whose cells are completely written, in order."""
    done = _glob(spark, f"{path}/cells/iteration=*/_SUCCESS")
    return sorted(int(name.split("iteration=")[-1].split("/")[0]) for name in done)


def labelled_iterations(spark: SparkSession, path: str) -> list[int]:
    """Committed iterations that have labels, in order."""
    found = _glob(spark, f"{path}/labels/iteration=*")
    stored = {int(name.rstrip("/").split("iteration=")[-1]) for name in found}
    return [t for t in committed_iterations(spark, path) if t in stored]


def read_model(spark: SparkSession, path: str, iteration: int) -> CellModel:
    one = spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells/iteration={iteration}")
    return CellModel.from_dataframe(one)


def last_iteration(spark: SparkSession, path: str) -> tuple[int, CellModel] | None:
    """The last committed iteration and its cells; None for a run without any."""
    done = committed_iterations(spark, path)
    return (done[-1], read_model(spark, path, done[-1])) if done else None


def write_settings(spark: SparkSession, path: str, settings: dict) -> None:
    row = [(json.dumps(settings, sort_keys=True),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def read_settings(spark: SparkSession, path: str) -> dict | None:
    if not _glob(spark, f"{path}/settings/_SUCCESS"):
        return None
    return json.loads(spark.read.text(f"{path}/settings").first().value)


def write_labels(
    labelled: DataFrame, path: str, iteration: int, mode: str = "errorifexists"
) -> None:
    """Rows with ``cell``; written by the tasks that computed them."""
    keep = [c for c in ("id", "x", "cell") if c in labelled.columns]
    labelled.select(*keep).write.mode(mode).parquet(
        f"{path}/labels/iteration={iteration}"
    )


def read_labels(spark: SparkSession, path: str, iteration: int | None = None) -> DataFrame:
    labels = spark.read.parquet(f"{path}/labels")
    return labels if iteration is None else labels.filter(F.col("iteration") == iteration)


def write_labels_csv(labelled: DataFrame, path: str, width: int, delimiter: str = ",") -> None:
    """id, one column per coordinate, cell, as delimited text."""
    with_width(labelled, x=width).select(
        "id", *[F.col("x")[j].alias(f"x{j}") for j in range(width)], "cell"
    ).write.mode("errorifexists").option("sep", delimiter).option("header", True).csv(path)


def cell_grid(cells: DataFrame, column: str, cols: int) -> DataFrame:
    """One row per iteration and grid row, one column per grid column."""
    return (
        cells.groupBy("iteration", "row")
        .pivot("col", list(range(cols)))
        .agg(F.first(column))
        .select(
            "iteration", "row", *[F.col(f"`{c}`").alias(f"c{c}") for c in range(cols)]
        )
    )


def write_cell_grid(cells: DataFrame, column: str, cols: int, path: str) -> None:
    """The grid of one quantity as text: partitioned by iteration, a line per row."""
    grid = cell_grid(cells, column, cols).repartition(1)  # K rows per iteration
    grid.sortWithinPartitions("iteration", "row").write.mode("errorifexists").partitionBy(
        "iteration"
    ).csv(path)


def trajectory_sample(
    cells: DataFrame, every: int, remainder: int = 0, digits: int = 6
) -> DataFrame:
    """Every n-th iteration, epsilons rounded for display."""
    return cells.filter(F.col("iteration") % every == remainder).withColumn(
        "bin_epsilon", F.round("bin_epsilon", digits)
    )


# -- index values ---------------------------------------------------------------


def index_rows(internal: DataFrame | None, external: DataFrame | None) -> DataFrame:
    """(kind, name, value) of the reported indices from one-row index tables."""
    wanted = []
    if internal is not None:
        wanted.append(("internal", internal, dict(zip(INTERNAL_REPORT, ("silhouette", "davies_bouldin")))))
    if external is not None:
        columns = ("czekanowski_dice", "fowlkes_mallows", "nmi", "precision", "recall", "rand")
        wanted.append(("external", external, dict(zip(EXTERNAL_REPORT, columns))))
    parts = []
    for kind, table, names in wanted:
        pairs = [
            F.struct(F.lit(name).alias("name"), F.col(column).alias("value"))
            for name, column in names.items()
            if column in table.columns
        ]
        parts.append(
            table.select(F.lit(kind).alias("kind"), F.inline(F.array(*pairs)))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_indices(values: DataFrame, path: str) -> None:
    """Append (kind, name, value) rows."""
    values.select("kind", "name", "value").coalesce(1).write.mode("append").parquet(
        f"{path}/indices"
    )


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/indices")


def index_lines(values: DataFrame) -> DataFrame:
    """``Name: value`` lines."""
    return values.select(F.concat_ws(": ", "name", F.col("value").cast("string")).alias("value"))


# -- text layout ------------------------------------------------------------------


def _text_lines(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """(iteration, line, tokens) of every file ``<stem><iteration>``."""
    from .delimited import read_delimited

    lines = read_delimited(spark, f"{path}/{stem}*", ",", file_name=True, line_in_file=True)
    number = F.regexp_extract("file_name", "([0-9]+)$", 1).cast("int")
    return lines.select(number.alias("iteration"), F.col("line").cast("int"), "tokens")


def read_text_cells(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """(iteration, cell, prob, num_items, bin_epsilon, cont_mean, bin_mean)."""
    out = None
    for stem, name in GRID_STEMS.items():
        part = _text_lines(spark, path, stem).select(
            "iteration", "line", F.posexplode("tokens").alias("col", "v")
        )
        part = part.select(
            "iteration",
            (F.col("line") * cols + F.col("col")).alias("cell"),
            F.col("v").cast("double").alias(name),
        )
        out = part if out is None else out.join(part, ["iteration", "cell"])
    for stem, name in CENTROID_STEMS.items():
        kind = "array<double>" if name == "cont_mean" else "array<int>"
        part = _text_lines(spark, path, stem).select(
            "iteration", F.col("line").alias("cell"), F.col("tokens").cast(kind).alias(name)
        )
        out = out.join(part, ["iteration", "cell"])
    return out


def read_text_labels(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, line, x, cell): coordinates, then the label, on each line."""
    return _text_lines(spark, path, LABEL_STEM).select(
        "iteration",
        "line",
        F.slice("tokens", 1, F.size("tokens") - 1).cast("array<double>").alias("x"),
        F.element_at("tokens", -1).cast("int").alias("cell"),
    )
