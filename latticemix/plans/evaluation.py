"""Judging a clustering: both evaluations and the full job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import CellModel
from ..constants import DEFAULT_COLS, DEFAULT_ROWS, JOB_MAX_ITER
from ..operators.external import INDEX_NAMES, align_labels, contingency, external_indices, match_one_to_one
from ..operators.internal import internal_indices
from ..operators.prep import (
    checked_width,
    concat_features,
    first_n,
    join_features,
    minmax_normalize,
)
from ..session import materialize
from ..sources import trajectory as store
from ..sources.delimited import scan_binary, scan_continuous, scan_labels
from .em import Fitted, fit


def evaluate_external(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """All external indices of two (id, label) tables, matched by id."""
    return external_indices(contingency(align_labels(true, predicted)))


def evaluate_run(spark: SparkSession, path: str, true: DataFrame, names: tuple[str, ...] = INDEX_NAMES) -> DataFrame:
    """(iteration, external indices) for every iteration of a stored run that has labels.

    One grouping by id brings the true label to all iterations' labels of a row
    and checks that each id has one of either; one contingency table holds them
    all.  ``true`` is (id, label).
    """
    iterations = store.labelled_iterations(spark, path)
    stored = store.read_labels(spark, path).filter(F.col("iteration").isin(iterations))
    labels = stored.select("id", F.lit(0).alias("given"), F.struct("iteration", "cell").alias("at"))
    sides = labels.unionByName(
        true.select("id", F.lit(1).alias("given"), F.col("label").alias("true_label")), allowMissingColumns=True
    )
    matched = sides.groupBy("id").agg(
        F.max("true_label").alias("true_label"), F.sum("given").alias("given"), F.collect_list("at").alias("at")
    )
    each_once = (F.col("given") == 1) & (F.size("at") == len(iterations)) & (
        F.size(F.array_distinct(F.transform("at", lambda a: a["iteration"]))) == len(iterations)
    )
    failed = F.raise_error(F.lit("both sides must have the same ids, each once"))
    rows = matched.filter(F.when(each_once, F.lit(True)).otherwise(failed))
    rows = rows.select("true_label", F.inline("at")).withColumnRenamed("cell", "pred_label")
    return external_indices(contingency(rows, "iteration"), names, by=("iteration",))


def evaluate_internal(points: DataFrame, predicted: DataFrame, width: int) -> DataFrame:
    """Silhouette and Davies-Bouldin of (id, x) with (id, label), matched by id.

    Both must hold the same ids, each once.  The indices read the matched rows
    several times, so they are kept.
    """
    matched = match_one_to_one(points.select("id", "x"), predicted.select("id", "label"))
    return internal_indices(materialize(matched), width)


@dataclass
class JobResult:
    fitted: Fitted
    labels: DataFrame  # id, label
    indices: DataFrame  # kind, name, value


def run_job(
    spark: SparkSession,
    continuous_path: str,
    binary_path: str,
    labels_path: str,
    output_path: str,
    *,
    delimiter: str = ",",
    first: int | None = None,
    rows: int = DEFAULT_ROWS,
    cols: int = DEFAULT_COLS,
    max_iter: int = JOB_MAX_ITER,
    init_cells: CellModel | None = None,
    update_continuous: bool = False,
    label_every: int = 1,
) -> JobResult:
    """Delimited files in, trained cells, labels and index values out.

    Continuous columns are normalised over all rows.  ``first`` then takes the
    rows below that number; without it all rows are used.  ``label_every`` stores
    the labels of every n-th iteration beside those of the last.
    """
    taken = lambda df: df if first is None else first_n(df, first)
    # read for its width, for its bounds and for the points
    parsed = scan_continuous(spark, continuous_path, delimiter).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = checked_width(parsed)
        continuous = taken(minmax_normalize(parsed, width))
        points = join_features(continuous, taken(scan_binary(spark, binary_path, delimiter)))
        points = points.persist(StorageLevel.MEMORY_AND_DISK)
        fitted = fit(
            points,
            init_cells,
            rows=rows,
            cols=cols,
            max_iter=max_iter,
            update_continuous=update_continuous,
            output_path=output_path,
            label_every=label_every,
        )
    finally:
        parsed.unpersist()  # the points are cached by now
    stored = store.read_labels(spark, output_path, max_iter)
    labels = stored.select("id", F.col("cell").alias("label"))
    true = taken(scan_labels(spark, labels_path, delimiter))
    features = concat_features(points)
    internal = evaluate_internal(features, labels, width + fitted.cells.bin_size)
    external = evaluate_external(true, labels)
    store.write_indices(store.index_rows(internal, external), output_path)
    points.unpersist()
    return JobResult(fitted, labels, store.read_indices(spark, output_path))
