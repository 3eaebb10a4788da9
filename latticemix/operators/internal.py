"""Indices from points and predicted labels alone.

Input is (id, x, label) with unique ids and labels matched to points by id.
Every row needs a label and a vector of the common width; a NULL fails the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_BROADCAST_VALUES
from ..functions import vectors as V
from ..session import materialize
from .ball_tree import LEAF_ROWS, largest_ratios
from .label_files import LabelFiles, one_array, over_targets, write_label_files

# Labels above this share of the rows are fewer than HOT_SHARE.
HOT_SHARE = 1000


def checked(labelled: DataFrame, width: int | None = None) -> DataFrame:
    """``labelled``; the job fails on a NULL label and, given ``width``, on another width of ``x``."""
    label = F.coalesce(F.col("label"), F.raise_error(F.lit("every row needs a label")))
    labelled = labelled.withColumn("label", label)
    return labelled if width is None else V.with_width(labelled, x=width)


def distinct_labels(labelled: DataFrame) -> DataFrame:
    return labelled.select("label").distinct()


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """(label, n)."""
    return checked(labelled).groupBy("label").agg(F.count("*").alias("n"))


def cluster_profile(labelled: DataFrame, width: int) -> DataFrame:
    """(label, n, center).

    Wide vectors are averaged as rows of (label, position), as one aggregate
    expression for each element would make a plan that takes longer than the work.
    """
    rows = checked(labelled, width)
    if width <= V.UNROLL_LIMIT:
        means = [F.avg(F.col("x")[j].cast("double")) for j in range(width)]
        return rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*means).alias("center"))
    long = rows.select("label", F.posexplode("x").alias("pos", "v"))
    means = long.groupBy("label", "pos").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("v"))
    placed = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("label").agg(
        F.max("n").alias("n"), F.transform(placed, lambda p: p["v"]).alias("center")
    )


def cluster_centers(labelled: DataFrame, width: int) -> DataFrame:
    """(label, center)."""
    return cluster_profile(labelled, width).select("label", "center")


def attach_center(rows: DataFrame, profile: DataFrame, width: int) -> DataFrame:
    """``rows`` with the centre of their label, whatever the number of labels.

    ``profile`` is a materialised ``cluster_profile``.  It is broadcast if its
    counted size is within bounds.  Beyond that only the labels holding more
    than 1/share of the rows are broadcast, fewer than ``share`` by counting;
    the others are shuffled, and none of those is hot.
    """
    size = profile.agg(F.count("*").alias("labels"), F.sum("n").alias("rows")).first()
    centers = profile.select("label", "center")
    if size.labels * (width + 1) <= MAX_BROADCAST_VALUES:
        return rows.join(F.broadcast(centers), "label")
    share = min(HOT_SHARE, MAX_BROADCAST_VALUES // (width + 1))
    hot = profile.filter(F.col("n") * share > size.rows).select("label", "center")
    cold = rows.join(F.broadcast(hot.select("label")), "label", "left_anti").join(
        centers.hint("shuffle_merge"), "label"
    )
    return rows.join(F.broadcast(hot), "label").unionByName(cold)


def cluster_scatter(labelled: DataFrame, width: int) -> DataFrame:
    """(label, scatter, center): mean Euclidean distance to the centre."""
    profile = materialize(cluster_profile(labelled, width))
    with_center = attach_center(labelled.select("label", "x"), profile, width)
    # Only doubles are aggregated, by hash; the centre joins one row per label.
    scatter = with_center.groupBy("label").agg(
        F.avg(V.euclidean(F.col("x"), F.col("center"), width)).alias("scatter")
    )
    return scatter.join(profile, "label").select("label", "scatter", "center")


def cluster_similarities(scatters: DataFrame, block_rows: int = LEAF_ROWS) -> DataFrame:
    """(label, similarity): the largest (S_i + S_j) / centre distance per cluster.

    Coincident centres give infinity (NULL if both scatters are 0 as well).
    ``block_rows`` clusters make a leaf of the tree that is searched.
    """
    best = largest_ratios(scatters, block_rows)
    # -inf: no other cluster at all; NaN: 0/0.
    known = (F.col("similarity") != float("-inf")) & ~F.isnan("similarity")
    return best.select("label", F.when(known, F.col("similarity")).alias("similarity"))


def davies_bouldin(labelled: DataFrame, width: int) -> DataFrame:
    """One row; NULL for a single cluster or an undefined pair."""
    worst = cluster_similarities(cluster_scatter(labelled, width))
    return worst.agg(
        F.when(F.count("similarity") == F.count("*"), F.avg("similarity")).alias("davies_bouldin")
    )


# -- silhouette -------------------------------------------------------------------


def _files(labelled: DataFrame) -> LabelFiles:
    rows = checked(labelled).select("id", "label", "x")
    return write_label_files(rows, lambda width: cluster_profile(labelled, width))


def distance_sums(labelled: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(id, label, other_label, sum_dist, n) to all n rows of each label.

    Rows are shuffled once, into files; a task streams the clusters past its
    targets and emits targets x labels rows.
    """
    files = _files(labelled)
    schema = (
        f"id {files.id_type}, label {files.label_type}, other_label {files.label_type}, "
        "sum_dist double, n bigint"
    )

    def measure(reader, ids, code, x):
        labels = one_array(reader.clusters["label"])
        own = labels.take(pa.array(code))
        for c, size in enumerate(reader.sizes.tolist()):
            others = labels.take(pa.array(np.full(len(x), c)))
            yield pa.RecordBatch.from_arrays(
                [ids, own, others, pa.array(reader.sums(x, c)), pa.array(np.full(len(x), size))],
                names=["id", "label", "other_label", "sum_dist", "n"],
            )

    return over_targets(labelled.sparkSession, files, measure, schema, block_rows)


def silhouette_rows(labelled: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(id, label, a, b, width, looked): over all rows, with unsquared Euclidean distance.

    ``a``: mean distance to the rest of the row's cluster, NULL when alone.
    ``b``: smallest mean distance to another cluster, NULL without one; found by
    going through the ``looked`` clusters whose centres are near enough.
    """
    files = _files(labelled)
    schema = f"id {files.id_type}, label {files.label_type}, a double, b double, looked bigint"

    def measure(reader, ids, code, x):
        rest = reader.sizes[code] - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            a = reader.own_sums(x, code) / rest
        b, looked = reader.nearest_means(x, code)
        labels = one_array(reader.clusters["label"]).take(pa.array(code))
        columns = [ids, labels, pa.array(a, mask=rest == 0), pa.array(b, mask=looked == 0), pa.array(looked)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "a", "b", "looked"])

    rows = over_targets(labelled.sparkSession, files, measure, schema, block_rows)
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    ratio = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return rows.select("id", "label", "a", "b", F.when(known, ratio).alias("width"), "looked")


def within_cluster_distance(labelled: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(id, label, sum_dist): summed distance to the rest of the row's cluster."""
    files = _files(labelled)
    schema = f"id {files.id_type}, label {files.label_type}, sum_dist double"

    def measure(reader, ids, code, x):
        labels = one_array(reader.clusters["label"]).take(pa.array(code))
        columns = [ids, labels, pa.array(reader.own_sums(x, code))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "sum_dist"])

    return over_targets(labelled.sparkSession, files, measure, schema, block_rows)


def silhouette_a(labelled: DataFrame) -> DataFrame:
    """(id, label, a) of rows that share their cluster with others."""
    return silhouette_rows(labelled).filter(F.col("a").isNotNull()).select("id", "label", "a")


def silhouette_b(labelled: DataFrame) -> DataFrame:
    """(id, label, b) when there is another cluster."""
    return silhouette_rows(labelled).filter(F.col("b").isNotNull()).select("id", "label", "b")


def silhouette_by_cluster(labelled: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(label, width): mean width; 0 for a lone row or a lone cluster.

    NULL where some row's width is undefined (0/0: all its distances are 0).
    """
    rated = F.col("a").isNotNull() & F.col("b").isNotNull()
    return (
        silhouette_rows(labelled, block_rows)
        .groupBy("label")
        .agg(
            F.when(F.count(F.when(rated, 1)) == 0, F.lit(0.0))
            .when(F.count(F.when(rated, 1)) == F.count("width"), F.avg("width"))
            .alias("width")
        )
    )


def silhouette(labelled: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row: unweighted mean over clusters of their mean widths."""
    widths = silhouette_by_cluster(labelled, block_rows)
    return widths.agg(
        F.when(F.count("width") == F.count("*"), F.avg("width")).alias("silhouette")
    )


def internal_indices(labelled: DataFrame, width: int) -> DataFrame:
    """One row: silhouette and Davies-Bouldin."""
    return silhouette(labelled).select(
        "silhouette", davies_bouldin(labelled, width).scalar().alias("davies_bouldin")
    )
