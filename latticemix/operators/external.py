"""Indices that compare predicted labels with true ones.

Everything follows from the contingency table, which is aggregated map-side, so
a label holding a third of the rows costs one partial row per task.  Pair
counts come in closed form; no pair of rows is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exact integer arithmetic: counts squared exceed BIGINT from 3e9 rows on.
WIDE = "decimal(38,0)"


def align_labels(true: DataFrame, predicted: DataFrame, strict: bool = True) -> DataFrame:
    """(id, true_label, pred_label) from two (id, label) tables with unique ids.

    ``strict`` fails the job unless both hold the same ids, each once; the check
    rides on the grouping that brings the two labels together.
    """
    t = true.select("id", F.col("label").alias("true_label"))
    p = predicted.select("id", F.col("label").alias("pred_label"))
    if not strict:
        return t.join(p, "id")
    return match_one_to_one(t, p)


def match_one_to_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' columns by id; the job fails unless they hold the same ids, each once.

    One grouping brings the two sides together and checks them.
    """
    sides = left.withColumn("_l", F.lit(1)).unionByName(
        right.withColumn("_r", F.lit(1)), allowMissingColumns=True
    )
    values = [c for c in dict.fromkeys(left.columns + right.columns) if c != "id"]
    # Shuffled by id first: then one sort serves the grouping, none comes before.
    matched = sides.repartition("id").groupBy("id").agg(
        *[F.max(c).alias(c) for c in values], F.count("_l").alias("_l"), F.count("_r").alias("_r")
    )
    one_to_one = F.when((F.col("_l") == 1) & (F.col("_r") == 1), F.lit(True)).otherwise(
        F.raise_error(F.lit("both sides must have the same ids, each once"))
    )
    return matched.filter(one_to_one).select("id", *values)


def match_stored(left: DataFrame, right: DataFrame) -> DataFrame:
    """``match_one_to_one`` of two tables stored by id in as many buckets: nothing is shuffled."""

    def once(side: DataFrame, count: str) -> DataFrame:
        values = [F.first(c).alias(c) for c in side.columns if c != "id"]
        return side.groupBy("id").agg(*values, F.count("*").alias(count))

    both = once(left, "_l").join(once(right, "_r"), "id", "full_outer")
    one_to_one = F.when((F.col("_l") == 1) & (F.col("_r") == 1), F.lit(True)).otherwise(
        F.raise_error(F.lit("both sides must have the same ids, each once"))
    )
    return both.filter(one_to_one).drop("_l", "_r")


def alignment_report(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: labels on each side, distinct ids, and ids found on both."""
    sides = true.select("id", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predicted.select("id", F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    per_id = sides.groupBy("id").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    return per_id.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_true"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"),
        F.count("*").alias("n_ids"),
        F.count(F.when((F.col("t") > 0) & (F.col("p") > 0), 1)).alias("n_matched"),
    )


def contingency(labels: DataFrame, *by: str) -> DataFrame:
    """(by, true_label, pred_label, n)."""
    return labels.groupBy(*by, "true_label", "pred_label").agg(F.count("*").alias("n"))


def label_marginals(table: DataFrame) -> DataFrame:
    """(side, label, n): class and cluster sizes from a contingency table."""
    true = table.groupBy(F.col("true_label").cast("string").alias("label")).agg(F.sum("n").alias("n"))
    pred = table.groupBy(F.col("pred_label").cast("string").alias("label")).agg(F.sum("n").alias("n"))
    return true.select(F.lit("true").alias("side"), "label", "n").unionByName(
        pred.select(F.lit("pred").alias("side"), "label", "n")
    )


def _levels(table: DataFrame, *by: str) -> DataFrame:
    """Sums over table cells (ij), classes (i) and clusters (j): one row, or one for each ``by``."""
    keys = [F.col(c) for c in by]
    # groupingSets marks a rolled-up column, and ``by`` never is one: ij -> 0, i -> 1, j -> 2.
    grouped = table.groupingSets(
        [
            [*keys, F.col("true_label"), F.col("pred_label")],
            [*keys, F.col("true_label")],
            [*keys, F.col("pred_label")],
        ],
        *keys,
        F.col("true_label"),
        F.col("pred_label"),
    ).agg(F.grouping_id().alias("level"), F.sum("n").alias("m"), F.max("n").alias("top"))
    m = F.col("m").cast("decimal(19,0)")
    at = {"ij": 0, "i": 1, "j": 2}
    sums = []
    for name, level in at.items():
        here = F.col("level") == level
        sums.append(
            F.coalesce(F.sum(F.when(here, (m * m).cast(WIDE))), F.lit(0).cast(WIDE)).alias(f"sq_{name}")
        )
        sums.append(F.sum(F.when(here, F.col("m") * F.ln("m"))).alias(f"ent_{name}"))
    sums.append(F.coalesce(F.sum(F.when(F.col("level") == 1, m.cast(WIDE))), F.lit(0).cast(WIDE)).alias("n"))
    sums.append(
        F.avg(F.when(F.col("level") == 2, F.try_divide(F.col("top").cast("double"), F.col("m")))).alias("purity")
    )
    return grouped.groupBy(*keys).agg(*sums)


def _pairs(levels: DataFrame) -> DataFrame:
    """Adds yy, yn, ny, nn, nt to the sums (exact until the last cast)."""
    half = lambda c: c.cast("double") / 2
    ij, i, j, n = (F.col(c) for c in ("sq_ij", "sq_i", "sq_j", "n"))
    total = (n.cast("decimal(19,0)") * n.cast("decimal(19,0)")).cast(WIDE)
    return levels.select(
        "*",
        half(ij - n).alias("yy"),
        half(i - ij).alias("yn"),
        half(j - ij).alias("ny"),
        half(total - i - j + ij).alias("nn"),
        half(total - n).alias("nt"),
    )


def pair_counts(table: DataFrame) -> DataFrame:
    """One row: unordered pairs by same class / same cluster, and their total."""
    return _pairs(_levels(table)).select("yy", "yn", "ny", "nn", "nt")


def _index_columns() -> dict[str, Column]:
    yy, yn, ny, nn, nt = (F.col(c) for c in ("yy", "yn", "ny", "nn", "nt"))
    per = F.try_divide
    n = F.col("n").cast("double")
    n_ln_n = n * F.ln(n)
    return {
        "precision": per(yy, yy + ny),
        "recall": per(yy, yy + yn),
        "czekanowski_dice": per(2 * yy, 2 * yy + yn + ny),
        "rand": per(yy + nn, nt),
        "rogers_tanimoto": per(yy + nn, yy + 2 * (yn + ny) + nn),
        "fowlkes_mallows": per(yy, F.sqrt((yy + yn) * (ny + yy))),
        "jaccard": per(yy, yy + yn + ny),
        "kulczynski": (per(yy, yy + ny) + per(yy, yy + yn)) / 2,
        "mcnemar": per(nn - ny, F.sqrt(nn + ny)),
        "russel_rao": per(yy, nt),
        "sokal_sneath1": per(yy, yy + 2 * (yn + ny)),
        "sokal_sneath2": per(yy + nn, yy + nn + (yn + ny) / 2),
        "purity": F.col("purity"),
        # Mutual information over mean entropy; the marginals enter as sums, so
        # they need no join back to the table.
        "nmi": per(
            2 * (F.col("ent_ij") - F.col("ent_i") - F.col("ent_j") + n_ln_n),
            2 * n_ln_n - F.col("ent_i") - F.col("ent_j"),
        ),
        "hubert": per(
            nt * yy - (yy + yn) * (yy + ny),
            F.sqrt(yy + yn) * F.sqrt(yy + ny) * F.sqrt(nn + yn) * F.sqrt(nn + ny),
        ),
        "phi": per(
            yy * nn - yn * ny, (yy + yn) * (yy + ny) * (yn + nn) * (ny + nn)
        ),
    }


INDEX_NAMES = tuple(
    "precision recall czekanowski_dice rand rogers_tanimoto fowlkes_mallows jaccard "
    "kulczynski mcnemar russel_rao sokal_sneath1 sokal_sneath2 purity nmi hubert phi".split()
)


def external_indices(table: DataFrame, names: tuple[str, ...] = INDEX_NAMES, by: tuple[str, ...] = ()) -> DataFrame:
    """One row with the chosen indices, or one for each ``by``; undefined ones (0/0) are NULL.

    ``names`` may also hold pair counts: yy, yn, ny, nn, nt.
    """
    columns = _index_columns()
    chosen = [columns.get(name, F.col(name)).alias(name) for name in names]
    return _pairs(_levels(table, *by)).select(*by, *chosen)


def indices_from_pairs(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Pair-based indices from given yy, yn, ny, nn, nt columns."""
    columns = _index_columns()
    return pairs.select(*[columns[name].alias(name) for name in names])
