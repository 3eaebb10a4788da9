"""One query per operator.  Each takes (spark, sf_dir) and reads whole tables.

Doubles are rounded to six digits to absorb summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticemix.cells import CellModel, temperature_at
from latticemix.cells import random_cells as drawn_cells
from latticemix.constants import EXTERNAL_REPORT, INTERNAL_REPORT
from latticemix.functions import lattice as L
from latticemix.functions import reduce as R
from latticemix.functions import vectors as V
from latticemix.functions.pairs import pair_notation
from latticemix.operators import density as D
from latticemix.operators import external as X
from latticemix.operators import internal as I
from latticemix.operators import posterior as P
from latticemix.operators import prep
from latticemix.operators import updates as U
from latticemix.plans.em import em_step, fit
from latticemix.plans.evaluation import evaluate_external, evaluate_run, run_job
from latticemix.session import new_path
from latticemix.sources import delimited as S
from latticemix.sources import tables as T
from latticemix.sources import trajectory as store
from latticemix.sources.bucketed import read_bucketed, write_bucketed
from latticemix.sources.text_run import read_text_run, write_text_run

ROWS = COLS = 5
K = ROWS * COLS
BITS = len(T.EVENT_TYPES)
EPSILON = 0.25
MAX_ITER = 10
FIT_ITER = MAX_ITER
FIRST_N = 2000
SEED = 1
BUCKETS = 8
EMBEDDING_ROWS, EMBEDDING_COLS = 2, 5


def start_model() -> CellModel:
    """The 5 x 5 start: grid means, prototypes = the cell number's low bits."""
    return CellModel.initial(
        ROWS,
        COLS,
        bin_mean=[[(c >> j) & 1 for j in range(BITS)] for c in range(K)],
        bin_epsilon=EPSILON,
    )


START_T = temperature_at(1, MAX_ITER)


def r6(column: Column | str, name: str | None = None) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    rounded = F.round(column.cast("double"), 6)
    return rounded.alias(name) if name else rounded


def long(df: DataFrame, value: str, cell: str = "cell") -> DataFrame:
    return df.select(F.col("id").alias("event_id"), cell, r6(value, value))


# -- scans and sinks ------------------------------------------------------------


def _written(spark, lines: DataFrame, name: str) -> str:
    """Write one text column to the shared folder; returns the path."""
    path = new_path(spark, name)
    lines.write.text(path)
    return path


def _events(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "events")


def read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _events(spark, sf_dir).select(
        F.concat(
            F.lit(" \t"), F.concat_ws(";", "event_id", "user_id", "event_type", F.lit(""), F.lit("")),
            F.lit(" "),
        ).alias("value")
    )
    tokens = S.read_delimited(spark, _written(spark, lines, "delimited"), ";").select("tokens")
    return tokens.select(
        F.col("tokens")[0].cast("long").alias("event_id"),
        F.col("tokens")[1].cast("long").alias("user_id"),
        F.col("tokens")[2].alias("event_type"),
        F.size("tokens").alias("n_tokens"),
    )


def _continuous_file(spark, sf_dir) -> str:
    lines = _events(spark, sf_dir).select(
        F.concat_ws(",", "event_id", "value", F.hour("ts")).alias("value")
    )
    return _written(spark, lines, "continuous")


def _by_hour(x: DataFrame) -> DataFrame:
    return x.groupBy(F.col("x")[1].cast("int").alias("hour")).agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("n_ids"),
        r6(F.sum(F.col("x")[0]), "sum_value"),
    )


def scan_continuous(spark, sf_dir) -> DataFrame:
    return _by_hour(S.scan_continuous(spark, _continuous_file(spark, sf_dir)))


def scan_whitespace(spark, sf_dir) -> DataFrame:
    lines = _events(spark, sf_dir).select(
        F.concat(F.lit("  "), "value", F.lit("  \t "), F.hour("ts"), F.lit("\t")).alias("value")
    )
    return _by_hour(S.scan_whitespace(spark, _written(spark, lines, "whitespace")))


def scan_binary(spark, sf_dir) -> DataFrame:
    bits = prep.one_hot(F.col("event_type"), T.EVENT_TYPES)
    lines = _events(spark, sf_dir).select(F.concat_ws(",", bits.cast("array<string>")).alias("value"))
    rows = S.scan_binary(spark, _written(spark, lines, "binary"))
    return rows.select("id", F.posexplode("b").alias("bit", "v")).groupBy("bit").agg(
        F.sum("v").alias("ones"), F.count("*").alias("n"), F.max("id").alias("last_id")
    )


def scan_labels(spark, sf_dir) -> DataFrame:
    lines = _events(spark, sf_dir).select(F.concat_ws(",", "event_type", "user_id").alias("value"))
    rows = S.scan_labels(spark, _written(spark, lines, "labels"))
    return rows.groupBy("label").agg(F.count_distinct("id").alias("n"))


def with_row_id(spark, sf_dir) -> DataFrame:
    rows = S.with_row_id(T.table(spark, sf_dir, "lineitem").select("l_quantity"))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        r6(F.sum("l_quantity"), "sum_quantity"),
    )


def _stored_run(spark, sf_dir) -> str:
    path = new_path(spark, "run")
    fit(
        T.event_points(spark, sf_dir),
        start_model(),
        max_iter=FIT_ITER,
        update_continuous=True,
        output_path=path,
        label_every=FIT_ITER,
    )
    return path


def cell_columns(cells: DataFrame, *lead: str) -> DataFrame:
    """Cells without arrays: means as m0, m1 and prototypes as text."""
    return cells.select(
        *lead,
        "cell",
        r6("prob", "prob"),
        r6("num_items", "num_items"),
        *[r6(F.col("cont_mean")[j], f"m{j}") for j in range(2)],
        r6("cont_variance", "cont_variance"),
        F.concat_ws("", F.col("bin_mean").cast("array<string>")).alias("bin_mean"),
        r6("bin_epsilon", "bin_epsilon"),
    )


def write_cells(spark, sf_dir) -> DataFrame:
    return cell_columns(store.read_cells(spark, _stored_run(spark, sf_dir)), "iteration")


def resumed_fit(spark, sf_dir) -> DataFrame:
    """A run that broke off in its third iteration, with labels but no cells of it, and went on."""
    points, path = T.event_points(spark, sf_dir), new_path(spark, "run")
    settings = {"max_iter": FIT_ITER, "update_continuous": True, "label_every": FIT_ITER}
    fitted = fit(points, start_model(), output_path=path, **settings)
    broken = new_path(spark, "run")
    store.write_settings(spark, broken, store.read_settings(spark, path))
    store.write_cells(spark, broken, 0, start_model())
    for step in fitted.steps[:2]:
        store.write_cells(spark, broken, step.iteration, step.cells)
    store.write_labels(fitted.predict(points), broken, 3)
    fit(points, output_path=broken, resume=True, **settings)
    return cell_columns(store.read_cells(spark, broken), "iteration")


def refused_run(spark, sf_dir) -> DataFrame:
    """The cells of a run whose folder a second run may not take."""
    path = _stored_run(spark, sf_dir)
    try:
        fit(T.event_points(spark, sf_dir), start_model(), max_iter=2, output_path=path)
    except ValueError:
        return cell_columns(store.read_cells(spark, path), "iteration")
    raise AssertionError("a run was written over another")


def text_run(spark, sf_dir) -> DataFrame:
    """A run's cells by way of the text layout, the grid of one quantity by way of its file."""
    cells, path = store.read_cells(spark, _stored_run(spark, sf_dir)), new_path(spark, "text-run")
    write_text_run(cells, path)
    grid = new_path(spark, "grid")
    store.write_cell_grid(cells, "cont_variance", COLS, grid)
    values = ", ".join(f"c{c} double" for c in range(COLS))
    lines = spark.read.schema(f"row int, {values}, iteration int").csv(grid)
    back = read_text_run(spark, path)
    spread = lines.groupBy("iteration").agg(F.sum(sum(F.col(f"c{c}") for c in range(COLS))).alias("sum_variance"))
    return back.join(spread, "iteration").select(
        "iteration",
        "cell",
        r6("prob", "prob"),
        r6("num_items", "num_items"),
        r6(F.col("cont_mean")[0], "m0"),
        r6(F.col("cont_mean")[1], "m1"),
        F.concat_ws("", F.col("bin_mean").cast("array<string>")).alias("bin_mean"),
        r6("bin_epsilon", "bin_epsilon"),
        r6("sum_variance", "sum_variance"),
    )


def run_indices(spark, sf_dir) -> DataFrame:
    """External indices of every iteration's labels in a stored run."""
    path = new_path(spark, "run")
    fit(
        T.event_points(spark, sf_dir),
        start_model(),
        max_iter=FIT_ITER,
        update_continuous=True,
        output_path=path,
        label_every=1,
        label_prior="current",
    )
    got = evaluate_run(spark, path, T.event_types(spark, sf_dir), (*X.INDEX_NAMES, "nt"))
    got = got.withColumn("phi", F.col("phi") * F.col("nt") * F.col("nt"))  # digits that survive rounding
    return got.select("iteration", *[r6(name, name) for name in X.INDEX_NAMES])


def stored_evaluation(spark, sf_dir) -> DataFrame:
    """External indices of two labellings stored by id; nothing is shuffled to match them."""
    true = T.event_types(spark, sf_dir).withColumnRenamed("label", "true_label")
    pred = T.value_buckets(spark, sf_dir).withColumnRenamed("label", "pred_label")
    paths = [new_path(spark, "by-id") for _ in range(2)]
    for table, path in zip((true, pred), paths):
        write_bucketed(table, path, BUCKETS)
    matched = X.match_stored(*(read_bucketed(spark, path) for path in paths))
    got = X.external_indices(X.contingency(matched), ("rand", "precision", "recall", "jaccard", "purity", "nmi"))
    return got.select(*[r6(name, name) for name in got.columns])


def _ordered_file(spark, sf_dir, name: str, *values) -> str:
    """Lines in event order: the files' names follow it, so line numbers do."""
    lines = _events(spark, sf_dir).orderBy("event_id").select(F.concat_ws(",", *values).alias("value"))
    return _written(spark, lines, name)


def scan_ids(spark, sf_dir) -> DataFrame:
    """Each line's number beside the key that the line itself holds."""
    path = _ordered_file(spark, sf_dir, "ordered", "event_id", "event_type")
    rows = S.read_delimited(spark, path, ",", with_id=True)
    return rows.select("id", F.col("tokens")[0].cast("long").alias("event_id"), F.col("tokens")[1].alias("event_type"))


def job_labels(spark, sf_dir) -> DataFrame:
    """The whole job on files, from reading to both evaluations; its last labels by line."""
    bits = prep.one_hot(F.col("event_type"), T.EVENT_TYPES).cast("array<string>")
    done = run_job(
        spark,
        _ordered_file(spark, sf_dir, "continuous", "event_id", "value", F.hour("ts")),
        _ordered_file(spark, sf_dir, "binary", bits),
        _ordered_file(spark, sf_dir, "labels", "event_type"),
        new_path(spark, "job"),
        max_iter=FIT_ITER,
        init_cells=start_model(),
        update_continuous=True,
        label_every=FIT_ITER,
    )
    if done.indices.count() != len(INTERNAL_REPORT) + len(EXTERNAL_REPORT):
        raise ValueError("the job stores every reported index")
    return done.labels.select("id", F.col("label").alias("cell"))


def read_trajectory(spark, sf_dir) -> DataFrame:
    cells = store.read_cells(spark, _stored_run(spark, sf_dir))
    grid = store.cell_grid(cells, "num_items", COLS)
    return grid.select("iteration", "row", *[r6(f"c{c}", f"c{c}") for c in range(COLS)])


def trajectory_sample(spark, sf_dir) -> DataFrame:
    cells = store.read_cells(spark, _stored_run(spark, sf_dir))
    return store.trajectory_sample(cells, 2).select("iteration", "cell", "bin_epsilon")


def write_labels(spark, sf_dir) -> DataFrame:
    labels = store.read_labels(spark, _stored_run(spark, sf_dir), FIT_ITER)
    return labels.select(
        F.col("id").alias("event_id"),
        r6(F.col("x")[0], "x0"),
        r6(F.col("x")[1], "x1"),
        "cell",
    )


def write_indices(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "indices")
    store.write_indices(store.index_rows(None, external_indices_events(spark, sf_dir)), path)
    points = T.embedding_points(spark, sf_dir)
    internal = I.davies_bouldin(points, T.EMBEDDING_WIDTH)
    store.write_indices(store.index_rows(internal, None), path)
    return store.read_indices(spark, path).select("kind", "name", r6("value", "value"))


# -- preparation -----------------------------------------------------------------


def column_min_max(spark, sf_dir) -> DataFrame:
    bounds = prep.column_min_max(T.part_points(spark, sf_dir), 2)
    return bounds.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "v")).select(
        "pos", r6(F.col("v.lo"), "lo"), r6(F.col("v.hi"), "hi")
    )


def vector_width(spark, sf_dir) -> DataFrame:
    return prep.vector_width(T.embedding_points(spark, sf_dir))


def _coordinates(points: DataFrame, key: str = "event_id") -> DataFrame:
    return points.select(
        F.col("id").alias(key), r6(F.col("x")[0], "x0"), r6(F.col("x")[1], "x1")
    )


def minmax_normalize(spark, sf_dir) -> DataFrame:
    return _coordinates(T.event_points(spark, sf_dir))


def first_n(spark, sf_dir) -> DataFrame:
    return _coordinates(prep.first_n(T.event_points(spark, sf_dir), FIRST_N))


def drop_leading(spark, sf_dir) -> DataFrame:
    parts = T.table(spark, sf_dir, "part").select(
        "p_partkey", F.split("p_type", " ").alias("tokens")
    )
    rest = S.drop_leading(F.col("tokens"))
    return parts.select("p_partkey", F.concat_ws("|", rest).alias("rest"), F.size(rest).alias("n"))


def concat_features(spark, sf_dir) -> DataFrame:
    joined = prep.concat_features(T.event_points(spark, sf_dir))
    return joined.select(
        F.col("id").alias("event_id"),
        F.size("x").alias("width"),
        *[r6(F.col("x")[j], f"x{j}") for j in range(2 + BITS)],
    )


def join_features(spark, sf_dir) -> DataFrame:
    points = T.event_points(spark, sf_dir)
    joined = prep.join_features(points.select("id", "x"), points.select("id", "b"))
    return joined.select(
        F.col("id").alias("event_id"),
        r6(F.col("x")[0], "x0"),
        F.concat_ws("", F.col("b").cast("array<string>")).alias("bits"),
    )


def int_to_bits(spark, sf_dir) -> DataFrame:
    coded = prep.int_to_bits(T.table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")
    return coded.select("event_id", F.concat_ws("", F.col("b").cast("array<string>")).alias("bits"))


def vector_arithmetic(spark, sf_dir) -> DataFrame:
    p = T.event_points(spark, sf_dir)
    weight = F.col("x")[0]
    weighted = V.scale(F.col("x"), weight)
    other = V.scale_complement(F.col("x"), weight)
    total = V.divide(V.add(weighted, other), F.lit(2.0))
    return p.select(
        F.col("id").alias("event_id"),
        *[r6(weighted[j], f"w{j}") for j in range(2)],
        *[r6(other[j], f"o{j}") for j in range(2)],
        *[r6(total[j], f"t{j}") for j in range(2)],
    )


def row_reductions(spark, sf_dir) -> DataFrame:
    points = T.embedding_points(spark, sf_dir)
    return points.select(
        F.col("id").alias("vec_id"),
        R.argmax_first(F.col("x")).alias("best"),
        r6(R.logsumexp(F.col("x")), "lse"),
        r6(F.aggregate(R.exp_all(F.col("x")), F.lit(0.0), lambda a, v: a + v), "sum_exp"),
    )


# -- grid --------------------------------------------------------------------------


def _home_cell(spark, sf_dir) -> DataFrame:
    """Each event's grid cell by position."""
    at = lambda j, n: F.least(F.floor(F.col("x")[j] * n), F.lit(n - 1)).cast("int")
    home = T.event_points(spark, sf_dir).select("id", at(0, ROWS).alias("row"), at(1, COLS).alias("col"))
    return home.withColumn("cell", L.cell_index(F.col("row"), F.col("col"), COLS))


def random_cells(spark, sf_dir) -> DataFrame:
    """A drawn start of the vectors' width."""
    width = prep.checked_width(T.embedding_points(spark, sf_dir))
    cells = drawn_cells(spark, EMBEDDING_ROWS * EMBEDDING_COLS, width, width, SEED)
    both = F.arrays_zip("cont_mean", "bin_mean")
    long = cells.select("cell", "bin_epsilon", F.posexplode(both).alias("pos", "v"))
    return long.select("cell", "pos", r6("v.cont_mean", "mean"), F.col("v.bin_mean").alias("bit"), r6("bin_epsilon", "epsilon"))


def init_cells(spark, sf_dir) -> DataFrame:
    counts = _home_cell(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n_events"))
    cells = start_model().to_dataframe(spark)
    return cells.join(counts, "cell", "left").select(
        "cell",
        "row",
        "col",
        r6("prob", "prob"),
        r6("num_items", "num_items"),
        r6(F.col("cont_mean")[0], "m0"),
        r6(F.col("cont_mean")[1], "m1"),
        r6("cont_variance", "cont_variance"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )


def grid_distance(spark, sf_dir) -> DataFrame:
    home = _home_cell(spark, sf_dir)
    distance = L.grid_distance(
        L.cell_row(F.col("cell"), COLS), L.cell_col(F.col("cell"), COLS), F.lit(2), F.lit(2)
    )
    return (
        home.withColumn("distance", distance)
        .withColumn("k", L.kernel(F.col("distance"), START_T))
        .groupBy("distance")
        .agg(F.count("*").alias("n"), r6(F.sum("k"), "sum_kernel"))
    )


def neighborhood(spark, sf_dir) -> DataFrame:
    """Events spread from their home cell over its neighbourhood."""
    home = _home_cell(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"))
    pairs = D.neighborhood(spark, ROWS, COLS, START_T)
    return (
        pairs.join(home.withColumnRenamed("cell", "cell_star"), "cell_star")
        .groupBy("cell")
        .agg(r6(F.sum(F.col("n") * F.col("weight")), "spread"), F.sum("distance").alias("distance"))
    )


def annealing_schedule(spark, sf_dir) -> DataFrame:
    """Temperature when the hour of the day is the iteration."""
    steps = D.annealing_schedule(spark, 24)
    hours = T.event_points(spark, sf_dir, normalize=False).select(
        (F.col("x")[1].cast("int") + 1).alias("iteration")
    )
    counts = hours.groupBy("iteration").agg(F.count("*").alias("n"))
    return counts.join(steps, "iteration").select(
        "iteration", "n", r6("temperature", "temperature"), r6(F.col("n") * F.col("temperature"), "heat")
    )


# -- densities and posteriors ----------------------------------------------------------


def hamming_to_cells(spark, sf_dir) -> DataFrame:
    return long(D.hamming_to_cells(T.event_points(spark, sf_dir, normalize=False), start_model()), "distance")


def log_gaussian_cells(spark, sf_dir) -> DataFrame:
    return long(D.log_gaussian_cells(T.event_points(spark, sf_dir), start_model()), "value")


def log_gaussian_scaled(spark, sf_dir) -> DataFrame:
    return long(
        D.log_gaussian_cells(T.event_points(spark, sf_dir), start_model(), "scaled_norm"), "value"
    )


def gaussian_density(spark, sf_dir) -> DataFrame:
    return long(D.log_gaussian_cells(T.event_points(spark, sf_dir), start_model(), "density"), "value")


def log_bernoulli_cells(spark, sf_dir) -> DataFrame:
    return long(D.log_bernoulli_cells(T.event_points(spark, sf_dir, normalize=False), start_model()), "value")


def log_mixed_density(spark, sf_dir) -> DataFrame:
    return long(D.log_mixed_density(T.event_points(spark, sf_dir), start_model()), "value")


def _scored(spark, sf_dir, *want: str) -> DataFrame:
    return P.with_posterior(T.event_points(spark, sf_dir), start_model(), START_T, want=want)


def log_px_given_winner(spark, sf_dir) -> DataFrame:
    scored = _scored(spark, sf_dir, "log_px_winner")
    return long(P.long_form(scored, "log_px_winner", "cell_star"), "value", "cell_star")


def log_px(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir, "log_px").select(F.col("id").alias("event_id"), r6("log_px", "log_px"))


def joint_posterior(spark, sf_dir) -> DataFrame:
    joint = P.joint_posterior(T.event_points(spark, sf_dir), start_model(), START_T)
    return joint.groupBy("cell_star", "cell").agg(
        F.count("*").alias("n"),
        r6(F.sum(F.exp("log_p")), "sum_p"),
        r6(F.min("log_p"), "min_log_p"),
        r6(F.max("log_p"), "max_log_p"),
    )


def posterior_winner(spark, sf_dir) -> DataFrame:
    scored = _scored(spark, sf_dir, "log_p_winner")
    return long(P.long_form(scored, "log_p_winner", "cell_star"), "value", "cell_star")


def posterior_cell(spark, sf_dir) -> DataFrame:
    return long(P.long_form(_scored(spark, sf_dir, "log_p_cell"), "log_p_cell"), "value")


def assign_by_cell(spark, sf_dir) -> DataFrame:
    got = P.assign_by_cell(T.event_points(spark, sf_dir), start_model(), START_T)
    return got.select(F.col("id").alias("event_id"), "cell")


def assign_by_winner(spark, sf_dir) -> DataFrame:
    got = P.assign_by_winner(T.event_points(spark, sf_dir), start_model(), START_T)
    return got.select(F.col("id").alias("event_id"), "cell")


def log_likelihood(spark, sf_dir) -> DataFrame:
    got = P.log_likelihood(T.event_points(spark, sf_dir), start_model(), START_T)
    return got.select("n", r6("log_likelihood", "log_likelihood"))


# -- updates and training ---------------------------------------------------------------


def _for_updates(spark, sf_dir) -> DataFrame:
    return U.score_for_updates(T.event_points(spark, sf_dir), start_model(), START_T)


def update_prior(spark, sf_dir) -> DataFrame:
    return U.update_prior(_for_updates(spark, sf_dir)).select("cell", r6("prob", "prob"))


def update_cont_mean(spark, sf_dir) -> DataFrame:
    got = U.update_cont_mean(_for_updates(spark, sf_dir), 2)
    return got.select("cell", *[r6(F.col("cont_mean")[j], f"m{j}") for j in range(2)])


def update_cont_variance(spark, sf_dir) -> DataFrame:
    scored = _for_updates(spark, sf_dir)
    means = [r.cont_mean for r in U.update_cont_mean(scored, 2).orderBy("cell").collect()]
    return U.update_cont_variance(scored, means).select("cell", r6("cont_variance", "cont_variance"))


def update_bin_prototype(spark, sf_dir) -> DataFrame:
    got = U.update_bin_prototype(_for_updates(spark, sf_dir), BITS)
    return got.select("cell", F.concat_ws("", F.col("bin_mean").cast("array<string>")).alias("bin_mean"))


def update_bin_epsilon(spark, sf_dir) -> DataFrame:
    got = U.update_bin_epsilon(_for_updates(spark, sf_dir), BITS)
    return got.select("cell", r6("bin_epsilon", "bin_epsilon"))


def items_per_cell(spark, sf_dir) -> DataFrame:
    return U.items_per_cell(_for_updates(spark, sf_dir)).select("cell", r6("num_items", "num_items"))


def one_step(spark, sf_dir) -> DataFrame:
    step = em_step(T.event_points(spark, sf_dir), start_model(), START_T)
    return cell_columns(step.computed.to_dataframe(spark))


def _fit(components: str, update: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir) -> DataFrame:
        fitted = fit(
            T.event_points(spark, sf_dir),
            start_model(),
            max_iter=FIT_ITER,
            components=components,
            update_continuous=update,
        )
        return cell_columns(fitted.cells.to_dataframe(spark))

    return run


def predict(spark, sf_dir) -> DataFrame:
    points = T.event_points(spark, sf_dir)
    fitted = fit(points, start_model(), max_iter=FIT_ITER, update_continuous=True)
    return fitted.predict(points).select(F.col("id").alias("event_id"), "cell")


def embedding_model(spark, sf_dir) -> tuple[DataFrame, CellModel]:
    """64 dimensions, ten cells started at the class means (ten rows)."""
    points = T.embedding_points(spark, sf_dir)
    k = EMBEDDING_ROWS * EMBEDDING_COLS
    centers = I.cluster_centers(points, T.EMBEDDING_WIDTH).orderBy("label").limit(k + 1).collect()
    if len(centers) != k:
        raise ValueError(f"the grid of {k} cells needs as many classes")
    model = CellModel.initial(
        EMBEDDING_ROWS,
        EMBEDDING_COLS,
        cont_mean=[r.center for r in centers],
        cont_variance=0.02,
    )
    return points, model


def fit_embeddings(spark, sf_dir) -> DataFrame:
    points, model = embedding_model(spark, sf_dir)
    fitted = fit(points, model, max_iter=FIT_ITER, components="cont", update_continuous=True)
    labelled = fitted.training_labels(points)
    return labelled.select(F.col("id").alias("vec_id"), "label", "cell")


def posterior_embeddings(spark, sf_dir) -> DataFrame:
    points, model = embedding_model(spark, sf_dir)
    scored = P.with_posterior(points, model, 1.0, components="cont", want=("log_p_cell",))
    return P.long_form(scored, "log_p_cell").select(
        F.col("id").alias("vec_id"), "cell", r6("value", "value")
    )


# -- external indices ------------------------------------------------------------------


def _aligned_events(spark, sf_dir) -> DataFrame:
    return X.align_labels(T.event_types(spark, sf_dir), T.value_buckets(spark, sf_dir))


def align_labels(spark, sf_dir) -> DataFrame:
    return _aligned_events(spark, sf_dir).withColumnRenamed("id", "event_id")


def alignment_report(spark, sf_dir) -> DataFrame:
    """Documents with and without labels."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    labels = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return X.alignment_report(docs, labels)


def points_with_labels(spark, sf_dir) -> DataFrame:
    joined = prep.points_with_labels(T.event_points(spark, sf_dir), T.value_buckets(spark, sf_dir))
    return joined.select(F.col("id").alias("event_id"), r6(F.col("x")[0], "x0"), "label")


def contingency(spark, sf_dir) -> DataFrame:
    return X.contingency(_aligned_events(spark, sf_dir))


def label_marginals(spark, sf_dir) -> DataFrame:
    return X.label_marginals(contingency(spark, sf_dir))


def pair_counts(spark, sf_dir) -> DataFrame:
    return X.pair_counts(contingency(spark, sf_dir))


def notation_of_neighbours(spark, sf_dir) -> DataFrame:
    """The pair notation of each event and the one with the next id."""
    a = _aligned_events(spark, sf_dir)
    b = a.select((F.col("id") - 1).alias("id"), F.col("true_label").alias("t"), F.col("pred_label").alias("p"))
    pair = a.join(b, "id").select(
        pair_notation(F.col("true_label"), F.col("pred_label"), F.col("t"), F.col("p")).alias("notation")
    )
    return pair.groupBy("notation").agg(F.count("*").alias("n"))


def external_indices_events(spark, sf_dir) -> DataFrame:
    return evaluate_external(T.event_types(spark, sf_dir), T.value_buckets(spark, sf_dir))


def external_indices(spark, sf_dir) -> DataFrame:
    got = external_indices_events(spark, sf_dir)
    return got.select(*[r6(name, name) for name in X.INDEX_NAMES if name != "phi"])


def _index(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """One index; phi, which shrinks with the fourth power of n, times nt * nt."""

    def run(spark, sf_dir) -> DataFrame:
        got = X.external_indices(contingency(spark, sf_dir), (name, "nt"))
        value = F.col("phi") * F.col("nt") * F.col("nt") if name == "phi" else F.col(name)
        return got.select(r6(value, name))

    return run


def model_quality(spark, sf_dir) -> DataFrame:
    """Flagship: label events with the start model and compare with their type."""
    got = P.assign_by_cell(T.event_points(spark, sf_dir), start_model(), START_T)
    predicted = got.select("id", F.col("cell").cast("string").alias("label"))
    table = X.contingency(X.align_labels(T.event_types(spark, sf_dir), predicted))
    names = ("rand", "precision", "recall", "purity", "nmi")
    return X.external_indices(table, names).select(*[r6(n, n) for n in names])


def labels_sorted(spark, sf_dir) -> DataFrame:
    got = P.assign_by_cell(T.event_points(spark, sf_dir), start_model(), START_T)
    labels = got.select("id", F.col("cell").cast("string").alias("label"))
    return prep.labels_sorted(labels).withColumnRenamed("id", "event_id")


# -- internal indices -------------------------------------------------------------------


def _event_clusters(spark, sf_dir) -> DataFrame:
    return T.event_points(spark, sf_dir).join(T.value_buckets(spark, sf_dir), "id").select("id", "x", "label")


def distinct_labels(spark, sf_dir) -> DataFrame:
    return I.distinct_labels(T.value_buckets(spark, sf_dir))


def cluster_sizes(spark, sf_dir) -> DataFrame:
    return I.cluster_sizes(T.value_buckets(spark, sf_dir))


def cluster_centers(spark, sf_dir) -> DataFrame:
    got = I.cluster_centers(T.embedding_points(spark, sf_dir), T.EMBEDDING_WIDTH)
    return got.select("label", F.posexplode("center").alias("pos", "v")).select("label", "pos", r6("v", "v"))


def cluster_scatter(spark, sf_dir) -> DataFrame:
    return I.cluster_scatter(T.part_points(spark, sf_dir), 2).select(
        "label", r6("scatter", "scatter"), r6(F.col("center")[0], "c0"), r6(F.col("center")[1], "c1")
    )


def distance_to_center(spark, sf_dir) -> DataFrame:
    points = T.embedding_points(spark, sf_dir)
    profile = I.materialize(I.cluster_profile(points, T.EMBEDDING_WIDTH))
    joined = I.attach_center(points, profile, T.EMBEDDING_WIDTH)
    return joined.select(
        F.col("id").alias("vec_id"),
        r6(V.euclidean(F.col("x"), F.col("center"), T.EMBEDDING_WIDTH), "distance"),
    )


def cluster_similarity(spark, sf_dir) -> DataFrame:
    scatters = I.cluster_scatter(_event_clusters(spark, sf_dir), 2)
    return I.cluster_similarities(scatters).select("label", r6("similarity", "similarity"))


def davies_bouldin(spark, sf_dir) -> DataFrame:
    got = I.davies_bouldin(_event_clusters(spark, sf_dir), 2)
    return got.select(r6("davies_bouldin", "davies_bouldin"))


def within_cluster_distance(spark, sf_dir) -> DataFrame:
    got = I.within_cluster_distance(T.embedding_points(spark, sf_dir))
    return got.select(F.col("id").alias("vec_id"), "label", r6("sum_dist", "sum_dist"))


def silhouette_a(spark, sf_dir) -> DataFrame:
    got = I.silhouette_a(T.embedding_points(spark, sf_dir))
    return got.select(F.col("id").alias("vec_id"), "label", r6("a", "a"))


def silhouette_b(spark, sf_dir) -> DataFrame:
    got = I.silhouette_b(T.embedding_points(spark, sf_dir))
    return got.select(F.col("id").alias("vec_id"), "label", r6("b", "b"))


def silhouette_by_cluster(spark, sf_dir) -> DataFrame:
    got = I.silhouette_by_cluster(T.embedding_points(spark, sf_dir))
    return got.select("label", r6("width", "width"))


def silhouette(spark, sf_dir) -> DataFrame:
    return I.silhouette(T.embedding_points(spark, sf_dir)).select(r6("silhouette", "silhouette"))


def silhouette_events(spark, sf_dir) -> DataFrame:
    return I.silhouette(_event_clusters(spark, sf_dir)).select(r6("silhouette", "silhouette"))


def internal_indices(spark, sf_dir) -> DataFrame:
    got = I.internal_indices(T.embedding_points(spark, sf_dir), T.EMBEDDING_WIDTH)
    return got.select(r6("silhouette", "silhouette"), r6("davies_bouldin", "davies_bouldin"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        read_delimited, scan_continuous, scan_whitespace, scan_binary, scan_labels, with_row_id,
        scan_ids, write_cells, refused_run, text_run, run_indices, stored_evaluation, random_cells, resumed_fit, job_labels, read_trajectory, trajectory_sample, write_labels, write_indices,
        column_min_max, vector_width, minmax_normalize, first_n, drop_leading, concat_features, join_features,
        int_to_bits, vector_arithmetic, row_reductions,
        init_cells, grid_distance, neighborhood, annealing_schedule,
        hamming_to_cells, log_gaussian_cells, log_gaussian_scaled, gaussian_density,
        log_bernoulli_cells, log_mixed_density, log_px_given_winner, log_px, joint_posterior,
        posterior_winner, posterior_cell, assign_by_cell, assign_by_winner, log_likelihood,
        update_prior, update_cont_mean, update_cont_variance, update_bin_prototype,
        update_bin_epsilon, items_per_cell, predict, fit_embeddings, posterior_embeddings,
        align_labels, alignment_report, points_with_labels, contingency, label_marginals,
        pair_counts, external_indices, model_quality, labels_sorted,
        distinct_labels, cluster_sizes, cluster_centers, cluster_scatter, distance_to_center,
        cluster_similarity, davies_bouldin, within_cluster_distance, silhouette_a, silhouette_b,
        silhouette_by_cluster, silhouette, silhouette_events, internal_indices,
    ]
    out = {fn.__name__: fn for fn in plain}
    out["pair_notation"] = notation_of_neighbours
    out["em_step"] = one_step
    for components in D.COMPONENTS:
        out[f"fit_{components}"] = _fit(components, False)
    out["fit_mixed_moving"] = _fit("mixed", True)
    out["fit_cont_moving"] = _fit("cont", True)
    for name in X.INDEX_NAMES:
        out[name] = _index(name)
    return out
