"""Input that must fail, and runs that broke off."""

import pytest
from pyspark.sql import functions as F

from fixtures import tiny_model, tiny_points
from latticemix.cells import CellModel
from latticemix.operators import density as D
from latticemix.operators import internal as I
from latticemix.operators import prep
from latticemix.operators import updates as U
from latticemix.operators.posterior import assign_by_cell
from latticemix.plans.em import fit
from latticemix.plans.evaluation import evaluate_internal
from latticemix.session import new_path
from latticemix.sources import trajectory as store


def wide_rows(spark, width, bad):
    rows = [(i, [float(i + j) for j in range(width)], "a") for i in range(3)]
    rows.append((3, bad, "b"))
    return spark.createDataFrame(rows, "id bigint, x array<double>, label string")


@pytest.mark.parametrize("width", [2, 128, 129])
@pytest.mark.parametrize("off", [1, -1, None])
def test_other_widths_fail_alike(spark, width, off):
    bad = None if off is None else [0.5] * (width + off)
    rows = wide_rows(spark, width, bad)
    model = CellModel.initial(1, 2, cont_size=width)
    scored = rows.withColumn("log_p_cell", F.array(F.lit(-0.5), F.lit(-0.5)))
    forms = (
        prep.minmax_normalize(rows, width),
        I.cluster_centers(rows, width),
        D.log_gaussian_cells(rows, model),
        U.update_cont_mean(scored, width),
        assign_by_cell(rows, model, 1.0, "cont"),
    )
    for form in forms:
        with pytest.raises(Exception, match=f"every vector needs exactly {width} values, none NULL"):
            form.collect()
    with pytest.raises(Exception, match=f"exactly {width} values"):
        I.cluster_scatter(rows, width).collect()


def test_labels_must_match_and_be_there(spark):
    points = tiny_points(spark)
    few = spark.createDataFrame([(0, "a"), (1, "b")], "id bigint, label string")
    with pytest.raises(Exception, match="same ids"):
        evaluate_internal(points, few, 2).collect()
    rows = points.select("id", "x", F.when(F.col("id") > 0, F.lit("a")).alias("label"))
    for form in (I.cluster_sizes, lambda r: I.cluster_centers(r, 2), I.distance_sums, I.silhouette_rows):
        with pytest.raises(Exception, match="needs a label"):
            form(rows).collect()


def test_variance_of_a_cell_without_weight(spark):
    scored = spark.createDataFrame(
        [(0, [1.0, 2.0], [0.0, float("-inf")])], "id bigint, x array<double>, log_p_cell array<double>"
    )
    means = [r.cont_mean for r in U.update_cont_mean(scored, 2).orderBy("cell").collect()]
    assert means == [[1.0, 2.0], [None, None]]
    got = U.update_cont_variance(scored, means).orderBy("cell").collect()
    assert [r.cont_variance for r in got] == [0.0, None]


SETTINGS = {"max_iter": 3, "update_continuous": True, "label_every": 1}


def test_a_run_that_broke_off_loses_nothing(spark):
    points, whole, broken = tiny_points(spark), new_path(spark, "run"), new_path(spark, "run")
    fitted = fit(points, tiny_model(), output_path=whole, resume=True, **SETTINGS)  # no run yet
    # labels of 2 are there, its cells only begun, the last iteration is missing
    store.write_settings(spark, broken, store.read_settings(spark, whole))
    for t, model in ((0, tiny_model()), (1, fitted.steps[0].cells)):
        store.write_cells(spark, broken, t, model)
    for t in (1, 2):
        store.write_labels(store.read_labels(spark, whole, t), broken, t)
    begun = spark._jvm.org.apache.hadoop.fs.Path(f"{broken}/cells/iteration=2/_temporary")
    begun.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(begun)
    rest = fit(points, output_path=broken, resume=True, **SETTINGS)
    assert [s.iteration for s in rest.steps] == [2, 3]
    assert store.committed_iterations(spark, broken) == [0, 1, 2, 3]
    key = lambda df: sorted((r.iteration, r.id, r.cell) for r in df.select("iteration", "id", "cell").collect())
    assert key(store.read_labels(spark, broken)) == key(store.read_labels(spark, whole))
    # complete: the model comes back, other settings are refused
    again = fit(points, output_path=broken, resume=True, **SETTINGS)
    assert not again.steps and (again.cells.prob == rest.cells.prob).all()
    assert (again.label_cells.prob == rest.label_cells.prob).all() and again.temperature == rest.temperature
    with pytest.raises(ValueError, match="max_iter"):
        fit(points, output_path=broken, resume=True, **SETTINGS | {"max_iter": 5})
    moved = tiny_model().with_values(prob=tiny_model().prob[::-1] * 2)
    with pytest.raises(ValueError, match="start"):
        fit(points, moved, output_path=whole, resume=True, **SETTINGS)
    assert not fit(points, tiny_model(), output_path=whole, resume=True, **SETTINGS).steps
    drawn = new_path(spark, "run")
    fit(points, rows=2, cols=3, seed=4, output_path=drawn, **SETTINGS)
    assert not fit(points, rows=2, cols=3, seed=4, output_path=drawn, resume=True, **SETTINGS).steps
    with pytest.raises(ValueError, match="start"):
        fit(points, rows=2, cols=3, seed=5, output_path=drawn, resume=True, **SETTINGS)


def test_a_large_grid_trains(spark):
    fitted = fit(tiny_points(spark), CellModel.initial(100, 100), max_iter=2, components="cont")
    assert fitted.cells.prob.sum() == pytest.approx(1.0)


def test_factors_are_the_neighbourhood():
    import numpy as np

    model = CellModel.initial(3, 4)
    by_row, by_col = model.neighborhood_factors(0.7)
    assert np.allclose(np.kron(by_row, by_col), model.neighborhood(0.7), atol=1e-15)


@pytest.mark.parametrize("labels", [100, 300])
def test_each_label_is_passed_on_once(spark, labels):
    rows = spark.range(900).select(
        "id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("x"), (F.col("id") % labels).cast("string").alias("label")
    )
    assert I.distance_sums(rows, 400).count() == 900 * labels


def test_silhouette_of_offset_rows(spark):
    import numpy as np

    x = 1e7 + np.random.default_rng(5).random((60, 12))
    names = ["a" if i % 2 else "b" for i in range(60)]
    rows = spark.createDataFrame([(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, names))], "id bigint, x array<double>, label string")
    moved = rows.withColumn("x", F.transform("x", lambda v: v - 1e7))
    assert I.silhouette(rows).first()[0] == pytest.approx(I.silhouette(moved).first()[0], abs=1e-6)


def test_wide_vectors_keep_their_results(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    for width in (128, 129, 1000):
        x = rng.random((6, width))
        names = list("aabbcc")
        rows = spark.createDataFrame([(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, names))], "id bigint, x array<double>, label string")
        got = {r.label: (r.n, r.center) for r in I.cluster_profile(rows, width).collect()}
        for k, name in enumerate("abc"):
            assert got[name][0] == 2 and got[name][1] == pytest.approx(x[2 * k : 2 * k + 2].mean(axis=0).tolist())
        scaled = np.array([r.x for r in prep.minmax_normalize(rows, width).orderBy("id").collect()])
        assert np.allclose(scaled, (x - x.min(0)) / (x.max(0) - x.min(0)))


@pytest.mark.parametrize("width", [128, 129, 600])
def test_wide_updates(spark, width):
    import time

    import numpy as np

    rng = np.random.default_rng(width)
    k, n = 25, 20
    log_p = np.log(rng.dirichlet(np.ones(k), n))
    log_p[:, 3] = -np.inf  # a cell without weight
    x, b = rng.random((n, width)), rng.integers(0, 2, (n, width))
    rows = [(i, u.tolist(), v.tolist(), p.tolist()) for i, (u, v, p) in enumerate(zip(x, b, log_p))]
    scored = spark.createDataFrame(rows, "id bigint, x array<double>, b array<int>, log_p_cell array<double>")
    p = np.exp(log_p)
    start = time.perf_counter()
    got = {f.__name__: f(scored, width).orderBy("cell").collect() for f in (U.update_cont_mean, U.update_bin_prototype, U.update_bin_epsilon)}
    assert time.perf_counter() - start < 20
    ones, zeros = p.T @ b, p.T @ (1 - b)
    for c in range(k):
        mean, proto, eps = (got[f][c][1] for f in ("update_cont_mean", "update_bin_prototype", "update_bin_epsilon"))
        if c == 3:
            assert mean == [None] * width and proto == [0] * width and eps is None
            continue
        assert np.allclose(mean, p[:, c] @ x / p[:, c].sum()) and proto == (zeros[c] < ones[c]).astype(int).tolist()
        assert eps == pytest.approx(np.minimum(zeros[c], ones[c]).sum() / (width * p[:, c].sum()))
    assert U.update_cont_mean(scored.limit(0), width).count() == 0


def test_tasks_follow_the_bytes():
    from latticemix.plans.em import TASK_BYTES, TASKS_PER_CORE, planned_tasks

    assert planned_tasks(10**14, 10**5, 10**6, cores=2) == -(-(10**14) // TASK_BYTES)  # cores not known yet
    assert planned_tasks(10**14, 32 * 10**6, 10**6, cores=2) < 200_000  # large models are sent less often
    assert planned_tasks(10**6, 10**5, 10**4, cores=8) == 8 * TASKS_PER_CORE
    assert planned_tasks(10**6, 10**5, 3, cores=8) == 3


@pytest.mark.parametrize("partitions", [1, 40, 1200])
def test_partials_add_up_over_a_tree(spark, partitions):
    import numpy as np

    from latticemix.operators.partials import add_up

    def partial(batches):
        ids = [i for b in batches for i in b.column("id").to_pylist()]
        return np.array([[len(ids), sum(ids)]], float) if ids else None

    assert add_up(spark.range(0, 3000, 1, partitions), partial, partitions).tolist() == [[3000.0, 3000 * 2999 / 2]]
    assert add_up(spark.range(0), partial, 8) is None
