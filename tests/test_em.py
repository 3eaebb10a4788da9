import numpy as np
import pytest

from fixtures import tiny_model, tiny_points
from latticemix.cells import CellModel, temperature_at
from latticemix.operators import updates as U
from latticemix.operators.posterior import assign_by_cell, assign_by_winner
from latticemix.plans.em import em_step, fit

EXPECTED = {
    # iteration, update_continuous: loglik, prob, eps, mean 0, mean 1, variance
    (1, False): (-15.912702786, (0.256611674, 0.243388326), (0.107508083, 0.04616986),
                 (0.103160348, 0.098514257), (0.132211949, 0.843276119), (0.008905656, 0.030092007)),
    (2, False): (-13.488696327, (0.366798098, 0.133201902), (0.108699072, 0.015556303),
                 (0.1011187, 0.098863001), (0.104967157, 0.872704251), (0.007273051, 0.011050853)),
    (2, True): (-1.559933913, (0.371986253, 0.128013747), (0.111093182, 0.000089118),
                (0.099999462, 0.099991663), (0.100011935, 0.899825168), (0.006666815, 0.000065379)),
}


@pytest.mark.parametrize("update", [False, True])
def test_tiny_trajectory(spark, update):
    fitted = fit(tiny_points(spark), tiny_model(), max_iter=2, update_continuous=update)
    for step in fitted.steps:
        want = EXPECTED[(step.iteration, update and step.iteration == 2)]
        got = step.computed
        assert step.log_likelihood == pytest.approx(want[0], abs=1e-8)
        for part, (edge, inner) in ((got.prob, want[1]), (got.bin_epsilon, want[2]), (got.cont_variance, want[5])):
            assert part == pytest.approx([edge, inner, inner, edge], abs=1e-8)
        assert got.cont_mean[0] == pytest.approx(want[3], abs=1e-8)
        assert got.cont_mean[1] == pytest.approx(want[4], abs=1e-8)
        assert got.bin_mean.tolist() == [[0, 0, 0], [0, 1, 1], [1, 0, 0], [1, 1, 1]]
        assert got.num_items.tolist() == [3, 1, 1, 3]
    if not update:
        assert np.array_equal(fitted.cells.cont_mean, tiny_model().cont_mean)
    labelled = fitted.training_labels(tiny_points(spark)).orderBy("id").collect()
    assert [r.cell for r in labelled] == [0, 0, 0, 3, 3, 3, 1, 2]


@pytest.mark.parametrize("prior", ["updated", "current"])
@pytest.mark.parametrize("assign", ["cell", "winner"])
def test_label_variants(spark, prior, assign):
    fitted = fit(tiny_points(spark), tiny_model(), max_iter=2, label_prior=prior, assign=assign)
    labelled = fitted.training_labels(tiny_points(spark)).orderBy("id").collect()
    assert [r.cell for r in labelled] == [0, 0, 0, 3, 3, 3, 1, 2]


@pytest.mark.parametrize("components", ["mixed", "cont", "bin"])
def test_single_updates_equal_the_fused_step(spark, components):
    points, model, t = tiny_points(spark), tiny_model(), temperature_at(1, 2)
    got = em_step(points, model, t, components=components).computed
    scored = U.score_for_updates(points, model, t, components)
    by_cell = lambda df, name: [r[name] for r in df.orderBy("cell").collect()]
    assert by_cell(U.update_prior(scored), "prob") == pytest.approx(got.prob.tolist(), abs=1e-12)
    assert by_cell(U.items_per_cell(scored), "num_items") == got.num_items.tolist()
    if components != "bin":
        means = by_cell(U.update_cont_mean(scored, 2), "cont_mean")
        assert np.allclose(means, got.cont_mean, atol=1e-12)
        variance = by_cell(U.update_cont_variance(scored, means), "cont_variance")
        assert variance == pytest.approx(got.cont_variance.tolist(), abs=1e-12)
    if components != "cont":
        assert by_cell(U.update_bin_prototype(scored, 3), "bin_mean") == got.bin_mean.tolist()
        assert by_cell(U.update_bin_epsilon(scored, 3), "bin_epsilon") == pytest.approx(
            got.bin_epsilon.tolist(), abs=1e-12
        )


def test_partition_count_does_not_matter(spark):
    model = tiny_model()
    results = [em_step(tiny_points(spark).repartition(n), model, 0.7).computed for n in (1, 3, 20)]
    for other in results[1:]:
        assert np.allclose(other.cont_mean, results[0].cont_mean, atol=1e-12)
        assert np.allclose(other.prob, results[0].prob, atol=1e-12)


def test_ties_count_for_every_cell_and_label_takes_the_first(spark):
    points = spark.createDataFrame([(0, [0.5, 0.5], [])], "id bigint, x array<double>, b array<int>")
    model = CellModel.initial(2, 2)
    step = em_step(points, model, 1.0, components="cont")
    assert step.cells.num_items.sum() == 4
    assert assign_by_cell(points, model, 1.0, "cont").first().cell == 0
    assert assign_by_winner(points, model, 1.0, "cont").first().cell == 0


def test_uncached_training_and_default_start(spark):
    points = tiny_points(spark)
    cached = fit(points, rows=2, cols=2, max_iter=2, seed=3)
    plain = fit(points, rows=2, cols=2, max_iter=2, seed=3, cache=False)
    assert cached.cells.bin_size == 3
    assert np.allclose(cached.cells.prob, plain.cells.prob, atol=1e-12)


def test_a_cell_on_a_single_point_stays_finite(spark):
    rows = [(i, [0.1 + 0.001 * i, 0.1], []) for i in range(20)] + [(20, [0.9, 0.9], [])]
    points = spark.createDataFrame(rows, "id bigint, x array<double>, b array<int>")
    fitted = fit(points, CellModel.initial(2, 2), max_iter=12, components="cont", update_continuous=True)
    cells = fitted.cells
    assert np.isfinite(cells.cont_mean).all() and np.isfinite(cells.prob).all()
    assert (cells.cont_variance >= 0).all() and cells.prob.sum() == pytest.approx(1.0)
    # Two passes over numpy give the same variances.
    last = fitted.steps[-1]
    from latticemix.operators import posterior as P

    start = fitted.steps[-2].cells
    x = np.array([r[1] for r in rows])
    p = P.task_values(start, last.temperature, "cont")
    log_d, _ = P.log_density(np.ascontiguousarray(x.T), None, p)
    weight, _, _ = P.weights(log_d, p)
    mean = weight @ x / weight.sum(axis=1, keepdims=True)
    sq = ((x[None] - mean[:, None]) ** 2).sum(axis=2)
    variance = (weight * sq).sum(axis=1) / (2 * weight.sum(axis=1))
    assert np.allclose(last.computed.cont_variance, variance, rtol=1e-6, atol=1e-25)


def test_predict_labels_a_stream(spark, tmp_path):
    points = tiny_points(spark)
    fitted = fit(points, tiny_model(), max_iter=2)
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    query = (
        fitted.predict(stream)
        .select("id", "cell")
        .writeStream.format("memory")
        .queryName("labelled_stream")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.table("labelled_stream").orderBy("id").collect()
    assert [r.cell for r in got] == [r.cell for r in fitted.predict(points).orderBy("id").collect()]


def test_rejects_bad_input(spark):
    with pytest.raises(ValueError):
        fit(tiny_points(spark), tiny_model(), max_iter=1)
    ragged = spark.createDataFrame(
        [(0, [0.0], [0, 0, 0]), (1, [0.0, 0.0, 0.0], [0, 0, 0])], "id bigint, x array<double>, b array<int>"
    )
    with pytest.raises(Exception, match="exactly 2 values"):
        em_step(ragged, tiny_model(), 1.0)
    with pytest.raises(ValueError, match="no rows"):
        em_step(tiny_points(spark).filter("id < 0"), tiny_model(), 1.0)


def test_random_start_is_seeded():
    one, two, other = (CellModel.initial(3, 3, bin_size=12, seed=s) for s in (1, 1, 2))
    assert np.array_equal(one.bin_mean, two.bin_mean)
    assert np.array_equal(one.bin_epsilon, two.bin_epsilon)
    assert not np.array_equal(one.bin_mean, other.bin_mean)
    assert set(np.unique(one.bin_mean)) <= {0, 1}
    wide = CellModel.initial(3, 3, cont_size=5)
    assert wide.cont_mean.shape == (9, 5) and (wide.cont_mean >= 0).all() and (wide.cont_mean < 1).all()


def test_cells_round_trip(spark):
    model = tiny_model()
    back = CellModel.from_dataframe(model.to_dataframe(spark))
    assert np.array_equal(back.cont_mean, model.cont_mean)
    assert np.array_equal(back.bin_mean, model.bin_mean)
    assert np.array_equal(back.prob, model.prob)
