import pytest
from pyspark.sql import functions as F

from fixtures import tiny_model, tiny_points
from latticemix.cells import temperature_at
from latticemix.functions import density as DF
from latticemix.functions import lattice as L
from latticemix.functions import reduce as R
from latticemix.functions import vectors as V
from latticemix.operators import density as D
from latticemix.operators import posterior as P
from latticemix.operators import prep


def points(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id bigint, x array<double>")


def test_normalize_uses_all_rows_and_constant_is_null(spark):
    df = points(spark, [[1.0, 5.0], [3.0, 5.0], [2.0, 5.0]])
    got = prep.first_n(prep.minmax_normalize(df, 2), 2).orderBy("id").collect()
    assert [r.x for r in got] == [[0.0, None], [1.0, None]]


def test_bits(spark):
    df = spark.createDataFrame([(0,), (1,), (30,)], "n int")
    got = [r.b for r in prep.int_to_bits(df, "n").orderBy("n").collect()]
    assert ["".join(map(str, b)) for b in got] == [format(n * 20, "020b") for n in (0, 1, 30)]
    jittered = prep.int_to_bits(spark.createDataFrame([(i,) for i in range(1, 200)], "n int"), "n", jitter=True)
    off = [int("".join(map(str, r.b)), 2) - 20 * r.n for r in jittered.collect()]
    assert set(off) == set(range(-7, 8))
    with pytest.raises(Exception, match="non-negative"):
        prep.int_to_bits(spark.createDataFrame([(-1,)], "n int"), "n").collect()


def test_vectors_agree_in_both_forms(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0, 4.0], [0.0, 4.0, 4.0], [1, 0, 1], [0, 0, 1])], "x array<double>, y array<double>, b array<int>, c array<int>"
    )
    for width in (3, None):
        got = df.select(
            V.squared_distance(F.col("x"), F.col("y"), width).alias("sq"),
            V.euclidean(F.col("x"), F.col("y"), width).alias("e"),
            V.hamming(F.col("b"), F.col("c"), width).alias("h"),
        ).first()
        assert (got.sq, got.e, got.h) == (5.0, pytest.approx(5**0.5), 1.0)
    got = df.select(R.argmax_first(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("m")).first()
    assert got.m == 1


def test_densities(spark):
    import math

    one = spark.range(1).select(F.lit(0.3).alias("sq"), F.lit(0.2).alias("v"), F.lit(2.0).alias("h"))
    got = one.select(
        DF.log_gaussian(F.col("sq"), 3, F.col("v")).alias("g"),
        DF.log_gaussian_scaled(F.col("sq"), 3, F.col("v")).alias("s"),
        DF.gaussian_density(F.col("sq"), 3, F.col("v")).alias("d"),
        DF.log_bernoulli(F.col("h"), 5, F.lit(0.0)).alias("b0"),
        DF.log_bernoulli(F.col("h"), 5, F.lit(1.0)).alias("b1"),
    ).first()
    assert got.g == pytest.approx(-0.5 * 0.3 / 0.2 - 1.5 * math.log(2 * math.pi * 0.2))
    assert got.s == pytest.approx(-1.5 * math.log(2 * math.pi * math.sqrt(0.2)) - 0.5 * 0.3 / 9 / 0.2)
    assert got.d == pytest.approx((2 * math.pi * 0.2) ** -1.5 * math.exp(-0.3 / (2 * 0.04)))
    assert got.b0 == pytest.approx(2 * math.log(1e-30))
    assert math.isfinite(got.b1)


def test_grid_and_schedule(spark):
    steps = D.annealing_schedule(spark, 10).orderBy("iteration").collect()
    assert [r.temperature for r in steps] == pytest.approx([temperature_at(t, 10) for t in range(1, 11)])
    assert steps[0].temperature < 10 and steps[8].temperature == pytest.approx(1.0)
    assert steps[9].temperature < 1.0
    near = tiny_model().neighborhood(0.5)
    for r in D.neighborhood(spark, 2, 2, 0.5).collect():
        assert r.weight == pytest.approx(near[r.cell_star, r.cell])
    with pytest.raises(ValueError):
        L.temperature(F.lit(1), 1)


@pytest.mark.parametrize("components", ["mixed", "cont", "bin"])
def test_column_form_equals_arrow_form(spark, components):
    df, model = tiny_points(spark), tiny_model()
    by_column = {(r.id, r.cell): r.value for r in D.log_mixed_density(df, model, components).collect()}
    scored = P.with_posterior(df, model, 0.7, components=components, want=P.VECTORS + ("log_px",))
    for r in scored.collect():
        assert r.log_px_cell == pytest.approx([by_column[r.id, c] for c in range(4)])
    # Posteriors sum to one, and the joint's margins are the posteriors.
    sums = scored.select(
        R.logsumexp(F.col("log_p_cell")).alias("c"), R.logsumexp(F.col("log_p_winner")).alias("w")
    ).collect()
    assert all(r.c == pytest.approx(0, abs=1e-12) and r.w == pytest.approx(0, abs=1e-12) for r in sums)
    joint = P.joint_posterior(df, model, 0.7, components)
    margin = joint.groupBy("id", "cell").agg(F.ln(F.sum(F.exp("log_p"))).alias("v"))
    want = {(r.id, r.cell): r.value for r in P.long_form(scored, "log_p_cell").collect()}
    assert {(r.id, r.cell): r.v for r in margin.collect()} == pytest.approx(want)


def test_rows_are_scored_once(spark):
    df = P.with_posterior(tiny_points(spark), tiny_model(), 1.0)
    plan = P.long_form(df, "log_p_cell")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
