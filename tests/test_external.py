import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fixtures import PREDICTED, TRUE, labels
from latticemix.functions.pairs import pair_notation
from latticemix.operators import external as X
from latticemix.plans.evaluation import evaluate_external
from pyspark.sql import functions as F

EXPECTED = {
    "precision": 0.4444444444, "recall": 0.5714285714, "czekanowski_dice": 0.5,
    "rand": 0.7142857143, "rogers_tanimoto": 0.5555555556, "fowlkes_mallows": 0.5039526307,
    "jaccard": 0.3333333333, "kulczynski": 0.5079365079, "mcnemar": 2.4003967926,
    "russel_rao": 0.1428571429, "sokal_sneath1": 0.2, "sokal_sneath2": 0.8333333333,
    "nmi": 0.5468828912, "purity": 0.8055555556,
}


def test_label_fixture(spark):
    got = evaluate_external(labels(spark, TRUE), labels(spark, PREDICTED)).first()
    for name, value in EXPECTED.items():
        assert got[name] == pytest.approx(value, abs=1e-9), name
    assert got.hubert == pytest.approx((28 * 4 - 7 * 9) / (7 * 9 * 19 * 21) ** 0.5)
    assert got.phi == pytest.approx((4 * 16 - 3 * 5) / (7 * 9 * 19 * 21))


def test_published_values_follow_from_pair_counts(spark):
    pairs = spark.createDataFrame(
        [(143474.0, 5026.0, 1391294.0, 2958706.0, 4498500.0)],
        "yy double, yn double, ny double, nn double, nt double",
    ).withColumn("n", F.lit(3000).cast("decimal(38,0)"))
    got = X.indices_from_pairs(
        pairs, ("czekanowski_dice", "fowlkes_mallows", "precision", "recall", "rand")
    ).first()
    assert got.czekanowski_dice == pytest.approx(0.17047077470729557, abs=1e-15)
    assert got.fowlkes_mallows == pytest.approx(0.3005305400847464, abs=1e-15)
    assert got.precision == pytest.approx(0.09348253286490206, abs=1e-15)
    assert got.recall == pytest.approx(0.9661548821548821, abs=1e-15)
    assert got.rand == pytest.approx(0.6896032010670223, abs=1e-15)


def brute_pairs(true, predicted):
    counts = dict.fromkeys(("yy", "yn", "ny", "nn"), 0)
    for i, j in itertools.combinations(range(len(true)), 2):
        counts["ny"[true[i] == true[j]] + "ny"[predicted[i] == predicted[j]]] += 1
    return counts


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("xyz")), min_size=1, max_size=60))
def test_closed_form_equals_all_pairs(spark, rows):
    true, predicted = [r[0] for r in rows], [r[1] for r in rows]
    table = X.contingency(X.align_labels(labels(spark, true), labels(spark, predicted)))
    got = X.pair_counts(table).first()
    want = brute_pairs(true, predicted)
    assert {k: int(got[k]) for k in want} == want
    assert got.nt == len(rows) * (len(rows) - 1) / 2


def test_notation_letters(spark):
    rows = spark.createDataFrame(
        [("a", "x", "a", "x"), ("a", "x", "a", "y"), ("a", "x", "b", "x"), ("a", "x", "b", "y")],
        "t1 string, p1 string, t2 string, p2 string",
    )
    got = rows.select(pair_notation(F.col("t1"), F.col("p1"), F.col("t2"), F.col("p2")).alias("n"))
    assert [r.n for r in got.collect()] == ["yy", "yn", "ny", "nn"]


def test_counts_beyond_bigint_squares(spark):
    big = 5_000_000_000
    table = spark.createDataFrame(
        [("a", "x", big), ("a", "y", big), ("b", "y", big)], "true_label string, pred_label string, n bigint"
    )
    got = X.pair_counts(table).first()
    assert got.yy == pytest.approx(3 * big * (big - 1) / 2, rel=1e-15)
    assert got.yn == pytest.approx(big * big, rel=1e-15)
    assert got.ny == pytest.approx(big * big, rel=1e-15)
    assert got.nn == pytest.approx(big * big, rel=1e-15)


@pytest.mark.parametrize("predicted", [TRUE[:-1], TRUE + ["a"]])
def test_unmatched_labels_fail(spark, predicted):
    with pytest.raises(Exception, match="same ids"):
        X.align_labels(labels(spark, TRUE), labels(spark, predicted)).collect()


def test_repeated_ids_fail(spark):
    twice = labels(spark, TRUE).union(labels(spark, TRUE).filter("id = 0"))
    with pytest.raises(Exception, match="same ids"):
        X.align_labels(twice, labels(spark, PREDICTED)).collect()
    report = X.alignment_report(twice, labels(spark, PREDICTED)).first()
    assert (report.n_true, report.n_pred, report.n_ids, report.n_matched) == (9, 8, 8, 8)


def test_undefined_is_null(spark):
    one = evaluate_external(labels(spark, ["a"]), labels(spark, ["x"])).first()
    assert one.precision is None and one.rand is None and one.nmi is None
    assert one.purity == 1.0


def test_hot_label_gives_the_same_result(spark):
    rows = spark.range(20000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("label"),
    )
    predicted = rows.select("id", F.when(F.col("id") % 3 == 0, "big").otherwise((F.col("id") % 7).cast("string")).alias("label"))
    table = X.contingency(X.align_labels(rows, predicted))
    plain = {(r.true_label, r.pred_label): r.n for r in table.collect()}
    got = X.pair_counts(table).first()
    assert got.yy == sum(n * (n - 1) / 2 for n in plain.values())
