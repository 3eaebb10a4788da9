"""Whitening against a plain version on lists of whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticemix.llm import queries, whitening


def plain(rows, weights="one", components=4):
    """(points, n, sums, covariance) from (key, vector) rows."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    points = [(k, tuple(math.floor(256 * c) for c in v)) for k, v in kept]
    copies = {}
    for _, p in points:
        copies[p] = copies.get(p, 0) + 1
    fit = {p: c if weights == "counts" else 1 for p, c in copies.items()}
    n = sum(fit.values())
    sums = [sum(w * p[i] for p, w in fit.items()) for i in range(len(points[0][1]))]
    centred = np.array([[(n * x - s) / n for x, s in zip(p, sums)] for p in fit])
    v = (centred * np.array(list(fit.values()))[:, None]).T @ centred / n
    return points, n, sums, v


def compare(got, rows, weights="one", rtol=1e-7):
    points, n, sums, v = plain(rows, weights)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(4, len(sums))
    assert len(got) == k * len(points)
    flips = {}
    for c in range(1, k + 1):
        want = {}
        for key, p in points:
            want.setdefault(key, []).append(
                (sum((n * x - s) ** 2 for x, s in zip(p, sums)), sum((x - s / n) * a for x, s, a in zip(p, sums, axes[:, c - 1])) / math.sqrt(values[c - 1]))
            )
        mine = [r for r in got if r.component == c]
        first = max(mine, key=lambda r: abs(r.whitened))
        flips[c] = np.sign(first.whitened * max((w for x in want.values() for w in x), key=lambda w: abs(w[1]))[1])
        have = {}
        for r in mine:
            assert r.n == n and abs(r.explained - values[c - 1] / np.trace(v)) < 1e-9 and r.identity_error < 1e-6
            have.setdefault(r.vec_id, []).append((r.deviation, r.whitened * flips[c]))
        assert have.keys() == want.keys()
        for key in want:
            for (d1, w1), (d2, w2) in zip(sorted(have[key]), sorted(want[key])):
                assert d1 == d2 and math.isclose(w1, w2, rel_tol=rtol, abs_tol=1e-7)


def test_query_equals_the_plain_version(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(queries.op11_whitening(spark, sf_dir).collect(), rows)


def odd_rows():
    rng = np.random.default_rng(1)
    scale = np.array([9.0, 5.0, 3.0, 2.0, 1.0, 0.5])
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a third of all rows and more
    rows += [(2000 + i, rows[i][1]) for i in range(20)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    bad = [None, [None] * 6, [1.0] * 5 + [None], [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5]
    return rows + [(3000 + i, b) for i, b in enumerate(bad)] + [(4000, [-0.0, 0.0, -0.001, 0.001, 0.0, 0.0])]


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_copies_nulls_and_clashing_names(spark, weights):
    docs = spark.createDataFrame(odd_rows(), "vec_id long, embedding array<double>").repartition(5)
    for name in ("point", "copies", "weight", "component", "n", "deviation", "vector"):
        docs = docs.withColumn(name, F.lit("taken"))
    got = whitening.whiten_vectors(docs, counted=weights == "counts").collect()
    compare(got, odd_rows(), weights)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * [3e6, 2e6, 1e6]).tolist()) for i in range(50)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    points, n, sums, _ = plain(rows)
    want = {k: sum((n * x - s) ** 2 for x, s in zip(p, sums)) for k, p in points}
    got = whitening.whiten_vectors(docs).collect()
    assert {r.vec_id: r.deviation for r in got} == {k: v if v < 1 << 63 else None for k, v in want.items()}
    far = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whitening.whiten_vectors(far).collect()} == {(0, None), (1, None)}


def test_no_spread_no_rows_and_unequal_widths(spark):
    kind = "vec_id long, embedding array<float>"
    one = whitening.whiten_vectors(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one)] == [(1, 1, 0, None, None), (2, 1, 0, None, None)] * 2
    line = whitening.whiten_vectors(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], kind)).collect()
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component == 2)
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in line if r.component == 1)
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten_vectors(spark.createDataFrame(rows, kind)).count() == 0
    with pytest.raises(Exception, match="unequal widths"):
        whitening.whiten_vectors(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], kind)).count()
