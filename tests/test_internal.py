import numpy as np
import pyarrow as pa
import pytest

from fixtures import PREDICTED, X
from latticemix.operators import ball_tree as B
from latticemix.operators import distance_tree as D
from latticemix.operators import internal as I
from latticemix.operators import label_files as L


def labelled(spark, x=X, names=PREDICTED):
    return spark.createDataFrame(
        [(i, list(map(float, p)), l) for i, (p, l) in enumerate(zip(x, names))],
        "id bigint, x array<double>, label string",
    )


def brute_silhouette(x, names):
    x, names = np.asarray(x, float), np.asarray(names)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    means = []
    for label in sorted(set(names)):
        widths = []
        for i in np.flatnonzero(names == label):
            own = (names == label).sum() - 1
            if own == 0 or len(set(names)) == 1:
                continue
            a = dist[i, names == label].sum() / own
            b = min(dist[i, names == o].mean() for o in set(names) - {label})
            widths.append((b - a) / max(a, b))
        means.append(np.mean(widths) if widths else 0.0)
    return means


def test_fixture(spark):
    rows = labelled(spark)
    centers = {r.label: r.center for r in I.cluster_centers(rows, 2).collect()}
    assert centers["0"] == pytest.approx([0.333333333, 0.1], abs=1e-9)
    assert centers["1"] == pytest.approx([0.725, 0.7], abs=1e-9)
    assert centers["2"] == pytest.approx([0.1, 0.9], abs=1e-9)
    scatter = {r.label: r.scatter for r in I.cluster_scatter(rows, 2).collect()}
    assert scatter == pytest.approx({"0": 0.389511996, "1": 0.404846997, "2": 0.0}, abs=1e-9)
    assert I.davies_bouldin(rows, 2).first()[0] == pytest.approx(0.9447344059, abs=1e-9)
    widths = {r.label: r.width for r in I.silhouette_by_cluster(rows).collect()}
    assert widths == pytest.approx({"0": 0.1832913044, "1": 0.1288321497, "2": 0.0}, abs=1e-9)
    both = I.internal_indices(rows, 2).first()
    assert both.silhouette == pytest.approx(0.1040411514, abs=1e-9)
    assert both.davies_bouldin == pytest.approx(0.9447344059, abs=1e-9)


@pytest.mark.parametrize("width", [2, 12])
@pytest.mark.parametrize("block_rows", [7, 40, 10_000])
def test_silhouette_equals_brute_force(spark, width, block_rows):
    rng = np.random.default_rng(width)
    x = rng.random((150, width))
    x[3] = x[4]  # equal rows
    names = np.where(rng.random(150) < 0.4, "hot", rng.integers(0, 9, 150).astype(str))
    got = I.silhouette_by_cluster(labelled(spark, x.tolist(), names.tolist()), block_rows)
    assert [r.width for r in got.orderBy("label").collect()] == pytest.approx(
        brute_silhouette(x, names), abs=1e-9
    )


def test_far_clusters_are_not_looked_through(spark):
    rng = np.random.default_rng(3)
    centers = rng.random((20, 5)) * 100
    x = np.concatenate([c + rng.normal(size=(30, 5)) for c in centers])
    names = np.repeat([f"c{i}" for i in range(20)], 30)
    rows = labelled(spark, x.tolist(), names.tolist())
    found = I.silhouette_rows(rows).collect()
    looked = sum(r.looked for r in found)
    assert len(x) <= looked < 0.1 * len(x) * 20
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in found:
        means = {c: dist[r.id, names == c].mean() for c in set(names) - {r.label}}
        assert r.b == pytest.approx(min(means.values()))
        assert r.a == pytest.approx(dist[r.id, names == r.label].sum() / 29)


def test_rows_are_shuffled_once_whatever_they_meet(spark):
    """The evaluating job reads files: its plan has no exchange but the dealing of row ranges."""
    rng = np.random.default_rng(4)
    rows = labelled(spark, rng.random((400, 3)).tolist(), [str(i % 7) for i in range(400)])
    plan = I.distance_sums(rows, block_rows=10)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD" in plan
    total = I.distance_sums(rows, block_rows=10).groupBy("id").sum("n").collect()
    assert len(total) == 400 and {r[1] for r in total} == {400}


@pytest.mark.parametrize("block_rows", [7, 300])
def test_distance_sums_and_own_sums(spark, block_rows):
    rng = np.random.default_rng(6)
    x, names = rng.random((90, 9)), rng.integers(0, 5, 90).astype(str)
    rows = labelled(spark, x.tolist(), names.tolist())
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in I.distance_sums(rows, block_rows).collect():
        assert r.sum_dist == pytest.approx(dist[r.id, names == r.other_label].sum()) and r.label == names[r.id]
    for r in I.within_cluster_distance(rows, block_rows).collect():
        assert r.sum_dist == pytest.approx(dist[r.id, names == r.label].sum())


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_davies_bouldin_of_many_clusters(spark, block_rows):
    rng = np.random.default_rng(0)
    table = [(str(i), float(s), c.tolist()) for i, (s, c) in enumerate(zip(rng.random(40), rng.random((40, 3))))]
    scatters = spark.createDataFrame(table, "label string, scatter double, center array<double>")
    got = {r.label: r.similarity for r in I.cluster_similarities(scatters, block_rows).collect()}
    for name, s, c in table:
        want = max(
            (s + s2) / np.linalg.norm(np.subtract(c, c2)) for other, s2, c2 in table if other != name
        )
        assert got[name] == pytest.approx(want)


def ratios(x, scatter, i):
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (scatter[i] + scatter) / np.sqrt(((x - x[i]) ** 2).sum(1))
    found[i] = -np.inf
    return found.max()


@pytest.mark.parametrize("width", [1, 3, 20])
def test_the_ball_tree_finds_every_maximum(spark, width):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(size=(300, width)), 50 + rng.normal(size=(190, width))])
    x[10] = x[11]  # coincident centres, one pair with scatters and one without
    x[20] = x[21]
    scatter = rng.random(len(x))
    scatter[[20, 21, 30]] = 0
    table = [(i, float(s), c.tolist()) for i, (s, c) in enumerate(zip(scatter, x))]
    rows = spark.createDataFrame(table, "label int, scatter double, center array<double>").repartition(4)
    for leaf in (7, 1000):
        got = {r.label: r.similarity for r in B.largest_ratios(rows, leaf).collect()}
        for i in range(len(x)):
            want = ratios(x, scatter, i)
            assert got[i] == pytest.approx(want, rel=1e-9, nan_ok=True)
    assert np.isnan(got[20]) and np.isinf(got[10])
    assert B.largest_ratios(rows.limit(0)).count() == 0


def test_many_clusters_need_few_pairs(spark):
    rng = np.random.default_rng(7)
    n = 100_000
    x, scatter = rng.random((n, 2)), 0.002 * (1 + rng.random(n))
    arrow = pa.table({"label": np.arange(n), "scatter": scatter, "center": pa.array(list(x))})
    rows = spark.createDataFrame(arrow).repartition(8)
    got = B.largest_ratios(rows).collect()
    assert sum(r.pairs for r in got) < 0.02 * n * n
    best = {r.label: r.similarity for r in got}
    for i in rng.choice(n, 500, replace=False).tolist():
        assert best[i] == pytest.approx(ratios(x, scatter, i), rel=1e-9)


def test_degenerate_clusters(spark):
    one = labelled(spark, X, ["a"] * 8)
    got = I.internal_indices(one, 2).first()
    assert got.silhouette == 0.0 and got.davies_bouldin is None
    same = labelled(spark, [[0, 0]] * 4, ["a", "a", "b", "b"])
    got = I.internal_indices(same, 2).first()
    assert got.silhouette is None and got.davies_bouldin is None
    singles = labelled(spark, X, [str(i) for i in range(8)])
    assert I.silhouette(singles).first()[0] == 0.0


def test_many_labels_are_joined_in_two_parts(spark, monkeypatch):
    x = np.random.default_rng(1).random((300, 2)).tolist()
    names = ["hot" if i % 3 == 0 else f"l{i % 40}" for i in range(300)]
    rows = labelled(spark, x, names)
    profile = I.materialize(I.cluster_profile(rows, 2))
    want = {r.id: r.center for r in I.attach_center(rows, profile, 2).collect()}
    scatter = {r.label: r.scatter for r in I.cluster_scatter(rows, 2).collect()}
    monkeypatch.setattr(I, "MAX_BROADCAST_VALUES", 100)  # 41 labels x 3 values
    monkeypatch.setattr(I, "HOT_SHARE", 10)
    split = I.attach_center(rows, profile, 2)
    assert "SortMergeJoin" in split._jdf.queryExecution().toString()
    assert {r.id: r.center for r in split.collect()} == want
    assert split.count() == 300
    assert {r.label: r.scatter for r in I.cluster_scatter(rows, 2).collect()} == pytest.approx(scatter)


def points_of_kind(kind, n, rng):
    plane = np.column_stack([rng.exponential(0.1, n), rng.integers(0, 24, n) / 23])
    if kind == "equal rows":
        return plane[rng.integers(0, 40, n)]
    if kind == "one row":
        return np.full((n, 2), 0.1)
    if kind == "offset":
        return 1e4 + rng.random((n, 2))
    if kind == "mixed":
        return np.hstack([plane, np.eye(5)[rng.integers(0, 5, n)]])
    return plane if kind == "plane" else rng.random((n, int(kind)))


@pytest.mark.parametrize("kind", ["plane", "equal rows", "one row", "offset", "mixed", "1", "3", "12"])
def test_sums_by_boxes_equal_sums_one_by_one(kind):
    rng = np.random.default_rng(11)
    x = points_of_kind(kind, 6000, rng)
    order, boxes = D.build(x, 300)
    assert sorted(order) == list(range(6000))
    x = x[order]
    got, measured = np.zeros(len(x)), 0

    def one_by_one(targets, points, weights):
        nonlocal measured
        measured += len(targets) * len(points)
        return L._measured(targets, points, weights)

    for group in D.groups(x, 300):
        got[group] = D.sums(x[group], boxes, 0, lambda ranges: L._blocks(x, ranges), one_by_one)
    assert got == pytest.approx(L._measured(x, x), rel=1e-10)
    if kind == "one row":
        assert not got.any()
    if kind not in ("3", "12"):  # in these, 6000 rows are all near
        assert measured < 0.7 * len(x) ** 2


def test_a_row_without_bounds_stays_visible():
    x = points_of_kind("plane", 2000, np.random.default_rng(2))
    x[7, 1], x[9, 0] = np.nan, np.inf
    order, boxes = D.build(x, 300)
    x = x[order]
    with np.errstate(invalid="ignore"):
        got = D.sums(x[:50], boxes, 0, lambda ranges: L._blocks(x, ranges), L._measured)
    assert np.isnan(got).all()


@pytest.mark.parametrize("kind", ["plane", "mixed"])
def test_silhouette_of_long_clusters_measures_few_pairs(spark, monkeypatch, kind):
    x = points_of_kind(kind, 9000, np.random.default_rng(4))
    names = ["long"] * 8000 + ["short"] * 1000
    rows = labelled(spark, x.tolist(), names)
    found = {r.id: r for r in I.silhouette_rows(rows, 700).collect()}
    for i in (0, 4000, 8500):
        off = np.sqrt(np.square(x - x[i]).sum(axis=1))
        means = off[:8000].sum() / (8000 - (i < 8000)), off[8000:].sum() / (1000 - (i >= 8000))
        a, b = means if i < 8000 else means[::-1]
        assert (found[i].a, found[i].b) == pytest.approx((a, b), rel=1e-9)
    reader, pairs, one_by_one = L._Reader(I._files(rows)), 0, L.distance_chunks

    def counted(a, b):
        nonlocal pairs
        pairs += len(a) * len(b)
        return one_by_one(a, b)

    monkeypatch.setattr(L, "distance_chunks", counted)
    _, code, targets = reader.targets(0, 0, 2000)
    reader.own_sums(targets, code)
    assert pairs < 0.6 * 2000 * 8000


def test_sums_of_some_targets_are_those_of_all():
    x = points_of_kind("mixed", 5000, np.random.default_rng(8))
    order, boxes = D.build(x)
    x, wanted = x[order], np.random.default_rng(9).random(5000) < 0.01
    wanted[1000:4000] = False
    got = D.Targets(x).sums(boxes, 0, lambda ranges: L._blocks(x, ranges), L._measured, wanted)
    assert got == pytest.approx(np.where(wanted, L._measured(x, x), 0), rel=1e-10)


def test_clusters_of_one_centre_are_told_apart_by_their_parts(spark):
    """Rings around one point: their centres exclude none of them."""
    angle = np.linspace(0, 2 * np.pi, 24000, endpoint=False)
    ring = 1 + np.arange(24000) % 6
    names = [str(r) for r in ring]
    x = ring[:, None] * np.column_stack([np.cos(angle), np.sin(angle)])
    found = I.silhouette_rows(labelled(spark, x.tolist(), names)).collect()
    assert sum(r.looked for r in found) < 3.5 * len(x)  # of 5 others
    for r in found[:: len(found) // 20]:
        means = {c: L._measured(x[r.id : r.id + 1], x[ring == c])[0] for c in range(1, 7)}
        assert r.a == pytest.approx(means.pop(int(r.label)) / 3999, rel=1e-10)
        assert r.b == pytest.approx(min(means.values()) / 4000, rel=1e-10)
