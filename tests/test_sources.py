import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import B, X, tiny_model, tiny_points
from latticemix.cells import CellModel
from latticemix.plans.em import fit
from latticemix.plans.evaluation import run_job
from latticemix.session import new_path
from latticemix.sources import delimited as S
from latticemix.sources import trajectory as store


def write(path, text):
    path.write_text(text)
    return str(path)


def test_split_follows_trim_and_regex_rules(spark, tmp_path):
    lines = ["a,b,c", "  a,b \t", "a,,c", "a,b,,", ",a", "a", "", ",,", " , x ,"]
    path = write(tmp_path / "t.txt", "\n".join(lines) + "\n")
    got = [r.tokens for r in S.read_delimited(spark, path, ",", with_id=True).orderBy("id").collect()]
    assert got == [
        ["a", "b", "c"], ["a", "b"], ["a", "", "c"], ["a", "b"], ["", "a"], ["a"], [""], [], ["", " x "],
    ]


def test_ids_follow_files_and_lines(spark, tmp_path):
    for name, count in (("part-0", 5), ("part-1", 40000), ("part-2", 7)):
        write(tmp_path / name, "\n".join(f"{name},{i}" for i in range(count)) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # several blocks per file
    try:
        rows = S.read_delimited(spark, str(tmp_path), ",", with_id=True)
        assert rows.rdd.getNumPartitions() > 3
        got = [(r.id, r.tokens[0], int(r.tokens[1])) for r in rows.orderBy("id").collect()]
        frame = spark.read.text(str(tmp_path))
        ids = [r.id for r in S.with_row_id(frame).orderBy("id").select("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = [(n, i) for n, c in (("part-0", 5), ("part-1", 40000), ("part-2", 7)) for i in range(c)]
    assert got == [(k, n, i) for k, (n, i) in enumerate(want)]
    assert ids == list(range(len(want)))


def test_ids_without_a_broadcast(spark, tmp_path, monkeypatch):
    for name in ("a", "b"):
        write(tmp_path / name, "".join(f"{name},{i}\n" for i in range(50)))
    monkeypatch.setattr(S, "MAX_BROADCAST_VALUES", 0)
    rows = S.read_delimited(spark, str(tmp_path), ",", with_id=True)
    assert "SortMergeJoin" in rows._jdf.queryExecution().toString()
    got = [(r.id, r.tokens) for r in rows.orderBy("id").collect()]
    assert got == [(i, ["ab"[i // 50], str(i % 50)]) for i in range(100)]


def test_typed_scans(spark, tmp_path):
    cont = write(tmp_path / "c.csv", "9,0.5,1.5\n9,2.5,-3\n")
    assert [(r.id, r.x) for r in S.scan_continuous(spark, cont).orderBy("id").collect()] == [
        (0, [0.5, 1.5]), (1, [2.5, -3.0])
    ]
    blank = write(tmp_path / "w.txt", "   664159    550946\n\t1 \t 2\n")
    assert [r.x for r in S.scan_whitespace(spark, blank).orderBy("id").collect()] == [
        [664159.0, 550946.0], [1.0, 2.0]
    ]
    names = write(tmp_path / "l.csv", "cat,1\ndog,2\n")
    assert [r.label for r in S.scan_labels(spark, names).orderBy("id").collect()] == ["cat", "dog"]
    bits = write(tmp_path / "b.csv", "0,1\n1,1\n")
    assert [r.b for r in S.scan_binary(spark, bits).orderBy("id").collect()] == [[0, 1], [1, 1]]
    with pytest.raises(Exception, match="0 or 1"):
        S.scan_binary(spark, write(tmp_path / "bad.csv", "0,2\n")).collect()


def test_run_is_stored_and_resumed(spark):
    points = tiny_points(spark)
    whole = fit(points, tiny_model(), max_iter=4, update_continuous=True)
    path = new_path(spark, "run")
    fit(points, tiny_model(), max_iter=4, update_continuous=True, output_path=path, label_every=2)
    stored = store.read_cells(spark, path)
    assert stored.select("iteration").distinct().count() == 5
    last = CellModel.from_dataframe(stored.filter("iteration = 4"))
    assert np.allclose(last.cont_mean, whole.cells.cont_mean, atol=1e-12)
    assert np.allclose(last.prob, whole.cells.prob, atol=1e-12)
    labels = store.read_labels(spark, path)
    assert {r.iteration for r in labels.select("iteration").distinct().collect()} == {2, 4}
    assert [r.cell for r in store.read_labels(spark, path, 4).orderBy("id").collect()] == [
        r.cell for r in whole.training_labels(points).orderBy("id").collect()
    ]
    with pytest.raises(Exception, match="(?i)exist"):
        fit(points, tiny_model(), max_iter=4, output_path=path)

    # A run that stopped after iteration 2 goes on to the same result.
    half = new_path(spark, "run")
    store.write_cells(spark, half, 0, tiny_model())
    for step in whole.steps[:2]:
        store.write_cells(spark, half, step.iteration, step.cells)
    rest = fit(points, max_iter=4, update_continuous=True, output_path=half, resume=True)
    assert [s.iteration for s in rest.steps] == [3, 4]
    assert np.allclose(rest.cells.cont_mean, whole.cells.cont_mean, atol=1e-12)


def test_grids_samples_and_text_layout(spark, tmp_path):
    points = tiny_points(spark)
    fitted = fit(points, tiny_model(), max_iter=3)
    cells = fitted.cell_table(spark, initial=tiny_model())
    grid = store.cell_grid(cells, "num_items", 2).filter("iteration = 1").orderBy("row").collect()
    assert [(r.row, r.c0, r.c1) for r in grid] == [(0, 3.0, 1.0), (1, 1.0, 3.0)]
    sample = store.trajectory_sample(cells, 2)
    assert {r.iteration for r in sample.collect()} == {0, 2}
    path = new_path(spark, "grid")
    store.write_cell_grid(cells, "num_items", 2, path)
    assert spark.read.csv(path).count() == 8

    # One file per quantity and iteration, as text.
    for step in fitted.steps[:2]:
        c, t = step.cells, step.iteration
        lines = lambda v: "\n".join(",".join(map(repr, map(float, r))) for r in v) + "\n"
        write(tmp_path / f"prob-{t}", lines(c.prob.reshape(2, 2)))
        write(tmp_path / f"items-{t}", lines(c.num_items.reshape(2, 2)))
        write(tmp_path / f"epsilon{t}", lines(c.bin_epsilon.reshape(2, 2)))
        write(tmp_path / f"contCentroid{t}", lines(c.cont_mean))
        write(tmp_path / f"binCentroid{t}", "\n".join(",".join(map(str, r)) for r in c.bin_mean.tolist()) + "\n")
        write(tmp_path / f"labels-{t}", "".join(f"{x[0]},{x[1]},{i % 4}\n" for i, x in enumerate(X)))
    back = store.read_text_cells(spark, str(tmp_path), 2).filter("iteration = 2").orderBy("cell").collect()
    want = fitted.steps[1].cells
    assert [r.prob for r in back] == want.prob.tolist()
    assert [r.num_items for r in back] == want.num_items.tolist()
    assert [r.bin_epsilon for r in back] == want.bin_epsilon.tolist()
    assert [r.cont_mean for r in back] == want.cont_mean.tolist()
    assert [r.bin_mean for r in back] == want.bin_mean.tolist()
    labels = store.read_text_labels(spark, str(tmp_path)).filter("iteration = 1").orderBy("line").collect()
    assert [(r.x, r.cell) for r in labels] == [(x, i % 4) for i, x in enumerate(X)]


def test_labels_as_text(spark):
    labelled = tiny_points(spark).withColumn("cell", F.col("id").cast("int") % 3)
    path = new_path(spark, "labels")
    store.write_labels_csv(labelled, path, 2)
    back = spark.read.option("header", True).schema("id bigint, x0 double, x1 double, cell int").csv(path)
    assert [(r.x0, r.x1, r.cell) for r in back.orderBy("id").collect()] == [
        (*x, i % 3) for i, x in enumerate(X)
    ]


def test_index_values_append(spark):
    path = new_path(spark, "indices")
    internal = spark.createDataFrame([(0.5, 1.5)], "silhouette double, davies_bouldin double")
    external = spark.createDataFrame(
        [(0.1, 0.2, 0.3, 0.4, 0.5, 0.6)],
        "czekanowski_dice double, fowlkes_mallows double, nmi double, precision double, recall double, rand double",
    )
    store.write_indices(store.index_rows(internal, None), path)
    store.write_indices(store.index_rows(None, external), path)
    got = store.read_indices(spark, path)
    assert {(r.kind, r.name): r.value for r in got.collect()} == {
        ("internal", "Silhouette"): 0.5, ("internal", "Davies Bouldin"): 1.5,
        ("external", "Czekanowski Dice"): 0.1, ("external", "Folkes Mallows"): 0.2,
        ("external", "NMI"): 0.3, ("external", "Precision"): 0.4,
        ("external", "Recall"): 0.5, ("external", "Rand"): 0.6,
    }
    assert "NMI: 0.3" in [r.value for r in store.index_lines(got).collect()]


def test_whole_job_on_files(spark, tmp_path):
    cont = write(tmp_path / "c.csv", "".join(f"{i},{x[0]},{x[1]}\n" for i, x in enumerate(X)))
    bits = write(tmp_path / "b.csv", "".join(",".join(map(str, b)) + "\n" for b in B))
    true = write(tmp_path / "l.csv", "".join(f"{c}\n" for c in "aaabbbcd"))
    out = new_path(spark, "job")
    got = run_job(spark, cont, bits, true, out, rows=2, cols=2, max_iter=2, init_cells=tiny_model())
    assert [r.label for r in got.labels.orderBy("id").collect()] == [0, 0, 0, 3, 3, 3, 1, 2]
    values = {r.name: r.value for r in got.indices.collect()}
    assert values["Rand"] == 1.0 and values["NMI"] == pytest.approx(1.0)
    assert 0 < values["Silhouette"] < 1 and values["Davies Bouldin"] > 0
    # Only the first rows by position, after normalising over all of them.
    few = run_job(
        spark, cont, bits, true, new_path(spark, "job"), first=5, rows=2, cols=2, max_iter=2, init_cells=tiny_model()
    )
    assert few.labels.count() == 5


NAMED_FOLDER = """
import sys
from pyspark.sql import SparkSession
from latticemix.session import materialize, new_path
spark = (
    SparkSession.builder.master("local[1]")
    .config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", sys.argv[1])
    .getOrCreate()
)
assert new_path(spark, "run").startswith(sys.argv[1] + "/run-")
kept = materialize(spark.range(5))
assert kept.count() == 5 and sys.argv[1] in spark.sparkContext.getCheckpointDir()
"""


def test_shared_folder_is_the_named_one(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(
        [sys.executable, "-c", NAMED_FOLDER, str(tmp_path / "shared")], check=True, cwd=root, timeout=120
    )


def test_tables_stored_by_id_meet_without_a_shuffle(spark):
    from latticemix.operators import external as X
    from latticemix.sources.bucketed import read_bucketed, write_bucketed

    left = spark.range(500).select("id", (F.col("id") % 3).alias("true_label"))
    right = spark.range(499, -1, -1).select("id", (F.col("id") % 5).alias("pred_label"))
    paths = [new_path(spark, "by-id") for _ in range(3)]
    for table, path in zip((left, right, right.union(right.limit(1))), paths):
        write_bucketed(table, path, 4)
    spark.sql(f"DROP TABLE bucketed_{__import__('hashlib').md5(paths[1].encode()).hexdigest()}")  # as a new session has it
    a, b, twice = (read_bucketed(spark, path) for path in paths)
    matched = X.match_stored(a, b)
    assert sorted(tuple(r) for r in matched.collect()) == [(i, i % 3, i % 5) for i in range(500)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        plan = X.match_stored(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for other in (twice, b.filter("id > 3")):
        with pytest.raises(Exception, match="same ids, each once"):
            X.match_stored(a, other).collect()
    with pytest.raises(ValueError, match="exists"):
        write_bucketed(left, paths[0], 4)


def test_a_text_run_must_be_whole_and_new(spark):
    from latticemix.sources.text_run import read_text_run, write_text_run

    path, run = new_path(spark, "text"), new_path(spark, "run")
    fitted = fit(tiny_points(spark), tiny_model(), max_iter=3, output_path=run)
    cells = store.read_cells(spark, run)
    write_text_run(cells, path)
    key = lambda df: sorted((r.iteration, r.cell, r.prob, r.num_items, r.bin_epsilon, r.cont_mean, r.bin_mean) for r in df.collect())
    assert key(read_text_run(spark, path)) == key(cells) and len(fitted.steps) == 3
    with pytest.raises(ValueError, match="exists"):
        write_text_run(cells, path)
    os.remove(path.removeprefix("file:") + "/epsilon2")
    with pytest.raises(Exception, match="epsilon2"):
        read_text_run(spark, path).collect()


def test_indices_of_a_run_need_every_label(spark):
    from latticemix.plans.evaluation import evaluate_run

    path = new_path(spark, "run")
    fit(tiny_points(spark), tiny_model(), max_iter=3, output_path=path, label_every=2)
    true = spark.createDataFrame(list(enumerate("aaabbbcd")), "id bigint, label string")
    got = {r.iteration: r.rand for r in evaluate_run(spark, path, true).collect()}
    assert sorted(got) == [2, 3] and got[3] == pytest.approx(1.0)
    with pytest.raises(Exception, match="same ids"):
        evaluate_run(spark, path, true.filter("id > 0")).collect()


def test_lines_are_trimmed_as_by_patterns(spark):
    lines = ["", " ", "\x00\t a,b \x1f", " a \x20b, ", "a,  ", " a  ", "a   ", " a \u0085", "  ", "\x7f a! "]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    bare = F.regexp_replace(F.regexp_replace("value", "^" + S.EDGE, ""), S.EDGE + "$", "")
    want = [r[0] for r in rows.orderBy("i").select(F.split(bare, "#")[0]).collect()]
    got = [r.tokens[0] for r in S._split(rows, "#").orderBy("i").collect()]
    assert got == want
