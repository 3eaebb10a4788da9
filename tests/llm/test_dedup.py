import numpy as np
import pytest
from pyspark.sql import functions as F

import reference as R
from latticemix.llm import line_dedup, queries, simhash, vector_dedup
from latticemix.llm.components import components, forest


def test_components_of_chains_stars_and_cliques(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)]
    edges += [(int(a), int(b)) for a, b in rng.integers(300, 400, (80, 2))] + [(500, 500), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    a, b = np.array(edges).T
    want = forest(a, b, 501)
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    pairs = {(want[x], got[x]) for x in nodes}
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    def near(i, j):
        a, b = rows[i][1], rows[j][1]
        if not ok(a) or not ok(b) or len(a) != len(b):
            return False
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95
    n = len(rows)
    links = [sum(near(i, j) for j in range(n) if j != i) for i in range(n)]
    return links, R.components(n, near)


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [base[rng.integers(0, 12)] + rng.normal(0, s, 16) for s in rng.choice([0.05, 0.15, 0.22, 1], 160)]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [rows[0]] * 40 + [[2 * x for x in rows[0]], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15]
    rows += [[float("inf")] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0], [1.0], [-3.0]]
    table = list(enumerate(rows))
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("taken"))
    links, root = brute_vectors(table)
    for tile in (7, 1024):
        got = vector_dedup.near_duplicates(df, tile=tile).orderBy("vec_id").collect()
        assert [r.n_links for r in got] == links
        assert [r.component_id for r in got] == root
        assert [r.kept for r in got] == [i == c for i, c in enumerate(root)]
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = vector_dedup.near_duplicates(df.filter("vec_id in (1, 200)").union(df.filter("vec_id = 1")))
    assert sorted((r.vec_id, r.n_links) for r in twice.collect())[:2] == [(1, 1), (1, 1)]


def test_vectors_of_any_size_and_null_keys(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((4, 8))
    rows = [(base[i % 4] + rng.normal(0, 0.1, 8)) * s for i, s in enumerate([1, 1e200, 1e-200, 1e300, 1e-300] * 8)]
    keys = [i if i % 7 else None for i in range(len(rows))]
    table = [(k, [float(x) for x in v]) for k, v in zip(keys, rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    scaled = [(k, (np.array(v) / np.abs(v).max()).tolist()) for k, v in table]
    links, root = brute_vectors(scaled)
    least = {}
    for (k, _), r in zip(table, root):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    got = vector_dedup.near_duplicates(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = [(k, n, least.get(r)) for (k, _), n, r in zip(table, links, root)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_only_rows_within_the_radius_meet():
    """Candidates of a block are its pairs within the budget, each once."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 0.125, (700, 8)), rng.normal(0, 0.125, (900, 8))
    budget = 0.05
    for mine, theirs, same in ((x, y, False), (x, x, True)):
        found = [p for i, j in vector_dedup._candidates(mine, theirs, same, budget) for p in zip(i.tolist(), j.tolist())]
        gap = ((mine[:, None] - theirs[None]) ** 2).sum(-1) <= budget
        want = set(zip(*(a.tolist() for a in np.nonzero(np.triu(gap, 1) if same else gap))))
        assert len(found) == len(set(found)) and {tuple(sorted(p)) if same else p for p in found} >= want


def test_a_perfect_hash_finds_its_keys_and_no_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        h1, h2 = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        counts = rng.integers(2, 1000, n)
        index = line_dedup.build_index(h1, h2, counts)
        assert (line_dedup.probe(index, h1, h2) == counts).all()
        assert not line_dedup.probe(index, h1 + np.uint64(1), h2 + np.uint64(3)).any()
        assert int(np.bitwise_count(index["bits"]).sum()) == n == len(index["prints"])


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_of_odd_texts(spark, min_docs):
    docs = R.edge_documents(spark)
    got = line_dedup.dedup_lines(docs, min_docs).collect()
    rows = docs.collect()
    want = R.lines([r.text for r in rows], min_docs)
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in got) == sorted(want)
    assert set(got[0].asDict()) == {*docs.columns, "n_lines", "n_dropped"}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, 1)


def test_small_shards_give_the_same_counts(spark, tmp_path):
    keys = spark.range(400).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(7), "id").alias("h2"), (F.col("id") + 2).alias("n"))
    index = line_dedup.write_index(keys, str(tmp_path), keys_per_shard=30)
    assert index.shards == 14
    rows = keys.collect()
    h1, h2 = (np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in (0, 1))
    assert index.counts(h1, h2).tolist() == [r.n for r in rows]


def test_line_query_equals_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for d, (n, dropped, text) in zip(documents, R.lines([d.text for d in documents], 10)):
        r = got[d.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, R.sha(text.encode()))


def test_simhash_query_equals_brute_force(spark, sf_dir, documents):
    prints = [R.simhash(d.text) for d in documents]
    root = R.components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r.doc_id: r for r in queries.op4_simhash(spark, sf_dir).collect()}
    for d, p, c in zip(documents, prints, root):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (f"{p:016x}", documents[c].doc_id)


@pytest.mark.parametrize("tile", [3, 2048])
def test_close_fingerprints_are_linked_whatever_the_tiles(spark, tile):
    rng = np.random.default_rng(2)
    values = set(rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist())
    for v in list(values):
        for _ in range(3):
            v ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            values.add(v)
    values = sorted(values | {0, (1 << 64) - 1})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=tile).collect()
    at = {v: i for i, v in enumerate(signed)}
    got = forest(np.array([at[e.a] for e in edges], int), np.array([at[e.b] for e in edges], int), len(values))
    want = R.components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    assert got.tolist() == want


def test_simhash_of_odd_texts(spark):
    docs = R.edge_documents(spark)
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    want = sorted(((r.doc_id, R.simhash(r.text)) for r in rows), key=repr)
    have = sorted(((r.doc_id, r.fp & (1 << 64) - 1) for r in got), key=repr)
    assert have == want
    assert {r.component_id for r in got if r.fp == 0} == {0}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 2 not in ids and None in ids
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows without an id that copy a named one, and groups without any id."""
    words = [" ".join(f"{t}{i}" for i in range(40)) for t in "abcd"]
    rows = [(4, words[0]), (4, words[0]), (9, words[0]), (None, words[0]), (None, words[1]), (None, words[1])]
    rows += [(7, words[2]), (7, words[3]), (7, words[3]), (None, None), (2, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = simhash.keep_first(docs).collect()
    assert sorted(((r.doc_id, r.text or "") for r in kept), key=repr) == sorted(
        [(4, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (2, "")], key=repr
    )
