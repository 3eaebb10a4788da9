"""Each stage of the pipeline against a brute-force version, on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import reference as R
from latticemix.llm import quality_knn
from latticemix.llm.shared import stored, text_table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, input rows, output rows) of every stage, and the columns of the table."""
    docs = text_table(spark, sf_dir, "documents")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, sf_dir), "stage")
        out[name] = (docs.orderBy("doc_id").collect(), made.orderBy("doc_id").collect())
        docs = made
    return columns, out


def test_columns_and_ids(stages):
    columns, out = stages
    names = [name for name, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        before, after = out[name]
        assert list(after[0].asDict()) == columns
        assert len({r.doc_id for r in after}) == len(after) and {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_classifier_stage(spark, sf_dir, stages):
    before, after = stages[1]["quality classifier"]
    voters = quality_knn.fit(text_table(spark, sf_dir, "documents"), text_table(spark, sf_dir, "labels"))
    scores = voters.score([r.text.encode() for r in before])
    assert [r.doc_id for r in after] == [r.doc_id for r, s in zip(before, scores) if s >= 0.5]
    labels = {r.doc_id: r.quality for r in text_table(spark, sf_dir, "labels").collect()}
    lost = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert sum(labels.get(i, 0) for i in lost) <= 0.02 * len(before)


def test_rules_stage(stages):
    before, after = stages[1]["quality rules"]
    kept = {r.doc_id for r in after}
    for r in before:
        n, chars, symbols, _, repeated, failed = R.quality(r.text)
        if failed or 10 * symbols > n:
            assert r.doc_id not in kept
        elif not symbols and 3 * n < chars < 8 * n and r.text.upper() != r.text and not R.quality(r.text)[3]:
            assert r.doc_id in kept


def test_line_stage(stages):
    before, after = stages[1]["line dedup"]
    want = [text for _, _, text in R.lines([r.text for r in before], 10)]
    assert [(r.doc_id, r.text, r.n_chars) for r in after] == [(r.doc_id, t, len(t)) for r, t in zip(before, want)]


def test_copies_stage(stages):
    before, after = stages[1]["SimHash near-dedup"]
    prints = [R.simhash(r.text) for r in before]
    root = R.components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert [r.doc_id for r in after] == [before[i].doc_id for i in sorted(set(root))]


def test_packing_stage(stages):
    before, after = stages[1]["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    for r in before:
        pieces = sorted((p.start, p.length) for p in after if p.doc_id == r.doc_id)
        assert sum(n for _, n in pieces) == next(p.doc_tokens for p in after if p.doc_id == r.doc_id)


def test_run_is_its_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got.collect()) == key(stages[1]["packing"][1])


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts and columns with the names that operators and stages use for themselves."""
    docs = R.edge_documents(spark)
    for name in ("N_Dropped", "__line_hashes", "__row", "__kept", "n", "column_0", "digest", "fingerprint"):
        docs = docs.withColumn(name, F.lit("taken"))
    return stored(docs.withColumn("n_chars", F.char_length("text")), "odd")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_stages_take_odd_texts_clashing_names_and_empty_tables(spark, sf_dir, odd, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    made = stored(stage(spark, odd, sf_dir), "odd-stage")
    assert last or made.columns == odd.columns
    if not last:
        taken = [c for c in odd.columns if c not in ("doc_id", "text", "n_chars")]
        assert all(r[c] == "taken" for r in made.collect() for c in taken)
    empty = stage(spark, odd.limit(0), sf_dir)
    assert empty.count() == 0 and (last or empty.columns == odd.columns)


def test_line_stage_of_odd_texts(spark, sf_dir, odd):
    docs = odd.union(odd.filter("doc_id = 3").crossJoin(spark.range(7).select()))
    made = corpus_pipeline.drop_lines(spark, docs, sf_dir).collect()
    want = R.lines([r.text for r in docs.collect()], 10)
    assert sorted((r.text, r.n_chars) for r in made) == sorted((t, len(t)) for _, _, t in want)
    assert sum(n for _, n, _ in want) >= 10
