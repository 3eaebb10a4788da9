"""Base patterns against the contract's own, and the field against all segmentations."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import reference as R
from latticemix.llm import personal_data as D
from latticemix.llm import queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BITS = ["a", "é", "_", "%", " ", "  ", "\n", "-", "+", ".", "..", "@", "@@", "(", ")", "1", "25", "0256", "4111 1111", "4111111111111111"]
BITS += ["1.2.3.4", "a.b@c.de", "+1 (017) 555-7713", "x@y", "٣", "9807915762804490", "7" * 30, "\t", "日", "00000300.1.1.1"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for at, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), at, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def odd_texts(n=3000):
    rng = random.Random(9)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_base_spans_equal_the_patterns():
    for text in odd_texts():
        spans, _ = D.base_spans(text)
        assert [f"{D.KINDS[k]}:{a}:{b}" for k, a, b in spans] == base(text)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        want = base(text)
        assert r.base_sha256 == R.sha(",".join(want).encode())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        parts = [(int(s.split(":")[1]), list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[2])) for s in spans]
        assert parts == sorted(parts) and all(0 <= a < b <= len(text) for a, _, b in parts)
        fixed = [(a, b) for a, k, b in parts if f"{list(PATTERNS)[k]}:{a}:{b}" in want]
        free = [(a, b) for a, k, b in parts if f"{list(PATTERNS)[k]}:{a}:{b}" not in want]
        assert all(b <= c or d <= a for a, b in free for c, d in fixed)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(sorted(free)))


def test_query_keeps_the_base_and_finds_numbers_in_a_row(spark, sf_dir, documents):
    got = sorted(queries.op12_personal_data(spark, sf_dir).collect())
    check(got, [d.text for d in documents])
    for r, d in zip(got, documents):
        told = {tuple(s.split(":")[1:]) for s in r.spans.split(",") if s}
        whole = {(str(m.start(1)), str(m.end(1))) for m in re.finditer(r"(?:^|\s)([0-9]{16})(?=\s|$)", d.text)}
        assert whole <= told
        if not re.search("[0-9@]", d.text):
            assert r.spans == ""


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    rows = []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for _ in range(400):
        body = rng.choice([
            lambda: f"{word()}.{number(2)}@{word()}.example.com",
            lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            lambda: next(c for c in iter(lambda: number(16), None) if luhn(c)),
            lambda: f"+1 ({number(3)}) 555-{number(4)}",
            lambda: f"version {number(1)}.{number(1)}", lambda: f"in {number(4)}", lambda: f'token = "{number(3)}af{number(4)}"',
        ])()
        rows.append(f"{word()} {word()} {body} {word()}.")
    counted = {}
    for text in rows:
        near = D._Near(*D.base_spans(text))
        for s in D.stretches(text):
            if known := D.example(s, *near.of(s)):
                counted[known] = counted.get(known, 0) + 1
    examples = [(*k, n) for k, n in counted.items()]
    made = D.fit_field(examples)
    assert all(tuple(made.decode(classes)) == spans for classes, spans, _ in examples)
    return made


def added(field, text):
    spans, _ = D.base_spans(text)
    return sorted((D.KINDS[k], text[a:b]) for k, a, b in D.Finder(field).added(text, spans))


def test_the_field_chooses_boundaries_and_kinds(field):
    one, two = "9807915762804490", "7536784127813051"
    assert not luhn(one) and not luhn(two)
    assert added(field, f"of {one} {two} the") == [("card", two), ("card", one)]
    assert added(field, f"call +1 (017) 555-7713 {one} now") == [("card", one), ("phone", "+1 (017) 555-7713")]
    assert added(field, "+1 (017) 555-7713 190.12.13.14") == [("phone", "+1 (017) 555-7713")]
    for clean in ("in 1984 it was", "version 4.0.", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "3. one"):
        assert added(field, clean) == []


def test_decoding_equals_all_segmentations(field):
    for text in ("+1 (017) 555-7713 98", "9807915762804490 75", "a.b@c.de 1.2.3", "1.2.3.4.5", "x 12 34-56"):
        (stretch,) = D.stretches(text)
        first, last, features = D.segments(stretch.classes)
        scores = field.weights[features].sum(1)
        options = [(i, j, t, scores[s, t]) for s, (i, j) in enumerate(zip(first, last)) for t in range(4)]
        n = len(stretch.classes) - 2

        def best(at, before):
            if at == n:
                return 0.0, []
            found = best(at + 1, 0)
            top = (found[0] + field.steps[before, 0], found[1])
            for i, j, t, score in options:
                if i == at:
                    rest = best(j, t + 1)
                    value = rest[0] + score + field.steps[before, t + 1]
                    top = max(top, (value, [(t, int(i), int(j)), *rest[1]]), key=lambda x: x[0])
            return top

        assert field.decode(stretch.classes) == best(0, 0)[1]


def test_forward_and_backward_sums_give_the_gradient(monkeypatch):
    """One step from zero weights moves each weight to the side of observed minus expected counts."""
    (stretch,) = D.stretches("12 34")
    monkeypatch.setattr(D, "PASSES", 1)
    made = D.fit_field([(stretch.classes, ((2, 0, 1),), 1)])
    first, last, features = D.segments(stretch.classes)
    # with zero weights all labellings are equally likely: segments [0,1) [2,3) [0,3), four kinds each
    assert sorted(zip(first.tolist(), last.tolist())) == [(0, 1), (0, 3), (2, 3)]
    total = 1 + 4 + 4 + 16 + 4
    expected = {(0, 1): 5 / total, (2, 3): 5 / total, (0, 3): 1 / total}
    grad = np.zeros_like(made.weights)
    for i, j, f in zip(first.tolist(), last.tolist(), features):
        for t in range(4):
            change = ((i, j, t) == (0, 1, 2)) - expected[i, j]
            np.add.at(grad[:, t], f, change * np.log1p(1))
    moved = grad != 0
    assert np.allclose(made.weights[moved], D.STEP * np.sign(grad[moved]), atol=1e-3)
    assert not made.weights[~moved].any()


def test_odd_documents(spark):
    docs = R.edge_documents(spark)
    for name in ("base", "spans", "n_email"):
        docs = docs.withColumn(name, F.lit("taken"))
    texts = [f"{i} {t}" for i, t in enumerate(odd_texts(200))]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).repartition(3)
    found = D.find_personal_data(docs)
    rows = {(r.doc_id, r.base): r for r in found.collect()}
    for d in docs.collect():
        want = base(d.text)
        r = rows[d.doc_id, ",".join(want)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
    assert found.count() == docs.count() and D.find_personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["1a", "a@", "1.", "+1 ", "1 ", "x", "1-", "(1", "a.", "+"])
def test_long_texts_take_linear_time(field, unit):
    def taken(n):
        text = unit * n + "@1"
        start = time.perf_counter()
        spans, _ = D.base_spans(text)
        D.Finder(field).added(text, spans)
        return time.perf_counter() - start

    taken(100)
    assert taken(16_000) < 8 * max(taken(4_000), 0.05)
