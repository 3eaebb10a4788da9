import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import reference as R
from latticemix.llm import html_text, ngram_lm, quality_knn, quality_rules, queries
from latticemix.llm.elias_fano import EliasFano, encode


def test_rules_query_equals_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    for d in documents:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == R.quality(d.text)
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    for r in labels:
        if not got[r.doc_id].base_failed:
            assert got[r.doc_id].kept == bool(r.quality)


def test_rules_on_odd_texts(spark):
    docs = R.edge_documents(spark)
    got = quality_rules.report(docs).collect()
    want = sorted(((d.doc_id, *R.quality(d.text)) for d in docs.collect()), key=repr)
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    assert quality_rules.with_verdict(docs).filter("kept").count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.report(docs.limit(0)).count() == 0


def test_the_order_of_rules_never_changes_the_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ordered = quality_rules.order_rules(docs, sample_rows=50)
    assert {c.rule.name for c in ordered} == {r.name for r in quality_rules.RULES}
    rows = docs.withColumn(quality_rules.WORDS, quality_rules.words_of(quality_rules.text_of()))
    kept = [
        rows.filter(quality_rules.cascade(some)).select("doc_id").orderBy("doc_id").collect()
        for some in (ordered, ordered[::-1])
    ]
    assert kept[0] == kept[1] and kept[0]


def test_rules_run_without_python(spark, sf_dir):
    plan = queries.op8_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_classifier_on_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = queries.op6_quality_knn(spark, big).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for _, p, y in held]) > 0.97
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_classifier_of_odd_texts_and_labels(spark, sf_dir):
    docs = R.edge_documents(spark)
    labels = spark.createDataFrame(
        [(0, 1), (2, 0), (3, 1), (3, 0), (5, None), (None, 1), (99, 1)], "doc_id long, quality int"
    )
    got = quality_knn.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality_knn.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_knn.classify(docs.limit(0), labels).count() == 0
    assert quality_knn.keep_predicted(docs, labels.limit(0)).columns == docs.columns


def voted(texts, sample, frequencies, n_docs, latent, neighbours):
    """The vote by hand: weights, latent vectors and cosines one text at a time."""
    Q = quality_knn
    runs = re.compile(rb"([a-z\x80-\xff]+)|([A-Z]+)|([0-9]+)|(.)\4*", re.S)
    # a run of small letters may begin only with one, as the pattern of the operator has it
    shape_of = lambda w: runs.sub(lambda m: b"a" if m[1] else b"A" if m[2] else b"0" if m[3] else m[4], w)

    def weights(text):
        words = (text or b"").split()
        counts = collections.Counter()
        for w in words:
            counts[zlib.crc32(w.lower()) % Q.WORD_BUCKETS] += 1
            counts[Q.WORD_BUCKETS + zlib.crc32(shape_of(w)) % Q.SHAPE_BUCKETS] += 1
        keys = [(zlib.crc32(w.lower()) % Q.WORD_BUCKETS, zlib.crc32(shape_of(w)) % Q.SHAPE_BUCKETS) for w in words]
        if len(words) > 2:
            windows = list(zip(keys, keys[1:], keys[2:]))
            share = 1 - len(set(windows)) / len(windows)
            counts[Q.WORD_BUCKETS + Q.SHAPE_BUCKETS + math.ceil(share * (Q.REPEAT_CODES - 1))] = 1
        return counts

    def vector(counts, df):
        out = np.zeros(Q.WIDTH)
        for b, n in counts.items():
            out[b] = math.log1p(n) * (math.log((1 + n_docs) / (1 + df.get(b, 0))) + 1)
        for part in np.split(out, [Q.WORD_BUCKETS, Q.WORD_BUCKETS + Q.SHAPE_BUCKETS]):
            norm = math.sqrt((part**2).sum())
            part /= norm or 1
        return out

    df = frequencies(weights)
    x = np.array([vector(weights(t), df) for t, _ in sample])
    basis = np.linalg.svd(x, full_matrices=False)[2][:latent].T
    unit = lambda v: v / (math.sqrt((v**2).sum()) or 1)
    known = [(unit(v @ basis), y) for v, (_, y) in zip(x, sample)]
    prior = sum(y for _, y in known) / len(known)
    out = []
    for t in texts:
        mine = unit(vector(weights(t), df) @ basis)
        near = sorted(((float(mine @ v), y) for v, y in known), reverse=True)[:neighbours]
        votes = [(max(0.0, min(1.0, c)) ** Q.SHARPNESS, y) for c, y in near]
        total = sum(v for v, _ in votes)
        out.append((sum(v * y for v, y in votes) + Q.PRIOR_VOTES * prior) / (total + Q.PRIOR_VOTES))
    return out


def test_votes_counted_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    sample = [(texts[r.doc_id], r.quality) for r in labels.orderBy("doc_id").collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]

    def frequencies(weights):
        df = collections.Counter()
        for t in texts.values():
            df.update(weights(t).keys())
        return df

    latent = min(quality_knn.LATENT, len(sample) // 2)  # well within the rank, where the basis is unique
    voters = quality_knn.fit(docs, labels, latent=latent)
    got = [r.score for r in quality_knn.score(docs, voters).orderBy("doc_id").collect()]
    want = voted([texts[i] for i in sorted(texts)], sample, frequencies, len(texts), latent, quality_knn.NEIGHBOURS)
    assert np.median(np.abs(np.subtract(got, want))) < 1e-5
    # neighbours of equal similarity may be others
    assert np.mean(np.abs(np.subtract(got, want)) < 1e-4) > 0.98


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.range(200).select(F.col("id"), F.concat(F.lit("other "), F.col("id").cast("string"))))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert len(quality_knn.fit(docs, labels).labels) <= 200
    assert len(quality_knn.fit(docs, labels, sample_rows=50).labels) == 50


def test_labels_lang_source_and_id_do_not_reach_a_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    voters = quality_knn.fit(docs, labels)
    texts = [r.text.encode() for r in docs.orderBy("doc_id").collect()]
    got = [r.score for r in quality_knn.score(docs.withColumn("lang", F.lit("x")), voters).orderBy("doc_id").collect()]
    assert got == pytest.approx(voters.score(texts).tolist(), abs=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies on this site, please accept all of them right now.</div>
<div class="layout"><div class="sidebar"><a href="x">one</a> two</div>
<div class="content"><h2>Title &amp; more</h2><p>First para with <b>bold</b> text
 that goes on<br>for a while.<p>Second&nbsp;one, also with some words &#x41;.<ul><li>item a<li>item b</ul>
<div class="ad">Buy now</div><form><p>Mail?</p><input></form>
<div class="comments"><p>great post, a very long comment that says nothing much at all, really.</p></div></div></div>
<footer>&copy; all rights</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == (
        "Title & more\nFirst para with bold text that goes on for a while.\n"
        "Second one, also with some words A.\nitem a\nitem b"
    )
    framed = (
        '<body><div class="page has-sidebar"><article class="post"><h1>Head</h1><p>Body text of it.</p></article>'
        '<section id="comments"><article class="comment"><p>What a long and thoughtful comment that is, indeed.</p>'
        '</article></section></div></body>'
    )
    assert html_text.main_text(framed) == "Head\nBody text of it."
    assert html_text.main_text("plain text  only") == "plain text only"
    assert html_text.main_text("<p>a<p>b") == "a\nb"
    assert html_text.main_text("<p title=it's>one</p><p title=\"a > b\">two's</p>") == "one\ntwo's"
    for broken in ("", "<", "<div", "<p", "</p></div>", "<!-- open", "<script>never closed", "<a href='x", "<p>\x00&bogus;"):
        html_text.main_text(broken)
    assert html_text.main_text("<body><article><p>" + "x " * 50000 + "</article>").startswith("x x")
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize(
    "attribute",
    ['class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', 'data-hidden-sm="x"', "data-aria-hidden=true",
     'title="hidden"', 'data-style="display:none"', 'title="display: none"', 'style="display:none;display:block"', "class=hidden-xs"],
)
def test_attributes_that_hide_nothing(attribute):
    for page in (f"<div {attribute}><article><p>Body text.</p></article></div>", f"<article {attribute}><p>Body text.</p></article>"):
        assert html_text.main_text(f"<body>{page}</body>") == "Body text."


@pytest.mark.parametrize(
    "attribute",
    ["hidden", "HIDDEN", 'hidden=""', 'id="x" hidden class="y"', "aria-hidden=true", 'aria-hidden="TRUE"', "style='color:red; Display : none'",
     'style="display:none !important;display:block"'],
)
def test_attributes_that_hide(attribute):
    assert html_text.main_text(f"<body><p>Body text.</p><div {attribute}>not to be seen</div></body>") == "Body text."


@pytest.mark.parametrize(
    "attribute",
    ['class="content has-sidebar"', "class=no-sidebar", 'class="page with-header"', 'id="page-header-fixed"', 'class="layout-no-sidebar"',
     'data-id="header"', "data-class='sidebar'", 'data-role="navigation"', 'class="post no-comments"', 'id="page-header" role="banner"'],
)
def test_frames_whose_name_has_a_mark(attribute):
    """An article in plain nodes within such a frame, whose own menus and adverts still go."""
    page = (
        f'<body><nav>Home</nav><div {attribute}><div class="ad">Buy now</div>'
        '<div><p>Body text of it.</p><p>And more of it.</p></div></div><footer>end</footer></body>'
    )
    assert html_text.main_text(page) == "Body text of it.\nAnd more of it."


def test_marks_still_cut():
    page = '<body><div class="content has-sidebar"><p>Body text of it.</p></div><div {}>Something else.</div></body>'
    for attribute in ('class="sidebar"', 'id="sidebar-with-ads"', "role=navigation", 'class="x comments"', "CLASS=Header"):
        assert html_text.main_text(page.format(attribute)) == "Body text of it."
    assert html_text.main_text('<body><div class="header">' * 2000 + "deep" + "</div>" * 2000) == "deep"


def test_forms_own_headers_and_named_paragraphs_keep_their_text():
    get = html_text.main_text
    assert get("<body><form><article><h1>Head</h1><p>Text of it.</p></article></form></body>") == "Head\nText of it."
    long = "Words of the text. " * 20
    assert get(f"<body><form><div><p>{long}</p></div><input><button>Go</button></form></body>") == long.strip()
    assert get("<body><article><header><h1>Head</h1></header><p>Text of it.</p></article></body>") == "Head\nText of it."
    social = ("A social history. " * 9).strip()
    page = (
        "<body><header><h1>Site</h1></header><div><div class='article-header'><h1>The title</h1></div>"
        f"<p>{long}</p><p class='social-history'>{social}</p><p class='copyright-line'>(c) x</p><p class='ad'>Buy</p>"
        f"<p class='related-links'>{'<a href=x>One more text to read</a> ' * 5}</p></div></body>"
    )
    assert get(page) == f"The title\n{long.strip()}\n{social}"
    assert get("<body><p>aa <x-word>bb</x-word> cc</p></body>") == "aa bb cc"
    small = "<body><form><p>Mail?</p><input></form>" + f"<div><p>{long}</p><p>{long}</p></div></body>"
    assert get(small) == f"{long.strip()}\n{long.strip()}"


def plain_page(rng):
    """A page of bare divs: link lists, teasers and short notes around one article; and the article's blocks."""
    words = lambda n: " ".join(rng.choice(["river", "stone", "evening", "about", "the", "of", "a"]) for _ in range(n))
    links = lambda n: "".join(f"<div><a href='/{i}'>{words(3)}</a></div>" for i in range(n))
    blocks = [words(5), *(words(rng.randint(35, 80)) + "." for _ in range(rng.randint(4, 9)))]
    article = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    page = (
        f"<body><div>{links(8)}</div><div><div>{links(rng.randint(4, 12))}</div><div>{article}</div>"
        f"<div><div>{words(4)}</div><div><a href=x>{words(6)}</a></div>{links(5)}</div></div><div><div>{words(6)}</div>{links(4)}</div></body>"
    )
    return page, blocks


def test_density_decides_on_pages_of_bare_divs(monkeypatch):
    import random

    rng = random.Random(8)
    pages = [plain_page(rng) for _ in range(60)]
    assert all(html_text.main_text(page) == "\n".join(blocks) for page, blocks in pages)
    monkeypatch.setattr(html_text, "_density", lambda node, ratio: 0.0)  # without densities all of the page is left
    assert all(html_text.main_text(page) != "\n".join(blocks) for page, blocks in pages)


@pytest.mark.parametrize(
    "page", ["<div>" * 100_000 + "</span>" * 100_000, "<b><article>" + "<i>" * 100_000 + "</b>" * 100_000, "<p>" + "a <b>" * 200_000], ids=["other", "inline", "unclosed"]
)
def test_stray_tags_of_long_pages_take_linear_time(page):
    import time

    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 20


def test_page_query_gives_the_articles(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op9_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"<[^>]+>", "", p) for p in re.split(r"</?(?:p|h1)[^>]*>", article)]
        parts = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n".join(p for p in parts if p)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_pages_without_text(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<html></html>"), (2, "u", "<html></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("taken"))
    got = html_text.extract(df).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0)] * 4
    assert html_text.extract(df.limit(0)).count() == 0


def test_elias_fano_sequences():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 1 << 63), (1000, 50), (70000, 10**7), (3000, 3000)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        sequence = EliasFano(encode(values))
        assert (sequence.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 300, dtype=np.uint64), values + np.uint64(1)])
        at, equal = sequence.successor(asked)
        assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


@pytest.mark.parametrize("bits", [1, 20, 57, 58, 63])
def test_elias_fano_reads_a_low_part_once_a_step(bits, monkeypatch):
    rng = np.random.default_rng(bits)
    values = np.sort(rng.integers(0, 1 << bits, 400, np.uint64))
    values = np.sort(np.concatenate([values, values[::7], values[:3], np.array([(1 << bits) - 1], np.uint64)]))
    sequence, read, low = EliasFano(encode(values)), [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, at: read.append(len(at)) or low(self, at))
    asked = np.unique(np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << bits, 300, np.uint64)]))
    at, equal = sequence.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()
    assert (sequence.get(np.arange(len(values))) == values).all()
    # a bucket of one value is read once
    lone = EliasFano(encode(np.arange(64, dtype=np.uint64) << np.uint64(8)))
    read.clear()
    assert lone.successor(np.arange(64, dtype=np.uint64) << np.uint64(8))[1].all()
    assert sum(read) == 64



def check_model(rows, texts, order):
    kept = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 or r.doc_id is None]
    model = R.Model([texts[id(r)] for r in kept], order, ngram_lm.DISCOUNT)
    for r in rows:
        tokens, known, base, score = model.scores(texts[id(r)])
        yield (tokens, known, model.n, base, score)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("shard", [300, None])
def test_model_equals_dictionaries(spark, sf_dir, documents, monkeypatch, order, shard):
    if shard:  # many shards, and contexts too frequent for one
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
        monkeypatch.setattr(ngram_lm, "SHARD_WORDS", shard)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    rows = docs.orderBy("doc_id").collect()
    got = ngram_lm.score_documents(docs, order).orderBy("doc_id").collect()
    for r, want in zip(got, check_model(rows, {id(r): r.text for r in rows}, order)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], abs=1e-6 * r.n_tokens)
        assert r.score == pytest.approx(want[4], abs=3e-4 * r.n_tokens)


def test_model_helps_on_held_out_documents(spark, sf_dir):
    got = [r for r in queries.op10_ngram_lm(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_model_of_odd_texts(spark):
    docs = R.edge_documents(spark)
    rows = docs.collect()
    got = ngram_lm.score_documents(docs).collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, check_model(rows, {id(r): r.text for r in rows}, 3))), key=repr)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-5) and a[5] == pytest.approx(b[5], abs=3e-4 * a[1])
    assert ngram_lm.score_documents(docs.limit(0)).count() == 0
