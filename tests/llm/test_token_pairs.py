"""Alignment of two tokenizers against a plain version."""

import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import reference as R
from latticemix.llm import queries, token_pairs
from latticemix.llm.shared import byte_letters

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
BITS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "word", "42", "!", "...", "\xa0", "日本", "\x1c", "<|endoftext|>"]
BITS += ["<s>", "</s>", "<0x0A>", "ﬁ", "☃", "🦊", "don't", "\r\n", " .", "　", "Öl.\nWein,", "x" * 30]


def plain(rows):
    """The contract, a token at a time."""
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    letters = {c: b for b, c in byte_letters().items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found, holders = [], collections.defaultdict(set)
    for at, (key, text) in enumerate(rows):
        told = b" " + (text or "").encode()
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
        piece = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
        bytes_b = [piece(i) for i in b]
        if not text or b"".join(bytes_a) != told or b"".join(bytes_b) != told:
            found.append((key, [], 0, 0))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            i, j = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((a[x:i], b[y:j]))
            x, y = i, j
        found.append((key, groups, len(a), len(b)))
        for side, other in groups:
            for i in side:
                for j in other:
                    holders[i, j].add(at)
    count = {pair: len(docs) for pair, docs in holders.items()}
    most = collections.Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for key, groups, n_a, n_b in found:
        links = [(i, j) for side, other in groups for i in side for j in other]
        told = ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, o)) for s, o in groups)
        best = sum(count[p] == most[p[0]] for p in links)
        out.append((key, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), R.sha(told.encode()) if groups else ""))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def test_query_equals_the_plain_version(spark, sf_dir, documents):
    rows = [(d.doc_id, d.text) for d in documents]
    assert found(queries.op13_token_pairs(spark, sf_dir)) == plain(rows)


def odd_rows():
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [t if t is None or len(t) < 9000 else t[:3000] for t in R.EDGE_TEXTS]
    texts += [" ", "  ", "\n", " a", "  a", "a ", "▁", "a ▁b", "tail\n", "\x00", "a\x00b c", "same", "same", "word " * 400]
    return list(enumerate(texts)) + [(None, "no id"), (3, "again"), (3, "again")]


@pytest.mark.parametrize("fan_in", [2, 512])
def test_odd_texts(spark, monkeypatch, fan_in):
    rows = odd_rows()
    docs = R.edge_documents(spark).limit(0).select("doc_id", "text", "fp", "kept", "rank")
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True).repartition(7)
    assert found(token_pairs.align_documents(docs, BYTE, PIECE, fan_in)) == plain(rows)
    assert token_pairs.align_documents(docs.limit(0), BYTE, PIECE).count() == 0


def test_small_blocks_and_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(token_pairs, "BLOCK_PAIRS", 3)
    rng = np.random.default_rng(2)
    runs, want = [], collections.Counter()
    for _ in range(20):
        keys = np.unique(rng.integers(0, 300, rng.integers(1, 120)))
        counts = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        runs += [(int(keys[i]), keys[i : i + 3], counts[i : i + 3]) for i in range(0, len(keys), 3)]
    runs.sort(key=lambda r: r[0])
    parts = list(token_pairs._merged(iter(runs)))
    assert len(parts) > 3
    keys, sums = (np.concatenate(x) for x in zip(*parts))
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), sums.tolist())) == dict(want)
    texts = pa.array([t or "" for _, t in odd_rows()])
    kept, forgetful = token_pairs.PairEncoder(BYTE, PIECE), token_pairs.PairEncoder(BYTE, PIECE, cache_units=5)
    for part in (texts.slice(0, 200), texts.slice(200)):
        for x, y in zip(kept.align(part), forgetful.align(part)):
            assert list(x) == list(y) if isinstance(x, list) else np.array_equal(x, y)


def test_many_links_of_a_pair_in_one_document():
    keys, docs, times = token_pairs._records(np.array([5, 3, 5]), np.array([1, 0, 1]), np.array([1000, 2, 255]))
    assert (keys.tolist(), docs.tolist(), times.tolist()) == ([3, 5], [0, 1], [2, 1255])


def test_files_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_pairs.PairEncoder(WORD, PIECE)
