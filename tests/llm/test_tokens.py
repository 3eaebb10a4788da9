import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import reference as R
from latticemix.llm import bpe_chunks, packing, queries, token_files, token_units
from latticemix.session import new_path

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
BITS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "word", "42", "!", "...", " ", "日本", "\x1c", "<|endoftext|>"]
BITS += ["ß", "$", "_", "٣", "́", "\r\n", "don't", "İ", "Σ", "\x0b", " ", "ſ", "Öl.\nWein,"]


def odd_texts(n=1500):
    rng = random.Random(7)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 200))) for _ in range(n)] + [t or "" for t in R.EDGE_TEXTS]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    return tokenizer


def test_texts_get_the_ids_of_the_library():
    rng = random.Random(3)
    texts = odd_texts() + ["  lead", " x", "a \n b", "tail ", "a\u3000 b"]
    texts += ["".join(rng.choices("abcdeinorstäé", k=rng.randint(1, 40))) for _ in range(20000)]
    tokenizer = library(BYTE)
    for plain in (False, True):
        tokenizer.encode_special_tokens = plain
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [i.tolist() for i in token_units.ByteEncoder(BYTE, plain).encode(texts)] == want


def test_both_engines_class_the_known_characters_alike():
    known = [c for c in map(chr, range(1 << 16)) if re.match(f"[{token_units.KNOWN}]", c)]
    texts = [f"a{c}b {c}1{c} {c}{c}\n{c}.{c}" for c in known]
    want = [e.ids for e in library(BYTE).encode_batch(texts, add_special_tokens=False)]
    encoder = token_units.ByteEncoder(BYTE)
    assert encoder.ranked and [i.tolist() for i in encoder.encode(texts)] == want


def test_units_are_cut_where_pieces_start():
    texts = odd_texts()
    encoder = token_units.ByteEncoder(BYTE, plain_specials=True)
    units, at, sizes = token_units.cut_texts(pa.array([" " + t for t in texts]))
    names, stops = units.to_pylist(), np.cumsum(sizes)
    assert [" ".join(names[i] for i in at[b - n : b]) for n, b in zip(sizes, stops)] == [" " + t for t in texts]
    ids, lengths = encoder.encode_units(names)
    apart = np.split(ids, np.cumsum(lengths)[:-1])
    for text, n, b in zip(texts, sizes, stops):
        first = names[at[b - n]]
        got = [*encoder.encode([first])] + [apart[i] for i in at[b - n + 1 : b]]
        assert np.concatenate(got).tolist() == next(encoder.encode([" " + text])).tolist()


def test_files_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_units.ByteEncoder(WORD)


def test_chunks_give_the_ids_of_whole_texts():
    class Nothing:
        find = staticmethod(lambda h1, h2: [None] * len(h1))

    texts, tokenizer, enc = odd_texts(), library(WORD), bpe_chunks.chunk_encoder(WORD)
    assert isinstance(enc, bpe_chunks.WordEncoder)
    got = bpe_chunks.encode_slice([t.encode() for t in texts], enc, Nothing)
    for t, ids in zip(texts, got):
        ids = np.frombuffer(ids, enc.dtype)
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert enc.decode(ids) == tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def test_copied_passages_fall_into_equal_chunks():
    rng = np.random.default_rng(4)
    passage = b" ".join(rng.choice([b"lorem", b"ipsum", b"dolor", b"sit"], 3000))
    texts = [b"some start " + passage, b"another, longer beginning of it all " + passage + b" end"]
    cores = [set(bpe_chunks.chunk([t]).cores()) for t in texts]
    assert len(cores[0] & cores[1]) > 10
    both = bpe_chunks.chunk(texts)
    assert set(both.cores()) == cores[0] | cores[1]  # a text's cuts don't depend on its neighbours


def test_joins_are_repaired_for_other_tokenizers():
    """A tokenizer that keeps case and white space: the library encodes, and joins widen until both sides agree."""

    class Nothing:
        find = staticmethod(lambda h1, h2: [None] * len(h1))

    enc = bpe_chunks.chunk_encoder(BYTE)
    assert not isinstance(enc, bpe_chunks.WordEncoder)
    rng = random.Random(12)
    texts = odd_texts(300) + ["Hello World, Foo  bar", "x" * 9000, " " * 3000, "a b " * 900, "\n \n" * 700]
    texts += [" ".join(rng.choice(["Word", "two", "  ", "\n", "9,", "l'été"]) for _ in range(2000)) for _ in range(20)]
    want = [e.ids for e in library(BYTE).encode_batch(texts, add_special_tokens=False)]
    got = bpe_chunks.encode_slice([t.encode() for t in texts], enc, Nothing)
    assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == want


def test_a_join_widens_until_both_sides_agree():
    class Picky(bpe_chunks.LibraryEncoder):
        """An encoder whose ids of a word depend on the two words before it."""

        dtype = np.dtype("<u2")

        def __init__(self):
            self.calls = 0

        def together(self, texts):
            self.calls += 1
            out = []
            for t in texts:
                words = t.split()
                out.append(np.array([sum(map(len, words[max(0, i - 2) : i + 1])) for i in range(len(words))], self.dtype).tobytes())
            return out

    rng = random.Random(2)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(800)).encode() for _ in range(5)]
    some, enc = bpe_chunks.chunk(texts), Picky()
    cores = [enc.encode(c) for c in some.cores()]
    enc.calls = 0
    found, joins = bpe_chunks.repaired(some, cores, enc)
    assert enc.calls > len(joins) and any(f is None for f in found)  # words behind a join never agree
    assert bpe_chunks.encode_slice(texts, enc, type("None", (), {"find": staticmethod(lambda a, b: [None] * len(a))})) == enc.together(texts)


def test_chunk_query_equals_the_library(spark, sf_dir, documents):
    tokenizer = library(WORD)
    got = {r.doc_id: r for r in queries.op7_bpe_chunks(spark, sf_dir).collect()}
    for d in documents:
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), R.sha(np.array(ids, "<u4").tobytes()), R.sha(text.encode()))
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_shared_chunks_come_from_the_dictionary(spark):
    docs = R.edge_documents(spark)
    for name in ("ids", "decoded", "h1", "core", "shard", "n"):
        docs = docs.withColumn(name, F.lit("taken"))
    docs = docs.union(docs).union(docs)
    folder = new_path(spark, "chunks")
    dictionary = bpe_chunks.write_dictionary(docs.select("text"), folder, WORD, chunks_per_shard=2)
    assert dictionary.shards > 1
    got = bpe_chunks.encode_documents(docs, WORD).collect()
    tokenizer = library(WORD)
    want = [(d.doc_id, np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for d in docs.collect()]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe_chunks.encode_documents(docs.limit(0), WORD).count() == 0


def test_token_files_hold_every_document_in_order(spark, sf_dir, documents):
    tokenizer = library(BYTE)
    got = sorted(queries.op5_token_files(spark, sf_dir).collect())
    start = 0
    assert len(got) == len(documents)
    for r, d in zip(got, documents):
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), R.crc(ids))
        start += len(ids)


def test_token_files_of_odd_texts(spark):
    docs, folder = R.edge_documents(spark), new_path(spark, "files")
    manifest = token_files.write_token_files(docs, folder, BYTE, end_id=0, partitions=3)
    tokenizer = library(BYTE)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want = [tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows]
    flat, keys = [], []
    for part in manifest:
        ids, offsets, held = token_files.open_part(folder, part)
        assert isinstance(ids, np.ndarray) and offsets.dtype == np.uint64 and part["id_base"] == len(flat)
        flat += ids.tolist()
        keys += held.to_pylist()
    assert keys == [r.doc_id for r in rows] and flat == sum(want, [])
    assert token_files.read_token_files(spark, folder).count() == len(rows)
    empty = new_path(spark, "files")
    token_files.write_token_files(docs.limit(0), empty, BYTE)
    assert token_files.read_token_files(spark, empty).count() == 0


def best_fit(lengths, window):
    """The textbook form: each piece into the tightest window that holds it."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(window - length)
    return sorted(rooms)


@pytest.mark.parametrize("window", [16, 31, 64])
def test_the_plan_is_best_fit_decreasing(window):
    rng = np.random.default_rng(window)
    for _ in range(20):
        lengths = rng.integers(1, window + 1, rng.integers(1, 200)).tolist()
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.best_fit_plan(counts, window)
        filled = {}
        for length, n in counts.items():
            runs = plan[plan[:, 0] == length]
            for rank in range(n):
                _, first_rank, per, first, offset = runs[runs[:, 1] <= rank][-1]
                window_at = first + (rank - first_rank) // per
                filled.setdefault(window_at, []).append((offset + (rank - first_rank) % per * length, length))
        rooms = []
        for pieces in filled.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= window
            rooms.append(window - end)
        assert sorted(rooms) == best_fit(lengths, window)


def check_packed(rows, ids_of, window):
    by_sequence, seen = {}, {}
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == R.crc(ids[r.start : r.start + r.length])
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    padding = 0
    for pieces in by_sequence.values():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
        assert {p for _, _, p in pieces} == {end if end & (end - 1) == 0 else window}
        padding += pieces[0][2] - end
    for key, ids in ids_of.items():
        end = 0
        for start, length in sorted(seen[key]):
            assert start == end
            end += length
        assert end == len(ids)
    return padding


def test_packing_query_places_every_id_once(spark, sf_dir, documents):
    tokenizer = library(BYTE)
    ids_of = {d.doc_id: tokenizer.encode(d.text, add_special_tokens=False).ids + [1] for d in documents}
    padding = check_packed(queries.op3_packing(spark, sf_dir).collect(), ids_of, 2048)
    assert padding < 0.02 * sum(map(len, ids_of.values()))


def test_packed_sequences_of_odd_texts(spark):
    docs = R.edge_documents(spark).dropDuplicates(["doc_id"]).repartition(3)
    tokenizer = library(BYTE)
    ids_of = {d.doc_id: tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1] for d in docs.collect()}
    packed = packing.pack(packing.stored(packing.token_pieces(docs, BYTE, window=64, with_ids=True), "p"), 64)
    check_packed(packed.collect(), ids_of, 64)
    got = packing.sequences(packed, pad_id=9).collect()
    assert all(len(r.ids) == 64 or len(r.ids) & (len(r.ids) - 1) == 0 for r in got)
    assert sum(len(r.ids) for r in got) >= sum(map(len, ids_of.values()))
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0
    doubled = packing.pack_documents(docs.union(docs), BYTE, window=64)
    assert doubled.agg({"length": "sum"}).first()[0] == 2 * sum(map(len, ids_of.values()))
