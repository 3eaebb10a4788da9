"""BPE encoding and decoding of whole texts by reuse of content-defined chunks.

A rolling hash over the bytes cuts every text where the bytes say so, so that
copied passages fall into equal chunks wherever they stand.  Chunks that occur
more than once are found by their hashes, encoded once, and kept in a perfect
hash dictionary of memory-mapped ids; a chunk that occurs once is encoded where
it stands.  A cut may split a word, so a chunk's ids count from its first to its
last white space.  Each join is repaired: the stretch between two chunks is
encoded together with words of both, and counts once the ids of those words
agree exactly with those that their chunks have; until then more words are
taken.  A text whose chunks end before they agree is encoded whole.

Words between white space are kept where the tokenizer, looked at when it is
loaded, encodes each of them by itself; for any other file the library encodes
every chunk.
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .line_dedup import ARRAYS, HashCounts, build_index, probe, write_index
from .shared import byte_letters, map_file, stored, write_file

WINDOW = 32  # bytes that decide on a cut
CUT_BITS = 9  # a cut every 512 bytes on average
CHUNKS_PER_SHARD = 1 << 15
CACHE_WORDS = 600_000
SLICE_BYTES = 1 << 22
_GEAR = np.random.default_rng(91).integers(0, 1 << 32, 256, dtype=np.uint32)
_LETTERS = byte_letters()
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


# -- encoding -------------------------------------------------------------------


class _Words(dict):
    def __init__(self, owner: WordEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.owner.word(word)
        return ids


class LibraryEncoder:
    """Ids of byte texts, every one by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        tokens = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]

    def together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, a call of the library for all."""
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def encode(self, text: bytes) -> bytes:
        return self.together([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        if self.tokenizer.decoder is None:  # the library then joins tokens by spaces
            tokens = self.tokens
            return " ".join([tokens[i] for i in ids.tolist()])
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def trim(self) -> None:
        """Nothing is kept."""


class WordEncoder(LibraryEncoder):
    """The same, encoding each word between ASCII white space once."""

    # what tells a tokenizer of this kind: case, white space of all kinds, marks, contractions, other scripts
    PROBES = ("Ab cD\tef  gh\n\nit's DON'T", " a.b, (C) x1y22 é\u0301 ", "\u0130 \u1e9e \u65e5\u672c\x0b!\x0cOne\r\n two...")

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.tokenizer.model
        self.words, self.parts = _Words(self), {}

    def fits(self) -> bool:
        """Whether words have the ids that the library gives them within a text, alone and as pieces of letters and marks."""
        normal = self.tokenizer.normalizer
        if normal is None or normal.normalize_str("Ab") != "ab":
            return False
        texts = [p.encode() for p in self.PROBES]
        return [self.encode(t) for t in texts] == self.together(texts)

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text)
        if plain is None:
            return self.together([word])[0]
        return b"".join([self._part(p) for p in (plain[1].lower(), plain[2]) if p])

    def _part(self, part: str) -> bytes:
        """One piece of Latin letters or of marks: the library's model on its byte-level form."""
        ids = self.parts.get(part)
        if ids is None:
            found = self.model.tokenize(_byte_level(part))
            ids = self.parts[part] = np.array([t.id for t in found], self.dtype).tobytes()
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))

    def trim(self) -> None:
        for cache in (self.words, self.parts):
            if len(cache) > CACHE_WORDS:
                cache.clear()


def _byte_level(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


@functools.lru_cache(maxsize=4)
def chunk_encoder(path: str) -> LibraryEncoder:
    """The worker's encoder for a tokenizer file."""
    by_word = WordEncoder(path)
    return by_word if by_word.fits() else LibraryEncoder(path)


# -- chunks ---------------------------------------------------------------------


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last ``WINDOW`` bytes."""
    h, reach = _GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


@dataclass
class Chunked:
    """Some texts side by side; chunk i's core is data[first[i]:last[i]], between its first and last of ``blanks``."""

    data: bytes
    starts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    blanks: np.ndarray

    def cores(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.first.tolist(), self.last.tolist())]


def chunk(texts: list[bytes]) -> Chunked:
    """Cut texts where the rolling hash says; cores without a word are left out."""
    data = b"".join(texts)
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    cuts = np.flatnonzero(rolling_hash(raw) >> np.uint32(32 - CUT_BITS) == 0) + 1 if len(raw) else np.empty(0, np.int64)
    # near a text's start the window would see the text before it
    owner = np.searchsorted(starts, cuts - 1, "right") - 1
    cuts = cuts[cuts - starts[owner] >= WINDOW]
    edges = np.unique(np.concatenate([starts, cuts]))
    blanks = np.flatnonzero(_BLANK[raw])
    left, right = np.searchsorted(blanks, edges[:-1]), np.searchsorted(blanks, edges[1:])
    held = right - left > 1
    first, last = blanks[left[held]], blanks[right[held] - 1]
    return Chunked(data, starts, first, last, np.searchsorted(starts, first, "right") - 1, blanks)


def core_hashes(cores: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = b"".join(map(xxhash.xxh3_128_digest, cores))
    both = np.frombuffer(h, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts of about ``SLICE_BYTES`` together, with the first one's row."""
    held, size, start = [], 0, 0
    for row, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
        held.append(text or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield start, held
            held, size, start = [], 0, row + 1
    if held:
        yield start, held


def _shared_chunks(texts: DataFrame) -> DataFrame:
    """(h1, h2, n) of the cores that occur more than once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in _slices(batch, 0):
                seen = Counter(chunk(some).cores())
                h1, h2 = core_hashes(list(seen))
                n = np.fromiter(seen.values(), np.int64, len(seen))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n)], ["h1", "h2", "n"]
                )

    counted = texts.mapInArrow(hashes, "h1 long, h2 long, n long")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1")


def _shared_texts(texts: DataFrame, index: HashCounts) -> DataFrame:
    """(h1, h2, core): the bytes of every indexed core, once."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            for _, some in _slices(batch, 0):
                cores = list(set(chunk(some).cores()) - told)
                h1, h2 = core_hashes(cores)
                shared = np.flatnonzero(index.counts(h1, h2))
                found = [cores[i] for i in shared]
                told.update(found)
                if len(told) > CHUNKS_PER_SHARD:  # repeats are dropped again below
                    told.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[shared].view(np.int64)), pa.array(h2[shared].view(np.int64)), pa.array(found, pa.binary())],
                    ["h1", "h2", "core"],
                )

    return texts.mapInArrow(pick, "h1 long, h2 long, core binary").dropDuplicates(["h1", "h2"])


KINDS = ARRAYS | {"at": "<u8", "ids": "u1"}


def _name(folder: str, shard: int, kind: str) -> str:
    return f"{folder}/chunks-{shard:06d}.{kind}"


@functools.lru_cache(maxsize=1024)
def _open(folder: str, shard: int) -> dict[str, np.ndarray]:
    return {kind: map_file(_name(folder, shard, kind), dtype) for kind, dtype in KINDS.items()}


@dataclass(frozen=True)
class Dictionary:
    """The ids of all shared cores, in shards of a perfect hash."""

    folder: str
    shards: int
    built: frozenset[int]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(h1)
        shard = h1.view(np.int64) % self.shards
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if s not in self.built:
                continue
            held, mine = _open(self.folder, s), order[edges[s] : edges[s + 1]]
            row = probe(held, h1[mine], h2[mine])  # rows count from 1
            known = np.flatnonzero(row)
            a, b = held["at"][row[known] - 1].tolist(), held["at"][row[known]].tolist()
            for i, x, y in zip(mine[known].tolist(), a, b):
                out[i] = held["ids"][x:y].tobytes()
        return out


def write_dictionary(texts: DataFrame, folder: str, tokenizer: str, chunks_per_shard: int = CHUNKS_PER_SHARD) -> Dictionary:
    """Find the cores that occur more than once, encode each once and write their ids."""
    shared = stored(_shared_chunks(texts), "shared-chunks")
    index = write_index(shared, f"{folder}/index")
    shards = max(1, -(-shared.count() // chunks_per_shard))

    def build(table: pa.Table) -> pa.Table:
        enc, s = chunk_encoder(tokenizer), table.column("shard")[0].as_py()
        ids = [enc.encode(core) for core in table.column("core").to_pylist()]
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        held = build_index(h1, h2, np.arange(1, len(ids) + 1))
        held["at"] = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        held["ids"] = np.frombuffer(b"".join(ids), np.uint8)
        for kind, dtype in KINDS.items():
            write_file(_name(folder, s, kind), [held[kind].astype(dtype).tobytes()])
        return pa.table({"shard": [s]})

    keyed = _shared_texts(texts, index).withColumn("shard", F.pmod("h1", F.lit(shards)))
    built = keyed.groupBy("shard").applyInArrow(build, "shard long").collect()  # a row a shard
    return Dictionary(folder, shards, frozenset(r.shard for r in built))


@dataclass
class _Join:
    """The stretch data[at:end] between two cores of a text, or one core and the text's edge; -1 stands for none."""

    doc: int
    left: int
    right: int
    at: int
    end: int


def _joins(some: Chunked) -> list[_Join]:
    """All joins in text order: one before each core, and one behind a text's last."""
    out, i = [], 0
    first, last, doc = some.first.tolist(), some.last.tolist(), some.doc.tolist()
    bounds = some.starts.tolist()
    for d, (at, end) in enumerate(zip(bounds[:-1], bounds[1:])):
        left = -1
        while i < len(doc) and doc[i] == d:
            out.append(_Join(d, left, i, at, first[i]))
            left, at = i, last[i]
            i += 1
        out.append(_Join(d, left, -1, at, end))
    return out


def repaired(some: Chunked, core_ids: list[bytes], enc: LibraryEncoder) -> tuple[list[bytes | None], list[_Join]]:
    """Ids of every join, none where the cores end before both sides agree; and the joins."""
    joins = _joins(some)
    out: list[bytes | None] = [None] * len(joins)
    blanks, data = some.blanks, some.data
    first, last = some.first.tolist(), some.last.tolist()
    first_at, last_at = (np.searchsorted(blanks, x).tolist() for x in (some.first, some.last))
    open_joins, words = list(range(len(joins))), 1
    while open_joins:
        spans = []
        for j in open_joins:
            join = joins[j]
            a, b = join.at, join.end
            if join.left >= 0:
                a = int(blanks[max(last_at[join.left] - words, first_at[join.left])])
            if join.right >= 0:
                b = int(blanks[min(first_at[join.right] + words, last_at[join.right])])
            spans.append((a, b))
        found = enc.together([data[a:b] for a, b in spans])
        rest = []
        for j, (a, b), ids in zip(open_joins, spans, found):
            join = joins[j]
            before = enc.encode(data[a : join.at]) if a < join.at else b""
            behind = enc.encode(data[join.end : b]) if join.end < b else b""
            agree = (
                len(before) + len(behind) <= len(ids)
                and ids.startswith(before)
                and ids.endswith(behind)
                and (join.left < 0 or core_ids[join.left].endswith(before))
                and (join.right < 0 or core_ids[join.right].startswith(behind))
            )
            if agree:
                out[j] = ids[len(before) : len(ids) - len(behind)]
            elif (join.left >= 0 and a > first[join.left]) or (join.right >= 0 and b < last[join.right]):
                rest.append(j)
        open_joins, words = rest, 2 * words
    return out, joins


def encode_slice(texts: list[bytes], enc: LibraryEncoder, dictionary: Dictionary) -> list[bytes]:
    """Ids of each text: cores from the dictionary or encoded here, joins repaired here."""
    some = chunk(texts)
    cores = some.cores()
    known = dictionary.find(*core_hashes(cores)) if cores else []
    core_ids = [enc.encode(core) if ids is None else ids for core, ids in zip(cores, known)]
    ids_of, joins = repaired(some, core_ids, enc)
    parts: list[list[bytes] | None] = [[] for _ in texts]
    for join, ids in zip(joins, ids_of):
        held = parts[join.doc]
        if ids is None:
            parts[join.doc] = None
        elif held is not None:
            held.append(ids)
            if join.right >= 0:
                held.append(core_ids[join.right])
    whole = iter(enc.together([t for t, p in zip(texts, parts) if p is None]))
    return [next(whole) if p is None else b"".join(p) for p in parts]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids binary, decoded) of every row: little-endian unsigned 32-bit ids and their decoding.

    A null or empty text has no ids and decodes to an empty text.  Repeated rows
    are encoded alike; rows without an id stay; an empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chunk_encoder(tokenizer)  # a file that can't be read fails here
    dictionary = write_dictionary(rows.select("text"), new_path(docs.sparkSession, "chunks"), tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(tokenizer)
        for batch in batches:
            for start, some in _slices(batch, 1):
                found = [np.frombuffer(i, enc.dtype) for i in encode_slice(some, enc, dictionary)]
                decoded = [enc.decode(ids) for ids in found]
                enc.trim()
                ids = [i.astype("<u4").tobytes() for i in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(some)), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return rows.mapInArrow(encode, "doc_id long, ids binary, decoded string")
