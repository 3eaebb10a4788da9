"""An n-gram model as an Elias-Fano trie, and the scores it gives whole texts.

Level 1 holds the hashes of all training words with their counts; level k the
successors of each node of level k - 1.  Node numbers grow with (context, word),
so a level is a monotone sequence: context's place times vocabulary plus word,
with monotone pointers to each context's first successor, and a quantised
discounted probability per node.  A lookup finds the context's place and then,
relative to it, the word's by successor search.

Levels are cut into shards of bounded size by ranges of contexts; the successors
of a context too frequent for one shard are dealt over all of them.  Shards are
built by one task each from sums that every task has taken over its own
documents, written to the shared folder and memory-mapped by the scoring tasks.
Texts are split and their words looked up once: the further passes read the
words' nodes from a stored table.

P_k(w | c) = max(count(c, w) - D, 0) / count(c) + D * successors(c) / count(c) * P_{k-1}(w),
down to the unigram probability (count + 1/2) / (N + (V + 1) / 2).
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .elias_fano import EliasFano, encode
from .shared import map_file, stored, write_file

ORDER = 3
DISCOUNT = 0.75
SHARD_WORDS = 1 << 20
SHARD_TOKENS = 1 << 21
CACHE_WORDS = 700_000
SLICE_TOKENS = 1 << 19
END = b""  # words are never empty
_FLOOR = 12.0  # least log10 of a stored probability
_STEPS = 65535


# -- trie -----------------------------------------------------------------------


@dataclass
class Level:
    """What every task needs to know of a level; its arrays lie in the folder."""

    folder: str
    shards: list[int]
    bases: np.ndarray  # first node of each shard, and their number
    contexts: int = 0  # nodes of the level before
    hot: dict[int, int] = field(default_factory=dict)  # contexts dealt over all shards: successors
    counted: bool = True

    @property
    def nodes(self) -> int:
        return int(self.bases[-1])


@dataclass
class Trie:
    levels: list[Level]
    tokens: int
    discount: float

    @property
    def vocabulary(self) -> int:
        return self.levels[0].nodes


def _name(folder: str, shard: int, kind: str) -> str:
    return f"{folder}/shard-{shard:06d}.{kind}"


@functools.lru_cache(maxsize=4096)
def _sequence(folder: str, shard: int, kind: str) -> EliasFano:
    return EliasFano(map_file(_name(folder, shard, kind), "<u8"))


@functools.lru_cache(maxsize=4096)
def _array(folder: str, shard: int, kind: str, dtype: str) -> np.ndarray:
    return map_file(_name(folder, shard, kind), dtype)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _shard_of(context: np.ndarray, word: np.ndarray, contexts: int, shards: int, hot: np.ndarray) -> np.ndarray:
    """Shards by ranges of contexts; words of hot contexts are dealt over all."""
    shard = (context.astype(float) * shards / max(1, contexts)).astype(np.int64)
    dealt = np.flatnonzero(np.isin(context, hot)) if len(hot) else []
    if len(dealt):
        shard[dealt] = (_mix(word[dealt]) % np.uint64(shards)).astype(np.int64)
    return np.minimum(shard, shards - 1)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    if shards == 1:
        if len(shard):
            yield 0, np.arange(len(shard))
        return
    if shards <= 1 << 16:
        shard = shard.astype(np.uint16)  # sorted by radix
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        yield s, order[edges[s] : edges[s + 1]]


def word_nodes(level: Level, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: unknown) and counts of word hashes."""
    nodes, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    shards = len(level.bases) - 1
    shard = (hashes >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)
    for s, mine in _by_shard(shard, shards):
        if s in level.shards:
            at, known = _sequence(level.folder, s, "words").successor(hashes[mine])
            mine, at = mine[known], at[known]
            nodes[mine] = level.bases[s] + at
            counts[mine] = _array(level.folder, s, "counts", "<u8")[at]
    return nodes, counts


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the runs of equal values, and each element's run."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def successor_nodes(trie: Trie, k: int, context: np.ndarray, word: np.ndarray, nodes_only: bool = False):
    """Of level ``k`` (from 1), for pairs in ascending order: node of the word (-1: none) and its
    discounted probability, successors and count of the context."""
    level, v = trie.levels[k], trie.vocabulary
    nodes, alpha = np.full(len(context), -1, np.int64), np.zeros(len(context))
    follow, seen = np.zeros((2, len(context)), np.int64)
    shards, hot = len(level.bases) - 1, np.array(sorted(level.hot), np.int64)
    shard = _shard_of(context, word, level.contexts, shards, hot)
    for s, mine in _by_shard(shard, shards):
        if s not in level.shards:
            continue
        first, run = _runs(context[mine])  # each context is looked up once
        place, known = _sequence(level.folder, s, "contexts").successor(context[mine[first]])
        if not nodes_only:
            held = np.flatnonzero(known)
            pointers = _sequence(level.folder, s, "pointers")
            degree = np.zeros(len(first), np.int64)
            degree[held] = pointers.get(place[held] + 1).astype(np.int64) - pointers.get(place[held]).astype(np.int64)
            follow[mine] = degree[run]
        inside = known[run]
        mine, place = mine[inside], place[run[inside]]
        target = place.astype(np.uint64) * np.uint64(v) + word[mine].astype(np.uint64)
        at, found = _sequence(level.folder, s, "successors").successor(target)
        mine, at = mine[found], at[found]
        nodes[mine] = level.bases[s] + at
        if not nodes_only:
            alpha[mine] = 10.0 ** (_array(level.folder, s, "alpha", "<u2")[at] * (-_FLOOR / _STEPS))
    if nodes_only:
        return nodes, alpha, follow, seen
    if len(hot):
        dealt = np.isin(context, hot)
        follow[dealt] = [level.hot[c] for c in context[dealt].tolist()]
    first, run = _runs(context)
    seen = node_counts(trie.levels[k - 1], context[first])[run]
    return nodes, alpha, follow, seen


def node_counts(level: Level, nodes: np.ndarray) -> np.ndarray:
    """Training counts of known nodes."""
    counts = np.zeros(len(nodes), np.int64)
    shard = np.searchsorted(level.bases, nodes, "right") - 1
    for s, mine in _by_shard(shard, len(level.bases) - 1):
        counts[mine] = _array(level.folder, s, "counts", "<u8")[nodes[mine] - level.bases[s]]
    return counts


# -- training -------------------------------------------------------------------


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Token lists, end included, of some documents at a time."""
    held, n = [], 0
    for text in texts:
        words = _words(text)
        words.append(END)
        held.append(words)
        n += len(words)
        if n >= SLICE_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _text_nodes(level: Level, words: list[bytes]) -> np.ndarray:
    """Nodes (-1: unknown) of words, equal ones looked up once."""
    hashes, back = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), return_inverse=True)
    return word_nodes(level, hashes)[0][back]


def code_words(docs: DataFrame, words: Level, folder: str) -> DataFrame:
    """(doc_id, held_out, nodes): every text's words, looked up once, as a stored table.

    ``nodes`` holds unsigned 32- or 64-bit numbers: a word's node plus one, zero
    for an unknown word, and the end token's last.
    """
    wide = _node_type(words)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in _slices(_text_column(batch, 2)):
                nodes = _text_nodes(words, list(itertools.chain.from_iterable(some)))
                data = (nodes + 1).astype(wide).tobytes()
                ends = (np.cumsum([len(d) for d in some]) * np.dtype(wide).itemsize).tolist()
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary())],
                    ["doc_id", "held_out", "nodes"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    coded = rows.mapInArrow(code, "doc_id long, held_out boolean, nodes binary")
    coded.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(coded.schema).parquet(folder)


def _node_type(words: Level) -> str:
    return "<u4" if words.nodes < (1 << 32) - 1 else "<u8"


def _coded_slices(batch: pa.RecordBatch, at: int, words: Level) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, nodes of all words, number of words of each document) of some documents at a time."""
    column = batch.column(at).cast(pa.large_binary())
    wide = np.dtype(_node_type(words))
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // wide.itemsize
    row = 0
    while row < len(column):
        done = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + SLICE_TOKENS, "right")))
        data = b"".join(column.slice(row, stop - row).to_pylist())
        yield row, np.frombuffer(data, wide).astype(np.int64) - 1, np.diff(ends[row:stop], prepend=done)
        row = stop


def _walk(trie: Trie, nodes: np.ndarray, sizes: np.ndarray, nodes_only: bool = False):
    """Per token of some documents: first the places of documents and the contexts of words, then
    what ``successor_nodes`` has for each further level.

    The end token, a document's last, is also the context of its first word.
    """
    starts = np.cumsum(sizes) - sizes
    context = np.empty_like(nodes)
    context[1:], context[starts] = nodes[:-1], nodes[starts + sizes - 1]
    yield starts, context
    word = nodes
    for k in range(1, len(trie.levels)):
        found, alpha = np.full(len(word), -1, np.int64), np.zeros(len(word))
        follow, seen = np.zeros((2, len(word)), np.int64)
        # equal pairs are looked up once; one with an unknown word still needs the context's successors
        asked = (context >= 0) & (word >= 0) if nodes_only else context >= 0
        keys = context[asked].astype(np.uint64) * np.uint64(trie.vocabulary) + np.maximum(word[asked], 0).astype(np.uint64)
        keys, back = np.unique(keys, return_inverse=True)
        pairs = (part.astype(np.int64) for part in np.divmod(keys, np.uint64(trie.vocabulary)))
        got = successor_nodes(trie, k, *pairs, nodes_only)
        for out, values in zip((found, alpha, follow, seen), got):
            out[asked] = values[back]
        unknown = word < 0
        found[unknown], alpha[unknown] = -1, 0.0
        yield found, alpha, follow, seen
        context = np.empty_like(found)
        context[1:], context[starts] = found[:-1], -1


def _train_texts(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select(F.col("text").cast("string"))


def _text_column(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _count_words(docs: DataFrame) -> DataFrame:
    """(h, n): hashes and counts of all training tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays(
            [
                pa.array(np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64)),
                pa.array(np.fromiter(seen.values(), np.int64, len(seen))),
            ],
            ["h", "n"],
        )
        for batch in batches:
            for text in _text_column(batch, 0):
                seen.update(_words(text))
                seen[END] += 1
                if len(seen) > CACHE_WORDS:
                    yield flush()
                    seen.clear()
        yield flush()

    return docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _build_words(words: DataFrame, folder: str) -> Level:
    """Write level 1: shards by the first bits of the hash."""
    total = words.count()
    bits = max(0, -(-total // SHARD_WORDS) - 1).bit_length()
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")

    def build(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        order, s = np.argsort(h), table.column("shard")[0].as_py()
        write_file(_name(folder, s, "words"), [encode(h[order]).tobytes()])
        write_file(_name(folder, s, "counts"), [table.column("n").to_numpy()[order].astype("<u8").tobytes()])
        return pa.table({"shard": [s], "n": [len(h)]})

    built = words.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, n long").collect()
    return _level(folder, {r.shard: r.n for r in built}, 1 << bits)


def _level(folder: str, sizes: dict[int, int], shards: int, **more) -> Level:
    each = np.array([sizes.get(s, 0) for s in range(shards)], np.int64)
    return Level(folder, sorted(sizes), np.concatenate([[0], np.cumsum(each)]), **more)


def _planes(x: np.ndarray, dtype: str) -> bytes:
    """Bytes of equal weight side by side, which compress well in a shuffle."""
    return np.ascontiguousarray(x.astype(dtype).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def _count_successors(coded: DataFrame, trie: Trie, k: int, shards: int, hot: np.ndarray) -> DataFrame:
    """(shard, keys, counts): each task's sums of (context, word) over coded texts, packed per shard."""
    contexts, v = trie.levels[k - 1].nodes, trie.vocabulary

    def pack(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        context, word = (keys // np.uint64(v)).astype(np.int64), (keys % np.uint64(v)).astype(np.int64)
        rows = []
        for s, mine in _by_shard(_shard_of(context, word, contexts, shards, hot), shards):
            mine = np.sort(mine)
            rows.append((s, _planes(np.diff(keys[mine], prepend=np.uint64(0)), "<u8"), _planes(counts[mine], "<u8")))
        columns = list(zip(*rows)) or [[], [], []]
        types = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, word, sizes in _coded_slices(batch, 0, trie.levels[0]):
                steps = _walk(trie, word, sizes, nodes_only=True)
                starts, context = next(steps)
                for found, *_ in steps:
                    context = np.empty_like(found)
                    context[1:], context[starts] = found[:-1], -1
                used = (context >= 0) & (word >= 0)
                keys = context[used].astype(np.uint64) * np.uint64(v) + word[used].astype(np.uint64)
                held.append(np.unique(keys, return_counts=True))
                n += len(held[-1][0])
                if n > 2 * SHARD_TOKENS:
                    yield pack(*_summed(held))
                    held, n = [], 0
        if held:
            yield pack(*_summed(held))

    return coded.select("nodes").mapInArrow(count, "shard long, keys binary, counts binary")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def _build_successors(packed: DataFrame, trie: Trie, k: int, shards: int, hot: np.ndarray, folder: str, last: bool) -> Level:
    """Write level k + 1 from the packed sums."""
    before, v, discount = trie.levels[k - 1], trie.vocabulary, trie.discount

    def build(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        parts = [
            (np.cumsum(_unplanes(key, "<u8"), dtype=np.uint64), _unplanes(count, "<u8"))
            for key, count in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())
        ]
        keys, counts = _summed(parts)
        context = (keys // np.uint64(v)).astype(np.int64)
        first, place = _runs(context)
        places = context[first]
        target = place.astype(np.uint64) * np.uint64(v) + keys % np.uint64(v)
        share = np.maximum(counts - discount, 0) / node_counts(before, places)[place]
        alpha = np.round(np.clip(-np.log10(np.maximum(share, 1e-300)), 0, _FLOOR) * (_STEPS / _FLOOR))
        files = {
            "contexts": encode(places),
            "pointers": encode(np.append(first, len(keys))),
            "successors": encode(target),
            "alpha": alpha.astype("<u2"),
        }
        if not last:
            files["counts"] = counts.astype("<u8")
        for kind, data in files.items():
            write_file(_name(folder, s, kind), [data.tobytes()])
        dealt = np.flatnonzero(np.isin(places, hot))
        degree = np.diff(np.append(first, len(keys)))[dealt]
        frequent = np.flatnonzero(counts > SHARD_TOKENS)
        return pa.table(
            {
                "shard": [s],
                "n": [len(keys)],
                "hot": pa.array([places[dealt].tolist()], pa.list_(pa.int64())),
                "degree": pa.array([degree.tolist()], pa.list_(pa.int64())),
                "frequent": pa.array([frequent.tolist()], pa.list_(pa.int64())),
            }
        )

    schema = "shard long, n long, hot array<long>, degree array<long>, frequent array<long>"
    built = packed.groupBy("shard").applyInArrow(build, schema).collect()  # a row a shard
    degrees: Counter = Counter()
    for row in built:
        degrees.update(dict(zip(row.hot, row.degree)))
    level = _level(folder, {r.shard: r.n for r in built}, shards, contexts=before.nodes, hot=dict(degrees))
    level.frequent = np.array(
        sorted(int(level.bases[r.shard]) + at for r in built for at in r.frequent), np.int64
    )
    return level


def train(docs: DataFrame, folder: str, order: int = ORDER, discount: float = DISCOUNT) -> tuple[Trie, DataFrame]:
    """Build and write the trie over the rows of ``docs`` that are not held out; and all rows, coded."""
    words = stored(_count_words(_train_texts(docs)), "lm-words")
    tokens = words.agg(F.sum("n").alias("n")).first().n or 0
    trie = Trie([_build_words(words, f"{folder}/level-1")], tokens, discount)
    coded = code_words(docs, trie.levels[0], f"{folder}/coded")
    shards = max(1, -(-tokens // SHARD_TOKENS))
    # fewer words than shards can be this frequent
    frequent = words.filter(F.col("n") > SHARD_TOKENS).select("h").collect()
    hot = np.array([r.h for r in frequent], np.int64).view(np.uint64)
    hot = np.sort(word_nodes(trie.levels[0], hot)[0]) if len(hot) else np.empty(0, np.int64)
    for k in range(1, order):
        if trie.levels[k - 1].nodes * trie.vocabulary >= 1 << 64:
            raise OverflowError(f"pairs of {trie.levels[k - 1].nodes} contexts and {trie.vocabulary} words don't fit 64 bits")
        packed = _count_successors(coded.filter(~F.col("held_out")), trie, k, shards, hot)
        level = _build_successors(packed, trie, k, shards, hot, f"{folder}/level-{k + 1}", k + 1 == order)
        trie.levels.append(level)
        hot = level.frequent
    return trie, coded


# -- scoring --------------------------------------------------------------------


def score(coded: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of coded texts.

    A null or empty text is its end token alone.  Without any training text all
    words are unknown to a vocabulary of none.  Rows without an id train the
    model; repeated rows get equal scores; an empty table gives no rows.
    """
    shared = coded.sparkSession.sparkContext.broadcast(trie)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        below = model.tokens + 0.5 * (model.vocabulary + 1)
        for batch in batches:
            for at, nodes, sizes in _coded_slices(batch, 2, model.levels[0]):
                steps = _walk(model, nodes, sizes)
                starts, _ = next(steps)
                known = nodes >= 0
                p = np.full(len(nodes), 0.5)
                p[known] += node_counts(model.levels[0], nodes[known])
                p /= below
                base = np.add.reduceat(np.log10(p), starts)
                for _, alpha, follow, seen in steps:
                    used = np.flatnonzero(follow)
                    p[used] = alpha[used] + model.discount * follow[used] / seen[used] * p[used]
                part = batch.slice(at, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                        pa.array(np.full(len(sizes), model.tokens, np.int64)),
                        pa.array(base),
                        pa.array(np.add.reduceat(np.log10(p), starts)),
                    ],
                    names,
                )

    return coded.select("doc_id", "held_out", "nodes").mapInArrow(scored, schema)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on the documents that are not held out, and score them all; other columns are ignored."""
    trie, coded = train(docs, new_path(docs.sparkSession, "language-model"), order)
    return score(coded, trie)
