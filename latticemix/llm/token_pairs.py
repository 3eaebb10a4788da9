"""Alignment of two tokenizers' tokens, weighed by how many documents link a pair.

Both tokenizers cut a text at byte offsets; where both cut, a group ends, and
all tokens of one side link all tokens of the other within their group.  How
many documents link a pair of ids is counted outside memory:

1. Tasks align their documents and write the pair-document records of a run,
   sorted by radix, first id, second id, document, as zstd frames of one file in
   the shared folder.  A pair's number of records in the run goes on alone.
2. These counts are shuffled by radix and merged by a heap over the runs' blocks
   as they come in key order.  Side-major order completes the pairs of a first
   id one after the other, which yields its highest count.  Beyond ``FAN_IN``
   runs, groups of runs are merged first.
3. The merged counts, files of zstd blocks in key order, stream past each run's
   records, and every record adds its pair's count to its document.

A frequent pair costs one count per run, however many documents hold it, and
a document never leaves its run.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .shared import map_file, stored, write_file
from .token_units import ByteEncoder, cut_texts, encoder, gather, slices

# Radixes of first ids; runs merged at once; pairs of a block; bytes of text of a run.
RADIXES = 128
FAN_IN = 512
BLOCK_PAIRS = 4096
RUN_BYTES = 5_000_000
# Tasks that fold runs, at most.
MAX_TASKS = 20_000
# Units kept per worker; a full cache is emptied and filled again.
CACHE_UNITS = 150_000
_DOC_BITS, _TIMES_BITS = 24, 8
_RUN = "radix int, run long, at int, first long, n long, keys binary, counts binary"
_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _expand(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=0).astype("<u8"))


def _expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, "<u8")).astype(np.int64)


# -- alignment --------------------------------------------------------------------


class PairEncoder:
    """Aligned tokens of units, kept per distinct unit; ``a`` is a byte-level file, ``b`` a piece model.

    Units start where neither tokenizer can join a token over the cut, so that
    groups end there too.  For ``b`` that holds if no piece has a space behind
    another character, which is looked at on loading.
    """

    def __init__(self, path_a: str, path_b: str, cache_units: int = CACHE_UNITS):
        import sentencepiece

        self.a: ByteEncoder = encoder(path_a, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b}: pieces that reach over a space")
        if self.a.added:
            raise ValueError(f"{path_a}: added tokens that are not special")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.width_b = np.array([len(x) for x in self.bytes_b])
        self.size_a, self.size_b = len(self.a.bytes_of), len(pieces)
        self.rows_a = -(-self.size_a // RADIXES)  # first ids of a radix
        if RADIXES * self.rows_a * self.size_b >= 1 << 63 - _DOC_BITS - _TIMES_BITS:
            raise ValueError("vocabularies too large for pair keys")
        signs = (",", "|", ";")  # what follows a token: another of its side, the other side, the next group
        self.text_of = np.array([f"{i}{s}" for s in signs for i in range(max(self.size_a, self.size_b))], object)
        self.cache_units = cache_units
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        # per unit: n_a, n_b, n_groups, n_links, whether both sides spell it, first pair, pairs
        self.facts = np.empty((0, 7), np.int64)
        self.keys, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Radix, then first id, then second id."""
        return (a % RADIXES * self.rows_a + a // RADIXES) * self.size_b + b

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side, b = np.divmod(keys, self.size_b)
        radix, row = np.divmod(side, self.rows_a)
        return row * RADIXES + radix, b

    def radix(self, keys: np.ndarray) -> np.ndarray:
        return keys // (self.rows_a * self.size_b)

    def learn(self, wanted: set[str]) -> None:
        """Align the units that are not known, each behind a space."""
        missing = [u for u in wanted if u not in self.known]
        if not missing:
            return
        # units that begin with white space are whole texts or their beginnings, and are encoded apart
        apart = [u for u in missing if not u or u[0].isspace()]
        joined = [u for u in missing if u and not u[0].isspace()]
        units = joined + apart
        ids_a, n_a = map(np.concatenate, zip(self.a.encode_units(joined), self.a.encode_units(apart, joined=1)))
        found = self.b.encode(units, num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        ids_b = np.fromiter((i for f in found for i in f), np.int64, int(n_b.sum()))
        ids_a = ids_a.astype(np.int64)
        heads_a, heads_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        spelt = np.ones(len(units), bool)
        for i, unit in enumerate(units):
            told = b" " + unit.encode()
            a = b"".join(map(self.a.bytes_of.__getitem__, ids_a[heads_a[i] : heads_a[i] + n_a[i]].tolist()))
            b = b"".join(map(self.bytes_b.__getitem__, found[i]))
            spelt[i] = a == b == told
        # units that a side spells otherwise have no tokens
        ids_a, ids_b = ids_a[np.repeat(spelt, n_a)], ids_b[np.repeat(spelt, n_b)]
        n_a, n_b = np.where(spelt, n_a, 0), np.where(spelt, n_b, 0)
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        ends_a, ends_b = np.cumsum(self.a.width[ids_a]), np.cumsum(self.width_b[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        of_a, of_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        unit_of = unit_a[np.searchsorted(group_a, np.arange(len(both)))]
        n_groups = np.bincount(unit_of, minlength=len(units))
        links = np.bincount(unit_of, weights=of_a * of_b, minlength=len(units)).astype(np.int64)
        # every token of a with every token of b of its group
        starts_b = (np.cumsum(of_b) - of_b)[group_a]
        all_a = np.repeat(ids_a, of_b[group_a])
        all_b = gather(ids_b, starts_b, of_b[group_a])
        keys = self.key(all_a, all_b)
        unit_of_pair = np.repeat(unit_a, of_b[group_a])
        order = np.lexsort((keys, unit_of_pair))
        keys, unit_of_pair = keys[order], unit_of_pair[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (unit_of_pair[1:] != unit_of_pair[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(keys)))
        n_pairs = np.bincount(unit_of_pair[at], minlength=len(units))
        first = len(self.keys) + np.cumsum(n_pairs) - n_pairs
        facts = np.column_stack([n_a, n_b, n_groups, links, spelt, first, n_pairs])
        self.groups += self._spell(ids_a, ids_b, group_a, group_b, n_a + n_b)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.facts = np.concatenate([self.facts, facts])
        self.keys, self.times = np.concatenate([self.keys, keys[at]]), np.concatenate([self.times, times])

    def _spell(self, ids_a, ids_b, group_a, group_b, n_tokens) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit, with a semicolon at its end."""
        size = max(self.size_a, self.size_b)
        sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        if len(ids_a):
            sign_a[np.append(np.flatnonzero(np.diff(group_a)), len(ids_a) - 1)] = 1
            sign_b[np.append(np.flatnonzero(np.diff(group_b)), len(ids_b) - 1)] = 2
        group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        words = self.text_of[np.concatenate([sign_a * size + ids_a, sign_b * size + ids_b])[order]].tolist()
        stops = np.cumsum(n_tokens).tolist()
        return ["".join(words[a:b]) for a, b in zip([0, *stops], stops)]

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Facts (n_a, n_b, n_groups, n_links) and digests per text, and records: keys, documents, times."""
        units, at, sizes = cut_texts(pc.binary_join_element_wise(" ", texts, ""))
        names = units.to_pylist()
        heads = np.cumsum(sizes) - sizes
        body = np.ones(len(at), bool)
        body[heads] = False
        inner = np.unique(at[body]).tolist()
        firsts = [names[i] for i in at[heads].tolist()]  # empty, or with the added space
        if len(self.known) > self.cache_units:
            self.clear()
        self.learn({names[i] for i in inner}.union(f[1:] for f in firsts if f))
        place = np.full(len(names), -1)
        place[inner] = [self.known[names[i]] for i in inner]
        at = place[at]
        at[heads] = [self.known[f[1:]] if f else -1 for f in firsts]
        doc = np.repeat(np.arange(len(texts)), sizes)
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        used = (at >= 0) & full[doc]
        at, doc = at[used], doc[used]
        # a text with a unit that one side spells otherwise counts as one unit
        doubted = np.unique(doc[self.facts[at, 4] == 0])
        if len(doubted):
            told = [texts[i].as_py() for i in doubted.tolist()]
            self.learn(set(told))
            wholes = np.array([self.known[t] for t in told])
            kept = ~np.isin(doc, doubted)
            at, doc = np.concatenate([at[kept], wholes]), np.concatenate([doc[kept], doubted])
            order = np.argsort(doc, kind="stable")
            at, doc = at[order], doc[order]
        facts = self.facts[at]
        sums = np.zeros((len(texts), 4), np.int64)
        if len(doc):
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            sums[doc[starts]] = np.add.reduceat(facts[:, :4], starts)
        stops = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
        order = at.tolist()
        digests = []
        for a, b in zip([0, *stops], stops):
            joined = "".join(map(self.groups.__getitem__, order[a:b]))
            digests.append(hashlib.sha256(joined[:-1].encode()).hexdigest() if joined else "")
        first, n_pairs = facts[:, 5], facts[:, 6]
        keys, times = gather(self.keys, first, n_pairs), gather(self.times, first, n_pairs)
        return sums, digests, *_records(keys, np.repeat(doc, n_pairs), times)


def _records(keys: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One record per pair and document, sorted, with the number of links."""
    limit = (1 << _TIMES_BITS) - 1
    if times.max(initial=0) > limit:  # a large number is split over several entries
        parts = -(-times // limit)
        last = np.cumsum(parts) - 1
        keys, docs, rest = np.repeat(keys, parts), np.repeat(docs, parts), times - (parts - 1) * limit
        times = np.full(len(keys), limit)
        times[last] = rest
    packed = keys << _DOC_BITS + _TIMES_BITS | docs << _TIMES_BITS | times
    packed.sort()
    named = packed >> _TIMES_BITS
    at = np.flatnonzero(np.diff(named, prepend=-1))
    times = np.add.reduceat(packed & limit, at) if len(at) else np.empty(0, np.int64)
    named = named[at]
    return named >> _DOC_BITS, named & (1 << _DOC_BITS) - 1, times


@functools.lru_cache(maxsize=2)
def pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    """The worker's encoder for two files; its cache outlives tasks."""
    return PairEncoder(path_a, path_b)


# -- runs -------------------------------------------------------------------------


def _run_file(folder: str, run: int) -> str:
    return f"{folder}/run-{run}"


def _write_frames(uri: str, frames: list[bytes]) -> None:
    """Frames one after the other, their sizes as an index, and the index's length at the end."""
    index = json.dumps([len(f) for f in frames]).encode()
    write_file(uri, [*frames, index, len(index).to_bytes(8, "little")])


class _Frames:
    def __init__(self, uri: str):
        self.data = map_file(uri, np.uint8)
        n = int.from_bytes(self.data[-8:].tobytes(), "little")
        self.ends = np.cumsum([0, *json.loads(self.data[-8 - n : -8].tobytes())])

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.ends[i] : self.ends[i + 1]].tobytes()


def _ipc(columns: dict) -> bytes:
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _blocks(radix: int, run: int, keys: np.ndarray, counts: np.ndarray, at: int = 0) -> list[tuple]:
    return [
        (radix, run, at + i // BLOCK_PAIRS, int(keys[i]), len(keys[i : i + BLOCK_PAIRS]),
         _squeeze_keys(keys[i : i + BLOCK_PAIRS]), _squeeze(counts[i : i + BLOCK_PAIRS].astype("<u8")))
        for i in range(0, len(keys), BLOCK_PAIRS)
    ]


def write_runs(docs: DataFrame, folder: str, path_a: str, path_b: str) -> DataFrame:
    """Align ``docs`` and write its runs; (radix, run, ...) rows of pair counts, and a row of radix -1 per run."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pair_encoder(path_a, path_b)
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in slices(batch.column(1), RUN_BYTES):
                sums, digests, keys, doc, times = enc.align(texts)
                at = np.flatnonzero(np.diff(keys, prepend=-1))
                counts, pairs = np.diff(np.append(at, len(keys))), keys[at]
                bounds = np.searchsorted(enc.radix(pairs), np.arange(RADIXES + 1))
                rows = [(-1, run, 0, 0, len(keys), None, None)]
                frames = [
                    _ipc({"doc_id": batch.column(0).slice(first, len(texts)), "sums": pa.array(sums.tolist(), pa.list_(pa.int64())), "sha": digests})
                ]
                for radix, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    x, y = (int(at[i]) if i < len(at) else len(keys) for i in (a, b))
                    rows += _blocks(radix, run, pairs[a:b], counts[a:b])
                    frames += (
                        _squeeze_keys(pairs[a:b]),
                        _squeeze(counts[a:b].astype("<u4")),
                        _squeeze(np.diff(doc[x:y], prepend=0).astype("<i4")),
                        _squeeze(times[x:y].astype("<u4")),
                    )
                _write_frames(_run_file(folder, run), frames)
                yield _batch(rows, _RUN)
                run += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, _RUN)


# -- merge ------------------------------------------------------------------------


def _merged(blocks: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge blocks that come by their first keys into (keys, summed counts) in key order.

    Blocks whose keys may still meet a later block's lie in a heap by their
    next key; the least of them bounds what is complete.
    """
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def complete(bound: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, counts, rest = [], [], []
        while heap and (bound is None or heap[0][0] < bound):
            _, n, k, c = heapq.heappop(heap)
            stop = len(k) if bound is None else int(np.searchsorted(k, bound))
            keys.append(k[:stop])
            counts.append(c[:stop])
            if stop < len(k):
                rest.append((int(k[stop]), n, k[stop:], c[stop:]))
        for item in rest:
            heapq.heappush(heap, item)
        if keys:
            joined, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(joined), np.int64)
            np.add.at(sums, inverse, np.concatenate(counts))
            yield joined, sums

    held, limit = 0, 16 * BLOCK_PAIRS
    for n, (first, keys, counts) in enumerate(blocks):
        if held > limit:
            yield from complete(first)
            held = sum(len(h[2]) for h in heap)
            limit = max(16 * BLOCK_PAIRS, 2 * held)
        heapq.heappush(heap, (first, n, keys, counts))
        held += len(keys)
    yield from complete(None)


def _by_group(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator]]:
    """Consecutive rows of equal ``names`` as (values, blocks), one group after the other."""

    def rows():
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in names))
            parts = zip(*(batch.column(n).to_pylist() for n in ("first", "keys", "counts")))
            yield from zip(keys, parts)

    for group, found in groupby(rows(), key=lambda r: r[0]):
        yield group, ((first, _expand_keys(k), _expand(c, "<u8").astype(np.int64)) for _, (first, k, c) in found)


def _gathered(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.repartition(*keys).sortWithinPartitions(*keys, "first", "run", "at")


def merge_groups(counts: DataFrame, n_groups: int) -> DataFrame:
    """Counts of ``n_groups`` groups of runs in place of single runs'."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, group), blocks in _by_group(batches, ("radix", "group")):
            at = 0
            for keys, sums in _merged(blocks):
                rows = _blocks(radix, group, keys, sums, at)
                at += len(rows)
                yield _batch(rows, _RUN)

    grouped = counts.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n_groups)))
    return _gathered(grouped, "radix", "group").mapInArrow(merge, _RUN)


def _count_file(folder: str, radix: int) -> str:
    return f"{folder}/counts-{radix}"


def write_counts(counts: DataFrame, folder: str, path_a: str, path_b: str) -> DataFrame:
    """Merge all runs' counts into a file of blocks per radix: keys, counts, and which are their first id's highest."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_b = pair_encoder(path_a, path_b).size_b
        for (radix,), blocks in _by_group(batches, ("radix",)):
            frames, firsts, lasts, n_pairs = [], [], [], 0

            def put(keys: np.ndarray, sums: np.ndarray) -> None:
                nonlocal n_pairs
                heads = np.flatnonzero(np.diff(keys // size_b, prepend=-1))
                most = np.repeat(np.maximum.reduceat(sums, heads), np.diff(np.append(heads, len(keys))))
                for i in range(0, len(keys), BLOCK_PAIRS):
                    part = slice(i, i + BLOCK_PAIRS)
                    frames.extend((_squeeze_keys(keys[part]), _squeeze(sums[part].astype("<u8")), _squeeze((sums == most)[part])))
                    firsts.append(int(keys[part][0]))
                    lasts.append(int(keys[part][-1]))
                n_pairs += len(keys)

            held = np.empty(0, np.int64), np.empty(0, np.int64)
            for keys, sums in _merged(blocks):
                keys, sums = np.concatenate([held[0], keys]), np.concatenate([held[1], sums])
                open_from = int(np.searchsorted(keys, keys[-1] // size_b * size_b))  # the last first id may go on
                if open_from:
                    put(keys[:open_from], sums[:open_from])
                held = keys[open_from:], sums[open_from:]
            if len(held[0]):
                put(*held)
            frames.append(json.dumps([firsts, lasts]).encode())
            _write_frames(_count_file(folder, radix), frames)
            yield _batch([(radix, n_pairs)], "radix int, n long")

    return _gathered(counts, "radix").mapInArrow(merge, "radix int, n long")


class _Counts:
    """A radix's merged counts, block by block."""

    def __init__(self, uri: str):
        self.frames = _Frames(uri)
        self.firsts, self.lasts = json.loads(self.frames[len(self.frames.ends) - 2])
        self.block = functools.lru_cache(maxsize=8)(self._block)

    def _block(self, i: int):
        keys, counts, best = (self.frames[3 * i + k] for k in range(3))
        return _expand_keys(keys), _expand(counts, "<u8").astype(np.int64), _expand(best, np.bool_)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and best marks of sorted keys, all of which are there."""
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = 0
        while at < len(keys):
            i = bisect.bisect_right(self.firsts, int(keys[at])) - 1
            stop = int(np.searchsorted(keys, self.lasts[i], "right"))
            there, n, top = self.block(i)
            place = np.searchsorted(there, keys[at:stop])
            counts[at:stop], best[at:stop] = n[place], top[place]
            at = stop
        return counts, best


# -- contributions ----------------------------------------------------------------


def _fold(run: _Frames, open_counts) -> pa.RecordBatch:
    """A run's documents with what the merged counts of their links come to."""
    table = pa.ipc.open_file(run[0]).read_all()
    sums = np.array(table["sums"].to_pylist(), np.int64).reshape(-1, 4)
    added = np.zeros((2, len(sums)), np.int64)
    for radix in range(RADIXES):
        keys = _expand_keys(run[1 + 4 * radix])
        if not len(keys):
            continue
        n = _expand(run[2 + 4 * radix], "<u4")
        docs = np.cumsum(_expand(run[3 + 4 * radix], "<i4"))
        times = _expand(run[4 + 4 * radix], "<u4").astype(np.int64)
        counts, best = open_counts(radix).find(keys)
        np.add.at(added[0], docs, times * np.repeat(best, n))
        np.add.at(added[1], docs, times * np.repeat(counts, n))
    columns = [table["doc_id"].combine_chunks(), *(pa.array(c) for c in sums.T), *(pa.array(c) for c in added), table["sha"].combine_chunks()]
    return pa.RecordBatch.from_arrays(columns, list(_COLUMNS))


def fold_runs(runs: DataFrame, folder: str) -> DataFrame:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_counts = functools.lru_cache(maxsize=RADIXES)(lambda radix: _Counts(_count_file(folder, radix)))
        for batch in batches:
            for run in batch.column(0).to_pylist():
                yield _fold(_Frames(_run_file(folder, run)), open_counts)

    return runs.select("run").mapInArrow(fold, _ROWS)


def align_documents(docs: DataFrame, path_a: str, path_b: str, fan_in: int = FAN_IN) -> DataFrame:
    """Per row of ``docs``: tokens, groups and links of both tokenizers, and what the links' counts come to.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  ``path_a``
    is a byte-level BPE file, ``path_b`` a piece model that puts a space before a
    text.  ``n_best`` counts links whose pair is its first id's most frequent,
    ties included; ``count_sum`` adds the pairs' numbers of documents.  Null and
    empty texts, and texts that one side spells otherwise (those with U+2581),
    have zeros and an empty digest and add nothing to any count.  Repeated rows
    are documents of their own; null ids stay; an empty table gives no rows.
    """
    folder = new_path(docs.sparkSession, "token-pairs")
    made = stored(write_runs(docs, folder, path_a, path_b), "pair-counts")
    runs = made.filter("radix = -1")
    n_runs = runs.count()
    counts = merge_runs(made.filter("radix >= 0"), n_runs, fan_in)
    write_counts(counts, folder, path_a, path_b).collect()  # a row per radix
    return fold_runs(runs.repartition(max(1, min(n_runs, MAX_TASKS))), folder)


def merge_runs(counts: DataFrame, n_runs: int, fan_in: int) -> DataFrame:
    """Counts of at most ``fan_in`` runs."""
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        counts = stored(merge_groups(counts, n_runs), "merged-counts")
    return counts
