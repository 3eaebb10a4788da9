"""Removal of lines that many documents share, by probing a perfect-hash index.

Keys are counted per document with one aggregate over their hashes.  Those of at
least two documents go into shards of a minimal perfect hash: levels of bits in
which a key owns the position that no other key of the level took, its rank
among the set bits being its slot in an array of fingerprints and one of counts.
Documents probe the memory-mapped arrays; no line is joined.  A key of a single
document has no slot: no threshold reaches it, and a 64-bit fingerprint beside
the slot tells it from those that have one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .shared import arrow_schema, map_file, stored, texts_of, write_file

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS_PER_SHARD = 1 << 18
_SPREAD = 1.5
_HASHES = "__line_hashes"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash_pair(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


# -- perfect hash ---------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = np.uint64(2 * level + 1)
    with np.errstate(over="ignore"):
        return (_mix(h1 + turn * np.uint64(0x9E3779B97F4A7C15)) ^ _mix(h2 * turn)) % np.uint64(size)


def build_index(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a minimal perfect hash over distinct (h1, h2) pairs and their counts."""
    sizes, words, left = [], [], np.arange(len(h1))
    while len(left):
        size = -(-int(_SPREAD * len(left) + 1) // 64) * 64
        at = _place(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    bits = np.concatenate(words) if words else np.empty(0, "<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype("<u4")
    index = {"sizes": np.array(sizes, "<i8"), "bits": bits, "ranks": ranks}
    slots = _slots(index, h1, h2)
    prints, held = np.empty(len(h1), "<u8"), np.empty(len(h1), "<u4")
    prints[slots], held[slots] = h2, np.minimum(counts, 0xFFFFFFFF)
    return index | {"prints": prints, "counts": held}


def _slots(index: dict[str, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each pair, -1 where no level has its bit."""
    found, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    one = np.uint64(1)
    for level, size in enumerate(index["sizes"].tolist()):
        at = _place(h1[left], h2[left], level, size).astype(np.int64) + base
        word, bit = index["bits"][at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & one == one
        below = np.bitwise_count(word & ((one << bit) - one))
        found[left[hit]] = index["ranks"][at[hit] >> 6] + below[hit].astype(np.int64)
        left, base = left[~hit], base + size
    return found


def probe(index: dict[str, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Counts of the pairs, 0 for those that the index does not hold."""
    slots = _slots(index, h1, h2)
    out = np.zeros(len(h1), np.int64)
    known = np.flatnonzero(slots >= 0)
    known = known[index["prints"][slots[known]] == h2[known]]
    out[known] = index["counts"][slots[known]]
    return out


ARRAYS = {"sizes": "<i8", "bits": "<u8", "ranks": "<u4", "prints": "<u8", "counts": "<u4"}


def _shard_name(folder: str, shard: int, name: str) -> str:
    return f"{folder}/shard-{shard:06d}.{name}"


@functools.lru_cache(maxsize=256)
def _open_shard(folder: str, shard: int) -> dict[str, np.ndarray]:
    return {n: map_file(_shard_name(folder, shard, n), t) for n, t in ARRAYS.items()}


# -- operators ------------------------------------------------------------------


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n) of every line key of at least ``min_chars`` code points."""
    keys = F.transform(_lines(F.col("text")), line_key)
    long_enough = F.filter(keys, lambda k: F.char_length(k) >= max(1, min_chars))
    pairs = docs.select(F.explode(F.array_distinct(F.transform(long_enough, _hash_pair))).alias("h"))
    return pairs.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n"))


def write_index(counted: DataFrame, folder: str, keys_per_shard: int = KEYS_PER_SHARD) -> HashCounts:
    """Write the shards of an index over ``counted`` (h1, h2, n), a stored table of distinct keys."""
    shards = max(1, -(-counted.count() // keys_per_shard))

    def build(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        index = build_index(column("h1").view(np.uint64), column("h2").view(np.uint64), column("n"))
        shard = table.column("shard")[0].as_py()
        for name, dtype in ARRAYS.items():
            write_file(_shard_name(folder, shard, name), [index[name].astype(dtype).tobytes()])
        return pa.table({"shard": [shard]})

    keyed = counted.withColumn("shard", F.pmod("h1", F.lit(shards)))
    built = keyed.groupBy("shard").applyInArrow(build, "shard long").collect()  # a row a shard
    return HashCounts(folder, shards, frozenset(r.shard for r in built))


@dataclass(frozen=True)
class HashCounts:
    """A written index; its arrays are mapped where they are probed."""

    folder: str
    shards: int
    built: frozenset[int]

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Counts of the keys, 0 for those without a slot; one shard at a time."""
        out = np.zeros(len(h1), np.int64)
        shard = h1.view(np.int64) % self.shards
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if s in self.built:
                mine = order[edges[s] : edges[s + 1]]
                out[mine] = probe(_open_shard(self.folder, s), h1[mine], h2[mine])
        return out


def drop_lines(docs: DataFrame, index: HashCounts, min_docs: int) -> DataFrame:
    """Lines whose indexed count is ``min_docs`` or more leave ``text``."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", _HASHES)]
    hashes = F.transform(F.transform(_lines(F.col("text")), line_key), _hash_pair)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], hashes.alias(_HASHES))
    added = {c: F.lit(0).cast("long") for c in ("n_lines", "n_dropped")}
    schema = rows.drop(_HASHES).withColumns(added).schema
    arrow = arrow_schema(schema)
    at_text = names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(_HASHES)
            flat = hashes.flatten()
            h1, h2 = (flat.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            gone = index.counts(h1, h2) >= min_docs
            sizes = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            texts, dropped = [], []
            for text, start, end in zip(texts_of(batch.column(at_text)), (ends - sizes).tolist(), ends.tolist()):
                n = int(gone[start:end].sum())
                if n:
                    lines = text.split("\n")
                    text = "\n".join([lines[i] for i in np.flatnonzero(~gone[start:end])])
                texts.append(text)
                dropped.append(n)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at_text] = pa.array(texts, pa.string())
            columns += [pa.array(sizes), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(rewrite, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop, in every document, all lines whose key is found in ``min_docs`` documents or more.

    A key is the line without blanks at its ends, A-Z in lower case; keys under
    ``min_chars`` (at least 1) code points are kept, so empty lines stay.  The
    columns of ``docs`` stay, with the remaining lines in ``text``, and ``n_lines``
    (before) and ``n_dropped`` are added, replacing columns of these names.  A null
    text counts as one empty line and becomes an empty text.  Each row counts as a
    document, so repeated rows count each; an empty table stays empty.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more: the index holds no keys of single documents")
    counted = stored(line_counts(docs, min_chars).filter("n >= 2"), "line-counts")
    index = write_index(counted, new_path(docs.sparkSession, "line-index"))
    return drop_lines(docs, index, min_docs)
