"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are sorted into cells by the population counts of their
four 16-bit quarters, and cells are cut into tiles of bounded size.  Two
fingerprints within the radius have quarter counts that differ by no more than
the radius in sum, so only tiles of such cells are compared; all others are
skipped.  A comparison of two tiles is an exclusive or and a bit count, and
yields a spanning forest of its links, never all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import numbered, stored, without_rows

RADIUS = 2
SHINGLE = 3
SEED = 42
TILE = 2048
_QUARTERS, _WIDTH = 4, 17  # counts 0..16
_BATCH = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if over half of the shingles' hashes have it; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64
    )
    held = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        held += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * held > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())  # one at a time: a batch of texts is large
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id long, fp long")


def _counts(fp: Column) -> list[Column]:
    return [
        F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("int")
        for q in range(_QUARTERS)
    ]


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of cells in reach, one of each opposite two; the null step first."""
    reach = range(-radius, radius + 1)
    near = [d for d in itertools.product(reach, repeat=_QUARTERS) if sum(map(abs, d)) <= radius]
    return [d for d in sorted(near) if d >= (0,) * _QUARTERS]


def _moved(cell: Column, by: Column, sign: int) -> Column:
    return F.zip_with(cell, by, lambda x, y: x + sign * y)


def _compare(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values linked within two tiles, and the least value each is linked to (a forest)."""
    values = np.concatenate([left, right])
    a, b = [], []
    rows = max(1, _BATCH // max(1, len(right)))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        a.append(i + at)
        b.append(j + len(left))
        if sum(map(len, a)) > _BATCH:  # keep a forest of what was found
            label = forest(np.concatenate(a), np.concatenate(b), len(values))
            linked = np.flatnonzero(label != np.arange(len(values)))
            a, b = [linked], [label[linked]]
    label = forest(np.concatenate(a), np.concatenate(b), len(values))
    linked = np.flatnonzero(values[label] != values)
    return values[linked], values[label[linked]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that span every group of distinct fingerprints ``fp`` in reach of each other."""
    celled = prints.select("fp", F.array(*_counts(F.col("fp"))).alias("cell"))
    # at most 17 ** 4 rows, whatever the number of fingerprints
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = F.broadcast(stored(sizes, "cells"))
    tiled = celled.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    tiles = stored(tiled.groupBy("cell", "tile", "tiles").agg(F.collect_list("fp").alias("fps")), "tiles")

    steps = F.array(*[F.array(*map(F.lit, s)) for s in _steps(radius)])
    still = F.forall("step", lambda x: x == 0)
    other = sizes.select(F.col("cell").alias("there"), F.col("tiles").alias("n_there"))
    reach = tiles.withColumn("step", F.explode(steps))
    # the later tile of each pair stays; the earlier one goes to every tile it meets
    moved = (
        reach.withColumn("there", _moved(F.col("cell"), F.col("step"), 1))
        .join(other, "there")
        .withColumn("other", F.explode(F.expr("sequence(0, n_there - 1)")))
        .filter(~still | (F.col("other") >= F.col("tile")))
        .select("there", "other", F.col("fps").alias("mine"))
    )
    home = tiles.select(F.col("cell").alias("there"), F.col("tile").alias("other"), F.col("fps").alias("theirs"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("mine", "theirs"):
                column = batch.column(name)
                ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
                sides.append(np.split(column.flatten().to_numpy().view(np.uint64), ends[:-1]))
            found = [_compare(x, y, radius) for x, y in zip(*sides)]
            a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    pairs = moved.join(home, ["there", "other"]).select("mine", "theirs")
    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, directly or through others, within ``radius`` bits.

    Texts without words (null, empty, blank) have fingerprint zero and link like
    any other.  ``component_id`` is the least ``doc_id`` in reach; rows without a
    ``doc_id`` take part but give no id (a group of such rows alone has null).
    Repeated rows stay, each with its group's id; an empty table gives no rows;
    other columns are ignored.
    """
    hashed = stored(fingerprints(docs, shingle), "fingerprints")
    least = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(links(least, radius))
    rooted = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(ids, "root").select("fp", "component_id"), "components")
    return hashed.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least ``doc_id``.

    A row without a ``doc_id`` stays only if its group has none with one; of rows
    with equal ids, or of a group without ids, one stays.
    """
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), radius, shingle)
    found = found.select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col("doc_id").cast("long").alias("id")).join(found, row)
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", row)).alias("best")
    kept = stored(ids.groupBy("component_id").agg(best).select(f"best.{row}"), "kept")
    return without_rows(rows, row, rows.select(row).join(kept, row, "left_anti"))
