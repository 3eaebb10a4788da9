"""Best-fit decreasing packing of token sequences into windows.

Overlong documents are first cut into full windows; their remainders and the
short documents are placed longest first, each into the open window with the
least room that still holds it.  The outcome depends on the pieces' lengths
alone, and there are no more lengths than the window has tokens.  So the counts
per length are packed once, on the driver, in runs of equal windows: a segment
tree over remaining capacities finds the tightest open one.  Each piece then
finds its window from its length and its rank among the pieces of that length.
The plan's size depends on the window, not on the documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, stored
from .token_units import encoder

WINDOW = 2048
PIECES = (
    "part long, rank long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
)


class CapacityTree:
    """A segment tree over capacities 0..n; finds the least marked one from a bound on."""

    def __init__(self, n: int):
        self.size = 1 << (n + 1).bit_length()
        self.marked = [False] * (2 * self.size)

    def mark(self, at: int, value: bool) -> None:
        at += self.size
        self.marked[at] = value
        while at > 1:
            at //= 2
            self.marked[at] = self.marked[2 * at] or self.marked[2 * at + 1]

    def least_from(self, bound: int) -> int | None:
        at = bound + self.size
        while not self.marked[at]:
            while at & 1:  # a right child: its parent holds nothing further right
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.marked[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Place ``counts[length]`` pieces of each length, longest first.

    Returns rows (length, first rank, per window, first window, first offset):
    from that rank on, pieces of the length go to consecutive windows, so many
    to each, from that offset on.
    """
    tree, runs = CapacityTree(window), [[] for _ in range(window + 1)]
    plan, windows = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs[capacity].append((first, n))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.least_from(length)
            if room is None:
                per = window // length
                n = -(-left // per)
                room, first, spare = window, windows, 0
                windows += n
            else:
                first, have = runs[room].pop()
                if not runs[room]:
                    tree.mark(room, False)
                per = room // length
                n = min(have, -(-left // per))
                spare = have - n
            plan.append((length, rank, per, first, window - room))
            placed = min(left, n * per)
            full, rest = divmod(placed, per)
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + n, spare)
            rank, left = rank + placed, left - placed
    return np.array(plan, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Encode every row and cut its ids, end id included, into pieces of at most ``window``.

    ``part`` and ``rank`` number the pieces of each length within their task; the
    table must be stored before they are used.
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, ranks = encoder(tokenizer), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                data, n = ids.astype("<u4").tobytes() + end, len(ids) + 1
                for start in range(0, n, window):
                    length, piece = min(window, n - start), data[4 * start : 4 * (start + window)]
                    row = (part, ranks[length], key, start, length, zlib.crc32(piece), n)
                    out.append((*row, piece) if with_ids else row)
                    ranks[length] += 1
            columns = list(zip(*out)) or [[]] * (8 if with_ids else 7)
            types = [pa.int64()] * 7 + [pa.binary()] * with_ids
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.mapInArrow(cut, schema)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``padded_length`` to stored pieces.

    A sequence is padded to ``window``, except one whose length is a power of
    two, which stays as it is.
    """
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = counted.select("part", "length", before.alias("base"))
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a row per length
    plan = best_fit_plan({r.length: r.n for r in totals}, window)
    order = np.lexsort((plan[:, 1], -plan[:, 0]))
    plan = plan[order]
    fills = _fills(plan, {r.length: r.n for r in totals})

    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.drop("part", "base")
    made = "sequence_id long, offset long, padded_length long"
    schema = ranked.select("*", *[F.lit(0).cast(c.split()[1]).alias(c.split()[0]) for c in made.split(", ")]).schema
    names = arrow_schema(schema).names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = int(plan[:, 1].max(initial=0)) + 1
        keys = -plan[:, 0] * scale + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, -length * scale + np.minimum(rank, scale - 1), "right") - 1
            nth, per = rank - plan[at, 1], plan[at, 2]
            sequence, offset = plan[at, 3] + nth // per, plan[at, 4] + nth % per * length
            filled = _filled(fills, sequence)
            padded = np.where(filled & (filled - 1) == 0, filled, window)
            columns = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (sequence, offset, padded))], names)

    return ranked.mapInArrow(place, schema)


def _fills(plan: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Runs of equally filled windows, (first window, tokens), in order of windows."""
    edges: Counter = Counter()
    for i, (length, rank, per, first, _) in enumerate(plan):
        last = counts[int(length)] if i + 1 == len(plan) or plan[i + 1, 0] != length else int(plan[i + 1, 1])
        full, rest = divmod(last - int(rank), int(per))
        edges[int(first)] += int(per * length)
        edges[int(first) + full] -= int(per * length)
        if rest:
            edges[int(first) + full] += int(rest * length)
            edges[int(first) + full + 1] -= int(rest * length)
    at = sorted(edges)
    return np.column_stack([at, np.cumsum([edges[a] for a in at])]).astype(np.int64).reshape(-1, 2)


def _filled(fills: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    return fills[np.searchsorted(fills[:, 0], sequence, "right") - 1, 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """All documents as packed pieces.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A null or
    empty text is its end id alone; repeated rows and null keys are packed like
    any other row; an empty table gives no pieces.  Pieces of equal length are
    interchangeable: which of them takes which place depends on the partitions.
    """
    return pack(stored(token_pieces(docs, tokenizer, end_id, window), "pieces"), window)


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the padded token ids of each sequence, for pieces packed with ids."""
    piece = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("padded_length").alias("n")
    ).mapInArrow(_joined(pad_id), "sequence_id long, ids array<long>")


def _joined(pad_id: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pieces, n in zip(batch.column("pieces").to_pylist(), batch.column("n").to_pylist()):
                ids = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()
                rows.append(ids + [pad_id] * (n - len(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int64()))], ["sequence_id", "ids"]
            )

    return join
