"""Token ids as flat binary files with 64-bit document offsets.

A folder holds, per part: ``ids`` (unsigned integers of the smallest width that
fits the vocabulary), ``offsets`` (n + 1 unsigned 64-bit positions within the
part) and ``keys`` (an Arrow file with the documents' keys), and one
``manifest.json`` with each part's counts and bases.  Parts are in key order, so
a base is the prefix sum of the counts before it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_file, read_bytes, write_file
from .token_units import encoder

COUNTS = "part long, n_docs long, n_ids long, dtype string"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _name(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:06d}.{kind}"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, partitions: int | None = None
) -> list[dict]:
    """Encode ``text`` of every row and write the files in ascending ``doc_id`` order.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored.  A
    null text is empty and yields the end id alone; null keys come first;
    repeated keys and rows are all kept, ties in order of their texts' hashes.  An empty
    table gives a manifest without ids.  The driver gets one row of counts per
    part and computes the bases from them.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows of one key, or of none, need not share a part: their texts' hashes, then their places, divide them
    place = [F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")]
    order = ["doc_id", "hash", "place"]
    keyed = rows.select("doc_id", "text", *place)
    spread = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    ordered = spread.sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        ids, sizes, keys = [], [], []
        for batch in batches:
            keys.append(batch.column(0))
            for one in enc.encode(batch.column(1)):
                ids += (one.tobytes(), end)
                sizes.append(len(one) + 1)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.uint64)]).astype("<u8")
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.chunked_array(keys, pa.int64())})
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        write_file(_name(folder, part, "ids"), ids)
        write_file(_name(folder, part, "offsets"), [offsets.tobytes()])
        write_file(_name(folder, part, "keys"), [sink.getvalue()])
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "n_docs": len(sizes), "n_ids": int(offsets[-1]), "dtype": enc.dtype.str}],
            schema=pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("dtype", pa.string())]),
        )

    counts = sorted(ordered.mapInArrow(write, COUNTS).collect())
    manifest, docs_before, ids_before = [], 0, 0
    for c in counts:
        manifest.append({**c.asDict(), "doc_base": docs_before, "id_base": ids_before})
        docs_before, ids_before = docs_before + c.n_docs, ids_before + c.n_ids
    write_file(f"{folder}/manifest.json", [json.dumps({"end_id": end_id, "parts": manifest}).encode()])
    return manifest


def open_part(folder: str, entry: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A part's ids and offsets, memory-mapped, and its keys."""
    ids = map_file(_name(folder, entry["part"], "ids"), entry["dtype"])
    offsets = map_file(_name(folder, entry["part"], "offsets"), "<u8")
    keys = pa.ipc.open_file(read_bytes(_name(folder, entry["part"], "keys"))).read_all()["doc_id"]
    return ids, offsets, keys.combine_chunks()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: place, length and checksum of its ids."""
    parts = json.loads(read_bytes(f"{folder}/manifest.json"))["parts"]
    if not parts:
        return spark.createDataFrame([], ROWS)
    listed = spark.createDataFrame([(json.dumps(p),) for p in parts], "entry string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in map(json.loads, batch.column(0).to_pylist()):
                ids, offsets, keys = open_part(folder, entry)
                bounds = offsets.astype(np.int64)
                crc = [
                    zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(bounds[:-1] + entry["id_base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return listed.repartition(len(parts)).mapInArrow(read, ROWS)
