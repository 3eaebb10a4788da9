"""Delimited text without a header, and row identity by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import MAX_BROADCAST_VALUES
from ..session import materialize

# Characters a line is trimmed of on both sides (fixed: all up to the space).
EDGE = r"[\x00-\x20]+"
EDGE_CHARACTERS = "".join(map(chr, range(0x21)))
# A pattern's end also lies before one of these, so that a line ending with one is trimmed by patterns.
LINE_ENDS = ("\u0085", "\u2028", "\u2029")


def _split(lines: DataFrame, delimiter: str) -> DataFrame:
    """Adds ``tokens``: trimmed, split by the regex ``delimiter``, no empty end.

    A line without any delimiter is one token, even if empty.
    """
    by_pattern = F.regexp_replace(F.regexp_replace("value", "^" + EDGE, ""), EDGE + "$", "")
    odd = F.endswith("value", F.lit(LINE_ENDS[0]))
    for end in LINE_ENDS[1:]:
        odd = odd | F.endswith("value", F.lit(end))
    bare = F.when(odd, by_pattern).otherwise(F.btrim("value", F.lit(EDGE_CHARACTERS)))
    tokens = F.col("_tokens")
    # Position of the last non-empty token, 0 when there is none.
    last = F.aggregate(
        F.transform(tokens, lambda t, i: F.when(t != "", i + 1).otherwise(0)),
        F.lit(0),
        lambda acc, i: F.greatest(acc, i),
    )
    as_is = (F.size(tokens) == 1) | (F.element_at(tokens, -1) != "")
    return lines.withColumn("_tokens", F.split(bare, delimiter)).withColumn(
        "tokens", F.when(as_is, tokens).otherwise(F.slice(tokens, 1, last))
    )


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str,
    *,
    with_id: bool = False,
    file_name: bool = False,
    line_in_file: bool = False,
) -> DataFrame:
    """``tokens`` (array of strings) per line.

    ``with_id`` adds ``id``, the 0-based line number over all files in path
    order; ``line_in_file`` the line number within the file as ``line``.
    """
    lines = spark.read.text(path)
    keep = ["tokens"]
    if with_id or line_in_file:
        lines = _number_lines(lines, within_file=line_in_file)
        keep.append("line" if line_in_file else "id")
    if file_name:
        known = "_file_name" if "_file_name" in lines.columns else "_metadata.file_name"
        lines = lines.withColumn("file_name", F.col(known))
        keep.append("file_name")
    return _split(lines, delimiter).select(*keep)


def _number_lines(lines: DataFrame, within_file: bool) -> DataFrame:
    """Dense line numbers by file and block, without shuffling the lines.

    Spark reads a block of a file in one go, so a line's place in its block is
    its running number minus the block's first.  Only one row per block is
    aggregated and joined back.
    """
    tagged = lines.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_name").alias("_file_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    blocks = tagged.groupBy("_file", "_block").agg(
        F.count("*").alias("_n"), F.min("_seq").alias("_first")
    )
    numbered = _with_offsets(blocks, ["_file", "_block"], within="_file" if within_file else None)
    name = "line" if within_file else "id"
    return _shifted(tagged, numbered, ["_file", "_block"], name).select("value", "_file_name", name)


def _with_offsets(blocks: DataFrame, order: list[str], within: str | None) -> DataFrame:
    """Rows before each block.  The window runs over blocks, not rows."""
    window = Window.orderBy(*order) if within is None else Window.partitionBy(within).orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _shifted(rows: DataFrame, blocks: DataFrame, on: list[str], name: str) -> DataFrame:
    """``rows`` with the dense number ``name`` in place of ``_seq``.

    Blocks number about one per input split (a million for 100 TB), and each
    needs two longs: a hashed key and its shift.  That table is counted and
    broadcast.  Beyond the bound, or if two keys hash alike, rows are shuffled
    by block instead; a block holds at most one split, so no key is hot.
    """
    table = materialize(
        blocks.select(
            *on, F.xxhash64(*on).alias("_key"), (F.col("_offset") - F.col("_first")).alias("_shift")
        )
    )
    size = table.agg(F.count("*").alias("n"), F.count_distinct("_key").alias("keys")).first()
    if size.n == size.keys and size.n * 2 <= MAX_BROADCAST_VALUES:
        keyed = rows.withColumn("_key", F.xxhash64(*on))
        joined = keyed.join(F.broadcast(table.select("_key", "_shift")), "_key")
    else:
        joined = rows.join(table.drop("_key").hint("shuffle_merge"), on)
    return joined.withColumn(name, F.col("_shift") + F.col("_seq"))


def with_row_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Dense 0-based id in the table's read order; prefer a key of the data.

    Counts rows per partition, then adds each partition's offset: two narrow
    passes over the input, which must be read the same way both times (a file
    scan is; put a table after a shuffle into storage first).
    """
    tagged = df.withColumn("_part", F.spark_partition_id()).withColumn(
        "_seq", F.monotonically_increasing_id()
    )
    blocks = tagged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    numbered = _with_offsets(blocks, ["_part"], None)
    return _shifted(tagged, numbered, ["_part"], name).select(name, *df.columns)


# -- typed scans ---------------------------------------------------------------------


def drop_leading(tokens: Column) -> Column:
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))


def scan_continuous(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(id, x): the first column is dropped, the rest are doubles."""
    rows = read_delimited(spark, path, delimiter, with_id=True)
    return rows.select("id", drop_leading(F.col("tokens")).cast("array<double>").alias("x"))


def scan_binary(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(id, b): every column is a 0/1 integer; anything else fails the job."""
    rows = read_delimited(spark, path, delimiter, with_id=True)
    bit = lambda t: F.when(t.isin(0, 1), t).otherwise(
        F.raise_error(F.lit("binary features must be 0 or 1"))
    )
    return rows.select("id", F.transform(F.col("tokens").cast("array<int>"), bit).alias("b"))


def scan_labels(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(id, label): the first token of each line."""
    rows = read_delimited(spark, path, delimiter, with_id=True)
    return rows.select("id", F.col("tokens")[0].alias("label"))


def scan_whitespace(spark: SparkSession, path: str) -> DataFrame:
    """(id, x): doubles separated by blanks or tabs, all columns kept."""
    rows = read_delimited(spark, path, "[ \t]+", with_id=True)
    return rows.select("id", F.col("tokens").cast("array<double>").alias("x"))
