"""Documents to packed training windows: classify, apply rules, drop shared lines, drop near-copies, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept.  Its result is written as a table and read again as the next stage's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticemix.llm import line_dedup, packing, quality_knn, quality_rules, simhash
from latticemix.llm.shared import text_table
from latticemix.session import made_so_far, new_path, remove_intermediate

TOKENIZER = "byte_bpe_50k.json"
# Documents of an Arrow batch: whole texts pass through Python, in buffers that double as they fill.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the nearest labelled neighbours call good: all of it without labels.

    Null and empty texts go by the overall share of label 1; repeated rows stay or go
    together, as do rows without an id; all columns stay.
    """
    _small_batches(spark)
    return quality_knn.keep_predicted(docs, text_table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what no quality rule rejects; null and empty texts have too few words.

    Repeated rows stay or go together; all columns stay.
    """
    return quality_rules.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that ten documents or more share; ``n_chars`` follows the text."""
    _small_batches(spark)
    # names that dedup_lines takes for itself stay free: columns keep their places
    names = [c if c in ("text", "n_chars") else f"column_{i}" for i, c in enumerate(docs.columns)]
    kept = line_dedup.dedup_lines(docs.toDF(*names), min_docs=10).drop("n_lines", "n_dropped")
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(names).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group whose fingerprints link at two bits or fewer."""
    _small_batches(spark)
    return simhash.keep_first(docs, radius=2, shingle=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in windows of 2048.

    A null or empty text is its end id alone; repeated rows and null ids are packed
    like any other; an empty table gives no pieces; other columns are left out.
    Pieces of equal length take their places in any order.
    """
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("packing", pack),
]

# The classifier, shingle hashes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage kept is deleted when the next has written its rows."""
    docs = text_table(spark, sf_dir, "documents")
    before = made_so_far()
    for name, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), new_path(spark, name.replace(" ", "-"))
        made.write.parquet(path)
        remove_intermediate(spark, before, (path,))
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
