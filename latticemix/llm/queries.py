"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import (
    bpe_chunks,
    html_text,
    line_dedup,
    ngram_lm,
    packing,
    personal_data,
    quality_knn,
    quality_rules,
    simhash,
    token_files,
    token_pairs,
    vector_dedup,
    whitening,
)
from .oracle import oracle_sql  # noqa: F401  registered beside the queries
from .shared import text_table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(text_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(text_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    docs = text_table(spark, sf_dir, "documents")
    token_files.write_token_files(docs, folder, public_tokenizers.path(BYTE_BPE), end_id=0)
    return token_files.read_token_files(spark, folder)


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(text_table(spark, sf_dir, "documents"), text_table(spark, sf_dir, "labels"))


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    coded = bpe_chunks.encode_documents(docs, public_tokenizers.path(WORD_BPE))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(text_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(text_table(spark, sf_dir, "pages"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(text_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(text_table(spark, sf_dir, "embeddings"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(text_table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op13_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    return token_pairs.align_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_vector_dedup,
        op2_line_dedup,
        op3_packing,
        op4_simhash,
        op5_token_files,
        op6_quality_knn,
        op7_bpe_chunks,
        op8_quality_rules,
        op9_html_text,
        op10_ngram_lm,
        op11_whitening,
        op12_personal_data,
        op13_token_pairs,
    )
    return {f.__name__: f for f in found}
