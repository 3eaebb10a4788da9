"""Quality by nearest-neighbour voting in a latent semantic space.

Texts become weighted counts of hashed words and word shapes plus a code for how
much they repeat themselves.  Document frequencies cover all documents.  A
bounded sample of labelled rows spans the latent space (truncated singular
vectors) and is broadcast; every document takes its exact cosines with all of
them, a block of documents at a time, and its nearest neighbours vote with
their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bound on the labelled rows that are fitted and broadcast.
SAMPLE_ROWS = 6000
LATENT = 64
NEIGHBOURS = 15
# Votes of the overall share of label 1, which decides for texts without neighbours.
PRIOR_VOTES = 0.25
SHARPNESS = 8
WORD_BUCKETS, SHAPE_BUCKETS, REPEAT_CODES = 1024, 256, 12
WIDTH = WORD_BUCKETS + SHAPE_BUCKETS + REPEAT_CODES
CACHE_WORDS = 250_000
BLOCK_DOCS = 512


class _Codes(dict):
    """Word -> word bucket * SHAPE_BUCKETS + shape bucket."""

    runs = re.compile(rb"([a-z\x80-\xff])[a-z\x80-\xff]*|([A-Z])[A-Z]*|([0-9])[0-9]*|(.)\4*", re.S)

    def __missing__(self, word: bytes) -> int:
        shape = self.runs.sub(lambda m: b"a" if m[1] else b"A" if m[2] else b"0" if m[3] else m[4], word)
        code = zlib.crc32(word.lower()) % WORD_BUCKETS * SHAPE_BUCKETS + zlib.crc32(shape) % SHAPE_BUCKETS
        self[word] = code
        return code


_codes = _Codes()


def _counts(texts: list[bytes | None]) -> np.ndarray:
    """Counts of word and shape buckets and the repetition code of each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    if len(_codes) > CACHE_WORDS:
        _codes.clear()
    for row, text in zip(out, texts):
        words = (text or b"").split()
        if not words:
            continue
        codes = np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))
        row[:WORD_BUCKETS] = np.bincount(codes // SHAPE_BUCKETS, minlength=WORD_BUCKETS)
        row[WORD_BUCKETS : WORD_BUCKETS + SHAPE_BUCKETS] = np.bincount(codes % SHAPE_BUCKETS, minlength=SHAPE_BUCKETS)
        n = len(words) - 2
        if n > 0:
            windows = (codes[:-2] * 31 + codes[1:-1]) * 1_000_003 + codes[2:]
            repeated = 1 - len(np.unique(windows)) / n
            row[WORD_BUCKETS + SHAPE_BUCKETS + int(np.ceil(repeated * (REPEAT_CODES - 1)))] = 1
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times inverse document frequency; words, shapes and repetition weigh alike."""
    weights = np.log1p(counts) * idf
    for part in np.split(weights, [WORD_BUCKETS, WORD_BUCKETS + SHAPE_BUCKETS], axis=1):
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part, norm, out=part, where=norm > 0)
    return weights


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _text_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for start in range(0, len(batch), BLOCK_DOCS):
            part = batch.slice(start, BLOCK_DOCS)
            yield part, part.column(at).cast(pa.binary()).to_pylist()


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every bucket, over all rows of ``docs``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(WIDTH, np.int64), 0
        for _, texts in _text_batches(batches, 0):
            total += (_counts(texts) > 0).sum(0)
            rows += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(WIDTH + 1)), pa.array(np.append(total, rows))], ["bucket", "n"]
        )

    summed = docs.select(F.col("text").cast("string")).mapInArrow(found, "bucket long, n long")
    rows = summed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row per bucket
    df = np.zeros(WIDTH + 1)
    for r in rows:
        df[r.bucket] = r.n
    return np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(1)


@dataclass(frozen=True)
class Voters:
    """What is broadcast: WIDTH + (LATENT + 1) * sample rows numbers, and the basis."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(texts), prior)
        x = _unit(_weighted(_counts(texts), self.idf) @ self.basis)
        near = x @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        votes = np.clip(np.take_along_axis(near, at, 1), 0, 1).astype(float) ** SHARPNESS
        return ((votes * self.labels[at]).sum(1) + PRIOR_VOTES * prior) / (votes.sum(1) + PRIOR_VOTES)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, latent: int = LATENT) -> Voters:
    """Voters from at most ``sample_rows`` labelled documents that are not held out.

    ``labels`` (doc_id, quality): rows with a null are ignored, of repeated ids
    the mean counts.  The sample is the ids of least hash; of documents with one
    id, the text of least hash stands for all, so the bound is on rows.
    """
    idf = inverse_frequencies(docs)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the sample's size is its parameter; a repeated id is one text before the shuffle
    found = texts.join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    sample = found.groupBy("doc_id").agg(F.first("quality").alias("quality"), one).select("quality", "one.text", "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _text_batches(batches, 1):
            rows = _weighted(_counts(texts), idf)
            yield pa.RecordBatch.from_arrays(
                [part.column(2), part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["doc_id", "quality", "x"],
            )

    got = sample.mapInArrow(vectors, "doc_id long, quality double, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    values, basis = np.linalg.eigh((x.T @ x).astype(float))
    basis = basis[:, ::-1][:, :latent].astype(np.float32)
    return Voters(idf, basis, _unit(x @ basis), got["quality"].to_numpy())


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; a text without words gets the overall share of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _text_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(texts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        vote, "doc_id long, score double"
    )


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts get the overall share of label 1, without any label 0.5.
    Rows without an id are scored and not held out; repeated rows get equal
    scores; an empty table gives no rows; other columns are never read.
    """
    scored = score(docs, fit(docs, labels, sample_rows))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_predicted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` predicted as quality 1, all columns kept.

    Null and empty texts go by the overall share of label 1, without any label
    they stay; repeated rows stay or go together, null ids too; an empty table
    gives no rows.
    """
    voters = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _text_batches(batches, at):
            yield part.filter(pa.array(voters.value.score(texts) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
