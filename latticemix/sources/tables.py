"""Bindings of the given Parquet tables to points, bits and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import minmax_normalize, one_hot

# The values of events.event_type, in one-hot order (fixed by the data).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, scan: DataFrame, key: str = "id") -> DataFrame:
    """``df`` hashed by its unique key if ``scan`` has fewer partitions than cores.

    For tables of a file or two, ahead of work that multiplies rows; a table
    with enough files stays as read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return df if scan.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def event_points(spark: SparkSession, sf_dir: str, normalize: bool = True) -> DataFrame:
    """(id, x, b): value and hour, min-max normalised, and the one-hot type."""
    events = table(spark, sf_dir, "events")
    points = events.select(
        F.col("event_id").alias("id"),
        F.array(F.col("value"), F.hour("ts").cast("double")).alias("x"),
        one_hot(F.col("event_type"), EVENT_TYPES).alias("b"),
    )
    return spread(minmax_normalize(points, 2) if normalize else points, events)


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("label")
    )


def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): events by value in steps of 25, and type for low values."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("value") < 25, F.col("event_type"))
        .otherwise(F.floor(F.col("value") / 25).cast("string"))
        .alias("label"),
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label): 64 values as doubles and the class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )


EMBEDDING_WIDTH = 64


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label): size and price of each part, and its brand."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("x"),
        F.col("p_brand").alias("label"),
    )
