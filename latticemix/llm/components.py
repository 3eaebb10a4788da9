"""Connected components of an edge table by randomised contraction.

In each round every node points to the neighbour (or itself) with the least
hash, edges follow their ends, and loops and repeats go.  Hashes change with the
round, so chains shrink by a constant factor on average, stars and cliques at
once.  Each round ends in stored tables; nothing is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); loops and repeats are allowed."""
    left = stored(_distinct(edges.select("a", "b")), "edges")
    labels, turn = None, 0
    while labels is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("to"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        chosen = F.least(F.col("best"), rank("a"))["to"]
        step = stored(best.select(F.col("a").alias("node"), chosen.alias("root")), "roots")
        for end in ("a", "b"):
            moved = step.select(F.col("node").alias(end), F.col("root").alias("to"))
            left = left.join(moved, end).drop(end).withColumnRenamed("to", end)
        left = stored(_distinct(left.select("a", "b")), "edges")
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            labels = labels.join(onward, "root", "left").select(
                "node", F.coalesce("onward", "root").alias("root")
            )
            labels = stored(labels, "labels")
        turn += 1
    return labels


def _distinct(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of each component of a local graph on nodes 0..n-1 with edges a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, label[label]):
            label = label[label]
