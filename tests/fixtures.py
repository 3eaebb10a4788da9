"""Small inputs with known results."""

import os

import numpy as np

from latticemix.cells import CellModel

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

X = [[0.0, 0.0], [0.1, 0.2], [0.2, 0.1], [0.8, 0.9], [0.9, 0.8], [1.0, 1.0], [0.1, 0.9], [0.9, 0.1]]
B = [[0, 0, 0], [0, 0, 1], [0, 0, 0], [1, 1, 1], [1, 1, 0], [1, 1, 1], [0, 1, 1], [1, 0, 0]]
TRUE = list("aaabbbcc")
PREDICTED = ["0", "0", "1", "1", "1", "1", "2", "0"]


def tiny_points(spark):
    return spark.createDataFrame(
        [(i, x, b) for i, (x, b) in enumerate(zip(X, B))],
        "id bigint, x array<double>, b array<int>",
    )


def tiny_model():
    return CellModel.initial(
        2,
        2,
        bin_mean=[[0, 0, 0], [0, 1, 1], [1, 0, 0], [1, 1, 1]],
        bin_epsilon=0.25,
    )


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, label string")


def bundle(*columns):
    return np.array(columns, dtype=float)
