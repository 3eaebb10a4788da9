"""Counter-based random numbers: each is a hash of what it is for, so any engine states the same."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading hexadecimal digits of the hash: 52 bits, which a double holds exactly.
DIGITS = 13


def uniform(*counters: Column | int) -> Column:
    """A double in [0, 1) for each combination of whole numbers."""
    text = F.concat_ws(":", *[(F.lit(c) if isinstance(c, int) else c).cast("string") for c in counters])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(16.0**DIGITS)


def uniform_table(seed: int, stream: int, rows: int, width: int) -> np.ndarray:
    """``uniform(seed, stream, row, position)`` for a whole table, on the driver."""
    digits = (
        hashlib.md5(f"{seed}:{stream}:{i}:{j}".encode()).hexdigest()[:DIGITS] for i in range(rows) for j in range(width)
    )
    return np.fromiter((int(d, 16) for d in digits), float, rows * width).reshape(rows, width) / 16.0**DIGITS
