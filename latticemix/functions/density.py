"""Log-densities of one row under one cell, from distances already computed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EPSILON_CEILING, EPSILON_FLOOR, VARIANCE_FLOOR


def log_gaussian(sq_dist: Column, width: int, variance: Column) -> Column:
    """Isotropic Gaussian log-density; ``variance`` is per dimension."""
    variance = F.greatest(variance, F.lit(VARIANCE_FLOOR))
    return (
        -0.5 * sq_dist / variance
        - F.lit(0.5 * width * math.log(2 * math.pi))
        - 0.5 * width * F.ln(variance)
    )


def log_gaussian_scaled(sq_dist: Column, width: int, variance: Column) -> Column:
    """Variant with the norm divided by the width and ln of the deviation."""
    return (
        -0.5 * width * F.ln(2 * math.pi * F.sqrt(variance))
        - 0.5 * sq_dist / (width * width) / variance
    )


def gaussian_density(sq_dist: Column, width: int, std: Column) -> Column:
    """Density (not log).  The normaliser holds ``std``, not its square."""
    return F.exp(-sq_dist / (2 * std * std)) / F.pow(2 * math.pi * std, F.lit(width / 2))


def log_bernoulli(distance: Column, width: int, epsilon: Column) -> Column:
    """``distance`` differing bits out of ``width``, each with chance ``epsilon``."""
    eps = F.least(F.greatest(epsilon, F.lit(EPSILON_FLOOR)), F.lit(EPSILON_CEILING))
    return distance * F.ln(eps) + (F.lit(float(width)) - distance) * F.ln(1 - eps)
