"""Chi-squared tail probability."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def _leading_factor(shape: float, x: float) -> float:
    """x ** shape * exp(-x) / gamma(shape), without losing digits where both are large."""
    if shape < 100:
        return math.exp(-x + shape * math.log(x) - math.lgamma(shape))
    excess = (x - shape) / shape
    correction = 1 / (12 * shape) - 1 / (360 * shape**3)  # Stirling's series
    return math.exp(-shape * (excess - math.log1p(excess)) - correction) * math.sqrt(shape / (2 * math.pi))


def upper_gamma(shape: float, x: float) -> float:
    """Regularised upper incomplete gamma function.

    Both expansions go on until they have settled, which takes a small multiple of
    the root of ``shape`` steps where the argument is near it.
    """
    if x <= 0:
        return 1.0
    scale = _leading_factor(shape, x)
    if x < shape + 1:
        term = total = 1.0 / shape
        for k in itertools.count(1):
            term *= x / (shape + k)
            total += term
            if term < total * 1e-16:
                return max(0.0, 1.0 - total * scale)
    # continued fraction, modified Lentz
    tiny = 1e-300
    b = x + 1.0 - shape
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for k in itertools.count(1):
        a = -k * (k - shape)
        b += 2.0
        d = a * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + a / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return scale * h


@F.pandas_udf(T.DoubleType())
def chi2_tail(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([upper_gamma(k / 2.0, x / 2.0) for x, k in zip(statistic, degrees)], dtype="float64")
