"""The regularised upper incomplete gamma function, as a vectorised function of two columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x): the power series of P below a + 1, else the continued fraction; 1 where x <= 0."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    out = np.where(x <= 0, 1.0, np.nan)
    lead = np.array([p * math.log(q) - q - math.lgamma(p) if p > 0 and q > 0 else 0.0 for p, q in zip(a, x)])
    low = (x > 0) & (a > 0) & (x < a + 1)
    if low.any():
        p, q = a[low], x[low]
        term = total = 1 / p
        for n in range(1, 2000):
            term = term * q / (p + n)
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[low] = 1 - total * np.exp(lead[low])
    high = (x > 0) & (a > 0) & ~low
    if high.any():
        p, q = a[high], x[high]
        b = q + 1 - p
        c, d = np.full_like(q, 1e300), 1 / b
        h = d
        for n in range(1, 2000):
            an = -n * (n - p)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            step = c * d
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = h * np.exp(lead[high])
    return np.clip(out, 0.0, 1.0)


def gamma_upper(a, x):
    """Q(a, x) of two columns."""

    def q(a: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(gamma_q(a.to_numpy(), x.to_numpy()))

    return F.pandas_udf(q, "double")(a, x)
