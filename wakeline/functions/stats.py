"""Small statistics: closed forms as Columns, quantiles and the cluster bootstrap on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_2(p: float) -> float:
    """Quantile of the chi-square distribution with two degrees of freedom."""
    return -2 * math.log(1 - p)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: float) -> float:
    """Quantile for any degrees of freedom, by bisection."""
    lo, hi = 0.0, df + 40 * math.sqrt(2 * df) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def gaussian_scores(re: Column, rn: Column, cee: Column, cnn: Column, cen: Column) -> dict[str, Column]:
    """Squared Mahalanobis distance, negative log likelihood and 90 % area of a residual; 1 m2 is added to the diagonal."""
    a, b = cee + 1.0, cnn + 1.0
    det = a * b - cen * cen
    d2 = (b * re * re - 2 * cen * re * rn + a * rn * rn) / det
    return {"d2": d2, "nll": 0.5 * (d2 + F.log(det) + 2 * math.log(2 * math.pi)), "area90_km2": math.pi * chi2_2(0.9) * F.sqrt(det) / 1e6}


def larger_sigma(cee: Column, cnn: Column, cen: Column) -> Column:
    """Standard deviation along the major axis of a 2x2 covariance."""
    return F.sqrt((cee + cnn) / 2 + F.sqrt(F.pow((cee - cnn) / 2, 2) + cen * cen))


def bootstrap_mean(sums: np.ndarray, counts: np.ndarray, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean over all samples and its percentile interval when whole clusters, given by sum and count, are resampled."""
    if not len(sums):
        return math.nan, math.nan, math.nan
    point = float(sums.sum() / counts.sum())
    if len(sums) < 2 or not n_boot:
        return point, math.nan, math.nan
    draw = np.random.default_rng(seed).integers(0, len(sums), size=(n_boot, len(sums)))
    return point, *map(float, np.quantile(sums[draw].sum(1) / counts[draw].sum(1), [alpha / 2, 1 - alpha / 2]))


def bootstrap_median(groups: list[np.ndarray], n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float, float]:
    if not groups:
        return math.nan, math.nan, math.nan
    point = float(np.median(np.concatenate(groups)))
    if len(groups) < 2 or not n_boot:
        return point, math.nan, math.nan
    rng = np.random.default_rng(seed)
    boot = [np.median(np.concatenate([groups[j] for j in rng.integers(0, len(groups), len(groups))])) for _ in range(n_boot)]
    return point, *map(float, np.quantile(boot, [alpha / 2, 1 - alpha / 2]))
