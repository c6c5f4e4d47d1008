"""Distribution tails and quantiles that Spark has no function for, for a handful of values on the driver."""

from __future__ import annotations

import math


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h


def chi2_sf(x: float, dof: int) -> float:
    return gamma_q(dof / 2, x / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(600):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(hits: int, trials: int, alpha: float = 0.05) -> tuple[float, float]:
    low = 0.0 if hits == 0 else beta_quantile(alpha / 2, hits, trials - hits + 1)
    high = 1.0 if hits == trials else beta_quantile(1 - alpha / 2, hits + 1, trials - hits)
    return low, high


def wilcoxon_p(w: float, n: int, ties: float, exact: bool) -> float:
    """Two-sided p of the smaller signed-rank sum: exact (no ties, no zeros) by counting subsets of ranks, else normal with
    tie correction; ``ties``: sum of t**3 - t."""
    if n == 0:
        return 1.0
    if exact:
        ways = [1]
        for rank in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if s >= rank else 0) for s in range(len(ways) + rank)]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return min(1.0, 2 * normal_sf(abs(w - n * (n + 1) / 4) / sd)) if sd else 1.0
