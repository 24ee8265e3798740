"""Tail probabilities of the F and chi-square distributions, for the one row of a test result."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value / a


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * value


def f_tail(f: float, df1: float, df2: float) -> float:
    """Probability of an F value at least so large."""
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return 1 - incomplete_gamma(df / 2, x / 2)
