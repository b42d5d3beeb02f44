"""Tail probabilities and quantiles of the F, t and chi-square distributions.

Only used on the few numbers of a fitted model, never on rows.
"""

from __future__ import annotations

import math

TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, Lentz evaluation."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = 1.0 + step / c
            c = c if abs(c) > TINY else TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)
    b = x + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    value = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = b + step / c
        c = c if abs(c) > TINY else TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return math.exp(log_front) * value


def f_tail(f: float, df1: float, df2: float) -> float:
    if not f > 0.0:
        return 1.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile with two-sided coverage p, by bisection."""
    lo, hi = 0.0, 1.0
    while 1.0 - t_tail(hi, df) < p and hi < 1e8:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if 1.0 - t_tail(mid, df) < p else (lo, mid)
    return (lo + hi) / 2.0
