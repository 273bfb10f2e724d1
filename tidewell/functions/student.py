"""Quantiles of Student's t, by integrating its density."""

from __future__ import annotations

import math


def t_cdf(t: float, df: int, steps: int = 2000) -> float:
    """P(T <= t), by Simpson's rule after the substitution x = sqrt(df) tan(u)."""
    upper = math.atan(abs(t) / math.sqrt(df))
    h = upper / steps
    total = sum((1 if k in (0, steps) else 4 if k % 2 else 2) * math.cos(k * h) ** (df - 1) for k in range(steps + 1))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    half = scale * total * h / 3
    return 0.5 + half if t >= 0 else 0.5 - half


def t_quantile(p: float, df: int) -> float:
    """t with P(T <= t) = p, by bisection."""
    if df < 1 or not 0 < p < 1:
        raise ValueError("df must be positive and p between 0 and 1")
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2
