"""Special functions that numpy lacks."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])
_NORMAL = NormalDist()


def normal_quantile(p: np.ndarray) -> np.ndarray:
    return np.vectorize(_NORMAL.inv_cdf, otypes=[float])(p)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
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
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for i in range(1, 1000):
        b += 2
        d = 1 / (-i * (i - a) * d + b or 1e-300)
        c = b - i * (i - a) / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - front * f


def incomplete_gammas(a: float, x: np.ndarray) -> np.ndarray:
    """The same for an array of x, side by side."""
    out = np.zeros(len(x))
    front = np.exp(np.minimum(700.0, a * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(a)))
    low = x < a + 1
    term = total = np.full(int(low.sum()), 1 / a)
    k = a
    while len(term) and (term > total * 1e-16).any():
        k += 1
        term = term * x[low] / k
        total = total + term
    out[low] = front[low] * total
    b = x[~low] + 1 - a
    c, d = np.full(len(b), 1e300), 1 / b
    f = d.copy()
    for i in range(1, 1000):
        if not len(b):
            break
        b = b + 2
        d = 1 / (-i * (i - a) * d + b)
        c = b - i * (i - a) / c
        f = f * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    out[~low] = 1 - front[~low] * f
    return out


def gamma_quantile(a: float, p: float) -> float:
    """Wilson and Hilferty's start, then bisection-guarded Newton steps."""
    z = _NORMAL.inv_cdf(p)
    x = max(1e-12, a * (1 - 1 / (9 * a) + z / (3 * math.sqrt(a))) ** 3)
    low, high = 0.0, math.inf
    for _ in range(200):
        gap = incomplete_gamma(a, x) - p
        low, high = (low, x) if gap > 0 else (x, high)
        slope = math.exp((a - 1) * math.log(x) - x - math.lgamma(a))
        new = x - gap / slope if slope > 0 else math.nan
        if not low < new < high:
            new = (low + high) / 2 if math.isfinite(high) else 2 * x
        if abs(new - x) <= 1e-13 * x:
            return new
        x = new
    return x


def t_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def bracketed(f, low: float, high: float, tolerance: float = 1e-13) -> float | None:
    """A root between two ends of unlike sign; None if the signs agree or an end has no
    value.  False position, where an end that stays loses half its weight, and a halving
    wherever that is slow or has no value."""
    a, b = f(low), f(high)
    if not (math.isfinite(a) and math.isfinite(b)) or a * b > 0:
        return None
    if a == 0 or b == 0:
        return low if a == 0 else high
    for step in range(200):
        x = (low * b - high * a) / (b - a) if step % 4 < 3 and b != a else (low + high) / 2
        if not min(low, high) < x < max(low, high):
            x = (low + high) / 2
        y = f(x)
        if not math.isfinite(y):
            x = (low + high) / 2
            y = f(x)
        if y == 0 or abs(high - low) <= tolerance * max(1.0, abs(x)) or abs(y) < 1e-14:
            return x
        if y * b < 0:
            low, a = high, b
        else:
            a /= 2
        high, b = x, y
    return (low + high) / 2
