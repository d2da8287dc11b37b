"""Normal and Student t distributions without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _NORMAL.inv_cdf(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    guard = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 / guard(1.0 + step * d)
            c = guard(1.0 + step / c)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t) or dof <= 0:
        return math.nan
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))
