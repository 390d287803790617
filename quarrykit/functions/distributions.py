"""Distribution functions from published series, for one number at a time on the driver.

Incomplete beta and gamma by continued fractions (Lentz), the normal quantile by Acklam's
rational approximation with one Newton step, Kolmogorov's series, and MacKinnon's response
surface for the constant-only unit-root statistic.
"""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if f <= 0:
        return 1.0
    return 0.0 if math.isinf(f) else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    """P(chi-square > x)."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


# Acklam's coefficients.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_ppf(p: float) -> float:
    if p <= 0 or p >= 1:
        return math.copysign(math.inf, p - 0.5)

    def poly(c, x):
        out = 0.0
        for k in c:
            out = out * x + k
        return out

    if min(p, 1 - p) < 0.02425:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        z = poly(_C, q) / poly((*_D, 1), q)
        z = z if p < 0.5 else -z
    else:
        q = p - 0.5
        z = q * poly(_A, q * q) / poly((*_B, 1), q * q)
    e = normal_cdf(z) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(z * z / 2)
    return z - u / (1 + z * u / 2)


def normal_ppfs(p: np.ndarray) -> np.ndarray:
    """``normal_ppf`` of each value, NaN for NaN: the same for a value whatever stands beside it."""
    distinct, where = np.unique(p, return_inverse=True)
    return np.array([normal_ppf(x) if x == x else np.nan for x in distinct.tolist()], dtype=float)[where]


def kolmogorov_sf(z: float) -> float:
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def ks_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    return kolmogorov_sf(math.sqrt(n1 * n2 / (n1 + n2)) * d)


def mackinnon_p(tau: float) -> float:
    """P-value of a unit-root statistic with a constant."""
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    if tau <= -1.61:
        return normal_cdf(2.1659 + 1.4412 * tau + 0.038269 * tau**2)
    return normal_cdf(1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
