"""P-values of test statistics, on the driver: one number in, one number out. What is no number gives 1."""

from __future__ import annotations

from math import erfc, exp, inf, isfinite, isnan, lgamma, log, sqrt


def _p(x: float) -> float:
    return min(1.0, max(0.0, x)) if isfinite(x) else 1.0


def z_two_tailed(z: float) -> float:
    return 0.0 if z in (inf, -inf) else _p(erfc(abs(z) / sqrt(2))) if not isnan(z) else 1.0


def reg_incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b), by its continued fraction."""
    if not (a > 0 and b > 0) or isnan(x):
        return float("nan")
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - reg_incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + t * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + t / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def reg_upper_gamma(a: float, x: float) -> float:
    """Q(a, x): a series under a + 1, a continued fraction from there on."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return 1.0 if isnan(x) or dof <= 0 or x <= 0 else 0.0 if x == inf else _p(reg_upper_gamma(dof / 2, x / 2))


def f_sf(f: float, d1: float, d2: float) -> float:
    if isnan(f) or d1 <= 0 or d2 <= 0 or f <= 0:
        return 1.0
    return 0.0 if f == inf else _p(reg_incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_two_tailed(t: float, dof: float) -> float:
    if isnan(t) or dof <= 0:
        return 1.0
    return 0.0 if t in (inf, -inf) else _p(reg_incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)))


def t_approx(t: float, dof: float) -> float:
    """By the normal distribution, corrected for few degrees of freedom."""
    return 1.0 if isnan(t) or dof <= 0 else z_two_tailed(t * (1 - 1 / (4 * dof)) / sqrt(1 + t * t / (2 * dof)) if isfinite(t) else t)


def pearson_p(r: float, n: int) -> float:
    if isnan(r) or n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_two_tailed(r * sqrt((n - 2) / (1 - r * r)), n - 2)


chi2_p_value, f_p_value = chi2_sf, f_sf
