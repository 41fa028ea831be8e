"""Tail probabilities of the normal, t, F, chi-square and hypergeometric distributions, on math alone and in log space."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def stirling_rest(x: float) -> float:
    """log gamma(x) less (x - 1/2) log x - x + log(2 pi) / 2."""
    if x < 30:
        return math.lgamma(x) - (x - 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi)
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function, by the continued fraction of Lentz; y is 1 - x where that is known to more digits."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    y = 1 - x if y is None else y
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, y, x)
    large, less = max(a, b), min(a, b)
    gammas = (large - 0.5) * math.log1p(less / large) + less * math.log(a + b) - (less - 0.5) * math.log(less) - 0.5 * math.log(2 * math.pi) + stirling_rest(a + b) - stirling_rest(a) - stirling_rest(b)
    logs = a * (math.log1p(-y) if x > 0.5 else math.log(x)) + b * (math.log1p(-x) if y > 0.5 else math.log(y))
    front = math.exp(gammas + logs) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > tiny else 1 / tiny
    f = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_upper(t: float, df: float) -> float:
    p = t_two_sided(t, df) / 2
    return p if t >= 0 else 1 - p


def t_quantile(p: float, df: float) -> float:
    """The t that a variable stays below with probability p >= 0.5, by bisection."""
    low, high = 0.0, 1.0
    while t_upper(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_upper(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def f_upper(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for k in range(1, 5000):
        num = -k * (k - a)
        b += 2
        d = 1 / (num * d + b or 1e-300)
        c = b + num / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided p of a 2 x 2 table."""

    def log_p(k):
        return sum(math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1) for n, r in ((a + b, k), (c + d, a + c - k))) - (math.lgamma(a + b + c + d + 1) - math.lgamma(a + c + 1) - math.lgamma(b + d + 1))

    own = log_p(a)
    p = sum(math.exp(x) for k in range(max(0, a + c - c - d), min(a + b, a + c) + 1) if (x := log_p(k)) <= own + 1e-7)
    odds = a * d / (b * c) if b * c else (math.inf if a * d else math.nan)
    return odds, min(1.0, p)
