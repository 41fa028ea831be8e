"""Tail probabilities of the t, normal and chi-square distributions as Columns.

The same functions as in tails, for rows instead of single numbers: incomplete beta and gamma functions by continued fraction
or series, in an aggregate over a sequence whose length follows the parameters.  The logarithms of gamma functions come from Stirling's
series with their large parts cancelled beforehand, so that many degrees of freedom cost no digits.  Null or impossible
arguments (no degrees of freedom) give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, CLOSE, MOST = 1e-300, 1e-16, 20_000
#: Stirling's series, coefficients of 1 / x, 1 / x^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def bound(value: Column, body) -> Column:
    """body(x) with x computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def away(x: Column) -> Column:
    """x, kept from zero."""
    return F.when(F.abs(x) < TINY, TINY).otherwise(x)


def stirling_rest(x: Column) -> Column:
    """log gamma(x) less (x - 1/2) log x - x + log(2 pi) / 2, for x > 0; small x are raised by ten steps of the recurrence."""

    def series(y: Column) -> Column:
        r, out = 1 / (y * y), F.lit(STIRLING[-1])
        for c in reversed(STIRLING[:-1]):
            out = out * r + c
        return out / y

    def raised(y: Column) -> Column:
        steps = y
        for k in range(1, 10):
            steps = steps * (y + k)
        return (y + 9.5) * F.log(y + 10) - 10 + series(y + 10) - F.log(steps) - (y - 0.5) * F.log(y)

    return F.when(x >= 10, series(x)).otherwise(raised(x))


def beta_inc(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b); y is 1 - x, given apart so that neither loses digits."""

    def fraction(s: Column) -> Column:
        """I_x(a, b) where x is on the side on which the continued fraction converges fast."""
        a, b, x, y = s["a"], s["b"], s["x"], s["y"]
        large, less = F.greatest(a, b), F.least(a, b)
        log_x = F.when(x > 0.5, F.log1p(-y)).otherwise(F.log(away(x)))
        log_y = F.when(y > 0.5, F.log1p(-x)).otherwise(F.log(away(y)))
        gammas = (large - 0.5) * F.log1p(less / large) + less * F.log(a + b) - (less - 0.5) * F.log(less) - HALF_LOG_2PI + stirling_rest(a + b) - stirling_rest(a) - stirling_rest(b)
        front = F.exp(a * log_x + b * log_y + gammas) / a

        def half(acc: Column, term: Column) -> Column:
            """One half step of Lentz's method."""
            d, c = 1 / away(1 + term * acc["d"]), away(1 + term / acc["c"])
            return bound(F.struct(c.alias("c"), d.alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (acc["f"] * n["c"] * n["d"]).alias("f"), (F.abs(n["c"] * n["d"] - 1) < CLOSE).alias("done")))

        def step(acc: Column, m: Column) -> Column:
            odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(acc["done"], acc).otherwise(bound(half(acc, odd), lambda one: half(one, even)))

        first = 1 / away(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"), F.lit(False).alias("done"))
        steps = F.least(F.lit(MOST), F.lit(40) + F.ceil(5 * F.sqrt(large)).cast("int"))
        return front * F.aggregate(F.sequence(F.lit(1), steps), start, step)["f"]

    swap = x > (a + 1) / (a + b + 2)
    given = F.struct(*(F.when(swap, q).otherwise(p).alias(n) for n, p, q in (("a", a, b), ("b", b, a), ("x", x, y), ("y", y, x))))
    inside = bound(given, fraction)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(swap, 1 - inside).otherwise(inside)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a larger absolute value of Student's t."""
    t, df = t.cast("double"), df.cast("double")

    def tail(s: Column) -> Column:
        n, square = s["df"], s["t"] * s["t"]
        return beta_inc(n / 2, F.lit(0.5), n / (n + square), square / (n + square))

    value = bound(F.struct(t.alias("t"), df.alias("df")), tail)
    return F.when(F.isnan(t), t).when(F.abs(t) > 1e150, F.when(df > 0, 0.0)).when((df > 0) & t.isNotNull(), value)


def t_upper(t: Column, df: Column) -> Column:
    """Probability of a value above t."""
    return bound(t_two_sided(t, df) / 2, lambda p: F.when(t >= 0, p).otherwise(1 - p))


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x)."""

    def tail(s: Column) -> Column:
        a, x = s["a"], s["x"]
        front = F.exp(a - x + a * F.log(away(x) / a) + 0.5 * F.log(a) - HALF_LOG_2PI - stirling_rest(a))
        most = F.least(F.lit(MOST), F.lit(60) + F.ceil(8 * F.sqrt(a)).cast("int"))

        def add(acc: Column, k: Column) -> Column:
            term = acc["term"] * x / (a + k)
            return F.when(acc["term"] < acc["total"] * CLOSE, acc).otherwise(bound(term, lambda v: F.struct(v.alias("term"), (acc["total"] + v).alias("total"))))

        one = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
        series = F.aggregate(F.sequence(F.lit(1), most), one, add)["total"]

        def step(acc: Column, k: Column) -> Column:
            term, level = -k * (k - a), x + 1 - a + 2 * k
            d, c = 1 / away(term * acc["d"] + level), away(level + term / acc["c"])
            moved = bound(F.struct(c.alias("c"), d.alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (acc["f"] * n["c"] * n["d"]).alias("f"), (F.abs(n["c"] * n["d"] - 1) < CLOSE).alias("done")))
            return F.when(acc["done"], acc).otherwise(moved)

        first = 1 / away(x + 1 - a)
        start = F.struct(F.lit(1 / TINY).alias("c"), first.alias("d"), first.alias("f"), F.lit(False).alias("done"))
        fraction = F.aggregate(F.sequence(F.lit(1), most), start, step)["f"]
        return F.when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    value = bound(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), tail)
    return F.when(F.isnan(x), x).when(x <= 0, 1.0).when(x > 1e300, 0.0).when((a > 0) & x.isNotNull(), value)


def chi2_upper(x: Column, df: Column) -> Column:
    """Probability of a larger chi-square."""
    return gamma_upper(df.cast("double") / 2, x.cast("double") / 2)


def normal_two_sided(z: Column) -> Column:
    """Probability of a larger absolute value of a standard normal."""
    z = z.cast("double")
    return F.when(F.abs(z) > 1e150, 0.0).otherwise(gamma_upper(F.lit(0.5), z * z / 2))
