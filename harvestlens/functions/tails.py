"""Tail probabilities of test statistics as column expressions.

The regularised incomplete gamma and beta functions come from a power series or a continued fraction. Either is one `aggregate` over a sequence whose length
follows the row's parameters, so a p-value is an expression like any other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

# The published coefficients of the log-gamma approximation with g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5."""
    y = x - 1
    total = reduce(lambda a, kc: a + F.lit(kc[1]) / (y + F.lit(float(kc[0]))), enumerate(LANCZOS[1:], 1), F.lit(LANCZOS[0]))
    t = y + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + F.lit(0.5)) * F.log(t) - t + F.log(total)


def _terms(size: Column) -> Column:
    """How many terms either expansion gets where both sides of its switch are slowest: a few times the root of the larger parameter."""
    return (F.lit(60) + F.ceil(F.lit(12.0) * F.sqrt(size))).cast("int")


def upper_gamma(a: Column, x: Column) -> Column:
    """Q(a, x), the upper regularised incomplete gamma function, for a >= 0.5; 1 for x <= 0, NULL where a or x is."""
    a, x = a.cast("double"), x.cast("double")
    inner = F.greatest(x, F.lit(1e-300))  # greatest and least skip NULLs, which are told at the end
    front = F.exp(a * F.log(inner) - x - log_gamma(a))
    n = _terms(a)
    # x under a + 1: the series of the lower function, sum of x^k / (a (a + 1) ... (a + k))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))

    def more(s, k):
        term = s["term"] * x / (a + k)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    lower = front * F.aggregate(F.sequence(F.lit(1), n), start, more, lambda s: s["sum"])
    # x beyond: the continued fraction of the upper one, from its last term back to the first
    fraction = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), x + 2 * n + 1 - a, lambda f, k: x + 2 * k - 1 - a - k * (k - a) / f)
    return F.when(a.isNull() | x.isNull(), F.lit(None)).when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - lower).otherwise(front / fraction)


def lower_beta(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b), the regularised incomplete beta function, for a, b >= 0.5 and x from 0 to 1; NULL where an argument is."""
    x, a, b = (c.cast("double") for c in (x, a, b))
    # on the far side of the mean the function of 1 - x converges faster
    far = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(far, b).otherwise(a), F.when(far, a).otherwise(b), F.when(far, 1 - x).otherwise(x)
    safe, rest = F.greatest(y, F.lit(1e-300)), F.greatest(1 - y, F.lit(1e-300))
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(safe) + q * F.log(rest)) / p

    def step(f, m):
        m = m.cast("double")
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        even = (m + 1) * (q - m - 1) * y / ((p + 2 * m + 1) * (p + 2 * m + 2))
        return 1 + odd / (1 + even / f)

    n = _terms(F.greatest(a, b))
    value = front / F.aggregate(F.sequence(n, F.lit(0), F.lit(-1)), F.lit(1.0), step)
    return F.when(x.isNull() | a.isNull() | b.isNull(), F.lit(None)).when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(far, 1 - value).otherwise(value)


def chi_square_tail(x: Column, dof: Column) -> Column:
    """Chance of a chi-square value of x or more; NULL without degrees of freedom."""
    return F.when(dof > 0, upper_gamma(F.greatest(dof.cast("double"), F.lit(1.0)) / 2, x.cast("double") / 2))


def student_tail(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a t statistic; NULL without degrees of freedom, 0 for an infinite t."""
    t, v = t.cast("double"), F.greatest(dof.cast("double"), F.lit(1.0))
    x = F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(v / (v + t * t))
    return F.when(dof > 0, lower_beta(x, v / 2, F.lit(0.5)))


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal value."""
    z = z.cast("double")
    return F.when(z.isNotNull(), upper_gamma(F.lit(0.5), F.least(z * z / 2, F.lit(1e6))))
