"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def to_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is zero or missing."""
    a, b = to_column(a), to_column(b)
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def as_num(c, default: float | None = None) -> Column:
    """Text or number to double; unreadable text and NaN become `default`."""
    value = to_column(c).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def as_int(c, default: int | None = None) -> Column:
    """Text or number to a whole number, truncating toward zero."""
    value = as_num(c).try_cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(int(default)).cast("bigint"))


def ratio_plus_one(a, b) -> Column:
    """a / (b + 1): a ratio that stays finite when b is zero."""
    return to_column(a) / (to_column(b) + 1)


def bin_by(c, edges: Sequence[float], labels: Sequence[str], closed: str = "left") -> Column:
    """Label a number by ordered edges; `closed` tells which side of each bin holds its edge.

    NULL falls to the last label, as the open-ended branch of a CASE does.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    c = to_column(c)
    below = (lambda e: c < F.lit(e)) if closed == "left" else (lambda e: c <= F.lit(e))
    chain = F
    for edge, label in zip(edges, labels):
        chain = chain.when(below(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def blend(parts: Sequence, weights: Sequence[float]) -> Column:
    """Weighted sum of prediction columns."""
    return reduce(lambda x, y: x + y, [to_column(p) * F.lit(float(w)) for p, w in zip(parts, weights, strict=True)])


def z_value(value, mean, std, fallback=0.0) -> Column:
    """(value - mean) / std where std is positive, else `fallback` (which may be None for NULL)."""
    std = to_column(std)
    return F.when(std > 0, (to_column(value) - to_column(mean)) / std).otherwise(
        F.lit(None).cast("double") if fallback is None else F.lit(float(fallback))
    )


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
