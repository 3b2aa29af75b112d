"""Exact ranks and percentiles without gathering a group in one task.

Values are first collapsed to (group, value, counts). Each group's value range is then cut into equal
slices, so sorting runs per slice instead of per group. A second level cuts every slice once more over its own
range, into as many parts as its share of the group's values asks for: one far value or a long tail then leaves
no slice with most of a group. More levels go on in the same way.
Slice totals (at most about `slices` rows per group and level) give the number of values below each slice.
The collapsed values are one exchange that Spark reuses, so the input is read once.
Slice numbers come from exact minima and maxima, so a recomputed task always finds the same slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

SLICES = 512
LEVELS = 2


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition; only group columns can be NULL, slice numbers (`__…`) never are."""
    tests = [left[a] == right[b] if a.startswith("__") else left[a].eqNullSafe(right[b]) for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def _cut(df: DataFrame, by: Sequence[str], keys: Sequence[str], name: str, slices: int) -> DataFrame:
    """Number the equal-width slice of each value within the value range of its keys; a group gets `slices` of them in all, dealt
    to its keys by how many values they hold."""
    ends = F.min("value").alias("__lo"), F.max("value").alias("__hi")
    if keys:
        aliases = [f"__g{i}" for i in range(len(keys))]
        span = df.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, aliases)]).agg(*ends, F.count(F.lit(1)).alias("__c"))
        # a window over the slices of a group, of which there are few
        whole = F.sum("__c").over(Window.partitionBy(*aliases[: len(by)]))
        share = F.ceil(F.col("__c") * F.lit(slices) / whole) if len(keys) > len(by) else F.lit(slices)
        span = span.withColumn("__p", share.cast("double")).drop("__c")
        joined = df.join(span, _same(df, span, list(zip(keys, aliases))), "inner").drop(*aliases)
    else:
        joined = df.withColumn("__ends", df.agg(F.struct(*ends).alias("s")).scalar())
        joined = joined.select(*df.columns, "__ends.__lo", "__ends.__hi", F.lit(float(slices)).alias("__p"))
    place = F.floor((F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.col("__p"))
    number = F.when(F.col("__hi") > F.col("__lo"), F.least(place, F.col("__p") - 1)).otherwise(F.lit(0))
    return joined.withColumn(name, number.cast("int")).drop("__lo", "__hi", "__p")


def _sliced(df: DataFrame, by: Sequence[str], value: str, counts: Mapping[str, Column], slices: int, levels: int):
    """(rows per group and value with their slice, slices with the counts below them, slice key columns)"""
    number = F.col(value).cast("double")
    rows = df.filter(number.isNotNull() & ~F.isnan(number))
    cut = rows.groupBy(*by, number.alias("value")).agg(*[F.sum(c).cast("bigint").alias(n) for n, c in counts.items()])
    keys = list(by)
    for level in range(levels):
        cut = _cut(cut, by, keys, f"__s{level}", slices)
        keys = keys + [f"__s{level}"]

    # running totals over the slices of a group: a window of at most about slices * levels rows
    totals = cut.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counts])
    group = Window.partitionBy(*by)
    earlier = group.orderBy(*keys[len(by):]).rowsBetween(Window.unboundedPreceding, -1)
    side = totals.select(
        *[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)],
        *[F.col(n).alias(f"__n_{n}") for n in counts],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__b_{n}") for n in counts],
        *[F.sum(n).over(group).alias(f"total_{n}") for n in counts],
    )
    return cut, side, keys


def _ranked(cut: DataFrame, side: DataFrame, by: Sequence[str], keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Exact counts below each value of the slices in `side`, sorting within slices only."""
    rows = cut.join(side, _same(cut, side, [(k, f"__j{i}") for i, k in enumerate(keys)]), "inner")
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        *by, "value", *counts,
        *[(F.col(f"__b_{n}") + F.coalesce(F.sum(n).over(w), F.lit(0))).alias(f"below_{n}") for n in counts],
        *[f"total_{n}" for n in counts],
    )


def cumulative_counts(
    df: DataFrame, by: Sequence[str], value: str, counts: Mapping[str, Column] | None = None, slices: int = SLICES,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per (group, value) with each count and the same count over all smaller values (`below_…`).

    Also carries the group total of every count (`total_…`). NULL and NaN values are left out.
    """
    counts = counts or {"n": F.lit(1)}
    cut, side, keys = _sliced(df, by, value, counts, slices, levels)
    return _ranked(cut, side, by, keys, list(counts))


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, points: Mapping[str, float], slices: int = SLICES, levels: int = LEVELS
) -> DataFrame:
    """Exact percentiles per group, linear between neighbours; groups without values give no row.

    Only the slices that hold a wanted rank are sorted.
    """
    cut, side, keys = _sliced(df, by, value, {"n": F.lit(1)}, slices, levels)
    last = F.col("total_n") - 1
    spots = {name: last * F.lit(float(p)) for name, p in points.items()}
    ranks = {name: (F.floor(s), F.least(F.floor(s) + 1, last)) for name, s in spots.items()}

    def covers(first: Column, size: Column) -> Column:
        return reduce(lambda a, b: a | b, [(first <= r) & (r < first + size) for pair in ranks.values() for r in pair])

    wanted = side.filter(covers(F.col("__b_n"), F.col("__n_n")))
    ranked = _ranked(cut, wanted, by, keys, ["n"])
    picks = []
    for name, (low, high) in ranks.items():
        for end, r in (("lo", low), ("hi", high)):
            here = (F.col("below_n") <= r) & (r < F.col("below_n") + F.col("n"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"__{end}_{name}"))
        picks.append(F.max(spots[name] - low).alias(f"__f_{name}"))
    found = ranked.groupBy(*by).agg(*picks)

    def between(name):
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col(f"__f_{name}"))

    out = found.select(*by, *[between(n).alias(n) for n in points])
    return out if by else out.filter(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in points]))


def many_percentiles(
    df: DataFrame, by: Sequence[str], values: Sequence[str], points: Mapping[str, float], slices: int = SLICES
) -> DataFrame:
    """The same percentiles for several columns at once, one row per (group, column)."""
    long = df.select(
        *by, F.explode(F.array(*[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("__v")) for c in values
        ])).alias("__p")
    ).select(*by, "__p.variable", "__p.__v")
    return percentiles(long, [*by, "variable"], "__v", points, slices)


def median_by(df: DataFrame, by: Sequence[str], values: Sequence[str], suffix: str = "") -> DataFrame:
    """One row per group with the median of each column."""
    long = many_percentiles(df, by, values, {"__med": 0.5})
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("variable") == c, F.col("__med"))).alias(f"{c}{suffix}") for c in values]
    )
