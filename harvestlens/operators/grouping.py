"""Group statistics beside the rows, totals, shares and ranked rows.

Group statistics are aggregated with map-side combine and joined back, instead of a window over the
group: a window would buffer a whole group in one task, while the join lets adaptive execution split
a hot group, or broadcast the statistics when they are measured to be small. Callers whose groups are small ask for the window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from harvestlens.functions.numeric import to_column


def with_group_stats(
    df: DataFrame, by: Sequence[str], stats: Mapping[str, Column], rows: Column | None = None, small: bool = False
):
    """Add per-group aggregates to every row; NULL keys form a group, as they do in a window.

    `rows` limits the rows that feed the statistics. An empty `by` gives overall statistics. With `small` the caller says that a
    group fits one task (a county, a station): then a window reads the input once, with one shuffle.
    """
    if small and by and rows is None:
        group = Window.partitionBy(*by)
        return df.withColumns({n: e.over(group) for n, e in stats.items()})
    source = df if rows is None else df.filter(rows)
    if not by:
        totals = source.agg(F.struct(*[e.alias(n) for n, e in stats.items()]).alias("all")).scalar()
        keep = df.withColumn("__all", totals)
        return keep.select(*df.columns, *[F.col("__all")[n].alias(n) for n in stats])
    keys = {k: f"__k{i}" for i, k in enumerate(by)}
    side = source.groupBy(*[F.col(k).alias(a) for k, a in keys.items()]).agg(*[e.alias(n) for n, e in stats.items()])
    same = reduce(lambda x, y: x & y, [df[k].eqNullSafe(side[a]) for k, a in keys.items()])
    return df.join(side, same, "left").drop(*keys.values())


def share_of_total(df: DataFrame, count: str, name: str, scale: float = 1.0) -> DataFrame:
    """Each row's part of the column total."""
    total = df.agg(F.sum(count).alias("t")).scalar()
    return df.withColumn(name, F.when(total != 0, F.col(count) / total * F.lit(float(scale))).otherwise(F.lit(0.0)))


def value_counts(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def distinct_count(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), approx: bool = False, name="n_distinct"):
    """Distinct values (or tuples), overall or per group."""
    what = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
    measure = F.approx_count_distinct(what) if approx else F.count_distinct(what)
    return df.groupBy(*by).agg(measure.alias(name))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def top_abs(df: DataFrame, col: str, k: int, ties: Sequence[str], keep_abs: str | None = None) -> DataFrame:
    """The k rows largest in absolute value; `ties` makes the cut deterministic."""
    size = F.abs(to_column(col))
    out = df.filter(F.col(col).isNotNull())
    if keep_abs:
        out = out.withColumn(keep_abs, size)
    return out.orderBy(size.desc(), *ties).limit(k)


def bottom_k(df: DataFrame, col: str, k: int, ties: Sequence[str]) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).orderBy(F.col(col).asc(), *ties).limit(k)


def top_groups(df: DataFrame, by: str, k: int, name: str = "n") -> DataFrame:
    """The k most frequent groups."""
    return value_counts(df, by, name=name).orderBy(F.col(name).desc(), by).limit(k)


def with_rank(limited: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rank column for rows already cut to a fixed k (one task then holds k rows)."""
    return limited.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "position"):
    """The first k rows of each group; Spark applies the rank limit before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def sort_by(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*keys)


def split_by_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, the other rows)."""
    listed = keys_df.select(*keys).distinct()
    return df.join(listed, list(keys), "left_semi"), df.join(listed, list(keys), "left_anti")
