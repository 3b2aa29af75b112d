"""Train/test splits and fold assignment by whole entity or by year."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from harvestlens.session import materialize

COUNTY_KEY = ("state_fips", "county_fips")
BUCKETS = 1000


def key_number(keys: Sequence[str]) -> Column:
    """Evenly spread whole number of an entity key."""
    return F.xxhash64(*keys)


def entity_split(
    df: DataFrame, keys: Sequence[str] = COUNTY_KEY, frac: float = 0.2, number: Column | None = None, name="split"
) -> DataFrame:
    """Every entity falls wholly into train or test; the same key always falls on the same side.

    `number` replaces the hash with any whole number of the key.
    """
    slot = F.pmod(key_number(keys) if number is None else number, F.lit(BUCKETS))
    return df.withColumn(name, F.when(slot < int(round(frac * BUCKETS)), F.lit("test")).otherwise(F.lit("train")))


def time_split(df: DataFrame, first_test_year: int, year="year", name="is_test") -> DataFrame:
    return df.withColumn(name, F.col(year) >= first_test_year)


def group_kfold(df: DataFrame, keys: Sequence[str] = COUNTY_KEY, k: int = 5, number: Column | None = None, name="fold"):
    """Fold of each row; rows of one entity share a fold."""
    return df.withColumn(name, F.pmod(key_number(keys) if number is None else number, F.lit(k)).cast("int"))


def validation_rows(df: DataFrame, frac: float, row_key: Sequence[str], name="is_validation") -> DataFrame:
    """Deterministic row-level holdout for early stopping."""
    slot = F.pmod(F.xxhash64(F.lit(42), *row_key), F.lit(BUCKETS))
    return df.withColumn(name, slot < int(round(frac * BUCKETS)))


def year_table(df: DataFrame, year="year") -> DataFrame:
    return df.select(F.col(year).cast("int").alias("year")).filter(F.col("year").isNotNull()).distinct()


def walk_forward(df: DataFrame, first_test_year: int, folds: int = 5, year="year") -> DataFrame:
    """Sliding folds before the test period: (fold, cutoff, test_year).

    Each fold trains on years before its cutoff and tests on as many consecutive training years as the
    real test period has; the last `folds` positions are kept. Works on the table of distinct years only.
    """
    years = year_table(df, year).agg(F.sort_array(F.collect_set("year")).alias("ys"))
    train = F.filter("ys", lambda y: y < first_test_year)
    window = F.size("ys") - F.size(train)
    starts = F.size(train) - window + 1
    cut = years.select(train.alias("ys"), window.alias("w"), starts.alias("starts")).filter(
        (F.col("w") > 0) & (F.col("starts") > 0)
    )
    first = F.greatest(F.col("starts") - folds, F.lit(0))
    placed = cut.select(
        "ys", "w", F.posexplode(F.slice("ys", first + 1, F.col("starts") - first)).alias("fold", "cutoff"),
        first.alias("first"),
    )
    return placed.select(
        (F.col("fold") + 1).alias("fold"), "cutoff",
        F.explode(F.slice("ys", F.col("first") + F.col("fold") + 1, F.col("w"))).alias("test_year"),
    )




def packed(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, int]]:
    """Deal entities to `k` folds, longest first, each to the fold with the fewest rows so far (the first of equal ones).

    `sizes` has (rows of an entity, number of such entities); the result has (rows, fold, from, to): the entities of that many rows with a number from `from` up
    to `to` fall in the fold. Equal entities are dealt at once: those that lift every fold to a common level, then the few that are left, one by one."""
    loads, out = [0] * k, []
    for rows, many in sorted(sizes, reverse=True):
        def lifted(level: int) -> list[int]:
            return [max(0, -(-(level - x) // rows)) for x in loads]

        low, high = min(loads), max(loads) + rows * (many + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(lifted(middle)) <= many else (low, middle)
        got = lifted(low)
        for _ in range(many - sum(got)):
            least = min(range(k), key=lambda f: (loads[f] + got[f] * rows, f))
            got[least] += 1
        first = 0
        for f in range(k):
            if got[f]:
                out.append((rows, f, first, first + got[f]))
                first += got[f]
            loads[f] += got[f] * rows
    return out


def balanced_folds(df: DataFrame, keys: Sequence[str] = COUNTY_KEY, k: int = 5, name: str = "fold", buckets: int = 64) -> DataFrame:
    """Fold of each row, whole entities, folds as equal in rows as longest-first packing makes them: no two differ by more than the largest entity.

    Only the number of entities of each size reaches the driver: as many rows as there are different sizes, at most the root of twice the table's rows. Entities
    of one size are numbered within buckets of their key's hash, so a size that most entities have is no single task. A null in the key is a value like any other."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    entities = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).withColumn("__b", F.pmod(key_number(keys), F.lit(buckets)).cast("int")))
    dealt = packed([(r["__rows"], r["n"]) for r in entities.groupBy("__rows").agg(F.count(F.lit(1)).alias("n")).collect()], k)
    plan = df.sparkSession.createDataFrame(dealt, "__rows long, __fold int, __from long, __to long")
    before = Window.partitionBy("__rows").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = entities.groupBy("__rows", "__b").agg(F.count(F.lit(1)).alias("n")).select("__rows", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__rows", "__b").orderBy(*keys)) - 1
    numbered = entities.withColumn("__n", within).join(starts, ["__rows", "__b"]).withColumn("__n", F.col("__n") + F.col("__start"))
    placed = numbered.join(plan, "__rows").filter("__n >= __from AND __n < __to").select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("__fold").alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    return df.drop(name).join(placed, reduce(and_, same)).drop(*[f"__k{i}" for i in range(len(keys))])
