"""Quantiles and distinct counts from sketches that can be stored and merged.

One scan makes a sketch for each finest group; every coarser level is a merge of small rows. The exact operators (`ranks`, `grouping`) stay beside them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

K = 800
REGISTERS = 12


def rank_error(k: int = K) -> float:
    """How far the rank of a quantile from a sketch of size k may be off, as a share of all rows, at 99 % confidence."""
    return 2.296 / k**0.9723


def distinct_error(registers: int = REGISTERS) -> float:
    """Relative standard error of a distinct count from 2**registers registers."""
    return 1.04 / 2 ** (registers / 2)


def value_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(by, n, least, most, total, sketch) of each group: what counts, means, extremes and quantiles of any union of groups need. NULL and NaN are no values; a group
    without values has no row."""
    seen = df.withColumn("__v", F.col(value).cast("double")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    return seen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.sum("__v").alias("total"),
        F.kll_sketch_agg_double("__v", F.lit(k)).alias("sketch"),
    )


def merged_values(sketches: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Counts, means, extremes and quantiles of coarser groups from the stored sketches."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("__s")
    ).filter("n > 0")
    found = [F.kll_sketch_get_quantile_double("__s", F.lit(p)).alias(name) for name, p in probs.items()]
    return merged.select(*by, "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most", *found)


def value_levels(sketches: DataFrame, levels: Sequence[Sequence[str]], probs: dict[str, float]) -> DataFrame:
    """`merged_values` of several levels in one table; columns that a level does not have are NULL, and `level` names its columns (`all` for none)."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    out = None
    for level in levels:
        part = merged_values(sketches, level, probs)
        shown = [F.col(c) if c in level else F.lit(None).cast(sketches.schema[c].dataType).alias(c) for c in names]
        part = part.select(F.lit(",".join(level) or "all").alias("level"), *shown, *[c for c in part.columns if c not in level])
        out = part if out is None else out.unionByName(part)
    return out


def distinct_sketches(df: DataFrame, by: Sequence[str], entity: Sequence[str], registers: int = REGISTERS) -> DataFrame:
    """(by, sketch) of the different entities of each group. An entity of several columns is one value; one with a NULL in all of them is none."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(_entity(entity), F.lit(registers)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_distinct): about how many different entities coarser groups hold, each counted once however many finer groups it is in."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def _entity(cols: Sequence[str]) -> Column:
    some = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
    return F.when(some, F.to_json(F.struct(*cols)))
