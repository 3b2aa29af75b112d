"""Upsert, conditional update and delete, and the differences between two versions of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from harvestlens.functions.numeric import to_column


def _and(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], set_: Mapping[str, Column | str] | None = None,
    insert: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Target with matching rows updated and unmatched source rows inserted.

    `set_` maps target columns to expressions over `t.<col>` and `s.<col>`; by default every shared column
    takes the source value. `insert` does the same for new rows over `s.<col>`. NULL keys never match.
    A target row matched by several source rows raises an error.

    The target side is a left join, so a hot key in the target can be split by adaptive execution; a full outer join could not.
    Which source keys have a match is found by joining the target's key columns with the packed source: both joins stream the
    target past the source where its measured size allows a broadcast, and only matched keys are made distinct.
    """
    keys = list(keys)
    set_ = {c: F.col(f"s.{c}") for c in target.columns if c in source.columns} if set_ is None else dict(set_)
    insert = {c: F.col(f"s.{c}") for c in target.columns if c in source.columns} if insert is None else dict(insert)

    # Keys compress so well that a task over merged partitions of little data would sort many millions of them; partitions that are dealt
    # out by number are not merged, neither are the target's that are joined to them.
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # source rows sharing a key are collapsed first, so a match stays one row per target row
    packed = source.repartition(parts, *keys).filter(_and([F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.struct(*source.columns)).alias("__row")
    )
    side = packed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", F.col("__row").alias("s"))
    t = target.select(F.struct(*target.columns).alias("t"), *[F.col(k).alias(f"__t{i}") for i, k in enumerate(keys)])
    joined = t.join(side, _and([F.col(f"__t{i}") == F.col(f"__k{i}") for i in range(len(keys))]), "left")
    matched = F.col("__n").isNotNull()

    def updated(c):
        kept = F.col(f"t.{c}")
        return F.when(matched, to_column(set_[c])).otherwise(kept) if c in set_ else kept

    many = F.raise_error(F.lit("several source rows match one target row"))
    checked = joined.withColumn("__ok", F.when(F.col("__n") > 1, many.cast("boolean")).otherwise(F.lit(True)))
    kept = checked.filter("__ok").select(*[updated(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])

    names = [f"__t{i}" for i in range(len(keys))]
    known = side.select(*[F.col(f"__k{i}") for i in range(len(keys))])
    held = target.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    seen = held.join(known, _and([F.col(n) == F.col(f"__k{i}") for i, n in enumerate(names)]), "left_semi").distinct()
    s = source.select(F.struct(*source.columns).alias("s"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    fresh = s.join(seen, _and([F.col(f"__k{i}") == F.col(f"__t{i}") for i in range(len(keys))]), "left_anti")
    added = fresh.select(*[
        (to_column(insert[c]) if c in insert else F.lit(None)).cast(target.schema[c].dataType).alias(c)
        for c in target.columns
    ])
    return kept.unionAll(added)


def update_where(df: DataFrame, cond: Column, set_: Mapping[str, Column]) -> DataFrame:
    """Set columns where the condition holds; all expressions see the old row."""
    return df.select(*[
        F.when(cond, set_[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in set_ else F.col(c)
        for c in df.columns
    ])


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows where the condition holds; an unknown condition keeps the row."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """Row changes between two versions: insert, delete, update_preimage and update_postimage.

    Both versions are united and grouped by key (NULL keys compare equal), which needs one shuffle and no
    join. A key held by several rows of one version raises an error.
    """
    cols = old.columns
    row = F.struct(*cols)
    both = old.select(*keys, row.alias("__o"), F.lit(None).cast(new.select(row).schema[0].dataType).alias("__n")).unionAll(
        new.select(*cols).select(*keys, F.lit(None).cast(old.select(row).schema[0].dataType).alias("__o"), row.alias("__n"))
    )
    grouped = both.groupBy(*keys).agg(
        F.max("__o").alias("o"), F.max("__n").alias("n"), F.count("__o").alias("no"), F.count("__n").alias("nn")
    )
    repeated = F.raise_error(F.lit("a key is held by several rows of one version"))
    grouped = grouped.filter(
        F.when((F.col("no") > 1) | (F.col("nn") > 1), repeated.cast("boolean")).otherwise(~F.col("o").eqNullSafe(F.col("n")))
    )

    def change(kind, side):
        return F.struct(F.lit(kind).alias("_change_type"), F.col(side).alias("row"))

    moves = (
        F.when(F.col("o").isNull(), F.array(change("insert", "n")))
        .when(F.col("n").isNull(), F.array(change("delete", "o")))
        .otherwise(F.array(change("update_preimage", "o"), change("update_postimage", "n")))
    )
    out = grouped.select(F.explode(moves).alias("c")).select("c.row.*", "c._change_type")
    return out if version is None else out.withColumn("_commit_version", F.lit(version))


def apply_changes(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old version with a change feed applied."""
    gone = changes.filter(F.col("_change_type").isin("delete", "update_preimage"))
    came = changes.filter(F.col("_change_type").isin("insert", "update_postimage")).select(*old.columns)
    dropped = gone.select(*[F.col(k).alias(f"__d{i}") for i, k in enumerate(keys)])
    same = _and([old[k].eqNullSafe(dropped[f"__d{i}"]) for i, k in enumerate(keys)])
    return old.join(dropped, same, "left_anti").unionAll(came)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by `order`, and by the whole row among equals. Combines before the shuffle."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    best = df.groupBy(*keys).agg(F.max(row).alias("__row"))
    return best.select("__row.*").select(*df.columns)
