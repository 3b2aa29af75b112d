"""Partitioned Parquet tables: upserts that rewrite the touched partitions only, and compaction towards a file size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestlens.operators.changes import upsert


def upsert_partitions(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], parts: Sequence[str],
    set_: Mapping[str, Column | str] | None = None, insert: Mapping[str, Column | str] | None = None,
) -> None:
    """Upsert into a table that is partitioned by `parts`, which belong to the key: a row never moves, so only the partitions that the source names are read and
    written anew, and the files of all others stay as they are. The write replaces whole partitions when all of its tasks are done.

    The source's partition values reach the scan of the table at run time. A source row without a partition value raises an error."""
    if not set(parts) <= set(keys):
        raise ValueError(f"the key {list(keys)} must hold the partition columns {list(parts)}")
    if source.filter(" OR ".join(f"`{p}` IS NULL" for p in parts)).head(1):
        raise ValueError("a source row has no partition value")
    table = spark.read.parquet(path)
    touched = table.join(source.select(*parts).distinct(), list(parts), "left_semi").select(*table.columns)
    new = upsert(touched, source, keys, set_, insert)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def stored_bytes(df: DataFrame) -> tuple[int, int]:
    """(bytes, files) of the files that a table's rows come from."""
    each = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    row = each.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    return row["size"], row["n"]


def compact_to_size(spark: SparkSession, src: str, dst: str, target: int, slack: float = 0.25) -> int:
    """Rewrite a table into files of about `target` bytes in a new folder; returns how many. Rows are dealt evenly, so wide rows of one input file spread over all
    new ones.

    The first number of files comes from the bytes there are. Small files hold much that is not rows, so where the new files miss the target by more than
    `slack`, they are dealt once more by the bytes that were written."""
    rows = spark.read.parquet(src)
    size, _ = stored_bytes(rows)
    files = max(1, math.ceil(size / target))
    rows.repartition(files).write.mode("errorifexists").parquet(dst)
    written, _ = stored_bytes(spark.read.schema(rows.schema).parquet(dst))
    better = max(1, math.ceil(written / target))
    if better == files or abs(written / files - target) <= slack * target:
        return files
    # the source is read again, so what is replaced is never read meanwhile
    rows.repartition(better).write.mode("overwrite").parquet(dst)
    return better
