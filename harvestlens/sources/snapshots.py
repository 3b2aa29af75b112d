"""Versions of a table as plain immutable folders `base/v=N` on a shared file system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from harvestlens.operators.changes import snapshot_diff


def _folder(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={int(version)}"


def _children(spark: SparkSession, base: str) -> list[tuple[str, bool]]:
    """(name, finished) of each subfolder; a folder is finished once its writer left the success marker."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    marker = jvm.org.apache.hadoop.fs.Path
    return [
        (s.getPath().getName(), fs.exists(marker(s.getPath(), "_SUCCESS")))
        for s in fs.listStatus(path) if s.isDirectory()
    ]


def versions(spark: SparkSession, base: str) -> list[int]:
    """Finished versions in order."""
    return sorted(int(n[2:]) for n, done in _children(spark, base) if done and n.startswith("v=") and n[2:].isdigit())


def latest_version(spark: SparkSession, base: str) -> int | None:
    found = versions(spark, base)
    return found[-1] if found else None


def write_version(df: DataFrame, base: str, version: int | None = None) -> int:
    """Write the next version. Existing versions are never changed, so readers of older ones are safe."""
    spark = df.sparkSession
    if version is None:
        last = latest_version(spark, base)
        version = 0 if last is None else last + 1
    df.write.mode("errorifexists").parquet(_folder(base, version))
    return version


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version as written; the latest when none is given."""
    if version is None:
        version = latest_version(spark, base)
        if version is None:
            raise ValueError(f"no version under {base}")
    return spark.read.parquet(_folder(base, version))


def change_feed(spark: SparkSession, base: str, keys: Sequence[str], start: int, end: int | None = None) -> DataFrame:
    """Changes of every version from `start` on, each marked with its version; version 0 counts as inserts."""
    found = versions(spark, base)
    end = max(found, default=-1) if end is None else end
    feed = None
    for v in [v for v in found if start <= v <= end]:
        new = read_version(spark, base, v)
        earlier = [u for u in found if u < v]
        old = read_version(spark, base, earlier[-1]) if earlier else new.limit(0)
        part = snapshot_diff(old, new, keys, v)
        feed = part if feed is None else feed.unionByName(part)
    if feed is None:
        raise ValueError("no version in the range")
    return feed


def publish_changes(spark: SparkSession, base: str, keys: Sequence[str], version: int, feed: str) -> str:
    """Write one version's changes as a folder of the change feed, for streaming readers."""
    path = f"{feed.rstrip('/')}/commit={int(version)}"
    change_feed(spark, base, keys, version, version).write.mode("errorifexists").parquet(path)
    return path


def compact(df: DataFrame, files: int, path: str) -> None:
    """Rewrite the same rows into a given number of files in a new folder."""
    df.repartition(files).write.mode("errorifexists").parquet(path)
