"""Tables in the shared scratch folder, text bytes from Arrow in blocks, and groups that arrive in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestlens.session import fresh_folder

BLOCK_BYTES = 1 << 20
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back: cuts the lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """The same rows with the columns that an operator does not use under names that it does not use either, and all columns as they were, to select at the end.
    So a caller's column may be called whatever an operator calls its own."""
    own = {c.lower() for c in used}
    kept = [c for c in df.columns if c.lower() in own]
    others = {c: f"__own_{i}" for i, c in enumerate(c for c in df.columns if c.lower() not in own)}
    plain = df.select(*[quoted(c) for c in kept], *[quoted(c).alias(n) for c, n in others.items()])
    return plain, [F.col(others[c]).alias(c) if c in others else quoted(c) for c in df.columns]


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows, for a Python function over whole texts: Arrow batches of BATCH_ROWS rows, unless the session was started with a size of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getConf().get(BATCH_KEY) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    return df


def text_blocks(batch: pa.RecordBatch, name: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of about `most` bytes each and the UTF-8 bytes of a string column in them; null is empty. A longer text is a
    range of its own."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate([*sizes, most + 1]):
        if i > start and held + size > most or i == len(sizes) and start < i:
            yield start, i, [x or b"" for x in column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches that are sorted by them; keys are longs or ints without nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and tuple(int(c[0]) for c in cols) != last
        edges = np.flatnonzero(new)
        begin = 0
        for edge in edges:
            if edge > begin:
                held.append(batch.slice(begin, edge - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], int(edge)
        held.append(batch.slice(begin))
        last = tuple(int(c[-1]) for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def by_shuffle(df: DataFrame) -> DataFrame:
    """The same rows, as a side of a join that deals both sides out and sorts them, so that neither passes through the driver. For joins in which a side may be far
    larger than Spark takes it to be: rows made by a Python function or an explode, files that compress well, and groupings of these. A join that was planned
    as a broadcast stays one when a finished stage shows a larger size, as the other plan has one shuffle more."""
    return df.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows to as many partitions as a shuffle has, for work that makes far more of a row than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))
