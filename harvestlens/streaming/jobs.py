"""Streaming append, upsert, aggregation, change and season jobs.

Checkpoints and outputs belong in folders every executor can reach. Every job can be started again from its
checkpoint: sinks are file sinks with a commit log, or batch folders that a replayed batch writes anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from harvestlens.functions import weather as wx
from harvestlens.operators.changes import latest_by_key


def stream_files(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """A stream over a folder of Parquet files, optionally only those matching a name pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def rate_source(spark: SparkSession, rows_per_second: int = 10, name: str = "id") -> DataFrame:
    """Generated rows with a growing number."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(
        F.col("value").alias(name), "timestamp"
    )


def stream_append(src: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a Parquet folder, then stop; a restart continues where it ended."""
    return (
        src.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(dst)
    )


def stream_to_memory(src: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Collect a small stream in a driver-side table, for inspection and tests."""
    return src.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def stream_to_console(src: DataFrame, rows: int = 1000, mode: str = "append") -> StreamingQuery:
    """Show a stream on the driver's console, `rows` of each batch at most: a display, not a result."""
    return src.writeStream.format("console").option("numRows", rows).outputMode(mode).start()


def upsert_batch(changes: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the last row per key goes to the batch's own folder.

    A replayed batch replaces only its own folder, so running it twice changes nothing, and a batch costs
    what it carries instead of a rewrite of the whole table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, keys, order).write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")

    return write


def stream_upsert(src: DataFrame, changes: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Upsert a stream by key; read the result with `upserted`."""
    return (
        src.writeStream.foreachBatch(upsert_batch(changes, keys, order)).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def upserted(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after all batches: per key the last row by `order`, as within a batch, and by batch among equals; else the row of the
    base table. A late row in a later batch does not replace a newer one."""
    cols = base.columns
    newest = latest_by_key(changes.select("batch", *cols), keys, [*order, "batch"]).select(*cols)
    touched = newest.select(*keys)
    return base.join(touched, list(keys), "left_anti").select(*cols).unionAll(newest)


def stream_agg(src: DataFrame, key, measures: dict, name: str, mode: str = "update") -> StreamingQuery:
    """Running aggregates per key into a driver-side table; the state grows with the number of keys."""
    grouped = src.groupBy(key).agg(*[e.alias(n) for n, e in measures.items()])
    return stream_to_memory(grouped, name, mode)


def stream_result(src: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    """Complete mode to a folder: every batch writes the whole result of its state as `dst/batch=N`.

    Read the highest batch; a replayed batch replaces only its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    return (
        src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete")
        .trigger(availableNow=True).start()
    )


def last_batch(spark: SparkSession, dst: str) -> DataFrame:
    """Rows of the highest batch; a partition filter, so only that folder is read."""
    batches = spark.read.parquet(dst)
    last = batches.agg(F.max("batch").alias("b")).scalar()
    return batches.filter(F.col("batch") == last).drop("batch")


def stream_changes(spark: SparkSession, feed: str, schema, start: int = 0) -> DataFrame:
    """A stream over published changes from one version on."""
    return stream_files(spark, feed, schema).filter(F.col("commit") >= start)


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Zone-less timestamps cannot carry a watermark; they are read as session time."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def windowed_counts(src: DataFrame, time: str, by: Sequence[str], length: str, late: str, measures: dict) -> DataFrame:
    """Tumbling windows per group; rows later than the watermark are dropped."""
    return (
        event_time(src, time).withWatermark(time, late).groupBy(F.window(time, length), *by)
        .agg(*[e.alias(n) for n, e in measures.items()])
        .select(F.col("window.start").alias("window_start"), *by, *measures)
    )


def season_measures(rain="precipitation", tmax="temp_max", tmin="temp_min") -> dict:
    """Season measures that add up, so a running total can be kept per group."""
    return {
        "total_precip": F.sum(rain),
        "dry_days": F.sum(wx.flag(F.col(rain) == 0)),
        "heat_stress_days": F.sum(wx.flag(F.col(tmax) > int(wx.HEAT_C * 10))),
        "gdd_raw": F.sum(wx.gdd_c(tmax, tmin)),
        "obs_count": F.count(F.lit(1)),
    }


def stream_season(src: DataFrame, date="date", station="station", months=(4, 9), **cols) -> DataFrame:
    """Running growing-season totals per station and year; one state row per station-year (update or complete mode).

    The state grows with the station-years seen. For streams without end use `stream_station_days`, whose state the watermark bounds, and
    `fold_seasons` over what it wrote."""
    rows = src.filter(wx.in_season(F.month(date), *months))
    return rows.groupBy(station, F.year(date).alias("year")).agg(
        *[e.alias(n) for n, e in season_measures(**cols).items()]
    )


def stream_station_days(src: DataFrame, date="date", station="station", late="30 days", **cols) -> DataFrame:
    """Daily totals per station in append mode: a day is emitted once the watermark passes it, its state is then
    dropped, and later rows for it are ignored. Season totals are sums over these rows."""
    return windowed_counts(src, date, [station], "1 day", late, season_measures(**cols))


def fold_seasons(days: DataFrame, months=(4, 9), station="station") -> DataFrame:
    """Season totals from the daily totals of `stream_station_days`."""
    rows = days.filter(wx.in_season(F.month("window_start"), *months))
    return rows.groupBy(station, F.year("window_start").alias("year")).agg(*[F.sum(n).alias(n) for n in season_measures()])
