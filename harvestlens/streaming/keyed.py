"""Keyed results of streams as tables: changed aggregates, rows that are delivered more than once, and runs of days that end.

Nothing is kept on the driver. A batch writes its own folder, so a replayed batch changes nothing, and a reader takes the last batch of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from harvestlens.streaming.jobs import event_time

# Two dry days in a row are a day apart; with another day between they are two.
RUN_GAP = "36 hours"
# The largest number of a day; what is left to it takes 32 bits.
LAST_DAY = 2**31 - 1


def write_batches(changed: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    """Update mode into a folder a batch: each holds the keys that changed in it, as they are after it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    return (
        changed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    )


def stream_keyed(src: DataFrame, keys: Sequence[str | Column], measures: dict, dst: str, checkpoint: str) -> StreamingQuery:
    """Running aggregates per key as a table: a batch writes the keys it changed and no others. Read it with `keyed`."""
    return write_batches(src.groupBy(*keys).agg(*[e.alias(n) for n, e in measures.items()]), dst, checkpoint)


def keyed(spark: SparkSession, dst: str, keys: Sequence[str]) -> DataFrame:
    """The last version of each key. Keys are grouped with map-side combine, so a key that every batch changes is no heavy task."""
    versions = spark.read.parquet(dst)
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select(*keys, *[F.col("v")[c].alias(c) for c in rest])


def fold_batches(spark: SparkSession, dst: str, keys: Sequence[str], upto: int, folded: str) -> DataFrame:
    """The batches up to `upto` written as one, the last version of each key only, under the number of the last of them. Together with the batches after it
    (`unfolded`) it reads like all of them, so the cost of a reader follows the keys and the late batches, not the age of the stream."""
    versions = spark.read.parquet(dst).filter(F.col("batch") <= upto)
    rest = [c for c in versions.columns if c not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, *[F.col("v")[c].alias(c) for c in rest if c != "batch"])
    last.write.mode("overwrite").parquet(f"{folded}/batch={upto}")
    return unfolded(spark, dst, keys, folded)


def unfolded(spark: SparkSession, dst: str, keys: Sequence[str], folded: str) -> DataFrame:
    """The last version of each key from a fold and the batches after it."""
    old = spark.read.parquet(folded)
    upto = old.agg(F.max("batch").alias("b")).scalar()
    versions = old.unionByName(spark.read.parquet(dst).filter(F.col("batch") > upto))
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select(*keys, *[F.col("v")[c].alias(c) for c in rest])


def once(src: DataFrame, ids: Sequence[str], time: str, late: str) -> DataFrame:
    """Each event once, however often it is delivered within `late` of its own time. The state holds the ids of that span only; an event that comes
    later than that is dropped."""
    return event_time(src, time).withWatermark(time, late).dropDuplicatesWithinWatermark(list(ids))


def stream_runs(src: DataFrame, wanted: Column, value: str, date: str = "date", by: Sequence[str] = ("station",), late: str = "30 days", gap: str = RUN_GAP) -> DataFrame:
    """Runs of consecutive days on which a day's sum of `value` is as `wanted` says, in append mode: (by, first_day, last_day, days).

    The days are summed in day windows, and days within `gap` of each other make a session. A run is emitted once the watermark has passed its end and then
    leaves the state, as its days have before; an observation later than `late` is ignored. Rows without a value do not count as observed."""
    seen = event_time(src.filter(F.col(value).isNotNull()), date).withWatermark(date, late).withColumn("__day", F.window(date, "1 day"))
    # a day goes by its last instant: one number in every shuffled row and state key instead of two ends, closed by the same watermark
    days = seen.select(*by, value, F.window_time("__day").alias("at")).groupBy(*by, "at").agg(F.sum(value).alias(value))
    held = days.filter(wanted).select(*by, "at")
    runs = held.groupBy(*by, F.session_window("at", gap).alias("__run")).agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("days"))
    return runs.select(*by, F.to_date("__run.start").alias("first_day"), F.to_date("last").alias("last_day"), "days")


def longest_by_year(runs: DataFrame, by: Sequence[str] = ("station",)) -> DataFrame:
    """The longest run of each calendar year; a run over New Year counts in each year with its days there. Of equal ones the first."""
    years = runs.select(*by, "first_day", "last_day", F.explode(F.sequence(F.year("first_day"), F.year("last_day"))).alias("year"))
    start = F.greatest("first_day", F.make_date("year", F.lit(1), F.lit(1)))
    end = F.least("last_day", F.make_date("year", F.lit(12), F.lit(31)))
    parts = years.select(*by, "year", start.alias("start"), (F.datediff(end, start) + 1).alias("days"))
    # longer first, then earlier, as one number: a maximum that is hashed, where one of structs would sort every run
    rank = F.shiftleft(F.col("days").cast("bigint"), 32) + (F.lit(LAST_DAY).cast("bigint") - F.unix_date("start"))
    best = parts.groupBy(*by, "year").agg(F.max(rank).alias("b"))
    start = F.date_from_unix_date((F.lit(LAST_DAY).cast("bigint") - F.col("b").bitwiseAND(F.lit(2**32 - 1))).cast("int"))
    return best.select(*by, "year", F.shiftright("b", 32).cast("int").alias("longest_run_days"), start.alias("run_start"))
