"""Streams: results equal their batch form, restarts and replays change nothing, late rows are dropped."""

import datetime as dt

from pyspark.sql import functions as F

from harvestlens.operators import changes, seasons
from harvestlens.streaming import jobs
from tests.test_weather import random_weather

SCHEMA = "id bigint, value bigint, ts timestamp"


def at(text):
    return dt.datetime.fromisoformat(text)


def add(spark, path, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_append_continues_after_restart(spark, folder):
    src, dst, ckpt = folder("src"), folder("dst"), folder("ckpt")
    add(spark, src, (1, 1, at("2024-01-01")))
    run(jobs.stream_append(jobs.stream_files(spark, src, SCHEMA), dst, ckpt))
    add(spark, src, (2, 2, at("2024-01-02")))
    for _ in range(2):
        run(jobs.stream_append(jobs.stream_files(spark, src, SCHEMA), dst, ckpt))
    assert sorted(r["id"] for r in spark.read.parquet(dst).collect()) == [1, 2]


def test_upsert_keeps_the_latest_row_and_replays_safely(spark, folder):
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    base = spark.createDataFrame([(1, 0, at("2023-01-01")), (9, 9, at("2023-01-01"))], SCHEMA)
    add(spark, src, (1, 10, at("2024-01-01")), (1, 11, at("2024-01-03")), (2, 20, at("2024-01-01")))
    run(jobs.stream_upsert(jobs.stream_files(spark, src, SCHEMA), out, ckpt, ["id"], ["ts", "value"]))
    add(spark, src, (2, 21, at("2023-12-01")))
    run(jobs.stream_upsert(jobs.stream_files(spark, src, SCHEMA), out, ckpt, ["id"], ["ts", "value"]))

    def result():
        return sorted((r["id"], r["value"]) for r in jobs.upserted(base, spark.read.parquet(out), ["id"], ["ts", "value"]).collect())

    # the second batch holds an older row of key 2, which does not win
    assert result() == [(1, 11), (2, 20), (9, 9)]
    batch = spark.createDataFrame([(2, 21, at("2023-12-01"))], SCHEMA)
    jobs.upsert_batch(out, ["id"], ["ts", "value"])(batch, 1)
    assert result() == [(1, 11), (2, 20), (9, 9)]


def test_key_aggregate_into_memory(spark, folder):
    src = folder("src")
    add(spark, src, *[(i, i, at("2024-01-01")) for i in range(25)])
    run(jobs.stream_agg(jobs.stream_files(spark, src, SCHEMA), (F.col("value") % 10).alias("k"), {"n": F.count(F.lit(1))}, "agg_mem", "complete"))
    assert {r["k"]: r["n"] for r in spark.table("agg_mem").collect()} == {k: 3 if k < 5 else 2 for k in range(10)}


def test_late_rows_are_dropped_behind_the_watermark(spark, folder):
    src, dst, ckpt = folder("src"), folder("dst"), folder("ckpt")

    def step(*rows):
        add(spark, src, *rows)
        stream = jobs.windowed_counts(jobs.stream_files(spark, src, SCHEMA), "ts", ["id"], "1 day", "1 day", {"n": F.count(F.lit(1))})
        run(jobs.stream_append(stream, dst, ckpt))

    step((1, 1, at("2024-01-01T10:00")), (1, 1, at("2024-01-10T10:00")))
    step((1, 1, at("2024-01-01T11:00")), (1, 1, at("2024-01-20T10:00")))
    got = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(dst).collect()}
    assert got == {"2024-01-01": 1, "2024-01-10": 1}


def test_season_stream_equals_batch(spark, folder):
    df, src = random_weather(spark), folder("src")
    df.repartition(3).write.parquet(src)
    stream = jobs.stream_season(jobs.stream_files(spark, src, df.schema, files_per_batch=1))
    run(jobs.stream_result(stream, folder("dst"), folder("ckpt")))
    got = {(r["station"], r["year"]): (r["total_precip"], r["dry_days"], r["obs_count"], r["gdd_raw"]) for r in jobs.last_batch(spark, folder("dst")).collect()}
    want = seasons.growing_season(df).groupBy("station", "year").agg(
        F.sum("total_precip").alias("a"), F.sum("dry_days").alias("b"), F.sum("obs_count_growing").alias("c"), F.sum("gdd_raw").alias("d"))
    assert got == {(r["station"], r["year"]): (r["a"], r["b"], r["c"], r["d"]) for r in want.collect()}


def test_station_days_are_emitted_once(spark, folder):
    df, src, dst = random_weather(spark, 200), folder("src"), folder("dst")
    df.coalesce(1).write.parquet(src)
    run(jobs.stream_append(jobs.stream_station_days(jobs.stream_files(spark, src, df.schema)), dst, folder("ckpt")))
    rows = spark.read.parquet(dst)
    assert rows.count() == rows.select("station", "window_start").distinct().count() > 0


def test_rate_source_and_memory_sink(spark):
    query = jobs.rate_source(spark, 50).writeStream.format("memory").queryName("rate_mem").start()
    try:
        query.processAllAvailable()
        assert spark.table("rate_mem").columns == ["id", "timestamp"]
    finally:
        query.stop()


def test_latest_by_key(spark):
    df = spark.createDataFrame([(1, 1, at("2024-01-01")), (1, 2, at("2024-01-01")), (None, 3, at("2024-01-01"))], SCHEMA)
    got = sorted(((r["id"], r["value"]) for r in changes.latest_by_key(df, ["id"], ["ts"]).collect()), key=str)
    assert got == [(1, 2), (None, 3)]
