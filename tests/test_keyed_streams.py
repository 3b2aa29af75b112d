"""Update-mode tables, repeated deliveries and runs in streams: restarts, replays and bounded state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import runs
from harvestlens.streaming import jobs, keyed

SCHEMA = "id bigint, value bigint, ts timestamp"


def at(text):
    return dt.datetime.fromisoformat(text)


def add(spark, path, *rows, schema=SCHEMA):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def totals(spark, out):
    return {r["k"]: (r["n"], r["total"]) for r in keyed.keyed(spark, out, ["k"]).collect()}


MEASURES = {"n": F.count, "total": F.sum}


def start(spark, src, out, ckpt):
    stream = jobs.stream_files(spark, src, SCHEMA, files_per_batch=1)
    return keyed.stream_keyed(stream, [(F.col("id") % 3).alias("k")], {n: f("value") for n, f in MEASURES.items()}, out, ckpt)


def test_update_mode_writes_changed_keys_only(spark, folder):
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    add(spark, src, *[(i, i, at("2024-01-01")) for i in range(30)])
    run(start(spark, src, out, ckpt))
    add(spark, src, (1, 100, at("2024-01-02")), (None, 5, at("2024-01-02")))
    run(start(spark, src, out, ckpt))
    batches = {(r["batch"], r["k"]) for r in spark.read.parquet(out).select("batch", "k").collect()}
    assert batches == {(0, 0), (0, 1), (0, 2), (1, 1), (1, None)}
    want = {k: (10, sum(range(k, 30, 3))) for k in range(3)}
    want[1], want[None] = (11, want[1][1] + 100), (1, 5)
    assert totals(spark, out) == want


def test_a_stop_in_the_middle_changes_nothing(spark, folder):
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    for k in range(4):
        add(spark, src, *[(i, 10**k, at("2024-01-01")) for i in range(7)])

    def broken(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id == 2:
            raise RuntimeError("lost after the folder was written, before the batch was committed")

    grouped = jobs.stream_files(spark, src, SCHEMA, files_per_batch=1).groupBy((F.col("id") % 3).alias("k")).agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    query = grouped.writeStream.foreachBatch(broken).option("checkpointLocation", ckpt).outputMode("update").trigger(availableNow=True).start()
    with pytest.raises(Exception):
        query.awaitTermination()
    assert sorted(r["batch"] for r in spark.read.parquet(out).select("batch").distinct().collect()) == [0, 1, 2]
    run(start(spark, src, out, ckpt))
    assert totals(spark, out) == {0: (12, 3 * 1111), 1: (8, 2 * 1111), 2: (8, 2 * 1111)}


def test_folded_batches_read_like_all(spark, folder):
    src, out, ckpt, folded = folder("src"), folder("out"), folder("ckpt"), folder("folded")
    for k in range(5):
        add(spark, src, *[(i, k, at("2024-01-01")) for i in range(k + 1)])
    run(start(spark, src, out, ckpt))
    whole = sorted(map(tuple, keyed.keyed(spark, out, ["k"]).select("k", "n", "total").collect()))
    got = keyed.fold_batches(spark, out, ["k"], 3, folded)
    assert sorted(map(tuple, got.select("k", "n", "total").collect())) == whole
    add(spark, src, (2, 50, at("2024-01-01")))
    run(start(spark, src, out, ckpt))
    later = keyed.unfolded(spark, out, ["k"], folded)
    assert sorted(map(tuple, later.select("k", "n", "total").collect())) == sorted(map(tuple, keyed.keyed(spark, out, ["k"]).select("k", "n", "total").collect())) != whole


def test_repeated_deliveries_count_once_and_the_state_is_bounded(spark, folder):
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    days = [[(100 * d + i, i, at("2024-01-01") + dt.timedelta(days=d, hours=i)) for i in range(20)] for d in range(12)]
    held = []
    for d in (*range(6), 5, 4, *range(6, 12), 11):
        add(spark, src, *days[d])
        query = run(jobs.stream_append(keyed.once(jobs.stream_files(spark, src, SCHEMA, files_per_batch=1), ["id"], "ts", "2 days"), out, ckpt))
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = [r["id"] for r in spark.read.parquet(out).select("id").collect()]
    assert sorted(got) == sorted(r[0] for day in days for r in day)
    # two days and the one that is read, however long the stream runs
    assert max(held) <= 3 * 20 + 20 and max(held[-4:]) <= max(held[2:6])


def test_an_event_that_comes_too_late_is_dropped(spark, folder):
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    for rows in ([(1, 1, at("2024-01-10"))], [(2, 2, at("2024-01-01")), (3, 3, at("2024-01-09"))]):
        add(spark, src, *rows)
        run(jobs.stream_append(keyed.once(jobs.stream_files(spark, src, SCHEMA, files_per_batch=1), ["id"], "ts", "2 days"), out, ckpt))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 3]


DAYS = "station string, date date, rain double"


def test_dry_runs_equal_the_batch_form_over_new_year(spark, folder):
    rng = random.Random(5)
    start = dt.date(2021, 11, 1)
    rows = []
    for s in ("a", "b", "c"):
        for d in range(130):
            day = start + dt.timedelta(days=d)
            if rng.random() < 0.9:
                dry = dt.date(2021, 12, 20) <= day <= dt.date(2022, 1, 8) or rng.random() < 0.6
                rows += [(s, day, 0.0 if dry else rng.choice([0.0, 2.5])), (s, day, 0.0 if dry else None)]
    df = spark.createDataFrame(rows, DAYS)
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    spans = [df.filter(F.col("date") < "2021-12-25"), df.filter(F.col("date").between("2021-12-25", "2022-01-31")), df.filter(F.col("date") > "2022-01-31")]
    end = spark.createDataFrame([("end", dt.date(2023, 6, 1), 9.0)], DAYS)
    states = []
    for part in (*spans, end):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = jobs.stream_files(spark, src, DAYS)
        query = run(jobs.stream_append(keyed.stream_runs(stream, F.col("rain") == 0, "rain", late="3 days"), out, ckpt))
        states.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    got = {(r["station"], r["year"]): (r["longest_run_days"], str(r["run_start"])) for r in keyed.longest_by_year(spark.read.parquet(out)).collect()}
    want = runs.longest_dry_run(df, "rain").collect()
    assert got == {(r["station"], r["year"]): (r["longest_run_days"], str(r["run_start"])) for r in want} and len(got) == 6
    # closed runs have left: what stays is the last observation's day
    assert states[-1] <= 1 and max(states) < 3 * 40


def test_a_run_is_emitted_once_when_the_watermark_passes(spark, folder):
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)

    def step(*rows):
        add(spark, src, *rows, schema=DAYS)
        run(jobs.stream_append(keyed.stream_runs(jobs.stream_files(spark, src, DAYS, files_per_batch=1), F.col("rain") == 0, "rain", late="2 days"), out, ckpt))
        return sorted((str(r["first_day"]), str(r["last_day"]), r["days"]) for r in spark.read.parquet(out).collect())

    assert step(("a", day(0), 0.0), ("a", day(1), 0.0), ("a", day(2), 1.0)) == []
    assert step(("a", day(3), 0.0), ("a", day(4), 0.0), ("a", day(12), 3.0)) == [("2024-01-01", "2024-01-02", 2), ("2024-01-04", "2024-01-05", 2)]
    # too late to mend a closed run
    assert step(("a", day(2), 0.0), ("a", day(30), 1.0)) == [("2024-01-01", "2024-01-02", 2), ("2024-01-04", "2024-01-05", 2)]


def test_a_day_is_one_number_in_the_state(spark, folder):
    src, out, ckpt = folder("src"), folder("out"), folder("ckpt")
    add(spark, src, ("a", dt.date(2024, 1, 1), 0.0), ("a", dt.date(2024, 1, 1), 1.5), ("b", dt.date(2024, 1, 2), 0.0), ("b", None, 0.0), schema=DAYS)
    run(jobs.stream_append(keyed.stream_runs(jobs.stream_files(spark, src, DAYS), F.col("rain") == 0, "rain"), out, ckpt))
    kept = [spark.read.format("statestore").option("operatorId", n).load(ckpt).select("key.*", "value.*") for n in (0, 1)]
    days = next(k for k in kept if k.count() == 2)
    # (station, day, sum): the state holds every open day, so what a row weighs is what the stream weighs
    assert [f.dataType.typeName() for f in days.schema] == ["string", "timestamp", "double"]
    assert sorted(tuple(r)[::2] for r in days.collect()) == [("a", 1.5), ("b", 0.0)]


def test_the_longest_run_is_found_without_a_sort(spark, capsys):
    rng, rows = random.Random(8), []
    for s in ("a", "b", None):
        for _ in range(60):
            first = dt.date(1960, 1, 1) + dt.timedelta(days=rng.randrange(6000))
            rows.append((s, first, first + dt.timedelta(days=rng.choice([0, 1, 1, 40, 500]))))
    rows += [("c", dt.date(1969, 12, 31), dt.date(1969, 12, 31)), ("c", dt.date(1969, 3, 1), dt.date(1969, 3, 1)), ("d", dt.date(1, 1, 1), dt.date(1, 1, 2)), ("d", dt.date(9999, 12, 30), dt.date(9999, 12, 31))]
    want = {}
    for s, first, last in rows:
        for y in range(first.year, last.year + 1):
            start = max(first, dt.date(y, 1, 1))
            days = (min(last, dt.date(y, 12, 31)) - start).days + 1
            best = want.get((s, y))
            if best is None or (days, -start.toordinal()) > (best[0], -best[1].toordinal()):
                want[s, y] = (days, start)
    found = keyed.longest_by_year(spark.createDataFrame(rows, "station string, first_day date, last_day date"))
    assert dict(found.dtypes) == {"station": "string", "year": "int", "longest_run_days": "int", "run_start": "date"}
    assert {(r["station"], r["year"]): (r["longest_run_days"], r["run_start"]) for r in found.collect()} == want
    found.explain()
    assert "Sort" not in capsys.readouterr().out
