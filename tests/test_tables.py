"""Upsert, versions, change feeds, tables and files."""

import json

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import changes
from harvestlens.plans import studies
from harvestlens.sources import files, snapshots, tables

STUDENT = "id int, name string, age int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def students(spark, *data):
    return spark.createDataFrame(list(data), STUDENT)


def test_upsert_with_expressions(spark):
    target = students(spark, (1, "a", 10), (2, "b", 20), (None, "n", 1))
    source = students(spark, (2, "B", 5), (3, "c", 30), (None, "m", 2))
    got = changes.upsert(target, source, ["id"], {"age": F.col("s.age") + 10})
    assert rows(got) == sorted([(1, "a", 10), (2, "b", 15), (None, "n", 1), (3, "c", 30), (None, "m", 2)], key=str)


def test_upsert_refuses_ambiguous_matches_only(spark):
    target = students(spark, (1, "a", 10))
    twice_new = students(spark, (7, "x", 1), (7, "y", 2))
    assert changes.upsert(target, twice_new, ["id"]).count() == 3
    with pytest.raises(Exception, match="several source rows"):
        changes.upsert(target, students(spark, (1, "x", 1), (1, "y", 2)), ["id"]).collect()


def test_upsert_updates_every_target_row_of_a_key(spark):
    target = students(spark, (1, "a", 10), (1, "b", 20))
    assert rows(changes.upsert(target, students(spark, (1, "z", 0)), ["id"])) == [(1, "z", 0), (1, "z", 0)]


def test_conditional_update_and_delete(spark):
    df = students(spark, (1, "a", None), (2, "b", 20), (3, "c", 30))
    assert rows(changes.update_where(df, F.col("age") > 20, {"age": F.col("id"), "id": F.col("age")})) == [(1, "a", None), (2, "b", 20), (30, "c", 3)]
    assert rows(changes.delete_where(df, F.col("age") > 20)) == [(1, "a", None), (2, "b", 20)]


def test_diff_reapplied_gives_the_new_version(spark):
    old = students(spark, (1, "a", 1), (2, "b", None), (3, "c", 3), (None, "n", 0))
    new = students(spark, (1, "a", 1), (2, "b", 2), (4, "d", 4), (None, "n", 5))
    diff = changes.snapshot_diff(old, new, ["id"])
    kinds = {(r["id"], r["_change_type"]) for r in diff.collect()}
    assert kinds == {(2, "update_preimage"), (2, "update_postimage"), (3, "delete"), (4, "insert"), (None, "update_preimage"), (None, "update_postimage")}
    assert rows(changes.apply_changes(old, diff, ["id"])) == rows(new)
    with pytest.raises(Exception, match="several rows"):
        changes.snapshot_diff(old, students(spark, (1, "a", 1), (1, "b", 1)), ["id"]).collect()


def test_version_walk(spark, folder):
    base = folder("t")
    start, source = spark.range(0, 5), spark.range(0, 20)
    assert studies.version_walk(spark, base, start, source) == [0, 1, 2, 3]
    assert rows(snapshots.read_version(spark, base, 0)) == [(i,) for i in range(5)]
    assert snapshots.read_version(spark, base, 1).count() == 20
    assert {r["id"] for r in snapshots.read_version(spark, base).collect()} == set(range(1, 20, 2))
    assert snapshots.latest_version(spark, base) == 3


def test_change_feed_of_a_keyed_table(spark, folder):
    base = folder("s")
    first = spark.range(0, 10).selectExpr("cast(id as int) id", "cast(id as string) name", "cast(id % 4 + 18 as int) age")
    snapshots.write_version(first.limit(0), base)
    snapshots.write_version(first, base)
    moved = changes.update_where(snapshots.read_version(spark, base), F.lit(True), {"id": F.col("id") + 1})
    snapshots.write_version(moved, base)
    snapshots.write_version(changes.delete_where(snapshots.read_version(spark, base), F.col("id") >= 7), base)
    feed = snapshots.change_feed(spark, base, ["name"], 1)
    counts = {(r["_commit_version"], r["_change_type"]): r["count"] for r in feed.groupBy("_commit_version", "_change_type").count().collect()}
    assert counts == {(1, "insert"): 10, (2, "update_preimage"): 10, (2, "update_postimage"): 10, (3, "delete"): 4}


def test_a_version_is_never_replaced(spark, folder):
    base = folder("v")
    snapshots.write_version(spark.range(3), base, 0)
    with pytest.raises(Exception):
        snapshots.write_version(spark.range(4), base, 0)
    assert snapshots.read_version(spark, base, 0).count() == 3


def test_unfinished_versions_are_ignored(spark, folder, tmp_path):
    base = folder("u")
    snapshots.write_version(spark.range(3), base)
    (tmp_path / "u" / "v=1").mkdir()
    assert snapshots.versions(spark, base) == [0]


def test_table_exists_and_probe(spark, folder):
    assert not tables.table_exists(spark, "no_such_table") and not tables.can_read(spark, "no_such_table")
    tables.register(spark.range(3), "some_view")
    assert tables.can_read(spark, "some_view") and tables.scan_any(spark, "some_view").count() == 3
    assert not tables.path_exists(spark, "parquet", folder("absent"))


def test_prediction_log_keeps_quotes(spark, folder):
    scored = spark.createDataFrame([("Corn", "IA", 12.5, "it's \"fine\"")], "crop_type string, state_abbr string, predicted_yield double, note string")
    tables.append_predictions(scored, "log_quotes", ["note"], location=folder("log"))
    row = spark.table("log_quotes").first()
    assert json.loads(row["input_json"])["note"] == "it's \"fine\"" and row["region"] == "" and row["state_fips"] == 0


def test_binary_scan_labels(spark, tmp_path):
    for label, name in (("tulip", "a.jpg"), ("rose", "b.jpg"), ("rose", "c.txt")):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_bytes(b"xyz")
    got = {(r["label"], r["filename"], r["length"]) for r in files.scan_binary(spark, str(tmp_path), "*.jpg").collect()}
    assert got == {("tulip", "a.jpg", 3), ("rose", "b.jpg", 3)}


def test_json_maps(spark, folder):
    path = folder("counties.json")
    with open(path, "w") as f:
        json.dump({"IL": [{"name": "Adams", "fips": 1}], "IA": []}, f, indent=2)
    assert [tuple(r) for r in files.scan_state_counties(spark, path).collect()] == [("IL", "Adams", 1)]
    trend = folder("trend.json")
    with open(trend, "w") as f:
        json.dump({"AL": [-9084.5, 4.5]}, f, indent=2)
    assert [tuple(r) for r in files.state_trend_rows(spark, trend, "Corn").collect()] == [("Corn", "AL", -9084.5, 4.5)]


def test_csv_header_is_trimmed(spark, folder):
    path = folder("x.csv")
    with open(path, "w") as f:
        f.write(" a , b\n1,2\n")
    assert files.scan_csv(spark, path).columns == ["a", "b"]


def test_upsert_does_not_merge_partitions_of_keys(spark, folder):
    """Millions of keys make few bytes; merged by their bytes, they would all be sorted in one task."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target, source = (spark.range(a, z).select("id", F.lit("a").alias("name"), F.lit(1).alias("age")) for a, z in ((0, 2000), (1000, 3000)))
        changes.upsert(target, source, ["id"]).write.parquet(folder("out"))
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, held[k]) if k in held else spark.conf.unset(k)
    got = spark.read.parquet(folder("out"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.count() == got.select("id").distinct().count() == 3000
    # updated and added rows come from all the partitions that the keys are dealt to
    assert len(got.inputFiles()) == 2 * parts
