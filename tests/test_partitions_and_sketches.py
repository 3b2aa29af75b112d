"""Upserts by partition, compaction by size, and sketches against exact results."""

import os
import random

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import sketches
from harvestlens.sources import partitions


def parts(path):
    """Files of each partition with their sizes and times."""
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def rows_of(spark, path):
    return sorted((r["k"], r["v"], r["p"]) for r in spark.read.parquet(path).collect())


def test_untouched_partitions_keep_their_files(spark, folder):
    path = folder("table")
    spark.createDataFrame([(i, i * 10, i % 5) for i in range(50)], "k int, v int, p int").write.partitionBy("p").parquet(path)
    before = parts(path)
    source = spark.createDataFrame([(2, -2, 2), (7, -7, 2), (100, 1000, 2), (101, 1001, 9)], "k int, v int, p int")
    partitions.upsert_partitions(spark, path, source, ["k", "p"], ["p"])
    after = parts(path)
    assert {d for d in after if after[d] != before.get(d)} == {"p=2", "p=9"}
    want = {(i, i % 5): i * 10 for i in range(50)} | {(2, 2): -2, (7, 2): -7, (100, 2): 1000, (101, 9): 1001}
    assert rows_of(spark, path) == sorted((k, v, p) for (k, p), v in want.items())


def test_upsert_by_partition_refuses_what_would_move_rows(spark, folder):
    path = folder("table")
    spark.createDataFrame([(1, 1, 1)], "k int, v int, p int").write.partitionBy("p").parquet(path)
    with pytest.raises(ValueError, match="partition columns"):
        partitions.upsert_partitions(spark, path, spark.read.parquet(path), ["k"], ["p"])
    with pytest.raises(ValueError, match="no partition value"):
        partitions.upsert_partitions(spark, path, spark.createDataFrame([(1, 2, None)], "k int, v int, p int"), ["k", "p"], ["p"])
    before = parts(path)
    partitions.upsert_partitions(spark, path, spark.read.parquet(path).limit(0), ["k", "p"], ["p"])
    assert parts(path) == before and rows_of(spark, path) == [(1, 1, 1)]


def test_files_come_out_near_the_target(spark, folder):
    rng = random.Random(3)
    # one input file holds nearly all bytes, many hold next to nothing
    wide = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))) for i in range(4000)]
    df = spark.createDataFrame(wide, "k int, v string")
    src, dst, target = folder("src"), folder("dst"), 100_000
    df.filter("k < 3900").coalesce(1).write.parquet(src)
    df.filter("k >= 3900").repartition(50).write.mode("append").parquet(src)
    files = partitions.compact_to_size(spark, src, dst, target)
    sizes = [os.path.getsize(f"{dst}/{f}") for f in os.listdir(dst) if f.endswith(".parquet")]
    assert len(sizes) == files and max(sizes) <= 2 * target and sorted(sizes)[1] >= target / 2
    assert spark.read.parquet(dst).exceptAll(df).count() == 0 and spark.read.parquet(dst).count() == 4000
    # many small files hold more footers than rows
    small, packed = folder("small"), folder("packed")
    df.limit(200).repartition(100).write.parquet(small)
    assert partitions.compact_to_size(spark, small, packed, target) == 1


def exact_ranks(values, q):
    return sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)


@pytest.mark.parametrize("kind", ["lognormal", "constant", "two"])
def test_quantiles_of_every_level_within_the_bound(spark, kind):
    rng = random.Random(4)
    draw = {"lognormal": lambda: rng.lognormvariate(0, 2), "constant": lambda: 7.0, "two": lambda: float(rng.random() < 0.3)}[kind]
    rows = [(rng.choice("aab"), rng.randint(2000, 2019), draw()) for _ in range(20000)]
    df = spark.createDataFrame([*rows, ("a", 2000, None), ("b", 2001, float("nan")), ("c", 2000, None)], "state string, year int, v double")
    held = sketches.value_sketches(df, ["state", "year"], "v").cache()
    assert held.count() == 40
    probs = {f"p{p}": p / 100 for p in (1, 10, 25, 50, 75, 90, 99)}
    out = sketches.value_levels(held, [["state", "year"], ["state"], []], probs).collect()
    assert len(out) == 40 + 2 + 1
    for r in out:
        own = [v for s, y, v in rows if (r["state"] is None or s == r["state"]) and (r["year"] is None or y == r["year"])]
        assert r["n"] == len(own) and r["least"] == min(own) and r["most"] == max(own) and r["mean"] == pytest.approx(sum(own) / len(own))
        for name, p in probs.items():
            below, upto = exact_ranks(own, r[name])
            # up to K values a sketch holds all of them; a rank between two values is half a row off
            error = sketches.rank_error() + 1 / len(own)
            assert below - error <= p <= upto + error, (kind, r["level"], name)


def test_distinct_counts_unite_over_groups(spark):
    rng = random.Random(6)
    rows = [(m, f"s{rng.randint(0, 5000)}", rng.randint(0, 2)) for m in range(12) for _ in range(3000)]
    df = spark.createDataFrame([*rows, (1, None, None)], "month int, station string, part int")
    held = sketches.distinct_sketches(df, ["month"], ["station", "part"])
    whole = sketches.merged_distinct(held, []).first()["n_distinct"]
    exact = len({(s, p) for _, s, p in rows})
    assert abs(whole - exact) <= 4 * sketches.distinct_error() * exact
    for r in sketches.merged_distinct(held, ["month"]).collect():
        own = len({(s, p) for m, s, p in rows if m == r["month"]})
        assert abs(r["n_distinct"] - own) <= 4 * sketches.distinct_error() * own
    none = sketches.merged_distinct(sketches.distinct_sketches(df.filter("station IS NULL"), ["month"], ["station"]), ["month"])
    assert none.first()["n_distinct"] == 0
