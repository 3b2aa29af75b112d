"""Queries that write and read: scans, sinks, upserts, versions, change feeds and streams.

Everything written goes to new folders under the shared scratch folder of the session.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from harvestlens.catalog.base import TABLES, TEST_FROM, Base
from harvestlens.catalog.counties import KEY
from harvestlens.catalog.registry import query
from harvestlens.functions.text import geoid
from harvestlens.operators import changes, daily, grouping
from harvestlens.plans import studies
from harvestlens.session import fresh_folder
from harvestlens.sources import artifacts, files, partitions, snapshots, tables
from harvestlens.streaming import jobs, keyed

ORDER = "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderpriority:s"
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def _folder(b: Base, label: str) -> str:
    return fresh_folder(b.spark, label)


def _orders(b: Base):
    return b.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


# ---- scans and sinks

_CUSTOMER = "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s"


@query("s01_s12_table_scan", _CUSTOMER, "SELECT * FROM customer")
def _(b):
    name = _name("customer_view")
    tables.register(b.table("customer"), name)
    return tables.scan_table(b.spark, name)


@query("s02_scan_by_name", _CUSTOMER, "SELECT * FROM customer")
def _(b):
    name = _name("customer_any")
    tables.register(b.table("customer"), name)
    return tables.scan_any(b.spark, name)


@query("s03_s18_csv_round_trip", "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d", "SELECT * FROM supplier")
def _(b):
    path = _folder(b, "csv")
    files.write_csv(b.table("supplier").withColumnRenamed("s_name", " s_name "), path)
    return files.scan_csv(b.spark, path)


@query("s04_parquet_round_trip", "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d", "SELECT * FROM supplier")
def _(b):
    path = _folder(b, "parquet")
    files.write_parquet(b.table("supplier"), path, ("s_nationkey",))
    return files.scan_parquet(b.spark, path)


@query("s05_p38_binary_files", "label:s filename:s length:i")
def _(b):
    return files.scan_binary(b.spark, b.sf_dir, "*.parquet").select("label", "filename", "length")


_FEATURE = """SELECT lpad(cast(state_fips AS string), 2, '0') || lpad(cast(county_fips AS string), 3, '0') AS geoid,
  (3 * south + 2 * north) / 5e0 AS lat, (3 * west + 2 * east) / 5e0 AS lon FROM county_box"""


@query("s06_geojson_centroids", "geoid:s lat:d lon:d", _FEATURE)
def _(b):
    ring = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.create_map(F.lit("STATE"), F.col("state_fips").cast("string"), F.lit("COUNTY"), F.col("county_fips").cast("string")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    # one collection per state, so each document holds the few counties of one state
    documents = b.counties.groupBy("state_fips").agg(F.collect_list(feature).alias("features"))
    path = _folder(b, "geojson")
    documents.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    return files.geojson_centroids(b.spark.read.schema(files.GEOJSON_SCHEMA).json(path))


@query("s08_centroid_csv", "geoid:s lat:d lon:d", """SELECT lpad(cast(state_fips AS string), 2, '0') || lpad(cast(county_fips AS string), 3, '0') AS geoid,
  south AS lat, west AS lon FROM county_box""")
def _(b):
    path = _folder(b, "centroids")
    rows = b.derived("county_box").select(F.concat(F.lit("g-"), geoid("state_fips", "county_fips")).alias("GEOID"),
                                          F.col("south").alias(" Latitude "), F.col("west").alias("LNG"))
    files.write_csv(rows, path)
    return files.scan_centroids_csv(b.spark, path)


@query("s10_range_calendar", "day:s n:i", """SELECT cast(d AS string) AS day, count(event_id) AS n FROM (SELECT a + cast(i AS int) AS d FROM (SELECT a, unnest(range(z - a + 1)) AS i FROM (
  SELECT min(cast(ts AS date)) AS a, max(cast(ts AS date)) AS z FROM events) e) r) t LEFT JOIN events ON cast(ts AS date) = d GROUP BY d""")
def _(b):
    # the calendar runs from the first day of the data to the last
    days = b.table("events").select(F.col("ts").cast("date").alias("day"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    span = 0 if first is None else (last - first).days + 1
    calendar = files.range_source(b.spark, 0, span).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
    counted = grouping.value_counts(days, "day")
    return calendar.join(counted, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("s11_inline_values", "event_type:s weighted:d4", """SELECT event_type, sum(value * w) AS weighted FROM events
  JOIN (VALUES ('click', 1.0), ('view', 0.5), ('purchase', 4.0)) AS v(event_type, w) USING (event_type) GROUP BY event_type""")
def _(b):
    weights = files.values_source(b.spark, {"event_type": ["click", "view", "purchase"], "w": [1.0, 0.5, 4.0]})
    return b.table("events").join(weights, "event_type").groupBy("event_type").agg(F.sum(F.col("value") * F.col("w")).alias("weighted"))


@query("s14_overwrite_table", ORDER, ORDERS)
def _(b):
    name, place = _name("orders_managed"), _folder(b, "managed")
    tables.overwrite_table(_orders(b).select("o_orderkey"), name, location=place)
    tables.overwrite_table(_orders(b), name, location=place)
    return tables.scan_table(b.spark, name)


@query("s15_s17_insert_overwrite", ORDER, ORDERS.replace("o_totalprice", "o_totalprice + 1 AS o_totalprice"))
def _(b):
    name = _name("orders_typed")
    tables.ensure_table(
        b.spark, name, "o_totalprice DOUBLE, o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING, o_orderstatus STRING",
        ("o_orderstatus",), _folder(b, "typed"))
    tables.insert_overwrite(_orders(b), name)
    tables.insert_overwrite(_orders(b).withColumn("o_totalprice", F.col("o_totalprice") + 1), name)
    return tables.scan_table(b.spark, name)


@query("s16_prediction_log", KEY.replace("commodity:s irrigation:s ", "") + "crop_type:s state_abbr:s predicted_yield:d model_version:s region:s is_irrigated:i",
       f"""SELECT state_fips, county_fips, year, commodity AS crop_type, state_abbr, coalesce(pred_yield, 0) AS predicted_yield, 'v7' AS model_version, '' AS region,
          CASE WHEN trim(irrigation) = 'Irrigated' THEN 1 ELSE 0 END AS is_irrigated FROM scored0 WHERE year >= {TEST_FROM}
          UNION ALL SELECT state_fips, county_fips, year, commodity, state_abbr, coalesce(pred_yield, 0), 'v8', '', CASE WHEN trim(irrigation) = 'Irrigated' THEN 1 ELSE 0 END
          FROM scored0 WHERE year < {TEST_FROM}""")
def _(b):
    name, place = _name("predictions_log"), _folder(b, "log")
    rows = b.predicted.select(
        F.col("commodity").alias("crop_type"), "state_abbr", "state_fips", "county_fips", "year", "gdd",
        F.when(F.trim("irrigation") == "Irrigated", 1).otherwise(0).alias("is_irrigated"), F.col("pred_yield").alias("predicted_yield"))
    tables.append_predictions(rows.filter(F.col("year") >= TEST_FROM), name, ["crop_type", "year", "gdd"], "v7", place)
    tables.append_predictions(rows.filter(F.col("year") < TEST_FROM), name, ["crop_type", "year", "gdd"], "v8", place)
    log = tables.scan_table(b.spark, name)
    # the stored inputs must read back to the row's own values
    inputs = F.from_json("input_json", "crop_type string, year int, gdd double")
    return log.filter((inputs["year"] == F.col("year")) & (inputs["crop_type"] == F.col("crop_type")))


@query("s19_table_probe", "name:s found:b", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) > 0 AS found FROM {t}" for t in TABLES) + " UNION ALL SELECT 'absent', false")
def _(b):
    found = [(t, tables.path_exists(b.spark, "parquet", b.path(t))) for t in (*TABLES, "absent")]
    return files.from_rows(b.spark, found, "name string, found boolean")


@query("s20_path_as_table", "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d", "SELECT * FROM part")
def _(b):
    return tables.scan_path_sql(b.spark, "parquet", b.path("part"))


# ---- upsert, update, delete, versions

_T = "SELECT user_id, count(*) AS n, cast(sum(round(value * 100)) AS bigint) AS cents FROM events WHERE event_type <> 'signup' GROUP BY user_id"
_S = "SELECT user_id, count(*) AS n, cast(sum(round(value * 100)) AS bigint) AS cents FROM events WHERE event_type = 'signup' GROUP BY user_id"


def _user_totals(b, where):
    return b.table("events").filter(where).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("s21_upsert", "user_id:i n:i cents:i", f"""SELECT coalesce(t.user_id, s.user_id) AS user_id, CASE WHEN t.user_id IS NULL THEN s.n ELSE t.n + coalesce(s.n, 0) END AS n,
  coalesce(s.cents, t.cents) AS cents FROM ({_T}) t FULL JOIN ({_S}) s ON t.user_id = s.user_id""")
def _(b):
    target = _user_totals(b, "event_type <> 'signup'")
    source = _user_totals(b, "event_type = 'signup'")
    return changes.upsert(target, source, ["user_id"], {"n": F.col("t.n") + F.col("s.n"), "cents": F.col("s.cents")})


@query("s21_upsert_orders", ORDER, """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority
  FROM orders UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'X', o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 6 = 0""")
def _(b):
    rows = _orders(b)
    edits = rows.filter("o_orderkey % 4 = 1 OR o_orderkey % 6 = 0").withColumns({
        "o_orderkey": F.expr("CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END"), "o_orderstatus": F.lit("X")})
    return changes.upsert(rows, edits, ["o_orderkey"])


_UPDATED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders"""


@query("s22_conditional_update", ORDER, _UPDATED)
def _(b):
    return changes.update_where(_orders(b), F.col("o_orderkey") % 2 == 0, {"o_orderstatus": F.lit("U"), "o_totalprice": F.col("o_totalprice") + 100})


@query("s23_conditional_delete", ORDER, ORDERS + " WHERE CASE WHEN o_orderkey % 11 = 0 THEN true ELSE NOT (o_orderstatus = 'F' AND o_totalprice > 100000) END")
def _(b):
    unknown = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("boolean"))
    condition = F.when(F.col("o_orderkey") % 11 == 0, unknown).otherwise((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
    return changes.delete_where(_orders(b), condition)


def _versioned(b: Base) -> str:
    """Three versions of the orders: as given, with updates and inserts, with deletes."""
    base = _folder(b, "orders")
    rows = _orders(b)
    snapshots.write_version(rows, base)
    extra = rows.filter("o_orderkey % 50 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 100000000})
    edits = rows.filter("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("U")).unionByName(extra)
    snapshots.write_version(changes.upsert(snapshots.read_version(b.spark, base, 0), edits, ["o_orderkey"]), base)
    snapshots.write_version(changes.delete_where(snapshots.read_version(b.spark, base, 1), F.col("o_orderkey") % 7 == 0), base)
    return base


_V1 = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 50 = 0"""


@query("s24_read_old_version", ORDER + " version:i", f"""SELECT *, 0 AS version FROM ({ORDERS}) a UNION ALL SELECT *, 1 FROM ({_V1}) b
  UNION ALL SELECT *, 2 FROM ({_V1}) c WHERE o_orderkey % 7 <> 0""")
def _(b):
    base = _versioned(b)
    parts = [snapshots.read_version(b.spark, base, v).withColumn("version", F.lit(v)) for v in snapshots.versions(b.spark, base)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FEED = f"""SELECT *, 'update_preimage' AS _change_type, 1 AS _commit_version FROM ({ORDERS}) a WHERE o_orderkey % 10 = 3 AND o_orderstatus <> 'U'
  UNION ALL SELECT *, 'update_postimage', 1 FROM ({_V1}) b WHERE o_orderkey % 10 = 3 AND o_orderkey < 100000000
  UNION ALL SELECT *, 'insert', 1 FROM ({_V1}) c WHERE o_orderkey >= 100000000
  UNION ALL SELECT *, 'delete', 2 FROM ({_V1}) d WHERE o_orderkey % 7 = 0"""


@query("s25_q18_change_feed", ORDER + " _change_type:s _commit_version:i", _FEED)
def _(b):
    return snapshots.change_feed(b.spark, _versioned(b), ["o_orderkey"], 1)


@query("s25_changes_applied", ORDER, f"SELECT * FROM ({_V1}) c WHERE o_orderkey % 7 <> 0")
def _(b):
    base = _versioned(b)
    old, new = snapshots.read_version(b.spark, base, 0), snapshots.read_version(b.spark, base, 2)
    return changes.apply_changes(old, changes.snapshot_diff(old, new, ["o_orderkey"]), ["o_orderkey"])


@query("s26_compaction", ORDER, ORDERS)
def _(b):
    scattered, packed = _folder(b, "scattered"), _folder(b, "packed")
    _orders(b).repartition(16).write.parquet(scattered)
    snapshots.compact(b.spark.read.parquet(scattered), 2, packed)
    return b.spark.read.parquet(packed)


@query("s26_compaction_by_size", ORDER + " sizes_hold:b", f"SELECT *, true AS sizes_hold FROM ({ORDERS}) q")
def _(b):
    scattered, packed, target = _folder(b, "uneven"), _folder(b, "even"), 64 << 10
    _orders(b).repartition(24, F.col("o_custkey") % 5).write.parquet(scattered)
    partitions.compact_to_size(b.spark, scattered, packed, target)
    rows = b.spark.read.parquet(packed)
    sizes = rows.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.max("file_size").alias("most"), F.min("file_size").alias("least"), F.count(F.lit(1)).alias("n"))
    hold = sizes.select(((F.col("most") <= 2 * target) & ((F.col("least") >= target / 2) | (F.col("n") == 1))).alias("h")).scalar()
    return rows.withColumn("sizes_hold", hold)


@query("s21_upsert_by_partition", "o_orderkey:i o_totalprice:d year:i", """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 AND o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, year(o_orderdate) AS year FROM orders
  UNION ALL SELECT o_orderkey + 100000000, o_totalprice, 1997 FROM orders WHERE year(o_orderdate) = 1997 AND o_orderkey % 50 = 0""")
def _(b):
    path = _folder(b, "by-year")
    rows = b.table("orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    rows.write.partitionBy("year").parquet(path)
    changed = rows.filter("year = 1996 AND o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    new = rows.filter("year = 1997 AND o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000)
    partitions.upsert_partitions(b.spark, path, changed.unionByName(new), ["o_orderkey", "year"], ["year"])
    return b.spark.read.parquet(path)


@query("s27_trend_and_baseline_artifacts", "commodity:s kind:s key:s a:d3 b:d", """SELECT commodity, 'trend' AS kind, state_abbr AS key, intercept AS a, slope AS b FROM trend_lines
  UNION ALL SELECT commodity, 'state', state_abbr, quantile_cont(yield_amount, 0.5), NULL FROM merged GROUP BY commodity, state_abbr
  UNION ALL SELECT commodity, 'county', state_fips || '-' || county_fips, quantile_cont(yield_amount, 0.5), NULL FROM merged GROUP BY commodity, state_fips, county_fips""")
def _(b):
    path = _folder(b, "artifacts")
    artifacts.write_artifacts(b.merged, path)
    trend = b.spark.read.schema("state_abbr string, line array<double>, commodity string").json(f"{path}/trend")
    base = b.spark.read.schema("level string, key string, value double, commodity string").json(f"{path}/baselines")
    lines = trend.select("commodity", F.lit("trend").alias("kind"), F.col("state_abbr").alias("key"), F.get("line", 0).alias("a"), F.get("line", 1).alias("b"))
    return lines.unionByName(base.select("commodity", F.col("level").alias("kind"), "key", F.col("value").alias("a"), F.lit(None).cast("double").alias("b")))


# ---- streams: each runs to the end of the available input, and the result is read back

_EVENT = "event_id:i user_id:i event_type:s value:d"


def _events(b: Base, **kw):
    return jobs.stream_files(b.spark, b.sf_dir, b.schema("events"), glob="events.parquet", **kw)


def _finish(q) -> None:
    q.awaitTermination()


@query("r01_stream_append", _EVENT, "SELECT * FROM events")
def _(b):
    out, ckpt = _folder(b, "append"), _folder(b, "append-ckpt")
    _finish(jobs.stream_append(_events(b), out, ckpt))
    # a second start from the same checkpoint finds nothing new
    _finish(jobs.stream_append(_events(b), out, ckpt))
    return b.spark.read.parquet(out)


@query("r03_r05_stream_key_aggregate", "id:i n:i cents:i", """SELECT user_id % 10 AS id, count(*) AS n, cast(sum(round(value * 100)) AS bigint) AS cents
  FROM events GROUP BY user_id % 10""")
def _(b):
    out = _folder(b, "stream-agg")
    grouped = _events(b).groupBy((F.col("user_id") % 10).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    _finish(jobs.stream_result(grouped, out, _folder(b, "stream-agg-ckpt")))
    return jobs.last_batch(b.spark, out)


@query("r04_stream_upsert", _EVENT, """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) q WHERE k = 1""")
def _(b):
    # four files of mixed times, one a batch, so that late rows come in later batches
    out, source, order = _folder(b, "upsert"), _folder(b, "upsert-src"), ["ts", "event_id"]
    b.table("events").repartition(4, "event_id").write.parquet(source)
    stream = jobs.stream_files(b.spark, source, b.schema("events"), files_per_batch=1)
    _finish(jobs.stream_upsert(stream, out, _folder(b, "upsert-ckpt"), ["user_id"], order))
    first = b.table("events").groupBy("user_id").agg(F.min_by(F.struct(*b.table("events").columns), F.struct(*order)).alias("e")).select("e.*")
    return jobs.upserted(first, b.spark.read.parquet(out), ["user_id"], order)


@query("r03_stream_to_memory", "event_type:s n:i cents:i", """SELECT event_type, count(*) AS n, cast(sum(round(value * 100)) AS bigint) AS cents FROM events GROUP BY event_type""")
def _(b):
    """The memory sink holds as many rows as there are types of events."""
    name = _name("by_type")
    grouped = _events(b).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    _finish(jobs.stream_to_memory(grouped, name, "complete"))
    return b.spark.table(name)


def _by_time(b: Base, parts: int) -> list:
    """The events in `parts` spans of time, one after another."""
    rows = b.table("events")
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    seconds = lambda t: F.unix_timestamp(F.col("ts").cast("timestamp")) - int(t.timestamp())
    place = F.least(F.floor(seconds(ends["a"]) * parts / max(int((ends["z"] - ends["a"]).total_seconds()), 1)), F.lit(parts - 1))
    return [rows.filter(place == k) for k in range(parts)]


@query("r05_update_mode_table", "id:i n:i cents:i least:d", """SELECT user_id % 10 AS id, count(*) AS n, cast(sum(round(value * 100)) AS bigint) AS cents, min(value) AS least
  FROM events GROUP BY user_id % 10""")
def _(b):
    source, out, ckpt, folded = (_folder(b, n) for n in ("update-src", "update", "update-ckpt", "update-fold"))
    measures = {"n": F.count(F.lit(1)), "cents": F.sum(F.round(F.col("value") * 100).cast("bigint")), "least": F.min("value")}
    # two starts of two batches each: the second goes on from the state of the first
    for k in (0, 1):
        b.table("events").filter(F.col("event_id") % 2 == k).repartition(2, "event_id").write.mode("append").parquet(source)
        stream = jobs.stream_files(b.spark, source, b.schema("events"), files_per_batch=1)
        _finish(keyed.stream_keyed(stream, [(F.col("user_id") % 10).alias("id")], measures, out, ckpt))
    return keyed.fold_batches(b.spark, out, ["id"], 1, folded)


@query("r04_repeated_events", _EVENT, "SELECT * FROM events")
def _(b):
    """The second of four spans is delivered twice, in two batches; each event is written once."""
    source, out, ckpt = (_folder(b, n) for n in ("again-src", "again", "again-ckpt"))
    spans = _by_time(b, 4)
    for k in (0, 1, 1, 2, 3):
        spans[k].coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_files(b.spark, source, b.schema("events"), files_per_batch=1)
        _finish(jobs.stream_append(keyed.once(stream, ["event_id"], "ts", "2 days"), out, ckpt))
    return b.spark.read.parquet(out)


@query("r04_upsert_of_repeated_events", _EVENT, """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) q WHERE k = 1""")
def _(b):
    source, out, ckpt, order = _folder(b, "twice-src"), _folder(b, "twice"), _folder(b, "twice-ckpt"), ["ts", "event_id"]
    spans = _by_time(b, 3)
    for k in (0, 1, 1, 2):
        spans[k].coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_files(b.spark, source, b.schema("events"), files_per_batch=1)
        _finish(jobs.stream_upsert(keyed.once(stream, ["event_id"], "ts", "2 days"), out, ckpt, ["user_id"], order))
    changed = b.spark.read.parquet(out)
    return jobs.upserted(changed.drop("batch").limit(0), changed, ["user_id"], order)


@query("r06_stream_of_changes", ORDER + " _change_type:s _commit_version:i", _FEED)
def _(b):
    base, feed, out = _versioned(b), _folder(b, "feed"), _folder(b, "feed-out")
    for v in (0, 1, 2):
        snapshots.publish_changes(b.spark, base, ["o_orderkey"], v, feed)
    schema = b.spark.read.parquet(feed).schema
    _finish(jobs.stream_append(jobs.stream_changes(b.spark, feed, schema, 1), out, _folder(b, "feed-ckpt")))
    return b.spark.read.parquet(out)


@query("r07_append_while_compacting", ORDER, ORDERS)
def _(b):
    source, packed, out, ckpt = (_folder(b, n) for n in ("live", "live-packed", "live-out", "live-ckpt"))
    rows = _orders(b)
    rows.filter("o_orderkey % 2 = 0").repartition(8).write.parquet(f"{source}/part=0")
    _finish(jobs.stream_append(jobs.stream_files(b.spark, source, rows.schema), out, ckpt))
    # compaction writes elsewhere, so the stream sees only the files that arrive later
    snapshots.compact(b.spark.read.parquet(source).drop("part"), 1, packed)
    rows.filter("o_orderkey % 2 <> 0").repartition(8).write.parquet(f"{source}/part=1")
    _finish(jobs.stream_append(jobs.stream_files(b.spark, source, rows.schema), out, ckpt))
    return b.spark.read.parquet(out)


_SEASON = "total_precip:i dry_days:i heat_stress_days:i gdd_raw:d obs_count:i"


def _weather_stream(b: Base):
    return b.derived("wx", lineitem=jobs.stream_files(b.spark, b.sf_dir, b.schema("lineitem"), glob="lineitem.parquet"))


@query("r08_stream_season", "station:s year:i " + _SEASON, "SELECT *, obs_count_growing AS obs_count FROM growing")
def _(b):
    out = _folder(b, "season")
    _finish(jobs.stream_result(jobs.stream_season(_weather_stream(b)), out, _folder(b, "season-ckpt")))
    return jobs.last_batch(b.spark, out)


@query("r08_w11_stream_dry_runs", "station:s year:i longest_run_days:i run_start:s", """WITH d AS (SELECT station, date, year(date) AS year, sum(precipitation) AS rain FROM wx WHERE precipitation >= 0 GROUP BY station, date),
  dry AS (SELECT *, date - cast(row_number() OVER (PARTITION BY station, year ORDER BY date) AS int) AS island FROM d WHERE rain = 0),
  runs AS (SELECT station, year, island, count(*) AS days, min(date) AS start FROM dry GROUP BY station, year, island)
  SELECT station, year, days AS longest_run_days, cast(start AS string) AS run_start FROM
    (SELECT *, row_number() OVER (PARTITION BY station, year ORDER BY days DESC, start) AS k FROM runs) q WHERE k = 1""")
def _(b):
    """Observations come in three spans of years; a last one of another station, long after, lets the watermark pass every run."""
    source, out, ckpt = (_folder(b, n) for n in ("runs-src", "runs", "runs-ckpt"))
    seen = daily.daily_units(b.weather).select("station", "date", "precip_mm")
    after = seen.agg(F.date_add(F.max("date"), 400).alias("date")).select(F.lit("after").alias("station"), "date", F.lit(1.0).alias("precip_mm"))
    for part in (seen.filter("year(date) < 1995"), seen.filter("year(date) BETWEEN 1995 AND 1996"), seen.filter("year(date) > 1996"), after.filter("date IS NOT NULL")):
        part.write.mode("append").parquet(source)
        stream = jobs.stream_files(b.spark, source, seen.schema)
        _finish(jobs.stream_append(keyed.stream_runs(stream, F.col("precip_mm") == 0, "precip_mm"), out, ckpt))
    return keyed.longest_by_year(b.spark.read.parquet(out))


@query("r08_stream_windows", "day:s event_type:s n:i cents:i", """SELECT cast(cast(ts AS date) AS string) AS day, event_type, count(*) AS n, cast(sum(round(value * 100)) AS bigint) AS cents
  FROM events GROUP BY 1, 2""")
def _(b):
    out = _folder(b, "windows")
    measures = {"n": F.count(F.lit(1)), "cents": F.sum(F.round(F.col("value") * 100).cast("bigint"))}
    counts = jobs.windowed_counts(_events(b), "ts", ["event_type"], "1 day", "2 days", measures)
    _finish(jobs.stream_result(counts, out, _folder(b, "windows-ckpt")))
    return jobs.last_batch(b.spark, out).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))




_DAYS = "SELECT cast(cast(ts AS date) AS string) AS day, event_type, count(*) AS n FROM events"


@query("r08_stream_late_rows", "day:s event_type:s n:i", f"""WITH e AS (SELECT max(ts) AS z FROM events) {_DAYS}, e
  WHERE NOT (event_id % 10 = 0 AND ts < z - INTERVAL 10 DAY) AND date_trunc('day', ts) + INTERVAL 1 DAY <= z - INTERVAL 2 DAY GROUP BY 1, 2""")
def _(b):
    """Append mode under a watermark: rows that come after their day was closed are dropped, and a closed day leaves the state."""
    source, out = _folder(b, "late-src"), _folder(b, "late")
    events = b.table("events")
    last = events.agg(F.max("ts").alias("z")).scalar()
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < last - F.expr("INTERVAL 10 DAYS"))
    ckpt = _folder(b, "late-ckpt")
    for part in (events.filter(~late), events.filter(late)):
        part.write.mode("append").parquet(source)
        stream = jobs.stream_files(b.spark, source, b.schema("events"))
        counts = jobs.windowed_counts(stream, "ts", ["event_type"], "1 day", "2 days", {"n": F.count(F.lit(1))})
        _finish(jobs.stream_append(counts, out, ckpt))
    return b.spark.read.parquet(out).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))


@query("r08_stream_station_days", "station:s day:s n:i", """SELECT station, cast(date AS string) AS day, count(*) AS n FROM wx
  WHERE date + INTERVAL 1 DAY <= (SELECT max(date) FROM wx) - INTERVAL 30 DAY GROUP BY 1, 2""")
def _(b):
    out = _folder(b, "station-days")
    _finish(jobs.stream_append(jobs.stream_station_days(_weather_stream(b)), out, _folder(b, "station-days-ckpt")))
    return b.spark.read.parquet(out).select("station", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.col("obs_count").alias("n"))


@query("q18_version_walk", "o_orderkey:i version:i", """WITH k AS (SELECT o_orderkey FROM orders UNION SELECT o_orderkey + 1 FROM orders)
  SELECT o_orderkey, 0 AS version FROM orders UNION ALL SELECT o_orderkey, 1 FROM k UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 100 ELSE o_orderkey END, 2 FROM k
  UNION ALL SELECT o_orderkey, 3 FROM k WHERE o_orderkey % 2 = 1""")
def _(b):
    base, keys = _folder(b, "walk"), b.table("orders").select("o_orderkey")
    steps = studies.version_walk(b.spark, base, keys, keys.union(keys.select(F.col("o_orderkey") + 1)).distinct(), ("o_orderkey",))
    parts = [snapshots.read_version(b.spark, base, v).withColumn("version", F.lit(v)) for v in steps]
    return reduce(lambda x, y: x.unionByName(y), parts)
