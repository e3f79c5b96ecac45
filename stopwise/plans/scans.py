"""Scans, sources, sinks, refresh and keyed upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stopwise.operators import clean, dedup, encoding, lookup, upsert
from stopwise.plans.registry import query
from stopwise.session import fresh_path
from stopwise.sources import files, published

DAY10, DAY12 = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)


@query("scan_columns", "SELECT event_id, event_type, value FROM events")
def _(t):
    return files.read_columns(t.spark, f"{t.folder}/events.parquet", ["event_id", "event_type", "value"])


@query("scan_date_range", """
SELECT hash_id, station, c FROM stops
WHERE (ar_pt >= TIMESTAMP '2024-01-10' OR dp_pt >= TIMESTAMP '2024-01-10')
  AND (ar_pt < TIMESTAMP '2024-01-12' OR dp_pt < TIMESTAMP '2024-01-12')""", views="stops")
def _(t):
    return files.load_stops(t.stops_by_date, ["hash_id", "station", "c"], DAY10, DAY12)


@query("scan_long_distance", "SELECT hash_id, station, f FROM stops WHERE f = 'F'", views="stops")
def _(t):
    return files.load_stops(t.stops, ["hash_id", "station", "f"], long_distance_only=True)


@query("full_refresh", """
SELECT d.hash_id, d.station, d.pp, d.ar_delay, d.dp_delay, d.ar_happened, d.dp_happened, s.lat, s.lon
FROM delayed d
  LEFT JOIN (SELECT name, nullif(lat, -999) AS lat, nullif(lon, -999) AS lon FROM (SELECT name, arg_max(coalesce(lat, -999), coalesce(valid_from, TIMESTAMP '0001-01-01')) AS lat,
    arg_max(coalesce(lon, -999), coalesce(valid_from, TIMESTAMP '0001-01-01')) AS lon FROM stations GROUP BY name)) s ON s.name = d.station
""", views="delayed stations")
def _(t):
    raw = fresh_path(t.spark, "raw")
    t.stops.write.parquet(raw)
    enriched = fresh_path(t.spark, "enriched")
    stops = clean.with_delays(t.spark.read.parquet(raw))
    lookup.add_coordinates(stops, t.stations).write.parquet(enriched)
    return files.read_columns(t.spark, enriched, ["hash_id", "station", "pp", "ar_delay", "dp_delay",
                                                 "ar_happened", "dp_happened", "lat", "lon"])


def _old_and_source(t):
    stops = t.stops.select("hash_id", "station", "ar_pt", "dp_pt", "ar_ct")
    old = stops.filter(F.col("ar_pt") < F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz"))
    source = stops.withColumn("station", F.concat("station", F.lit("*")))
    return old, source


REFRESH_SQL = """
WITH old AS (SELECT hash_id, station, ar_pt, dp_pt, ar_ct FROM stops WHERE ar_pt < TIMESTAMP '2024-01-20'),
fresh AS (SELECT hash_id, station || '*' AS station, ar_pt, dp_pt, ar_ct FROM stops,
  (SELECT max(ar_pt) - INTERVAL '2' DAY AS mark FROM old) m WHERE ar_pt > mark OR dp_pt > mark),
refreshed AS (SELECT * FROM old WHERE hash_id NOT IN (SELECT hash_id FROM fresh) UNION ALL SELECT * FROM fresh)
"""


@query("incremental_refresh", REFRESH_SQL + "SELECT * FROM refreshed", views="stops")
def _(t):
    old, source = _old_and_source(t)
    path = files.write_by_date(old, fresh_path(t.spark, "by_date"))
    upsert.refresh_by_date(t.spark, path, source, ["hash_id"])
    return t.spark.read.parquet(path).select(*old.columns)


@query("row_progress", REFRESH_SQL + """
SELECT (SELECT count(*) FROM old) AS rows_before, (SELECT count(*) FROM refreshed) AS rows_after,
  (SELECT count(*) FROM refreshed) - (SELECT count(*) FROM old) AS rows_new""", views="stops")
def _(t):
    old, source = _old_and_source(t)
    return upsert.refresh_counts(old, upsert.incremental_refresh(old, source, ["hash_id"]))


@query("materialized_table", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return published.materialized_table(
        t.spark, "events_per_type", generate=True,
        table_generator=lambda: t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@query("publish_table", "SELECT station, count(ar_pt) AS arrivals FROM stops GROUP BY station", views="stops")
def _(t):
    counts = t.stops.groupBy("station").agg(F.count("ar_pt").alias("arrivals"))
    published.publish_table(counts.limit(0), "arrivals_per_station")
    return published.publish_table(counts, "arrivals_per_station")


UPSERT_SQL = """
WITH old AS (SELECT hash_id, station, ar_ct FROM stops WHERE hash_id % 3 <> 1),
new AS (SELECT hash_id, station || '+' AS station, ar_ct FROM stops WHERE hash_id % 2 = 0)
"""


def _upsert_sides(t):
    rows = t.stops.select("hash_id", "station", "ar_ct")
    return (rows.filter("hash_id % 3 <> 1"),
            rows.filter("hash_id % 2 = 0").withColumn("station", F.concat("station", F.lit("+"))))


@query("upsert_update", UPSERT_SQL + """
SELECT * FROM old WHERE hash_id NOT IN (SELECT hash_id FROM new) UNION ALL SELECT * FROM new""", views="stops")
def _(t):
    return upsert.upsert_update(*_upsert_sides(t), ["hash_id"])


@query("upsert_ignore", UPSERT_SQL + """
SELECT * FROM old UNION ALL SELECT * FROM new WHERE hash_id NOT IN (SELECT hash_id FROM old)""", views="stops")
def _(t):
    return upsert.upsert_ignore(*_upsert_sides(t), ["hash_id"])


@query("lookup_by_keys", "SELECT hash_id, station FROM stops WHERE hash_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", views="stops")
def _(t):
    keys = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("hash_id"))
    return upsert.lookup_by_keys(t.stops.select("hash_id", "station"), keys, ["hash_id"])


@query("plan_of_station", """
SELECT hash_id, station, date_id FROM stops
WHERE station = 'S7' AND date_id >= TIMESTAMP '2024-01-10' AND date_id < TIMESTAMP '2024-01-12'""", views="stops")
def _(t):
    return upsert.plan_of_station(t.stops.select("hash_id", "station", "date_id"), "S7", DAY10, DAY12)


@query("key_range_chunks", """
SELECT chunk, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM (
  SELECT l_orderkey, CAST(least(floor((l_orderkey - k0) / w), chunks - 1) AS BIGINT) AS chunk FROM lineitem,
   (SELECT k0, chunks, greatest(CAST(k1 - k0 AS DOUBLE) / chunks, 1) AS w FROM (
     SELECT min(l_orderkey) AS k0, max(l_orderkey) AS k1, greatest(count(*) // 20000, 1) AS chunks FROM lineitem)))
GROUP BY chunk""")
def _(t):
    chunks = upsert.key_chunks(t.lineitem.select("l_orderkey"), "l_orderkey")
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("lo"),
                                       F.max("l_orderkey").alias("hi"))


@query("count_rows", "SELECT date_id, count(*) AS n FROM stops GROUP BY date_id UNION ALL SELECT NULL, count(*) FROM stops", views="stops")
def _(t):
    # one pass: the grand total is the row with a null date
    return t.stops.rollup("date_id").agg(F.count(F.lit(1)).alias("n"))


@query("high_water_mark", "SELECT max(ar_pt) AS mark FROM stops", views="stops")
def _(t):
    return t.stops.agg(F.max("ar_pt").alias("mark"))


@query("csv_scan", "SELECT n_nationkey AS nation, n_name AS name, n_regionkey AS region FROM nation UNION ALL "
                   "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(t):
    rows = t.nation.select("n_nationkey", "n_name", "n_regionkey").union(t.customer.select("c_custkey", "c_name", "c_nationkey"))
    path = files.write_csv(rows, fresh_path(t.spark, "csv"), sep=";")
    return files.read_csv(t.spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint", sep=";",
                          rename={"n_nationkey": "nation", "n_name": "name", "n_regionkey": "region"})


@query("json_scan", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    parsed = files.parse_json(t.events.select("event_id", "props"), "props", "k bigint")
    return parsed.select("event_id", "props.k")


@query("xml_records", """
SELECT event_id AS hash_id, 'S' || CAST(user_id AS VARCHAR) AS station, event_type AS category,
  CAST(2 AS BIGINT) AS messages, CAST(event_id AS VARCHAR) || '-b' AS last_message FROM events""")
def _(t):
    xml = F.format_string(
        '<s id="%s" station="S%s"><tl c="%s"/><ar><m id="%s-a" t="f"/><m id="%s-b" t="q"/></ar></s>',
        F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("event_id"), F.col("event_id"))
    feed = t.events.select(xml.alias("record"))
    message = "struct<id: string, t: string>"
    parsed = files.parse_xml(feed, "record", f"id bigint, station string, tl array<struct<c: string>>, ar array<struct<m: array<{message}>>>")
    first = F.get("record.ar", F.lit(0))["m"]
    return parsed.select(F.col("record.id").alias("hash_id"), "record.station",
                         F.get("record.tl", F.lit(0))["c"].alias("category"),
                         F.size(first).cast("bigint").alias("messages"), F.element_at(first, -1)["id"].alias("last_message"))


@query("partitioned_write", "SELECT station, count(*) AS n, min(hash_id) AS first_id FROM stops GROUP BY station", views="stops")
def _(t):
    path = files.write_partitioned(t.stops.select("hash_id", "station"), fresh_path(t.spark, "by-station"), "station")
    return files.read_partitioned(t.spark, path).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min("hash_id").alias("first_id"))


@query("compact_write", "SELECT count(*) AS n, count(DISTINCT hash_id) AS ids FROM stops", views="stops")
def _(t):
    path = files.write_compact(t.stops.select("hash_id", "station"), fresh_path(t.spark, "compact"), files=4)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash_id").alias("ids"))


@query("append_results", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type "
                         "UNION ALL SELECT f, count(*) FROM stops GROUP BY f", views="stops")
def _(t):
    path = fresh_path(t.spark, "appended")
    files.append_rows(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    files.append_rows(t.stops.groupBy(F.col("f").alias("event_type")).agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.parquet(path)


@query("html_attributes", r"""
SELECT page_id, list_last(list_filter(pairs, lambda p: p[1] = 'lang'))[2] AS lang,
  list_last(list_filter(pairs, lambda p: p[1] = 'charset'))[2] AS charset,
  list_last(list_filter(pairs, lambda p: p[1] = 'class'))[2] AS class,
  list_last(list_filter(pairs, lambda p: p[1] = 'href'))[2] AS href
FROM (SELECT page_id, list_transform(range(1, len(names) + 1), lambda i: [names[i], vals[i]]) AS pairs
  FROM (SELECT page_id, regexp_extract_all(html, '([a-z-]+)="([^"]*)"', 1) AS names,
          regexp_extract_all(html, '([a-z-]+)="([^"]*)"', 2) AS vals FROM pages))""")
def _(t):
    name, value = r'([a-z-]+)="[^"]*"', r'[a-z-]+="([^"]*)"'
    found = files.html_attributes(t.pages.select("page_id", "html"), "html", ["lang", "charset", "class", "href"], name, value)
    return found.drop("html")


@query("encoders_table", """
SELECT 'c' AS name, c AS value, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT c FROM stops WHERE c IS NOT NULL)
UNION ALL SELECT 'o', o, dense_rank() OVER (ORDER BY o) - 1 FROM (SELECT DISTINCT o FROM stops WHERE o IS NOT NULL)
UNION ALL SELECT 'station', station, dense_rank() OVER (ORDER BY station) - 1 FROM (SELECT DISTINCT station FROM stops WHERE station IS NOT NULL)
UNION ALL SELECT x.name, NULL, -1 FROM (VALUES ('c'), ('o'), ('station')) AS x(name)""", views="stops")
def _(t):
    path = fresh_path(t.spark, "encoders")
    encoding.build_encoders(t.stops, ["c", "o", "station"]).write.parquet(path)
    return t.spark.read.parquet(path)
