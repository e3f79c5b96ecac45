"""Streams and the station history. Streams run over files derived from the tables and end by themselves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stopwise.plans.columns import raw_change, raw_plan
from stopwise.plans.registry import query
from stopwise.session import fresh_path
from stopwise.streaming import feeds, history


def _stored(t, df, name: str, files: int = 4) -> str:
    path = fresh_path(t.spark, name)
    df.repartition(files).write.parquet(path)
    return path


NOON, LATER = dt.datetime(2024, 2, 1, 12), dt.datetime(2024, 2, 1, 12, 10)


def _key_feed(t) -> str:
    """Two publications, the first one sent twice."""
    path = fresh_path(t.spark, "keys")
    for keys, at in (("hash_id % 2 = 0", NOON), ("hash_id % 2 = 0", NOON), ("hash_id % 3 = 0", LATER)):
        feeds.publish_keys(t.stops.filter(keys), path, at)
    return path


def _by_key(t, name: str, make) -> feeds.KeyBuckets:
    path = t.stored_path(name, make, lambda rows, path: feeds.KeyBuckets(t.spark, path, "hash_id").append(rows))
    return feeds.KeyBuckets(t.spark, path, "hash_id")


@query("publish_changed_keys", "SELECT hash_id FROM stops WHERE hash_id % 2 = 0 UNION ALL SELECT hash_id FROM stops WHERE hash_id % 3 = 0", views="stops")
def _(t):
    return t.spark.read.parquet(_key_feed(t)).distinct().select("hash_id")


@query("consume_since_offset", "SELECT hash_id FROM stops WHERE hash_id % 2 = 0 OR hash_id % 3 = 0", views="stops")
def _(t):
    feed = feeds.once(feeds.read_feed(t.spark, _key_feed(t), feeds.KEY_FEED), ["hash_id"])
    target = fresh_path(t.spark, "consumed")
    feeds.start_upserts(feed, ["hash_id"], [F.col("at")], target, fresh_path(t.spark, "offsets")).awaitTermination()
    return feeds.current_rows(t.spark, target, ["hash_id"]).select("hash_id")


PARSED = """
WITH p AS (SELECT hash_id, station, ar_pt, dp_pt, CASE WHEN hash_id % 4 <> 1 THEN coalesce(ar_ct, ar_pt) ELSE ar_pt END AS ar_ct,
  CASE WHEN hash_id % 4 <> 1 THEN coalesce(dp_ct, dp_pt) ELSE dp_pt END AS dp_ct FROM stops WHERE hash_id % 2 = 0 OR hash_id % 3 = 0),
d AS (SELECT *, CAST(floor((epoch(ar_ct) - epoch(ar_pt)) / 60) AS INT) AS a, CAST(floor((epoch(dp_ct) - epoch(dp_pt)) / 60) AS INT) AS b FROM p)
SELECT hash_id, station, ar_ct, dp_ct, CASE WHEN b >= -1 THEN a ELSE 0 END AS ar_delay, CASE WHEN b >= -1 THEN b ELSE 0 END AS dp_delay FROM d"""


@query("continuous_parse", PARSED, views="stops")
def _(t):
    plan, change = _by_key(t, "plan_by_key", lambda: raw_plan(t)), _by_key(t, "change_by_key", lambda: raw_change(t))
    keys = feeds.read_feed(t.spark, _key_feed(t), feeds.KEY_FEED, files_per_batch=4)
    target = fresh_path(t.spark, "parsed")
    feeds.continuous_parse(keys, plan, change, target, fresh_path(t.spark, "offsets"), seconds=None).awaitTermination()
    return feeds.current_rows(t.spark, target, ["hash_id"], ["hash_id", "station", "ar_ct", "dp_ct", "ar_delay", "dp_delay"])


def _upserted(t, rows, schema, keys, order, files_per_batch=None):
    feed = feeds.read_feed(t.spark, _stored(t, rows, "feed"), schema, files_per_batch)
    target = fresh_path(t.spark, "upserted")
    feeds.start_upserts(feed, keys, order, target, fresh_path(t.spark, "offsets")).awaitTermination()
    return feeds.current_rows(t.spark, target, keys)


@query("change_feed", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def _(t):
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    latest = _upserted(t, rows, "user_id bigint, ts timestamp_ntz, event_id bigint, event_type string", ["user_id"], [F.col("ts")])
    return latest.select("user_id", "event_id", "event_type")


@query("plan_feed", "SELECT hash_id, station, id FROM stops", views="stops")
def _(t):
    rows = raw_plan(t).union(raw_plan(t).filter("hash_id % 5 = 0"))
    latest = _upserted(t, rows, "hash_id bigint, stop string", ["hash_id"], [F.col("stop")])
    return latest.select("hash_id", F.get_json_object("stop", "$.station").alias("station"), F.get_json_object("stop", "$.id").alias("id"))


@query("buffered_upsert", "SELECT hash_id, station FROM stops", views="stops")
def _(t):
    return _upserted(t, t.stops.select("hash_id", "station"), "hash_id bigint, station string", ["hash_id"], [F.col("station")], files_per_batch=2)


@query("obstacle_feed", "SELECT obstacle_id, priority, summary FROM works", views="works")
def _(t):
    rows = t.works.select("obstacle_id", F.to_json(F.struct("priority", "summary")).alias("data"))
    latest = _upserted(t, rows, "obstacle_id bigint, data string", ["obstacle_id"], [F.col("data")])
    body = F.from_json("data", "priority int, summary string")
    return latest.select("obstacle_id", body["priority"].alias("priority"), body["summary"].alias("summary"))


@query("freshness_alert", """
WITH c AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY 1)
SELECT hour, n, printf('%d plans in the hour from %s, expected at least 14', n, strftime(hour, '%Y-%m-%d %H:%M')) AS alert
FROM (SELECT h.hour, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL '1' HOUR)) AS hour FROM c) h LEFT JOIN c USING (hour)) WHERE n < 14""")
def _(t):
    return feeds.freshness_alert(feeds.hourly_counts(t.events), 14, "plans")


@query("freshness_alert_stream", """
WITH c AS (SELECT * FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY 1)
  WHERE hour < (SELECT date_trunc('hour', max(ts) - INTERVAL '2' HOUR) FROM events))
SELECT hour, n FROM (SELECT h.hour, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL '1' HOUR)) AS hour FROM c) h LEFT JOIN c USING (hour)) WHERE n < 14""")
def _(t):
    path = fresh_path(t.spark, "ticks")
    t.events.select("ts").repartitionByRange(4, "ts").write.parquet(path)
    feed = feeds.read_feed(t.spark, path, "ts timestamp_ntz")
    target = fresh_path(t.spark, "hourly_counts")
    feeds.hourly_counts(feed, late="2 hours").writeStream.outputMode("append").format("parquet").option("checkpointLocation", fresh_path(t.spark, "offsets")) \
        .trigger(availableNow=True).start(target).awaitTermination()
    closed = t.spark.read.schema("hour timestamp_ntz, n bigint").parquet(target)
    return feeds.freshness_alert(closed, 14, "plans").select("hour", "n")


@query("scd2_update", """
WITH cur AS (SELECT eva, name, ds100, coalesce(valid_from, TIMESTAMP '0001-01-01') AS valid_from, coalesce(valid_to, TIMESTAMP '9999-12-31') AS valid_to, 'p' AS platforms, FALSE AS db, TRUE AS iris, lat, lon FROM stations),
inc AS (SELECT 8000000 + c_custkey * 2 AS eva, 'S' || CAST(c_custkey * 2 AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN ' Neu' ELSE '' END AS name,
   'D' || CAST(c_custkey * 2 AS VARCHAR) || CASE WHEN c_custkey * 2 % 3 = 1 THEN 'X' ELSE '' END AS ds100,
   TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 300 AS INT) AS created, 'q' AS platforms, TRUE AS db FROM customer),
m AS (SELECT *, max(valid_from) OVER (PARTITION BY eva) AS latest, count(*) OVER (PARTITION BY eva) AS versions FROM cur),
j AS (SELECT m.*, i.name AS iname, i.ds100 AS ids100, i.created, i.eva IS NOT NULL AS found, i.name IS NOT DISTINCT FROM m.name AND i.ds100 IS NOT DISTINCT FROM m.ds100 AS same FROM m LEFT JOIN inc i ON i.eva = m.eva WHERE valid_from = latest)
SELECT eva, name, ds100, valid_from, valid_to, platforms, db, iris, lat, lon FROM m WHERE valid_from < latest
UNION ALL SELECT eva, name, ds100, CASE WHEN found AND versions = 1 AND created > valid_from THEN created ELSE valid_from END,
  CASE WHEN found AND same OR valid_to <= TIMESTAMP '2024-02-01' THEN valid_to ELSE TIMESTAMP '2024-02-01' END, CASE WHEN found AND same THEN 'q' ELSE platforms END,
  CASE WHEN found AND same THEN TRUE ELSE db END, CASE WHEN NOT found THEN FALSE ELSE iris END, lat, lon FROM j
UNION ALL SELECT eva, iname, ids100, TIMESTAMP '2024-02-01', TIMESTAMP '9999-12-31', 'q', TRUE, TRUE, lat, lon FROM j WHERE found AND NOT same
UNION ALL SELECT eva, name, ds100, created, TIMESTAMP '9999-12-31', 'q', TRUE, TRUE, NULL, NULL FROM inc WHERE eva NOT IN (SELECT eva FROM cur)""", views="stations")
def _(t):
    current = t.stations.select("eva", "name", "ds100", "valid_from", "valid_to", F.lit("p").alias("platforms"), F.lit(False).alias("db"), F.lit(True).alias("iris"), "lat", "lon")
    k = F.col("c_custkey") * 2
    incoming = t.customer.select(
        (8000000 + k).alias("eva"), F.concat(F.lit("S"), k.cast("string"), F.when(F.col("c_custkey") % 5 == 0, " Neu").otherwise("")).alias("name"),
        F.concat(F.lit("D"), k.cast("string"), F.when(k % 3 == 1, "X").otherwise("")).alias("ds100"),
        F.expr("timestamp_ntz'2023-06-01 00:00:00' + make_dt_interval(cast(c_custkey % 300 as int))").alias("created"),
        F.lit("q").alias("platforms"), F.lit(True).alias("db"))
    return history.scd2_update(current, incoming, dt.datetime(2024, 2, 1))
