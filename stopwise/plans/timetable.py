"""Timetable statistics over stop times derived from orders: one trip per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.functions import timecols
from stopwise.operators import timetable
from stopwise.plans.aggregates import rounded
from stopwise.plans.columns import distance_sql
from stopwise.plans.registry import query


def stop_times(t):
    k, start = F.col("o_orderkey"), timecols.epoch_seconds(F.col("o_orderdate")) + F.col("o_orderkey") % 1440 * 60
    rows = t.orders.select("o_orderkey", "o_custkey", start.alias("start"), F.explode(F.sequence(F.lit(0), (2 + k % 4).cast("int"))).alias("seq"))
    place = (F.col("o_custkey") + F.col("seq") * 3) % 80
    return rows.select(F.col("o_orderkey").alias("trip_id"), "seq", F.concat(F.lit("H"), place.cast("string")).alias("stop"),
                       (47 + place * 0.1).alias("lat"), (6 + place * 0.07).alias("lon"),
                       F.timestamp_seconds(F.col("start") + F.col("seq") * (20 + F.col("o_custkey") % 15) * 60).cast(timecols.NTZ).alias("at"),
                       F.concat(F.lit("R"), (F.col("o_custkey") % 20).cast("string")).alias("route"))


STOP_TIMES = f"""
WITH st AS (SELECT k AS trip_id, CAST(i AS INT) AS seq, 'H' || CAST(p AS VARCHAR) AS stop, 47 + p * 0.1::DOUBLE AS lat, 6 + p * 0.07::DOUBLE AS lon, 'R' || CAST(c % 20 AS VARCHAR) AS route,
  base + INTERVAL '1' MINUTE * CAST(i * (20 + c % 15) AS INT) AS moment FROM (
   SELECT o_orderkey AS k, o_custkey AS c, o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS INT) AS base, i, (o_custkey + i * 3) % 80 AS p
   FROM (SELECT *, unnest(range(0, 3 + o_orderkey % 4)) AS i FROM orders))),
legs AS (SELECT *, coalesce(CAST(round({distance_sql('lat0', 'lon0', 'lat', 'lon')} * 1000) AS BIGINT), 0) AS leg FROM (
  SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(moment) OVER w AS moment0, max(seq) OVER (PARTITION BY trip_id) AS last_seq FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY seq))),
trips AS (SELECT trip_id, route, count(*) AS stops, min(moment) AS start, max(moment) AS finish, CAST(sum(leg) AS DOUBLE) / 1000 AS distance_m, (epoch(max(moment)) - epoch(min(moment))) / 60.0::DOUBLE AS minutes FROM legs GROUP BY trip_id, route)
"""


@query("stop_distances", STOP_TIMES + "SELECT trip_id, seq, round(CAST(sum(leg) OVER (PARTITION BY trip_id ORDER BY seq) AS DOUBLE) / 1000, 3) AS distance_m FROM legs")
def _(t):
    return timetable.stop_distances(stop_times(t)).select("trip_id", "seq", F.round("distance_m", 3).alias("distance_m"))


@query("trip_stats", STOP_TIMES + "SELECT trip_id, route, stops, start, finish AS \"end\", round(distance_m, 3) AS distance_m, minutes, round(distance_m / 1000 / nullif(minutes / 60, 0), 6) AS speed_kmh FROM trips")
def _(t):
    rows = timetable.trip_stats(stop_times(t))
    return rows.withColumns({"distance_m": F.round("distance_m", 3), "speed_kmh": F.round("speed_kmh", 6)})


def _binned(hours: int, by: str = "") -> str:
    return f"SELECT {by} CAST(time_bucket(INTERVAL '{hours}' HOUR, start, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS bin, count(*) AS trips, round(sum(distance_m), 3) AS distance_m, round(sum(minutes), 3) AS minutes FROM trips GROUP BY ALL"


@query("feed_time_series", STOP_TIMES + _binned(6))
def _(t):
    return rounded(timetable.time_series(timetable.trip_stats(stop_times(t))), 3)


@query("downsample", STOP_TIMES + _binned(12))
def _(t):
    return rounded(timetable.downsample(timetable.time_series(timetable.trip_stats(stop_times(t)))), 3)


@query("route_time_series", STOP_TIMES + _binned(12, "route,"))
def _(t):
    return rounded(timetable.time_series(timetable.trip_stats(stop_times(t)), 12, ("route",)), 3)


@query("route_cross_section", STOP_TIMES + """, s AS (SELECT route, time_bucket(INTERVAL '12' HOUR, start, TIMESTAMP '1970-01-01') AS bin, count(*) AS trips FROM trips GROUP BY ALL)
SELECT CAST(bin AS TIMESTAMP) AS bin, CAST(sum(trips) FILTER (WHERE route = 'R1') AS BIGINT) AS R1, CAST(sum(trips) FILTER (WHERE route = 'R2') AS BIGINT) AS R2 FROM s GROUP BY bin""")
def _(t):
    return timetable.cross_section(timetable.time_series(timetable.trip_stats(stop_times(t)), 12, ("route",)), "trips", ["R1", "R2"])


@query("locate_trips", STOP_TIMES + """, asked AS (SELECT DISTINCT CAST(date_trunc('hour', moment) AS TIMESTAMP) AS asked FROM st)
SELECT trip_id, asked, round(lat0 + (lat - lat0) * f, 9) AS lat, round(lon0 + (lon - lon0) * f, 9) AS lon FROM (
 SELECT *, (epoch(asked) - epoch(moment0)) / (epoch(moment) - epoch(moment0)) AS f FROM legs JOIN asked ON asked >= moment0 AND (asked < moment OR (asked = moment AND seq = last_seq)))""")
def _(t):
    rows = stop_times(t)
    asked = rows.select(timecols.floor_to_seconds(F.col("at"), 3600).alias("asked")).distinct()
    return rounded(timetable.locate_trips(rows, asked), 9)


@query("route_timetable", STOP_TIMES + """
SELECT min(moment) OVER (PARTITION BY trip_id) AS start, trip_id, seq, stop, moment AS "at" FROM st WHERE route = 'R3' ORDER BY start, trip_id, seq""")
def _(t):
    return timetable.route_timetable(stop_times(t), F.lit("R3"))
