"""Scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.functions import codes, geo, scoring, textcols, timecols
from stopwise.operators import clean, encoding, nested
from stopwise.plans.registry import query


@query("parse_compact_ts", """
SELECT event_id, date_trunc('minute', ts) AS parsed, CAST(NULL AS TIMESTAMP) AS nothing FROM events""")
def _(t):
    text = F.date_format("ts", "yyMMddHHmm")
    return t.events.select("event_id", timecols.parse_compact_ts(text).alias("parsed"),
                           timecols.parse_compact_ts(F.lit(None).cast("string")).alias("nothing"))


@query("parse_path", """
SELECT page_id, CAST(len(parts) AS BIGINT) AS parts, parts[1] AS first_part, parts[-1] AS last_part
FROM (SELECT page_id, string_split(nullif(CASE WHEN page_id % 7 = 0 THEN '' ELSE replace(url, '/', '|') END, ''), '|') AS parts FROM pages)""")
def _(t):
    text = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.replace("url", F.lit("/"), F.lit("|")))
    path = t.pages.select("page_id", textcols.parse_path(text).alias("parts"))
    return path.select("page_id", F.when(F.col("parts").isNotNull(), F.size("parts")).cast("bigint").alias("parts"),
                       F.get("parts", F.lit(0)).alias("first_part"), F.try_element_at("parts", F.lit(-1)).alias("last_part"))


@query("split_stop_id", """
SELECT hash_id, dayly_id, strftime(date_id, '%y%m%d%H%M') AS date_text, stop_id FROM stops""", views="stops")
def _(t):
    parts = textcols.split_stop_id(F.col("id"))
    return t.stops.select("hash_id", *[c.alias(n) for n, c in parts.items()])


def raw_plan(t):
    return t.stored("plans", lambda: make_plan(t))


def raw_change(t):
    return t.stored("changes", lambda: make_change(t))


def make_plan(t):
    """Nested plan records built from the stops view, as JSON text."""
    compact = lambda c: F.date_format(c, timecols.COMPACT_FORMAT)
    s = t.stops
    end = lambda e, path: F.array(F.struct(
        compact(f"{e}_pt").alias("pt"), F.col(f"{e}_pp").alias("pp"),
        F.when(F.col("hash_id") % 9 == 0, "p").alias("ps"), path.alias("ppth"),
        F.when(F.col("hash_id") % 6 == 0, "1").when(F.col("hash_id") % 6 == 1, "0").alias("hi")))
    arrival = F.when(F.col("ar_pt").isNotNull(), end("ar", F.concat(F.lit("S1|S"), F.col("n"), F.lit("|S9"))))
    departure = F.when(F.col("dp_pt").isNotNull(), end("dp", F.when(F.col("hash_id") % 4 != 0, F.concat(F.lit("S2|S"), F.col("stop_id"))).otherwise("")))
    line = F.when(F.col("hash_id") % 14 != 0, F.array(F.struct("f", "t", "o", "c", "n")))
    stop = F.struct("id", "station", line.alias("tl"), arrival.alias("ar"), departure.alias("dp"))
    return s.select("hash_id", F.to_json(stop).alias("stop"))


def make_change(t):
    """Nested change records for a part of the stops, as JSON text."""
    compact = lambda c: F.date_format(c, timecols.COMPACT_FORMAT)
    s = t.stops.filter("hash_id % 4 <> 1")
    message = lambda tag: F.struct(F.concat(F.lit(tag), F.col("hash_id")).alias("id"), F.lit("f").alias("t"),
                                   (F.col("hash_id") % 100).cast("string").alias("c"), compact("ar_ct").alias("ts"))
    arrival = F.when(F.col("ar_ct").isNotNull(), F.array(F.struct(
        compact("ar_ct").alias("ct"), compact("ar_pt").alias("clt"),
        F.when(F.col("hash_id") % 8 == 0, "S3|S4").alias("cpth"), F.col("ar_cs").alias("cs"),
        F.when(F.col("hash_id") % 5 == 0, "99").alias("cp"),
        F.when(F.col("hash_id") % 3 == 0, F.array(message("a"), message("b"))).alias("m"))))
    departure = F.when(F.col("dp_ct").isNotNull(), F.array(F.struct(
        compact("dp_ct").alias("ct"), F.col("dp_cs").alias("cs"))))
    general = F.when(F.col("hash_id") % 2 == 0, F.array(message("s")))
    return s.select("hash_id", F.to_json(F.struct("id", arrival.alias("ar"), departure.alias("dp"), general.alias("m"))).alias("change"))


FLAT_SQL = """
SELECT hash_id, dayly_id, date_id, stop_id, station, CASE WHEN hash_id % 14 <> 0 THEN f END AS f,
  CASE WHEN hash_id % 14 <> 0 THEN c END AS c, ar_pt, dp_pt, ar_pp,
  CASE WHEN ar_pt IS NOT NULL THEN 'S1|S' || n || '|S9' END AS ar_ppth,
  CASE WHEN dp_pt IS NOT NULL AND hash_id % 4 <> 0 THEN 'S2|S' || CAST(stop_id AS VARCHAR) END AS dp_ppth,
  CASE WHEN ar_pt IS NOT NULL AND hash_id % 9 = 0 THEN 'p' END AS ar_ps,
  (ar_pt IS NOT NULL AND hash_id % 6 = 0) AS ar_hi FROM stops"""


@query("flatten_plan_stop", FLAT_SQL, views="stops")
def _(t):
    plans = raw_plan(t).select("hash_id", F.from_json("stop", clean.PLAN_SCHEMA).alias("stop"))
    flat = clean.flatten_plan(plans)
    return flat.select("hash_id", "dayly_id", "date_id", "stop_id", "station", "f", "c", "ar_pt", "dp_pt", "ar_pp",
                       F.array_join("ar_ppth", "|").alias("ar_ppth"), F.array_join("dp_ppth", "|").alias("dp_ppth"),
                       "ar_ps", "ar_hi")


CHANGE_SQL = """
WITH flat AS (""" + FLAT_SQL + """)
SELECT s.hash_id,
  CASE WHEN s.hash_id % 4 <> 1 THEN coalesce(s.ar_ct, s.ar_pt) ELSE s.ar_pt END AS ar_ct,
  CASE WHEN s.hash_id % 4 <> 1 THEN coalesce(s.dp_ct, s.dp_pt) ELSE s.dp_pt END AS dp_ct,
  CASE WHEN s.hash_id % 4 <> 1 AND s.ar_ct IS NOT NULL THEN s.ar_pt END AS ar_clt,
  CASE WHEN s.hash_id % 8 = 0 AND s.ar_ct IS NOT NULL THEN 'S3|S4' ELSE flat.ar_ppth END AS ar_cpth,
  CASE WHEN s.hash_id % 4 <> 1 AND s.ar_ct IS NOT NULL THEN coalesce(s.ar_cs, flat.ar_ps) ELSE flat.ar_ps END AS ar_cs,
  CASE WHEN s.hash_id % 4 <> 1 AND s.hash_id % 5 = 0 AND s.ar_ct IS NOT NULL THEN '99' ELSE s.ar_pp END AS ar_cp
FROM stops s JOIN flat ON s.hash_id = flat.hash_id"""


def _changed(t):
    parsed = clean.parse_stops(raw_plan(t), raw_change(t))
    return parsed.select("hash_id", "ar_ct", "dp_ct", "ar_clt", F.array_join("ar_cpth", "|").alias("ar_cpth"), "ar_cs", "ar_cp")


query("apply_change", CHANGE_SQL, views="stops")(_changed)


@query("plan_left_change", """
SELECT s.hash_id, s.station, CASE WHEN s.hash_id % 4 <> 1 THEN s.id END AS changed_id FROM stops s""", views="stops")
def _(t):
    changes = raw_change(t).select("hash_id", F.from_json("change", clean.CHANGE_SCHEMA).alias("change"))
    joined = clean.join_changes(t.stops.select("hash_id", "station"), changes)
    return joined.select("hash_id", "station", F.col("change.id").alias("changed_id"))


@query("flatten_messages", """
SELECT hash_id, 'ar' AS level, tag || CAST(hash_id AS VARCHAR) AS id, 'f' AS t, CAST(hash_id % 100 AS INT) AS c, ar_ct AS ts
  FROM stops, (VALUES ('a'), ('b')) AS v(tag) WHERE hash_id % 4 <> 1 AND hash_id % 3 = 0 AND ar_ct IS NOT NULL
UNION ALL SELECT hash_id, 'stop', 's' || CAST(hash_id AS VARCHAR), 'f', CAST(hash_id % 100 AS INT), ar_ct FROM stops
  WHERE hash_id % 4 <> 1 AND hash_id % 2 = 0""", views="stops")
def _(t):
    changes = raw_change(t).select("hash_id", F.from_json("change", clean.CHANGE_SCHEMA).alias("change"))
    return clean.messages_long(changes)


@query("message_arrays", """
SELECT hash_id, CASE WHEN hash_id % 3 = 0 AND ar_ct IS NOT NULL THEN 'a' || CAST(hash_id AS VARCHAR) || ',b' || CAST(hash_id AS VARCHAR) END AS ar_ids,
  CASE WHEN hash_id % 2 = 0 THEN CAST(hash_id % 100 AS INT) END AS stop_code FROM stops WHERE hash_id % 4 <> 1""", views="stops")
def _(t):
    changes = raw_change(t).select("hash_id", F.from_json("change", clean.CHANGE_SCHEMA).alias("change"))
    arrays = clean.flatten_messages(changes)
    return arrays.select("hash_id", F.array_join("ar_m_id", ",").alias("ar_ids"), F.get("stop_m_c", F.lit(0)).alias("stop_code"))


@query("flag_columns", """
SELECT hash_id, (ar_pt IS NOT NULL AND hash_id % 6 = 0) AS ar_hi, (dp_pt IS NOT NULL AND hash_id % 6 = 0) AS dp_hi,
  FALSE AS ar_dc FROM stops""", views="stops")
def _(t):
    plans = raw_plan(t).select("hash_id", F.from_json("stop", clean.PLAN_SCHEMA).alias("stop"))
    return clean.flatten_plan(plans).select("hash_id", "ar_hi", "dp_hi", "ar_dc")


@query("delays", """
SELECT hash_id, ar_delay, dp_delay, ar_happened, dp_happened, ar_cancelled, dp_cancelled FROM delayed""", views="delayed")
def _(t):
    return clean.add_delays(t.stops).select("hash_id", "ar_delay", "dp_delay", "ar_happened", "dp_happened",
                                            "ar_cancelled", "dp_cancelled")


@query("delays_only_early", """
SELECT hash_id, CASE WHEN d < -1 THEN 0 ELSE a END AS ar_delay, CASE WHEN d < -1 THEN 0 ELSE d END AS dp_delay FROM (
 SELECT hash_id, CAST(floor((epoch(ar_ct) - epoch(ar_pt)) / 60) AS INT) AS a, CAST(floor((epoch(dp_ct) - epoch(dp_pt)) / 60) AS INT) AS d FROM stops)""", views="stops")
def _(t):
    return clean.add_delays(t.stops, clamp="only_early").select("hash_id", "ar_delay", "dp_delay")


@query("coalesce_platform", "SELECT hash_id, coalesce(ar_pp, dp_pp) AS pp FROM stops", views="stops")
def _(t):
    return clean.coalesce_platform(t.stops).select("hash_id", "pp")


@query("ml_time_features", """
SELECT hash_id, CAST(extract(hour FROM p) * 60 + extract(minute FROM p) AS INT) AS minute, CAST(isodow(p) - 1 AS INT) AS day,
  CAST(floor(((epoch(dp_pt) - epoch(ar_pt)) % 86400 + 86400) % 86400 / 60) AS INT) AS stay_time,
  CAST(month(p) AS INT) AS month, CAST(hour(p) AS INT) AS hour FROM (SELECT *, coalesce(ar_pt, dp_pt) AS p FROM stops)""", views="stops")
def _(t):
    rows = clean.calendar_features(clean.time_features(t.stops))
    return rows.select("hash_id", "minute", "day", "stay_time", "month", "hour")


@query("fill_defaults", "SELECT hash_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in clean.OBSTACLE_COLUMNS) + " FROM stops", views="stops")
def _(t):
    return clean.fill_obstacles(t.stops).select("hash_id", *clean.OBSTACLE_COLUMNS)


@query("label_encode", """
SELECT hash_id, CASE WHEN o IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY o NULLS LAST) - 1 AS INT) END AS o_code,
  CAST(dense_rank() OVER (ORDER BY station) - 1 AS INT) AS station_code FROM stops""", views="stops")
def _(t):
    return encoding.label_encode(t.stops.select("hash_id", "o", "station"), ["o", "station"]).select("hash_id", "o_code", "station_code")


@query("encode_lookup", """
WITH codes AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT c FROM stops WHERE f = 'F' AND o IS NOT NULL AND c <> 'view'))
SELECT s.hash_id, CAST(coalesce(code, -1) AS INT) AS c_code FROM stops s LEFT JOIN codes USING (c)""", views="stops")
def _(t):
    known = t.stops.filter("f = 'F' and o is not null and c <> 'view'")
    return encoding.encode(t.stops.select("hash_id", "c"), encoding.build_encoders(known, ["c"]), ["c"]).select("hash_id", "c_code")


@query("extract_code", r"""
SELECT ds100, nullif(regexp_extract(name, '.*\(([A-Z\s]+)\)', 1), '') AS code,
  nullif(regexp_extract(ds100, '.*\(([A-Z\s]+)\)', 1), '') AS no_code FROM points""", views="points")
def _(t):
    return t.points.select("ds100", textcols.extract_code(F.col("name")).alias("code"), textcols.extract_code(F.col("ds100")).alias("no_code"))


_VALUES = lambda texts: ", ".join(f"({k!r}, '{v}')" for k, v in texts.items())


@query("code_to_text", f"""
WITH p(code, text) AS (VALUES {_VALUES(codes.PRIORITY_TEXTS)}), m(code, text) AS (VALUES {_VALUES(codes.MESSAGE_TEXTS)}),
 k(code, text) AS (VALUES {_VALUES(codes.MESSAGE_TYPES)})
SELECT w.obstacle_id, p.text AS priority_text, m.text AS message_text, k.text AS type_text FROM works w
LEFT JOIN p ON p.code = w.priority LEFT JOIN m ON m.code = w.obstacle_id % 110
LEFT JOIN k ON k.code = substr('dfqhiurcx', CAST(w.obstacle_id % 9 + 1 AS INT), 1)""", views="works")
def _(t):
    kind = F.substring(F.lit("dfqhiurcx"), (F.col("obstacle_id") % 9 + 1).cast("int"), F.lit(1))
    return t.works.select(
        "obstacle_id", codes.code_text(F.col("priority"), codes.PRIORITY_TEXTS).alias("priority_text"),
        codes.code_text((F.col("obstacle_id") % 110).cast("int"), codes.MESSAGE_TEXTS).alias("message_text"),
        codes.code_text(kind, codes.MESSAGE_TYPES).alias("type_text"))


@query("utc_to_local", """
SELECT o_orderkey, CAST(timezone('Europe/Berlin', timezone('UTC', o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT))) AS TIMESTAMP) AS local_time FROM orders""")
def _(t):
    utc = F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)")
    text = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return t.orders.select("o_orderkey", timecols.utc_to_local(text).alias("local_time"))


@query("duration_text", """
SELECT hash_id, CASE WHEN d = 0 THEN '' WHEN abs(d) = 1 THEN CAST(d AS VARCHAR) || ' day, ' ELSE CAST(d AS VARCHAR) || ' days, ' END
  || CAST((s - d * 86400) // 3600 AS VARCHAR) || ':' || lpad(CAST((s - d * 86400) % 3600 // 60 AS VARCHAR), 2, '0') AS duration
FROM (SELECT hash_id, s, CAST(floor(s / 86400.0) AS BIGINT) AS d FROM (
  SELECT hash_id, CAST(epoch(ar_ct) - epoch(ar_pt) AS BIGINT) * (hash_id % 100) AS s FROM stops WHERE ar_ct IS NOT NULL))""", views="stops")
def _(t):
    seconds = (timecols.epoch_seconds(F.col("ar_ct")) - timecols.epoch_seconds(F.col("ar_pt"))) * (F.col("hash_id") % 100)
    return t.stops.filter("ar_ct is not null").select("hash_id", timecols.duration_text(seconds).alias("duration"))


@query("stay_times", """
SELECT hash_id, string_agg(coalesce(CAST(CAST(floor(((epoch(d) - epoch(a)) % 86400 + 86400) % 86400 / 60) AS INT) AS VARCHAR), '-'), ',' ORDER BY i) AS stay_times
FROM (SELECT hash_id, i, CASE WHEN i > 0 THEN ar_ct + INTERVAL '15' MINUTE * CAST(i AS INT) END AS a,
        CASE WHEN i < stop_id THEN dp_ct + INTERVAL '17' MINUTE * CAST(i AS INT) END AS d
      FROM (SELECT *, unnest(range(0, stop_id + 1)) AS i FROM stops)) GROUP BY hash_id""", views="stops")
def _(t):
    later = lambda c, minutes: F.timestamp_seconds(timecols.epoch_seconds(F.col(c)) + minutes * 60).cast(timecols.NTZ)
    stopovers = F.transform(F.sequence(F.lit(0), "stop_id"), lambda i: F.struct(
        F.when(i > 0, later("ar_ct", i * 15)).alias("arrival"),
        F.when(i < F.col("stop_id"), later("dp_ct", i * 17)).alias("departure")))
    minutes = nested.stay_times(stopovers)
    return t.stops.select("hash_id", F.array_join(F.transform(minutes, lambda m: m.cast("string")), ",", "-").alias("stay_times"))


@query("min_max_scale", """
SELECT hash_id, round((distance_to_start - lo1) / (hi1 - lo1), 6) AS start_scaled, round((ar_delay - lo2) / CAST(hi2 - lo2 AS DOUBLE), 6) AS delay_scaled
FROM delayed, (SELECT min(distance_to_start) AS lo1, max(distance_to_start) AS hi1, min(ar_delay) AS lo2, max(ar_delay) AS hi2 FROM delayed)""", views="delayed")
def _(t):
    rows = encoding.min_max_scale(t.delayed.select("hash_id", "distance_to_start", "ar_delay"), ["distance_to_start", "ar_delay"])
    return rows.select("hash_id", F.round("distance_to_start_scaled", 6).alias("start_scaled"), F.round("ar_delay_scaled", 6).alias("delay_scaled"))


@query("standard_scale", """
SELECT hash_id, round((distance_to_start - m) / s, 6) AS start_scaled FROM stops,
 (SELECT avg(distance_to_start) AS m, stddev_pop(distance_to_start) AS s FROM stops)""", views="stops")
def _(t):
    rows = encoding.standard_scale(t.stops.select("hash_id", "distance_to_start"), ["distance_to_start"])
    return rows.select("hash_id", F.round("distance_to_start_scaled", 6).alias("start_scaled"))


@query("normalize_name", """
SELECT ds100, regexp_replace(regexp_replace(lower(name || ' gl.3'), '[ ()]|gl\\.', '', 'g'), '[.\\-_/]', '', 'g') AS normal FROM points""", views="points")
def _(t):
    return t.points.select("ds100", textcols.normalize_name(F.concat("name", F.lit(" gl.3"))).alias("normal"))


@query("coerce", """
SELECT o_orderkey, TRY_CAST(replace(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE replace(CAST(o_orderkey % 1000 / 8 AS VARCHAR), '.', ',') END, ',', '.') AS DOUBLE) AS number,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS moment FROM orders""")
def _(t):
    number = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(
        F.replace(((F.col("o_orderkey") % 1000) / 8).cast("string"), F.lit("."), F.lit(",")))
    moment = F.when(F.col("o_orderkey") % 6 == 0, "gestern").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select("o_orderkey", textcols.decimal_comma(number).alias("number"), moment.try_cast("timestamp_ntz").alias("moment"))


@query("split_edge_name", "SELECT u AS source, v AS target, length FROM edges", views="edges")
def _(t):
    named = t.edges.select(F.concat("u", F.lit(" - "), "v").alias("name"), "length")
    return named.select(*[c.alias(n) for n, c in textcols.split_edge_name(F.col("name")).items()], "length")


@query("stable_hash_key")
def _(t):
    from stopwise.functions.keys import stable_key
    return t.stops.select("id", stable_key(F.col("id")).alias("key"))


@query("marker_size", """
SELECT station, round(n / 30.0 / 2000 * 70, 6) AS per_day_size, round(n / CAST(max(n) OVER () AS DOUBLE) * 70, 6) AS relative_size
FROM (SELECT station, count(ar_pt) + count(dp_pt) AS n FROM stops GROUP BY station)""", views="stops")
def _(t):
    counts = t.stops.groupBy("station").agg((F.count("ar_pt") + F.count("dp_pt")).alias("n"))
    largest = counts.agg(F.max("n")).scalar()
    return counts.select("station", F.round(scoring.marker_size_per_day(F.col("n"), F.lit(30)), 6).alias("per_day_size"),
                         F.round(scoring.marker_size_relative(F.col("n"), largest), 6).alias("relative_size"))


@query("threshold_flags", """
SELECT hash_id, ar_delay <= 5 AS ar_within_5, ar_delay > 5 AS ar_over_5, ar_delay > 10 AS ar_over_10, ar_delay > 15 AS ar_over_15,
  dp_delay <= 5 AS dp_within_5, dp_delay > 5 AS dp_over_5, dp_delay > 10 AS dp_over_10, dp_delay > 15 AS dp_over_15 FROM delayed""", views="delayed")
def _(t):
    flags = clean.threshold_flags(t.delayed)
    return flags.select("hash_id", *[c for c in flags.columns if "_within_" in c or "_over_" in c])


@query("transfer_doable", """
SELECT hash_id, p AS planned_minutes, (p + dp_delay - ar_delay) > 3 AS doable, (p + dp_delay - ar_delay) > 5 AS doable_5 FROM (
 SELECT hash_id, ar_delay, dp_delay, CAST(((extract(hour FROM dp_pt) * 60 + extract(minute FROM dp_pt) - extract(hour FROM ar_pt) * 60 - extract(minute FROM ar_pt)) % 1440 + 1440) % 1440 AS INT) AS p
 FROM delayed WHERE ar_pt IS NOT NULL AND dp_pt IS NOT NULL)""", views="delayed")
def _(t):
    rows = t.delayed.filter("ar_pt is not null and dp_pt is not null")
    arrival, departure = F.date_format("ar_pt", "HH:mm"), F.date_format("dp_pt", "HH:mm")
    planned = scoring.planned_transfer(arrival, departure)
    return rows.select("hash_id", planned.alias("planned_minutes"),
                       scoring.transfer_doable(planned, F.col("ar_delay"), F.col("dp_delay")).alias("doable"),
                       scoring.transfer_doable(planned, F.col("ar_delay"), F.col("dp_delay"), 5).alias("doable_5"))


HAVERSINE_SQL = "(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
DISTANCE_SQL = f"(2 * 6371008.8 * asin(sqrt(CASE WHEN {HAVERSINE_SQL} > 1 THEN 1.0 ELSE {HAVERSINE_SQL} END)))"


def distance_sql(a, b, c, d):
    return DISTANCE_SQL.format(a=a, b=b, c=c, d=d)


@query("geo_distance", f"""
SELECT ds100, round({distance_sql('lat', 'lon', '48.5', '9.05')}, 3) AS metres,
  round({distance_sql('lat', 'lon', 'lat + 0.1', 'lon')} + {distance_sql('lat + 0.1', 'lon', 'lat + 0.1', 'lon + 0.2')}, 3) AS line_metres
FROM points""", views="points")
def _(t):
    lat, lon = F.col("lat"), F.col("lon")
    point = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    line = F.array(point(lat, lon), point(lat + 0.1, lon), point(lat + 0.1, lon + 0.2))
    return t.points.select("ds100", F.round(geo.distance_m(lat, lon, F.lit(48.5), F.lit(9.05)), 3).alias("metres"),
                           F.round(geo.polyline_length_m(line), 3).alias("line_metres"))


@query("angle_three_points", """
SELECT ds100, round(CASE WHEN a < 0 THEN a + 360 ELSE a END % 180, 6) AS angle FROM (
 SELECT ds100, degrees(atan2(lat - 48.5, lon - 9.05) - atan2(1.5, -2.25)) AS a FROM points)""", views="points")
def _(t):
    angle = geo.angle_degrees(F.lit(6.8), F.lit(50.0), F.lit(9.05), F.lit(48.5), F.col("lon"), F.col("lat"))
    return t.points.select("ds100", F.round(angle, 6).alias("angle"))


@query("clock_to_hour", """
SELECT hash_id, CAST(round_even(h / 100, 0) + CASE WHEN h % 100 > 30 THEN 1 ELSE 0 END AS INT) AS hour FROM (
 SELECT hash_id, CAST(strftime(coalesce(ar_pt, dp_pt), '%H%M') AS INT) AS h FROM stops)""", views="stops")
def _(t):
    hhmm = F.date_format(clean.planned_time(), "HHmm").cast("int")
    return t.stops.select("hash_id", timecols.clock_to_hour(hhmm).alias("hour"))


@query("status_flags", """
SELECT hash_id, ar_delay <= 5 AS ar_on_time, dp_delay <= 5 AS dp_on_time, ar_cs IS NOT DISTINCT FROM 'c' AS ar_is_cancelled,
  dp_cs IS NOT DISTINCT FROM 'c' AS dp_is_cancelled FROM delayed""", views="delayed")
def _(t):
    return clean.status_flags(t.delayed).select("hash_id", "ar_on_time", "dp_on_time", "ar_is_cancelled", "dp_is_cancelled")


@query("rename_drop", "SELECT n_nationkey AS area, n_name AS label, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.drop("n_regionkey", "r_regionkey").withColumnsRenamed(
        {"n_nationkey": "area", "n_name": "label", "r_name": "region"}).select("area", "label", "region")
