"""Joins: dimension lookups, validity, ranges, places and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.functions import timecols
from stopwise.operators import clean, dedup, encoding, filters, lookup, matching, ranges, spatial
from stopwise.plans.columns import distance_sql
from stopwise.plans.registry import query

OPEN = "coalesce(valid_from, TIMESTAMP '0001-01-01') AS valid_from, coalesce(valid_to, TIMESTAMP '9999-12-31') AS valid_to"
NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY coalesce(valid_from, TIMESTAMP '0001-01-01') DESC) AS rn FROM stations) WHERE rn = 1)"""


@query("add_coordinates", "WITH " + NEWEST + " SELECT hash_id, station, lat, lon FROM stops LEFT JOIN newest ON name = station", views="stops stations")
def _(t):
    return lookup.add_coordinates(t.stops.select("hash_id", "station"), t.stations)


def _temporal(key: str) -> str:
    return f"""SELECT r.hash_id, r.{key}, s.name AS found_name, s.ds100 AS found_ds100, s.lat AS found_lat FROM (
  SELECT hash_id, station AS name, 8000000 + CAST(substr(station, 2) AS BIGINT) AS eva, 'D' || substr(station, 2) AS ds100, coalesce(ar_pt, dp_pt) AS date FROM stops) r
LEFT JOIN (SELECT name, eva, ds100, lat, {OPEN} FROM stations) s
  ON s.{key} = r.{key} AND s.valid_from <= r.date AND r.date < s.valid_to"""


def _requests(t, key):
    number = F.substring("station", 2, 10)
    value = {"name": F.col("station"), "eva": 8000000 + number.cast("bigint"), "ds100": F.concat(F.lit("D"), number)}[key]
    return t.stops.select("hash_id", value.alias(key), clean.planned_time().alias("date"))


def _station_lookup(key):
    def build(t):
        dimension = t.stations.withColumns({"found_name": F.col("name"), "found_ds100": F.col("ds100"), "found_lat": F.col("lat")})
        found = lookup.station_lookup(_requests(t, key), dimension, key, "date", ["found_name", "found_ds100", "found_lat"])
        return found.drop("date")
    return build


query("station_lookup_temporal", _temporal("name"), views="stops stations")(_station_lookup("name"))
query("station_lookup_by_eva", _temporal("eva"), views="stops stations")(_station_lookup("eva"))
query("station_lookup_by_ds100", _temporal("ds100"), views="stops stations")(_station_lookup("ds100"))


@query("station_lookup_latest", "WITH " + NEWEST + " SELECT hash_id, station, eva, ds100 FROM stops LEFT JOIN newest ON name = station", views="stops stations")
def _(t):
    requests = t.stops.select("hash_id", F.col("station").alias("name"))
    return lookup.station_lookup_latest(requests, t.stations, "name", ["eva", "ds100"]).withColumnRenamed("name", "station")


@query("station_lookup_pairs", f"""
SELECT r.hash_id, r.position, r.name, r.date, s.eva FROM (
  SELECT hash_id, 0 AS position, station AS name, ar_pt AS date FROM stops UNION ALL
  SELECT hash_id, 1, 'S' || CAST(hash_id % 100 AS VARCHAR), dp_pt FROM stops) r
LEFT JOIN (SELECT name, eva, {OPEN} FROM stations) s ON s.name = r.name AND s.valid_from <= r.date AND r.date < s.valid_to""", views="stops stations")
def _(t):
    lists = t.stops.select("hash_id", F.array("station", F.concat(F.lit("S"), (F.col("hash_id") % 100).cast("string"))).alias("names"),
                           F.array("ar_pt", "dp_pt").alias("dates"))
    return lookup.station_lookup_pairs(lists, t.stations, "names", "dates", "name", ["eva"])


@query("dimension_lookup", """
SELECT o_orderkey, code, p.name AS found_name, p.lat AS found_lat, p.lon AS found_lon
FROM (SELECT o_orderkey, 'P' || CAST(o_custkey + o_orderkey % 3 * 900 AS VARCHAR) AS code FROM orders) LEFT JOIN points p ON p.ds100 = code""", views="points")
def _(t):
    code = F.concat(F.lit("P"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 900).cast("string"))
    requests = t.orders.select("o_orderkey", code.alias("code"))
    return lookup.dimension_lookup(requests, t.points, "code", "ds100", ["name", "lat", "lon"])


FALLBACK = """
WITH """ + NEWEST + """, r AS (SELECT o_orderkey, 'P' || CAST(o_custkey + o_orderkey % 3 * 900 AS VARCHAR) AS code, 8000000 + o_orderkey % 130 AS eva FROM orders)"""


def _fallback(t):
    code = F.concat(F.lit("P"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 900).cast("string"))
    requests = t.orders.select("o_orderkey", code.alias("code"), (8000000 + F.col("o_orderkey") % 130).alias("eva"))
    return lookup.fallback_lookup(requests, t.points, ("code", "ds100"), lookup.latest_version(t.stations, "name"), ("eva", "eva"), "name", "station")


@query("fallback_lookup", FALLBACK + """
SELECT o_orderkey, code, r.eva, coalesce(p.name, s.name) AS station FROM r LEFT JOIN points p ON p.ds100 = code LEFT JOIN newest s ON s.eva = r.eva""", views="stations points")
def _(t):
    return _fallback(t)


@query("unknown_places", FALLBACK + """
SELECT DISTINCT code, r.eva FROM r LEFT JOIN points p ON p.ds100 = code LEFT JOIN newest s ON s.eva = r.eva
WHERE p.name IS NULL AND s.name IS NULL""", views="stations points")
def _(t):
    return _fallback(t).filter("station is null").select("code", "eva").distinct()


@query("connecting_trains", """
SELECT a.station, a.hash_id AS ar_id, d.hash_id AS dp_id, a.c AS ar_c, d.c AS dp_c, a.ar_pt AS ar_time, d.dp_pt AS dp_time
FROM stops a JOIN stops d ON a.station = d.station AND a.hash_id <> d.hash_id
 AND d.dp_pt >= a.ar_pt + INTERVAL '2' MINUTE AND d.dp_pt <= a.ar_pt + INTERVAL '10' MINUTE""", views="stops")
def _(t):
    pairs = ranges.connecting_trains(t.stops, ["c"])
    return pairs.withColumnsRenamed({"ar_side_hash_id": "ar_id", "dp_side_hash_id": "dp_id", "ar_side_c": "ar_c", "dp_side_c": "dp_c"})


@query("nearest_point", f"""
SELECT place, arg_min(node, (d, node)) AS nearest, round(min(d), 3) AS distance_m FROM (
 SELECT s.name || '/' || s.ds100 AS place, p.ds100 AS node, {distance_sql('s.lat', 's.lon', 'p.lat', 'p.lon')} AS d
 FROM stations s, points p WHERE s.lat IS NOT NULL AND p.lat IS NOT NULL) GROUP BY place""", views="stations points")
def _(t):
    places = filters.with_coordinates(t.stations).select(F.concat("name", F.lit("/"), "ds100").alias("place"), "lat", "lon")
    found = spatial.nearest_point(places, filters.with_coordinates(t.points), "ds100")
    return found.select("place", "nearest", F.round("distance_m", 3).alias("distance_m"))


GRAMS = """list_distinct(list_transform(range(1, length({n})), lambda i: substr({n}, i, 2)))"""
FUZZY = f"""
WITH l AS (SELECT DISTINCT s_name AS name, regexp_replace(regexp_replace(lower(s_name), '[ ()]|gl\\.', '', 'g'), '[.\\-_/#]', '', 'g') AS n FROM (SELECT DISTINCT replace(s_name, '#000', '') AS s_name FROM supplier)),
r AS (SELECT DISTINCT c_name AS candidate, regexp_replace(regexp_replace(lower(c_name), '[ ()]|gl\\.', '', 'g'), '[.\\-_/#]', '', 'g') AS n FROM (SELECT DISTINCT replace(replace(c_name, 'Customer', 'Supplier'), '#', '') AS c_name FROM customer)),
p AS (SELECT name, candidate, {GRAMS.format(n='l.n')} AS a, {GRAMS.format(n='r.n')} AS b FROM l, r),
s AS (SELECT name, candidate, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS similarity FROM p WHERE len(list_intersect(a, b)) > 0)
SELECT name, arg_min(candidate, (-similarity, candidate)) AS match, round(max(similarity), 6) AS similarity FROM s """


def _fuzzy(t, cutoff):
    names = t.supplier.select(F.replace("s_name", F.lit("#000"), F.lit("")).alias("name"))
    candidates = t.customer.select(F.replace(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.lit("#"), F.lit("")).alias("candidate"))
    found = matching.fuzzy_name_match(names, candidates, cutoff)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("fuzzy_name_match", FUZZY + "GROUP BY name")
def _(t):
    return _fuzzy(t, 0.0)


@query("fuzzy_name_match_cutoff", FUZZY + "WHERE similarity >= 0.8 GROUP BY name")
def _(t):
    return _fuzzy(t, 0.8)


MAPPING = f"""
WITH place AS (SELECT name, arg_min(node, (d, node)) AS by_place, min(d) AS distance_m FROM (
 SELECT s.name || '/' || s.ds100 AS name, p.ds100 AS node, {distance_sql('s.lat', 's.lon', 'p.lat', 'p.lon')} AS d
 FROM stations s, points p WHERE s.lat IS NOT NULL AND p.lat IS NOT NULL) GROUP BY name),
grams AS (SELECT n, side, {GRAMS.format(n='m')} AS g FROM (
   SELECT DISTINCT n, side, regexp_replace(n, '[.\\-_/]', '', 'g') AS m FROM (
     SELECT lower(name || '/' || ds100) AS k, name || '/' || ds100 AS n, 's' AS side FROM stations WHERE lat IS NOT NULL
     UNION ALL SELECT lower(ds100), ds100, 'p' FROM points WHERE lat IS NOT NULL))),
sims AS (SELECT a.n AS name, b.n AS candidate, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS similarity
  FROM (SELECT n, {GRAMS.format(n="lower(replace(n, '/', ''))")} AS g FROM grams WHERE side = 's') a,
       (SELECT n, {GRAMS.format(n='lower(n)')} AS g FROM grams WHERE side = 'p') b WHERE len(list_intersect(a.g, b.g)) > 0),
text AS (SELECT name, arg_min(candidate, (-similarity, candidate)) AS by_text, max(similarity) AS similarity FROM sims GROUP BY name),
m AS (SELECT place.name, by_text, coalesce(similarity, 0) AS similarity, by_place, distance_m FROM place LEFT JOIN text USING (name))
"""


def _matches(t):
    places = filters.with_coordinates(t.stations).select(F.concat("name", F.lit("/"), "ds100").alias("name"), "lat", "lon")
    nodes = filters.with_coordinates(t.points)
    near = spatial.nearest_point(places, nodes, "ds100").select("name", F.col("nearest").alias("by_place"), "distance_m")
    text = matching.fuzzy_name_match(places, nodes.select(F.col("ds100").alias("candidate"))).withColumnRenamed("match", "by_text")
    return near.join(text, "name", "left").fillna(0.0, subset=["similarity"])


@query("best_mapping", MAPPING + """
SELECT name, CASE WHEN similarity >= 1 THEN by_text WHEN by_text = by_place THEN by_text WHEN distance_m < 5000 THEN by_place END AS match FROM m""", views="stations points")
def _(t):
    best = matching.best_mapping(F.col("by_text"), F.col("similarity"), F.col("by_place"), F.col("distance_m"))
    return _matches(t).select("name", best.alias("match"))


@query("match_review", MAPPING + """
SELECT name, by_place, round(distance_m, 3) AS distance_m FROM m WHERE distance_m > 1000 AND distance_m < 10000 AND similarity < 1""", views="stations points")
def _(t):
    return filters.match_review(_matches(t)).select("name", "by_place", F.round("distance_m", 3).alias("distance_m"))


@query("spatial_candidates", """
WITH e AS (SELECT a.name || '>' || b.ds100 AS edge_id, least(a.lat, b.lat) AS south, greatest(a.lat, b.lat) AS north, least(a.lon, b.lon) AS west, greatest(a.lon, b.lon) AS east
  FROM points b JOIN (SELECT DISTINCT name, lat, lon, eva FROM stations WHERE valid_to IS NULL) a ON a.eva - 8000000 = b.point_key % 100 WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL AND abs(a.lat - b.lat) < 0.5 AND abs(a.lon - b.lon) < 0.5),
p AS (SELECT name || '/' || ds100 AS place, lat, lon, 100 / (pi() * 6371008.8 / 180) AS dlat, 100 / (pi() * 6371008.8 / 180) / cos(radians(lat)) AS dlon FROM stations WHERE lat IS NOT NULL)
SELECT edge_id, place FROM e, p WHERE south <= lat + dlat AND lat - dlat <= north AND west <= lon + dlon AND lon - dlon <= east""", views="stations points")
def _(t):
    a = t.stations.filter("valid_to is null").select("name", F.col("lat").alias("alat"), F.col("lon").alias("alon"), (F.col("eva") - 8000000).alias("k"))
    b = t.points.select("ds100", "lat", "lon", (F.col("point_key") % 100).alias("k"))
    near = a.join(b, "k").filter((F.abs(F.col("alat") - F.col("lat")) < 0.5) & (F.abs(F.col("alon") - F.col("lon")) < 0.5))
    edges = near.select(F.concat("name", F.lit(">"), "ds100").alias("edge_id"), F.least("alat", "lat").alias("south"),
                        F.greatest("alat", "lat").alias("north"), F.least("alon", "lon").alias("west"), F.greatest("alon", "lon").alias("east"))
    places = filters.with_coordinates(t.stations).select(F.concat("name", F.lit("/"), "ds100").alias("place"), "lat", "lon")
    return spatial.spatial_candidates(edges, places)


@query("radius_mean", "WITH " + NEWEST + """,
x AS (SELECT hash_id, ar_delay, lat, lon, epoch(ar_ct) AS moment FROM delayed JOIN newest ON name = station WHERE lat IS NOT NULL AND ar_ct IS NOT NULL),
b AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1, min(moment) AS t0, max(moment) AS t1 FROM x),
y AS (SELECT hash_id, ar_delay, (lat - a0) / (a1 - a0) AS p, (lon - o0) / (o1 - o0) AS q, (moment - t0) / (t1 - t0) AS r FROM x, b)
SELECT w.hash_id, round(avg(k.ar_delay), 6) AS radius_mean FROM (SELECT * FROM y WHERE hash_id % 5 = 0) w LEFT JOIN (SELECT * FROM y WHERE hash_id % 5 <> 0) k
 ON (w.p - k.p) * (w.p - k.p) + (w.q - k.q) * (w.q - k.q) + (w.r - k.r) * (w.r - k.r) <= 0.02 * 0.02 GROUP BY w.hash_id""", views="delayed stations")
def _(t):
    rows = lookup.add_coordinates(t.delayed.select("hash_id", "station", "ar_delay", "ar_ct"), t.stations)
    rows = rows.filter("lat is not null and ar_ct is not null").withColumn("at", timecols.epoch_seconds(F.col("ar_ct")))
    scaled = encoding.min_max_scale(rows, ["lat", "lon", "at"])
    axes = ["lat_scaled", "lon_scaled", "at_scaled"]
    means = spatial.radius_mean(scaled.filter("hash_id % 5 = 0"), scaled.filter("hash_id % 5 <> 0"), axes, 0.02, "ar_delay", "hash_id")
    return means.withColumn("radius_mean", F.round("radius_mean", 6))


@query("anti_refresh", "SELECT hash_id, station FROM stops WHERE hash_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')", views="stops")
def _(t):
    new = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("hash_id"))
    return t.stops.select("hash_id", "station").join(new, "hash_id", "left_anti")


@query("timetable_lookup", """
WITH tt AS (SELECT n AS train, station, min(stop_id) AS station_number, max(CASE WHEN n NOT IN ('7', '8') THEN distance_to_start END) AS length, max(CASE WHEN f = 'F' THEN k END) AS stay FROM (
  SELECT *, CAST(floor((epoch(dp_pt) - epoch(ar_pt)) / 60) AS INT) AS k FROM stops) WHERE hash_id % 2 = 0 GROUP BY n, station)
SELECT s.hash_id, tt.station_number, tt.length, CASE WHEN tt.train IS NOT NULL THEN coalesce(tt.stay, 0) END AS stay_time, tt.train IS NOT NULL AS found
FROM stops s LEFT JOIN tt ON tt.train = s.n AND tt.station = s.station""", views="stops")
def _(t):
    stay = timecols.minutes_between(F.col("dp_pt"), F.col("ar_pt"))
    timetable = t.stops.filter("hash_id % 2 = 0").groupBy(F.col("n").alias("train"), "station").agg(
        F.min("stop_id").alias("station_number"), F.max(F.when(~F.col("n").isin("7", "8"), F.col("distance_to_start"))).alias("length"),
        F.max(F.when(F.col("f") == "F", stay)).alias("stay"))
    timetable = timetable.withColumns({"stay_time": F.coalesce("stay", F.lit(0)), "found": F.lit(True)})
    requests = t.stops.select("hash_id", F.col("n").alias("train"), "station")
    joined = requests.join(timetable, ["train", "station"], "left")
    return joined.select("hash_id", "station_number", "length", "stay_time", F.coalesce("found", F.lit(False)).alias("found"))


@query("encoder_join", """
WITH codes AS (SELECT station, dense_rank() OVER (ORDER BY station) - 1 AS code FROM (SELECT DISTINCT station FROM stops WHERE hash_id % 10 < 3))
SELECT s.hash_id, CAST(coalesce(code, -1) AS INT) AS station_code FROM stops s LEFT JOIN codes USING (station)""", views="stops")
def _(t):
    known = t.stops.filter("hash_id % 10 < 3")
    encoders = encoding.build_encoders(known, ["station"])
    return encoding.encode(t.stops.select("hash_id", "station"), encoders, ["station"]).select("hash_id", "station_code")


@query("coords_fallback", "WITH " + NEWEST + """,
own AS (SELECT eva, meta_eva, lat, lon FROM newest),
one AS (SELECT eva, lat + 0.01 AS lat, lon + 0.01 AS lon FROM newest WHERE eva % 4 <> 0 AND lat IS NOT NULL AND eva % 7 <> 2),
two AS (SELECT eva, lat + 0.02 AS lat, lon + 0.02 AS lon FROM newest WHERE eva % 5 = 0 AND lat IS NOT NULL),
mid AS (SELECT meta_eva, avg(one.lat) AS lat, avg(one.lon) AS lon FROM own JOIN one USING (eva) GROUP BY meta_eva)
SELECT own.eva, round(coalesce(one.lat, two.lat, own.lat, mid.lat), 6) AS lat, round(coalesce(one.lon, two.lon, own.lon, mid.lon), 6) AS lon,
 CASE WHEN one.lat IS NOT NULL THEN 'first' WHEN two.lat IS NOT NULL THEN 'second' WHEN own.lat IS NOT NULL THEN 'own' WHEN mid.lat IS NOT NULL THEN 'group' ELSE 'missing' END AS location_source
FROM own LEFT JOIN one USING (eva) LEFT JOIN two USING (eva) LEFT JOIN mid USING (meta_eva)""", views="stations")
def _(t):
    newest = lookup.latest_version(t.stations, "name").select("eva", "meta_eva", "lat", "lon")
    shift = lambda df, d: df.select("eva", (F.col("lat") + d).alias("lat"), (F.col("lon") + d).alias("lon"))
    one = shift(newest.filter("eva % 4 <> 0 and lat is not null and eva % 7 <> 2"), 0.01)
    two = shift(newest.filter("eva % 5 = 0 and lat is not null"), 0.02)
    found = lookup.coordinates_with_fallback(newest, one, two, "meta_eva")
    return found.select("eva", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "location_source")


@query("attach_geo_dim", """
SELECT c_custkey, name, lat, lon FROM (SELECT c_custkey, 'P' || CAST(c_custkey * 2 AS VARCHAR) AS code FROM customer) LEFT JOIN points ON ds100 = code""", views="points")
def _(t):
    rows = t.customer.select("c_custkey", F.concat(F.lit("P"), (F.col("c_custkey") * 2).cast("string")).alias("ds100"))
    return rows.join(t.points.select("ds100", "name", "lat", "lon"), "ds100", "left").drop("ds100")


@query("unmatched_keys", "SELECT DISTINCT station FROM stops WHERE station NOT IN (SELECT name FROM stations)", views="stops stations")
def _(t):
    return dedup.unmatched_keys(t.stops, t.stations.select(F.col("name").alias("station")), ["station"])


@query("explode_edges_events", """
SELECT obstacle_id, e AS edge, v AS event, source || '-' || CAST(e AS VARCHAR) AS from_station, target || '-' || CAST(e AS VARCHAR) AS to_station,
  from_time + INTERVAL '1' DAY * CAST(v AS INT) AS from_time, to_time + INTERVAL '1' DAY * CAST(v AS INT) AS to_time, priority
FROM (SELECT *, unnest(range(0, 1 + obstacle_id % 3)) AS e FROM works WHERE obstacle_id % 7 <> 0), (SELECT unnest([0, 1]) AS v)""", views="works")
def _(t):
    from stopwise.operators.nested import explode_edges_events
    day = lambda c, n: F.date_format(F.timestamp_seconds(timecols.epoch_seconds(F.col(c)) + n * 86400).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    edge = lambda i: F.struct(
        F.struct(i.cast("string").alias("id"), F.concat("source", F.lit("-"), i.cast("string")).alias("name")).alias("fromLoc"),
        F.struct(i.cast("string").alias("id"), F.concat("target", F.lit("-"), i.cast("string")).alias("name")).alias("toLoc"),
        F.lit(1).alias("dir"), F.struct(F.lit("t").alias("title"), F.lit("x").alias("type")).alias("icon"))
    event = lambda n: F.struct(day("from_time", n).alias("start"), day("to_time", n).alias("end"))
    edges = F.when(F.col("obstacle_id") % 7 != 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("obstacle_id") % 3), edge))
    raw = t.works.select(F.to_json(F.struct(
        F.col("obstacle_id").cast("string").alias("id"), F.lit("HIM").alias("type"), "summary", F.lit("").alias("text"), "category",
        F.lit("x").alias("modified"), "priority", edges.alias("edges"), F.array(event(0), event(1)).alias("events"))).alias("data"))
    rows = explode_edges_events(raw)
    number = lambda c: c.cast("bigint")
    return rows.select(number(F.col("id")).alias("obstacle_id"), number(F.col("from_id")).alias("edge"),
                       number(F.col("event")).alias("event"), "from_station", "to_station", "from_time", "to_time", "priority")
