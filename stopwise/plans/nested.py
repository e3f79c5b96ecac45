"""Arrays, JSON and connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.functions import scoring, textcols, timecols
from stopwise.functions.codes import SUPERSEDES
from stopwise.operators import nested
from stopwise.operators.clean import ENDS
from stopwise.plans.registry import query
from stopwise.session import stored


def _paths(t):
    ar = F.when(F.col("ar_pt").isNotNull(), F.array(F.lit("S1"), F.concat(F.lit("S"), "n"), F.lit("S9")))
    dp = F.when(F.col("dp_pt").isNotNull(), F.array(F.lit("S2"), F.concat(F.lit("S"), F.col("stop_id").cast("string"))))
    return t.stops.select("hash_id", "station", "stop_id", "n", ar.alias("ar_path"), dp.alias("dp_path"))


@query("path_neighbours", """
SELECT hash_id, CASE WHEN ar_pt IS NOT NULL THEN 'S9' END AS last_station, CASE WHEN dp_pt IS NOT NULL THEN 'S2' END AS next_station,
  CASE WHEN ar_pt IS NOT NULL THEN 'S1|S' || n || '|S9|' || station END AS path_here,
  CASE WHEN dp_pt IS NOT NULL THEN station || '|S2|S' || CAST(stop_id AS VARCHAR) END AS path_onwards FROM stops""", views="stops")
def _(t):
    found = nested.path_neighbours(F.col("ar_path"), F.col("dp_path"), F.col("station"))
    return _paths(t).select("hash_id", *[(F.array_join(c, "|") if n.startswith("path") else c).alias(n) for n, c in found.items()])


TRIP = "['S1', 'S' || n, 'S9', station]"


def _trip(t):
    return t.stops.select("hash_id", "station", "stop_id", F.array(F.lit("S1"), F.concat(F.lit("S"), "n"), F.lit("S9"), "station").alias("trip"))


POSITION = f"""SELECT *, coalesce(list_position(trip, 'S' || CAST(stop_id AS VARCHAR)), list_position(trip, 'S' || CAST(hash_id % 5 AS VARCHAR)), 0) - 1 AS position
FROM (SELECT hash_id, station, stop_id, {TRIP} AS trip FROM stops)"""


def _position(t):
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    return _trip(t).withColumn("position", nested.stop_position(F.col("trip"), name(F.col("stop_id")), name(F.col("hash_id") % 5)))


@query("stop_position", f"SELECT hash_id, CAST(position AS INT) AS position FROM ({POSITION})", views="stops")
def _(t):
    return _position(t).select("hash_id", "position")


@query("slice_to_from", f"""
SELECT hash_id, array_to_string(list_slice(trip, 1, position + 1), '|') AS until_stop,
  CASE WHEN position < 0 THEN trip[-1] ELSE array_to_string(list_slice(trip, position + 1, 4), '|') END AS from_stop FROM ({POSITION})""", views="stops")
def _(t):
    return _position(t).select("hash_id", F.array_join(nested.trip_until(F.col("trip"), F.col("position")), "|").alias("until_stop"),
                               F.array_join(nested.trip_from(F.col("trip"), F.col("position")), "|").alias("from_stop"))


@query("consecutive_pairs", f"""
SELECT hash_id, i - 1 AS position, trip[i] AS a, trip[i + 1] AS b FROM (SELECT hash_id, trip, unnest(range(1, len(trip))) AS i FROM (SELECT hash_id, {TRIP} AS trip FROM stops))""", views="stops")
def _(t):
    rows = _trip(t).select("hash_id", F.posexplode(nested.consecutive_pairs(F.col("trip"))).alias("position", "p"))
    return rows.select("hash_id", "position", "p.a", "p.b")


@query("unique_categories", """
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))), ',') AS tags FROM pages""")
def _(t):
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))))
    return t.pages.select("page_id", F.array_join(tags, ",").alias("tags"))


@query("parse_meta", """
SELECT c_custkey, CAST(2 + c_custkey % 2 AS BIGINT) AS members, c_custkey + c_nationkey + CASE WHEN c_custkey % 2 = 1 THEN 7 ELSE 0 END AS total FROM customer""")
def _(t):
    text = F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 1, "7"))
    ids = textcols.int_items(text)
    return t.customer.select("c_custkey", F.size(ids).cast("bigint").alias("members"),
                             F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("array_text_parse", """
SELECT p_partkey, p_name || ';' || p_brand || ', ' || p_type || ';' || CAST(p_size AS VARCHAR) AS items FROM part""")
def _(t):
    text = F.format_string('{%s,"%s, %s",%d}', "p_name", "p_brand", "p_type", "p_size")
    return t.part.select("p_partkey", F.array_join(textcols.array_text_items(text), ";").alias("items"))


@query("explode_plan_json", """
SELECT 'S' || CAST(user_id AS VARCHAR) AS station, tag || CAST(event_id AS VARCHAR) AS id, 'S' || CAST(user_id AS VARCHAR) AS stop_station, event_type AS c
FROM events, (VALUES ('a-'), ('b-')) AS v(tag)""")
def _(t):
    from stopwise.operators.clean import PLAN_SCHEMA
    part = lambda tag: [F.concat(F.lit(tag), F.col("event_id").cast("string")), F.struct(
        F.concat(F.lit(tag), F.col("event_id").cast("string")).alias("id"), F.array(F.struct(F.col("event_type").alias("c"))).alias("tl"))]
    plans = t.events.select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station"),
                            F.to_json(F.create_map(*part("a-"), *part("b-"))).alias("plan"))
    rows = nested.explode_plan_json(plans, "plan", f"struct<{PLAN_SCHEMA}>")
    return rows.select("station", "id", F.col("stop.station").alias("stop_station"), F.get("stop.tl", F.lit(0))["c"].alias("c"))


@query("flatten_station_json", "SELECT name, eva, ds100, lat, lon FROM stations WHERE lat IS NOT NULL", views="stations")
def _(t):
    objects = t.stations.filter("lat is not null").select(F.to_json(F.array(F.struct(
        "name", "eva", "ds100", F.array("lat", "lon").alias("latlong")))).alias("body"))
    return nested.flatten_station_json(objects, "body")


@query("id_or_alias_match", "SELECT c_custkey FROM customer WHERE c_custkey = 20 OR c_nationkey = 20 OR c_custkey // 10 = 20")
def _(t):
    records = t.customer.select("c_custkey", F.array(F.col("c_nationkey").cast("bigint"), F.expr("c_custkey div 10")).alias("aliases"))
    return nested.id_or_alias_match(records, "c_custkey", "aliases", F.lit(20).cast("bigint")).select("c_custkey")


@query("suppress_superseded", f"""
WITH m AS (SELECT o_custkey AS stop, CAST(80 + o_orderkey % 20 AS INT) AS code, o_orderkey FROM orders),
t(code, cancelled) AS (VALUES {', '.join(f'({k}, {v})' for k, vs in SUPERSEDES.items() for v in vs)})
SELECT stop, code, o_orderkey FROM m WHERE NOT EXISTS (SELECT 1 FROM m o JOIN t ON o.code = t.code WHERE o.stop = m.stop AND t.cancelled = m.code)""")
def _(t):
    messages = t.orders.select(F.col("o_custkey").alias("stop"), (80 + F.col("o_orderkey") % 20).cast("int").alias("code"), "o_orderkey")
    return nested.suppress_superseded(messages, "stop", "code").select("stop", "code", "o_orderkey")


# --- connections made of orders --------------------------------------------------------


ROUTES_PER_FILE = 20_000


def raw_connections(t):
    """The routes as JSON, stored once. Orders are spread before they become texts, so no text is shuffled."""
    return t.stored("routes", lambda: make_connections(t), lambda routes, path: routes.write.option("compression", "zstd").parquet(path))


def make_connections(t):
    """One route per order: 1 to 4 trains, some with a walk in front or after the first train."""
    base = timecols.epoch_seconds(F.col("o_orderdate")) + (F.col("o_custkey") % 1440) * 60
    k = F.col("o_orderkey")
    text = lambda minutes: F.date_format(F.timestamp_seconds(base + minutes * 60).cast(timecols.NTZ), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    event = lambda planned, late, platform: F.struct(text(planned).alias("scheduledTime"), text(planned + late).alias("time"),
                                                     platform.alias("scheduledPlatform"), F.lit(None).cast("string").alias("platform"))
    nowhere = F.lit(None).cast("string")
    place = lambda number: F.struct((8000000 + number).cast("string").alias("id"), F.concat(F.lit("Halt "), number.cast("string")).alias("title"))
    stop = lambda v: F.struct(F.struct(F.struct(v.alias("lat"), (v + 1).alias("lng")).alias("coordinates")).alias("station"))

    def train(i):
        return F.struct(
            F.lit("TRAIN").alias("type"), F.concat(k.cast("string"), F.lit("#"), i.cast("string")).alias("jid"),
            place((k + i) % 120).alias("segmentStart"), place((k + i + 1) % 120).alias("segmentDestination"),
            event(i * 50, k % 9, F.when(k % 2 == 0, i.cast("string"))).alias("departure"),
            event(i * 50 + 35, (k + i * 7) % 23, nowhere).alias("arrival"),
            F.struct(F.concat(F.lit("RE "), i.cast("string")).alias("name"), F.lit("RE").alias("type"),
                     (k % 100).cast("string").alias("number"), F.lit("80____").alias("admin")).alias("train"),
            F.array(stop((k % 10).cast("double")), stop((i + 20).cast("double"))).alias("stops"),
            F.when(k % 4 == 0, "Endstation").alias("finalDestination"))

    def walk(at, minutes):
        none = F.lit(None)
        return F.struct(
            F.lit("WALK").alias("type"), nowhere.alias("jid"), place(k % 120).alias("segmentStart"), place(k % 120).alias("segmentDestination"),
            event(at, F.lit(0), nowhere).alias("departure"), event(at + minutes, F.lit(0), nowhere).alias("arrival"),
            none.cast("struct<name:string,type:string,number:string,admin:string>").alias("train"),
            none.cast("array<struct<station:struct<coordinates:struct<lat:double,lng:double>>>>").alias("stops"), nowhere.alias("finalDestination"))

    trains = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), train)
    none = F.slice(trains, F.lit(1), F.lit(0))
    middle = F.when((k % 6 == 0) & (k % 4 > 0), F.array(walk(F.lit(36), k % 8))).otherwise(none)
    lead = F.when(k % 5 == 0, F.array(walk(F.lit(-10), F.lit(5)))).otherwise(none)
    segments = F.concat(lead, F.slice(trains, F.lit(1), F.lit(1)), middle, F.slice(trains, F.lit(2), F.lit(9)))
    route = F.struct((k % 10 != 3).alias("isRideable"), F.array(F.lit("RE"), F.lit("IC"), F.lit("RE")).alias("segmentTypes"),
                     F.when(k % 3 == 0, F.array(F.struct(F.array(F.struct((k % 500).cast("int").alias("price"))).alias("fares")))).alias("tarifSet"),
                     segments.alias("segments"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.repartition(orders.count() // ROUTES_PER_FILE + 1).select("o_orderkey", F.to_json(route).alias("route"))


CONNECTIONS = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS last, o_orderdate + INTERVAL '1' MINUTE * CAST(o_custkey % 1440 AS INT) AS base FROM orders WHERE o_orderkey % 10 <> 3),
local AS (SELECT *, CAST(timezone('Europe/Berlin', timezone('UTC', base)) AS TIMESTAMP) AS dp_pt,
  CAST(timezone('Europe/Berlin', timezone('UTC', base + INTERVAL '1' MINUTE * CAST(k % 9 AS INT))) AS TIMESTAMP) AS dp_ct,
  CAST(timezone('Europe/Berlin', timezone('UTC', base + INTERVAL '1' MINUTE * CAST(last * 50 + 35 AS INT))) AS TIMESTAMP) AS ar_pt,
  CAST(timezone('Europe/Berlin', timezone('UTC', base + INTERVAL '1' MINUTE * CAST(last * 50 + 35 + (k + last * 7) % 23 AS INT))) AS TIMESTAMP) AS ar_ct FROM o),
seg AS (SELECT k, last, i, CASE WHEN i < last THEN CAST((epoch(timezone('Europe/Berlin', timezone('UTC', base + INTERVAL '1' MINUTE * CAST((i + 1) * 50 + k % 9 AS INT))))
     - epoch(timezone('Europe/Berlin', timezone('UTC', base + INTERVAL '1' MINUTE * CAST(i * 50 + 35 + (k + i * 7) % 23 AS INT))))) / 60 AS INT) END AS transfer_time,
  CASE WHEN i = 0 AND k % 6 = 0 AND last > 0 THEN CAST(k % 8 AS INT) ELSE 0 END AS walk FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM o))
"""


@query("parse_connections", CONNECTIONS + """
SELECT k AS o_orderkey, dp_pt, dp_ct, ar_pt, ar_ct, CAST(last AS INT) AS transfers, 'IC,RE' AS train_categories,
  CASE WHEN ar_ct < dp_ct THEN '-1 day, ' ELSE '' END || CAST(CAST(floor((epoch(ar_ct) - epoch(dp_ct) + CASE WHEN ar_ct < dp_ct THEN 86400 ELSE 0 END) / 3600) AS INT) AS VARCHAR) || ':' || lpad(CAST(CAST((epoch(ar_ct) - epoch(dp_ct) + 86400) % 3600 / 60 AS INT) AS VARCHAR), 2, '0') AS duration,
  CASE WHEN k % 3 = 0 THEN CAST(k % 500 AS INT) ELSE -1 END AS price, w.walks, CAST(last + 1 AS INT) AS trains
FROM local JOIN (SELECT k, string_agg(CAST(walk AS VARCHAR), ',' ORDER BY i) AS walks FROM seg GROUP BY k) w USING (k)""")
def _(t):
    c = nested.parse_connections(raw_connections(t))
    s = lambda name: F.col(f"summary.{name}").alias(name)
    walks = F.array_join(F.transform("segments", lambda x: x["walk"].cast("string")), ",")
    return c.select("o_orderkey", s("dp_pt"), s("dp_ct"), s("ar_pt"), s("ar_ct"), s("transfers"),
                    F.array_join("summary.train_categories", ",").alias("train_categories"), s("duration"), s("price"),
                    walks.alias("walks"), F.size("segments").alias("trains"))


@query("transfer_time", CONNECTIONS + "SELECT k AS o_orderkey, CAST(i AS INT) AS position, transfer_time FROM seg")
def _(t):
    c = nested.parse_connections(raw_connections(t))
    return nested.explode_segments(c, "o_orderkey").select("o_orderkey", "position", "s.transfer_time")


@query("rideable_only", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3")
def _(t):
    return nested.parse_connections(raw_connections(t)).select("o_orderkey")


@query("sort_connections", CONNECTIONS + "SELECT k AS o_orderkey, dp_ct, price FROM (SELECT *, CASE WHEN k % 3 = 0 THEN CAST(k % 500 AS INT) ELSE -1 END AS price FROM local) ORDER BY price DESC, k")
def _(t):
    c = nested.parse_connections(raw_connections(t)).select("o_orderkey", F.struct("summary.dp_ct", "summary.price").alias("summary"))
    c = nested.sort_connections(stored(c, "summaries"), "price", "o_orderkey", ascending=False)  # a sort reads its input twice
    return c.select("o_orderkey", "summary.dp_ct", "summary.price")


@query("format_datetimes", CONNECTIONS + """
SELECT k AS o_orderkey, strftime(dp_ct, '%Y-%m-%dT%H:%M:%S') AS summary_dp, strftime(ar_ct, '%Y-%m-%dT%H:%M:%S') AS summary_ar,
  strftime(dp_pt, '%Y-%m-%dT%H:%M:%S') AS first_dp FROM local""")
def _(t):
    c = nested.times_as_text(nested.parse_connections(raw_connections(t)))
    return c.select("o_orderkey", F.col("summary.dp_ct").alias("summary_dp"), F.col("summary.ar_ct").alias("summary_ar"),
                    F.get("segments", F.lit(0))["dp_pt"].alias("first_dp"))


@query("connection_segments", CONNECTIONS + """
SELECT seg.k AS o_orderkey, CAST(i AS INT) AS position, coalesce(d.name, '') AS dp_station, coalesce(a.name, '') AS ar_station
FROM seg JOIN o USING (k)
LEFT JOIN (SELECT name, eva FROM stations WHERE valid_from IS NULL) d ON d.eva = 8000000 + (seg.k + i) % 120
LEFT JOIN (SELECT name, eva FROM stations WHERE valid_from IS NULL) a ON a.eva = 8000000 + (seg.k + i + 1) % 120""", views="stations")
def _(t):
    rows = nested.connection_segments(nested.parse_connections(raw_connections(t)), t.stations, "o_orderkey")
    return rows.select("o_orderkey", "position", "dp_station", "ar_station")


# --- scores ----------------------------------------------------------------------------

MODELS = 15
AR = "least((m + 1 + k % 5) / 18.0, 1.0)"
DP = "greatest(1.0 - m * (1 + k % 3) / 50.0, 0.05)"


def chances(t):
    """Stand-in model output: chances per minute, rising for arrivals and falling for departures."""
    k = F.col("hash_id")
    minutes = F.sequence(F.lit(0), F.lit(MODELS - 1))
    ar = F.transform(minutes, lambda m: F.least((m + 1 + k % 5) / 18.0, F.lit(1.0)))
    dp = F.transform(minutes, lambda m: F.greatest(1.0 - m * (1 + k % 3) / 50.0, F.lit(0.05)))
    return t.stops.select("hash_id", ar.alias("ar"), dp.alias("dp"), (k % 20 - 2).cast("int").alias("transfer"))


CHANCES = f"""
WITH p AS (SELECT k, k % 20 - 2 AS t, list_transform(range(0, {MODELS}), lambda m: {AR}) AS ar, list_transform(range(0, {MODELS}), lambda m: {DP}) AS dp FROM (SELECT hash_id AS k FROM stops)),
z AS (SELECT *, greatest(t - 2, 0) AS a0, greatest(2 - t, 0) AS d0 FROM p),
s AS (SELECT k, t, CASE WHEN t < 0 OR t >= {MODELS} THEN 1.0 ELSE least(1.0, ar[a0 + 1] * dp[d0 + 1] + coalesce(list_sum(list_transform(range(0, greatest({MODELS} - 1 - greatest(a0, d0), 0)),
   lambda j: (ar[a0 + 2 + j] - ar[a0 + 1 + j]) * dp[d0 + 2 + j])), 0)) END AS score FROM z)
"""


@query("connection_score", CHANCES + "SELECT k AS hash_id, CAST(t AS INT) AS transfer, round(CAST(score AS DOUBLE), 6) AS score FROM s", views="stops")
def _(t):
    score = scoring.connection_score(F.col("ar"), F.col("dp"), F.col("transfer"))
    return chances(t).select("hash_id", "transfer", F.round(score, 6).alias("score"))


@query("journey_score", CHANCES + """
SELECT k AS hash_id, CAST(round_even(CAST(score * coalesce(other, 1) AS DOUBLE) * 100, 0) AS INT) AS score, CAST(round_even(CAST(score AS DOUBLE) * 100, 0) AS INT) AS first_score FROM (
  SELECT k, score, CASE WHEN k % 2 = 0 THEN 0.5 + k % 7 / 16.0 END AS other FROM s)""", views="stops")
def _(t):
    first = scoring.connection_score(F.col("ar"), F.col("dp"), F.col("transfer"))
    rows = chances(t).withColumn("first", first)
    other = F.when(F.col("hash_id") % 2 == 0, F.array(F.col("first"), 0.5 + F.col("hash_id") % 7 / 16.0)).otherwise(F.array("first"))
    return rows.select("hash_id", scoring.journey_score(other).alias("score"), scoring.percent(F.col("first")).alias("first_score"))


@query("scored_connections", """
WITH p AS (SELECT o_orderkey AS k, o_orderkey % 4 AS last FROM orders WHERE o_orderkey % 10 <> 3),
seg AS (SELECT k, last, i, CAST((i + 1) * 50 + k % 9 - (i * 50 + 35 + (k + i * 7) % 23) AS INT) AS t FROM (SELECT *, unnest(range(0, last)) AS i FROM p)),
z AS (SELECT k, i, t, greatest(t - 2, 0) AS a0, greatest(2 - t, 0) AS d0,
  list_transform(range(0, 15), lambda m: least((m + 1 + (k + i) % 5) / 18.0, 1.0)) AS ar, list_transform(range(0, 15), lambda m: greatest(1.0 - m * (1 + (k + i + 1) % 3) / 50.0, 0.05)) AS dp FROM seg),
s AS (SELECT k, CAST(CASE WHEN t < 0 OR t >= 15 THEN 1.0 ELSE least(1.0, ar[a0 + 1] * dp[d0 + 1] + coalesce(list_sum(list_transform(range(0, greatest(14 - greatest(a0, d0), 0)),
   lambda j: (ar[a0 + 2 + j] - ar[a0 + 1 + j]) * dp[d0 + 2 + j])), 0)) END AS DOUBLE) AS score FROM z)
SELECT p.k AS o_orderkey, CAST(round_even(coalesce(product(score), 1) * 100, 0) AS INT) AS score FROM p LEFT JOIN s USING (k) GROUP BY p.k""")
def _(t):
    c = nested.parse_connections(raw_connections(t))
    k = F.col("o_orderkey")
    minutes = F.sequence(F.lit(0), F.lit(MODELS - 1))
    index = F.sequence(F.lit(0), F.size("segments") - 1)
    ar = F.transform(index, lambda i: F.transform(minutes, lambda m: F.least((m + 1 + (k + i) % 5) / 18.0, F.lit(1.0))))
    dp = F.transform(index, lambda i: F.transform(minutes, lambda m: F.greatest(1.0 - m * (1 + (k + i) % 3) / 50.0, F.lit(0.05))))
    return nested.score_connections(c.withColumns({"ar": ar, "dp": dp}), "ar", "dp").select("o_orderkey", "score")


@query("banded_connection_score", """
WITH x AS (SELECT hash_id, hash_id % 25 AS t, CASE WHEN hash_id % 11 = 0 THEN 1 - 0.95 ELSE 0.3 + hash_id % 7 / 100.0 END AS a5, CASE WHEN hash_id % 11 = 0 THEN 1 - 0.97 ELSE 0.2 + hash_id % 5 / 100.0 END AS a10,
  CASE WHEN hash_id % 11 = 0 THEN 1 - 0.99 ELSE 0.1 + hash_id % 3 / 100.0 END AS a15, CASE WHEN hash_id % 13 = 0 THEN 1 - 0.95 ELSE 0.25 + hash_id % 6 / 100.0 END AS d5,
  CASE WHEN hash_id % 13 = 0 THEN 1 - 0.97 ELSE 0.15 END AS d10, CASE WHEN hash_id % 13 = 0 THEN 1 - 0.99 ELSE 0.05 END AS d15 FROM stops)
SELECT hash_id, round(CAST(CASE WHEN t > 17 THEN 1 WHEN t > 12 THEN 1 - a15 * (1 - d5) WHEN t > 7 THEN 1 - ((a10 - a15) * (1 - d5) + a15 * (1 - d10))
  ELSE 1 - ((a5 - a10) * (1 - d5) + (a10 - a15) * (1 - d10) + a15 * (1 - d15)) END AS DOUBLE), 6) AS score FROM x""", views="stops")
def _(t):
    k = F.col("hash_id")
    known = lambda modulus, value: F.when(k % modulus != 0, value)
    ar = {5: known(11, 0.3 + k % 7 / 100.0), 10: known(11, 0.2 + k % 5 / 100.0), 15: known(11, 0.1 + k % 3 / 100.0)}
    dp = {5: known(13, 0.25 + k % 6 / 100.0), 10: known(13, F.lit(0.15)), 15: known(13, F.lit(0.05))}
    return t.stops.select("hash_id", F.round(scoring.banded_score(k % 25, ar, dp), 6).alias("score"))
