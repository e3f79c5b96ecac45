"""Paths, routes, groups and simplification of networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.operators import filters, graph, lookup, ranges
from stopwise.plans.columns import distance_sql
from stopwise.plans.joins import NEWEST
from stopwise.plans.registry import query

ROUNDS = 12
NUMBERED = "e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY u, v, length) - 1 AS edge_id, u, v, length FROM edges)"
ARCS = NUMBERED + ", arcs AS MATERIALIZED (SELECT edge_id, u AS a, v AS b, length FROM e UNION ALL SELECT edge_id, v, u, length FROM e)"


def ways_sql(sources: str) -> str:
    """Best ways from each source after a fixed number of rounds, more than the test networks need."""
    parts = [ARCS, f"w0 AS MATERIALIZED (SELECT DISTINCT s AS source, s AS node, 0.0::DOUBLE AS d, 0 AS hops, []::BIGINT[] AS path FROM ({sources}) WHERE s IN (SELECT a FROM arcs))"]
    for i in range(ROUNDS):
        parts.append(f"""w{i + 1} AS MATERIALIZED (SELECT source, node, b.d, b.hops, b.path FROM (SELECT source, node, min({{'d': d, 'hops': hops, 'path': path}}) AS b FROM (
  SELECT * FROM w{i} UNION ALL SELECT source, arcs.b, d + length, hops + 1, list_append(path, edge_id) FROM w{i} JOIN arcs ON node = a) GROUP BY source, node))""")
    return ",\n".join(parts)


@query("build_edge_table", "WITH " + NUMBERED + " SELECT * FROM e", views="edges")
def _(t):
    return graph.build_edge_table(t.edges)


@query("number_nodes", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_id FROM (SELECT u AS node FROM edges UNION SELECT v FROM edges)", views="edges")
def _(t):
    return graph.number_nodes(t.edges)


def _numbered(t):
    return t.edge_table


PAIRS = "SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS source, 'S' || CAST(l_partkey % 130 AS VARCHAR) AS target FROM lineitem"


def _pairs(t):
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    return t.lineitem.select(name(F.col("l_suppkey")).alias("source"), name(F.col("l_partkey") % 130).alias("target")).distinct()


@query("shortest_paths", "WITH " + ways_sql("SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS s FROM lineitem") + f"""
SELECT p.source, p.target, d AS distance, array_to_string(path, ',') AS path FROM ({PAIRS}) p LEFT JOIN w{ROUNDS} w ON w.source = p.source AND w.node = p.target""", views="edges")
def _(t):
    return graph.shortest_paths(_pairs(t), _numbered(t)).select("source", "target", "distance", F.array_join("path", ",").alias("path"))


# routes: three waypoints per order
ROUTES = """routes AS (SELECT o_orderkey, 'S' || CAST(o_custkey % 120 AS VARCHAR) AS p1, 'S' || CAST(o_orderkey % 99 AS VARCHAR) AS p2, 'S' || CAST((o_custkey + o_orderkey) % 105 AS VARCHAR) AS p3 FROM orders),
hops AS (SELECT o_orderkey, least(p1, p2) AS u, greatest(p1, p2) AS v FROM routes UNION ALL SELECT o_orderkey, least(p2, p3), greatest(p2, p3) FROM routes)"""


def _routes(t):
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    points = F.array(name(F.col("o_custkey") % 120), name(F.col("o_orderkey") % 99), name((F.col("o_custkey") + F.col("o_orderkey")) % 105))
    return t.orders.select("o_orderkey", points.alias("route"), "o_orderdate")


CACHE = "cache AS (SELECT DISTINCT u, v FROM hops WHERE length(u) = 2 AND length(v) = 2)"


def _empty_cache(t):
    return t.spark.createDataFrame([], "u string, v string, distance double, path array<bigint>")


@query("path_cache", "WITH " + ROUTES + ", " + ways_sql("SELECT u AS s FROM hops") + f", {CACHE}" + f"""
SELECT h.u, h.v, CASE WHEN cache.u IS NOT NULL THEN -1.0 ELSE d END AS distance FROM (SELECT DISTINCT u, v FROM hops) h
LEFT JOIN cache USING (u, v) LEFT JOIN w{ROUNDS} w ON w.source = h.u AND w.node = h.v""", views="edges")
def _(t):
    pairs = graph.route_pairs(_routes(t), "route")
    cache = graph.unordered(pairs).filter("length(u) = 2 and length(v) = 2").select(
        "u", "v", F.lit(-1.0).alias("distance"), F.array().cast("array<bigint>").alias("path"))
    return graph.refresh_path_cache(cache, pairs, _numbered(t)).select("u", "v", "distance")


LINE = distance_sql("a.lat", "a.lon", "b.lat", "b.lon")
DISTANCES = "dist AS MATERIALIZED (SELECT h.u, h.v, coalesce(w.d, " + LINE + f", 0) AS distance FROM (SELECT DISTINCT u, v FROM hops) h LEFT JOIN w{ROUNDS} w ON w.source = h.u AND w.node = h.v LEFT JOIN newest a ON a.name = h.u LEFT JOIN newest b ON b.name = h.v)"


def _distances(t, pairs):
    paths = graph.refresh_path_cache(_empty_cache(t), pairs, _numbered(t))
    return graph.pair_distances(pairs, paths, lookup.latest_version(t.stations, "name"))


@query("pair_distance", "WITH " + NEWEST + ", " + ROUTES + ", " + ways_sql("SELECT u AS s FROM hops") + ", " + DISTANCES + " SELECT u, v, round(distance, 3) AS distance FROM dist", views="edges stations")
def _(t):
    return _distances(t, graph.route_pairs(_routes(t), "route")).select("u", "v", F.round("distance", 3).alias("distance"))


@query("route_length", "WITH " + NEWEST + ", " + ROUTES + ", " + ways_sql("SELECT u AS s FROM hops") + ", " + DISTANCES + """
SELECT o_orderkey, round(sum(distance), 3) AS route_length FROM hops JOIN dist USING (u, v) GROUP BY o_orderkey""", views="edges stations")
def _(t):
    routes = _routes(t)
    lengths = graph.route_lengths(routes, "o_orderkey", ["route"], _distances(t, graph.route_pairs(routes, "route")))
    return lengths.select("o_orderkey", F.round("route_length", 3).alias("route_length"))


# works on single edges, and paths of two edges per order
EDGE_WORKS = """ew AS (SELECT w.obstacle_id % (SELECT count(*) FROM e) AS edge_id, priority, from_time, to_time FROM works w),
obs AS (SELECT ew.edge_id, priority, e.length, from_time, to_time FROM ew JOIN e USING (edge_id))"""


def _edge_works(t, edges):
    n = edges.agg(F.count(F.lit(1))).scalar()
    works = t.works.select((F.col("obstacle_id") % n).alias("edge_id"), "priority", "from_time", "to_time")
    return works.join(edges.select("edge_id", "length"), "edge_id")


@query("obstacles_on_path", "WITH " + NUMBERED + ", " + EDGE_WORKS + """,
uses AS (SELECT hash_id, ar_pt, unnest([hash_id % m, hash_id * 7 % m, hash_id % m]) AS edge_id FROM stops, (SELECT count(*) AS m FROM e) WHERE ar_pt IS NOT NULL),
hits AS (SELECT hash_id, priority, length FROM uses JOIN obs ON obs.edge_id = uses.edge_id AND from_time <= ar_pt AND ar_pt <= to_time)
SELECT s.hash_id, """ + ", ".join(f"coalesce(sum(length) FILTER (WHERE priority = {p}), 0) AS priority_{p}" for p in ranges.PRIORITIES) + """
FROM stops s LEFT JOIN hits USING (hash_id) GROUP BY s.hash_id""", views="stops edges works")
def _(t):
    edges = _numbered(t)
    k, m = F.col("hash_id"), edges.agg(F.count(F.lit(1))).scalar()
    paths = t.stops.select("hash_id", "ar_pt", F.array(k % m, k * 7 % m, k % m).alias("path"))
    return ranges.obstacles_on_path(paths, _edge_works(t, edges), "hash_id", "path", "ar_pt").drop("path", "ar_pt")


@query("route_features", "WITH " + NEWEST + """, paths AS (SELECT hash_id, station, ar_pt, dp_pt, 'S' || n AS s1, 'S' || CAST(stop_id AS VARCHAR) AS s2 FROM stops),
legs AS (SELECT hash_id, 'start' AS kind, least(s1, 'S9') AS u, greatest(s1, 'S9') AS v FROM paths WHERE ar_pt IS NOT NULL
 UNION ALL SELECT hash_id, k, least('S9', station), greatest('S9', station) FROM paths, (VALUES ('start'), ('last')) AS x(k) WHERE ar_pt IS NOT NULL
 UNION ALL SELECT hash_id, k, least(station, 'S2'), greatest(station, 'S2') FROM paths, (VALUES ('end'), ('next')) AS x(k) WHERE dp_pt IS NOT NULL
 UNION ALL SELECT hash_id, 'end', least('S2', s2), greatest('S2', s2) FROM paths WHERE dp_pt IS NOT NULL),
hops AS (SELECT DISTINCT u, v FROM legs), """ + ways_sql("SELECT u AS s FROM hops") + ", " + DISTANCES + ", " + EDGE_WORKS + f""",
sums AS (SELECT hash_id, {', '.join(f"sum(distance) FILTER (WHERE kind = '{k}') AS {k}" for k in ('last', 'start', 'next', 'end')).replace('AS end', 'AS fin').replace('AS next', 'AS nxt')} FROM legs JOIN dist USING (u, v) GROUP BY hash_id),
uses AS (SELECT hash_id, unnest(w.path) AS edge_id FROM legs l JOIN w{ROUNDS} w ON w.source = l.u AND w.node = l.v WHERE kind = 'start'),
hits AS (SELECT u.hash_id, priority, obs.length FROM uses u JOIN stops s USING (hash_id) JOIN obs ON obs.edge_id = u.edge_id AND from_time <= ar_pt AND ar_pt <= to_time),
tot AS (SELECT hash_id, {', '.join(f"sum(length) FILTER (WHERE priority = {p}) AS p{p}" for p in ranges.PRIORITIES)} FROM hits GROUP BY hash_id)
SELECT p.hash_id, round(coalesce(last, 0), 3) AS distance_to_last, round(coalesce(start, 0), 3) AS distance_to_start, round(coalesce(nxt, 0), 3) AS distance_to_next, round(coalesce(fin, 0), 3) AS distance_to_end,
 {', '.join(f"coalesce(p{p}, 0) AS obstacles_priority_{p}" for p in ranges.PRIORITIES)} FROM paths p LEFT JOIN sums USING (hash_id) LEFT JOIN tot USING (hash_id)""", views="stops edges stations works")
def _(t):
    ar = F.when(F.col("ar_pt").isNotNull(), F.array(F.concat(F.lit("S"), "n"), F.lit("S9")))
    dp = F.when(F.col("dp_pt").isNotNull(), F.array(F.lit("S2"), F.concat(F.lit("S"), F.col("stop_id").cast("string"))))
    stops = t.stops.select("hash_id", "station", "ar_pt", ar.alias("ar_cpth"), dp.alias("dp_cpth"))
    edges = _numbered(t)
    found = graph.route_features(stops, edges, lookup.latest_version(t.stations, "name"), _edge_works(t, edges))
    return found.select(*[F.round(c, 3).alias(c) if c.startswith("distance_") else F.col(c) for c in found.columns])


@query("obstacles_to_edges", "WITH c AS (SELECT * FROM works WHERE category = 1 AND source <> target), " + ways_sql("SELECT least(source, target) AS s FROM c") + f"""
SELECT obstacle_id, x.edge_id, e.u, e.v, e.length, priority, from_time, to_time FROM (
 SELECT c.*, unnest(w.path) AS edge_id FROM c JOIN w{ROUNDS} w ON w.source = least(c.source, c.target) AND w.node = greatest(c.source, c.target)) x JOIN e USING (edge_id)""", views="edges works")
def _(t):
    return graph.obstacles_to_edges(filters.construction_only(t.works), _numbered(t))


LINKS = """links AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - c_custkey % 7 WHEN c_custkey % 35 = 1 THEN c_custkey + 7 ELSE c_custkey END AS b FROM customer)"""


def _links(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("a"), F.when(k % 3 == 0, k - k % 7).when(k % 35 == 1, k + 7).otherwise(k).alias("b"))


GROUPS = "WITH RECURSIVE " + LINKS + """, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON seen = a)
"""


@query("connected_groups", GROUPS + "SELECT node, min(seen) AS label FROM reach GROUP BY node")
def _(t):
    return graph.connected_groups(_links(t))


@query("group_sizes", GROUPS + "SELECT node, label, count(*) OVER (PARTITION BY label) AS members FROM (SELECT node, min(seen) AS label FROM reach GROUP BY node)")
def _(t):
    return graph.group_sizes(graph.connected_groups(_links(t)))


TRACK_IDS = "tr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY u, v, length, tag) AS edge_id, u, v, length FROM tracks)"


def _tracks(t):
    from stopwise.operators.numbering import global_row_number
    order = [F.col(c) for c in ("u", "v", "length", "tag")]
    return global_row_number(t.tracks, order, "edge_id").select("edge_id", "u", "v", "length")


PARALLEL = TRACK_IDS + """, single AS MATERIALIZED (SELECT edge_id, u, v, length FROM (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY length, edge_id) AS r
  FROM tr WINDOW p AS (PARTITION BY least(u, v), greatest(u, v))) WHERE n = 1 OR r > 1)"""


@query("drop_parallel_edges", "WITH " + PARALLEL + " SELECT * FROM single", views="tracks")
def _(t):
    return graph.drop_parallel_edges(_tracks(t))


def _pruned_sql(rounds: int = 30) -> str:
    parts = [PARALLEL, "g0 AS MATERIALIZED (SELECT * FROM single)"]
    for i in range(rounds):
        parts.append(f"""g{i + 1} AS MATERIALIZED (WITH deg AS (SELECT node FROM (SELECT u AS node FROM g{i} UNION ALL SELECT v FROM g{i}) GROUP BY node HAVING count(*) < 2),
 dead AS (SELECT node FROM deg WHERE node NOT IN (SELECT node FROM track_types)) SELECT * FROM g{i} WHERE u NOT IN (SELECT node FROM dead) AND v NOT IN (SELECT node FROM dead))""")
    return ",\n".join(parts)


@query("prune_dead_ends", "WITH " + _pruned_sql() + " SELECT * FROM g30", views="tracks track_types")
def _(t):
    return graph.prune_dead_ends(graph.drop_parallel_edges(_tracks(t)), t.track_types)


@query("contract_degree_2", "WITH RECURSIVE " + _pruned_sql() + """,
inner_nodes AS MATERIALIZED (SELECT node FROM (SELECT u AS node FROM g30 UNION ALL SELECT v FROM g30) GROUP BY node HAVING count(*) = 2 AND node NOT IN (SELECT node FROM track_types)),
ga AS MATERIALIZED (SELECT edge_id, u AS a, v AS b, length FROM g30 UNION ALL SELECT edge_id, v, u, length FROM g30),
walk(start, first_edge, at_node, last_edge, length, merged) AS (
 SELECT a, edge_id, b, edge_id, length, CAST(1 AS BIGINT) FROM ga WHERE a NOT IN (SELECT node FROM inner_nodes)
 UNION ALL SELECT start, first_edge, ga.b, ga.edge_id, walk.length + ga.length, merged + 1 FROM walk JOIN ga ON ga.a = at_node AND ga.edge_id <> last_edge WHERE at_node IN (SELECT node FROM inner_nodes)),
done AS (SELECT least(start, at_node) AS u, greatest(start, at_node) AS v, length, merged, least(first_edge, last_edge) AS x, greatest(first_edge, last_edge) AS y FROM walk WHERE at_node NOT IN (SELECT node FROM inner_nodes))
SELECT u, v, CAST(length AS BIGINT) AS length, merged FROM (SELECT DISTINCT * FROM done)""", views="tracks track_types")
def _(t):
    pruned = graph.prune_dead_ends(graph.drop_parallel_edges(_tracks(t)), t.track_types)
    contracted = graph.contract_chains(pruned, t.track_types)
    return contracted.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "length", "merged")


@query("construction_edges", """
SELECT u, v, length FROM edges WHERE EXISTS (SELECT 1 FROM works w WHERE category = 1 AND ((w.source = u AND w.target = v) OR (w.source = v AND w.target = u)))""", views="edges works")
def _(t):
    closed = filters.construction_only(t.works).select(F.col("source").alias("u"), F.col("target").alias("v"))
    return graph.construction_edges(t.edges, closed)


def _waves_sql(rounds: int = 40) -> str:
    parts = ["l AS MATERIALIZED (SELECT u AS a, v AS b FROM tracks UNION SELECT v, u FROM tracks)",
             "r0 AS MATERIALIZED (SELECT node, 0 AS wave FROM track_types)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT * FROM r{i} UNION ALL SELECT DISTINCT b, {i + 1} FROM r{i} JOIN l ON node = a WHERE wave = {i} AND b NOT IN (SELECT node FROM r{i}))")
    return "WITH " + ",\n".join(parts) + f" SELECT * FROM r{rounds}"


@query("reachability_waves", _waves_sql(), views="tracks track_types")
def _(t):
    links = t.tracks.select(F.col("u").alias("a"), F.col("v").alias("b"))
    return graph.reachability_waves(t.track_types, links.union(links.select("b", "a")))
