"""Views that give the test tables the shape of transit data.

One text per view serves both Spark and DuckDB; ``render`` fills in the three
words that differ between the engines.
"""

from __future__ import annotations

WORDS = {
    "spark": {
        "S": "STRING", "J": "get_json_object", "N": "TIMESTAMP_NTZ", "P": "MOD", "DIV": "div",
        "D": "date_format(date_trunc('day', ts), 'yyMMddHHmm')",
    },
    "duckdb": {
        "S": "VARCHAR", "J": "json_extract_string", "N": "TIMESTAMP", "P": "MOD", "DIV": "//",
        "D": "strftime(date_trunc('day', ts), '%y%m%d%H%M')",
    },
}

STOPS = """
SELECT event_id AS hash_id, 'S' || CAST(user_id AS {S}) AS station,
 CAST(event_id * 7919 % 1000003 - 500000 AS BIGINT) AS dayly_id, day_id AS date_id, CAST(k % 12 AS INT) AS stop_id,
 CAST(event_id * 7919 % 1000003 - 500000 AS {S}) || '-' || day_text || '-' || CAST(k % 12 AS {S}) AS id,
 CASE WHEN event_id % 3 = 0 THEN 'F' ELSE 'N' END AS f, CASE WHEN event_id % 8 = 7 THEN 'e' ELSE 'p' END AS t,
 CASE WHEN event_id % 29 <> 0 THEN 'op' || CAST(event_id % 25 AS {S}) END AS o,
 event_type AS c, CAST(k AS {S}) AS n,
 CASE WHEN event_id % 10 <> 0 AND event_id % 6 <> 5 THEN CAST(k % 9 + 1 AS {S}) END AS ar_pp,
 CASE WHEN event_id % 11 <> 0 THEN CAST((k + 3) % 9 + 1 AS {S}) END AS dp_pp,
 CASE WHEN event_id % 10 <> 0 THEN base END AS ar_pt,
 CASE WHEN event_id % 10 <> 0 THEN base + INTERVAL '1' MINUTE * (m % 40 - 3) END AS ar_ct,
 CASE WHEN event_id % 13 = 0 THEN 'c' END AS ar_cs,
 CASE WHEN event_id % 11 <> 0 THEN base + INTERVAL '1' MINUTE * (k % 7) END AS dp_pt,
 CASE WHEN event_id % 11 <> 0 THEN base + INTERVAL '1' MINUTE * (k % 7 + m % 37 - 3) END AS dp_ct,
 CASE WHEN event_id % 17 = 0 THEN 'c' END AS dp_cs,
 CAST(k * 1500 AS DOUBLE) AS distance_to_start, CAST((99 - k) * 1500 AS DOUBLE) AS distance_to_end,
 CAST(CASE WHEN event_id % 10 <> 0 THEN 300 + m * 10 ELSE 0 END AS DOUBLE) AS distance_to_last,
 CAST(CASE WHEN event_id % 11 <> 0 THEN 400 + m * 7 ELSE 0 END AS DOUBLE) AS distance_to_next,
 CASE WHEN event_id % 19 = 0 THEN CAST(k % 5 * 100 AS DOUBLE) END AS obstacles_priority_24,
 CASE WHEN event_id % 7 = 0 THEN CAST(k % 3 * 250 AS DOUBLE) END AS obstacles_priority_37,
 CASE WHEN event_id % 23 = 0 THEN CAST(m AS DOUBLE) END AS obstacles_priority_63,
 CASE WHEN event_id % 31 = 0 THEN CAST(m * 2 AS DOUBLE) END AS obstacles_priority_65,
 CASE WHEN event_id % 5 = 0 THEN CAST(k % 2 * 80 AS DOUBLE) END AS obstacles_priority_70,
 CASE WHEN event_id % 37 = 0 THEN CAST(k AS DOUBLE) END AS obstacles_priority_80
FROM (SELECT event_id, user_id, event_type, CAST(floor(value) AS INT) AS m,
        CAST({J}(props, '$.k') AS INT) AS k, CAST(date_trunc('minute', ts) AS {N}) AS base,
        CAST(date_trunc('day', ts) AS {N}) AS day_id, {D} AS day_text FROM events) AS raw
"""

# Versions of stations: open, renamed code half way, and closed ones.
STATIONS = """
SELECT 'S' || CAST(s_suppkey AS {S}) AS name, CAST(8000000 + s_suppkey AS BIGINT) AS eva,
  'D' || CAST(s_suppkey AS {S}) || CASE WHEN version = 1 THEN 'X' ELSE '' END AS ds100,
  CASE WHEN s_suppkey % 41 <> 40 THEN CAST(47 + s_suppkey % 37 * 0.21 AS DOUBLE) + version * 0.001 END AS lat,
  CASE WHEN s_suppkey % 41 <> 40 THEN CAST(6 + s_suppkey % 53 * 0.17 AS DOUBLE) + version * 0.001 END AS lon,
  CASE WHEN version = 1 THEN {N} '2024-01-15 00:00:00'
       WHEN s_suppkey % 3 = 2 THEN {N} '2024-01-05 00:00:00' END AS valid_from,
  CASE WHEN s_suppkey % 3 = 1 AND version = 0 THEN {N} '2024-01-15 00:00:00'
       WHEN s_suppkey % 3 = 2 THEN {N} '2024-01-25 00:00:00' END AS valid_to,
  CAST(floor(s_acctbal) AS BIGINT) AS number_of_events,
  CAST(8000000 + CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey - 3 ELSE s_suppkey END AS BIGINT) AS meta_eva,
  s_nationkey AS area
FROM (SELECT s_suppkey, s_acctbal, s_nationkey, 0 AS version FROM supplier
      UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey, 1 AS version FROM supplier WHERE s_suppkey % 3 = 1) AS v
"""

# Operating points: one per customer.
POINTS = """
SELECT 'P' || CAST(c_custkey AS {S}) AS ds100, c_name || ' (' || c_mktsegment || ')' AS name, c_mktsegment AS type,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(47 + c_custkey * 31 % 977 * 0.008 AS DOUBLE) END AS lat,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(6 + c_custkey * 57 % 983 * 0.0091 AS DOUBLE) END AS lon,
  c_custkey AS point_key FROM customer
"""

# Undirected network between stations; parallel tracks keep the shortest length.
EDGES = """
SELECT u, v, min(length) AS length FROM (
  SELECT 'S' || CAST(least(l_suppkey, l_partkey % 100) AS {S}) AS u,
         'S' || CAST(greatest(l_suppkey, l_partkey % 100) AS {S}) AS v, l_quantity AS length
  FROM lineitem WHERE l_suppkey <> l_partkey % 100) AS raw GROUP BY u, v
"""

# Sparse network with chains, dead ends, parallel tracks and cycles.
TRACKS = """
SELECT u, v, CAST(length AS BIGINT) AS length, tag FROM (
 SELECT 'c' || CAST(k AS {S}) AS u, CASE WHEN k % 3 = 0 THEN 'm' || CAST(k AS {S}) ELSE 'c' || CAST(k {DIV} 2 AS {S}) END AS v,
   100 + k % 900 AS length, 0 AS tag FROM (SELECT c_custkey AS k FROM customer) AS a WHERE k > 0
 UNION ALL SELECT 'm' || CAST(k AS {S}), 'c' || CAST(k {DIV} 2 AS {S}), 50 + k % 70, 1 FROM (SELECT c_custkey AS k FROM customer) AS a WHERE k > 0 AND k % 3 = 0
 UNION ALL SELECT 'c' || CAST(k AS {S}), 'c' || CAST(k {DIV} 4 AS {S}), 300 + k % 500, 2 FROM (SELECT c_custkey AS k FROM customer) AS a WHERE k > 3 AND k % 5 = 0
 UNION ALL SELECT 'c' || CAST(k AS {S}), 'c' || CAST(k {DIV} 2 AS {S}), 90 + k % 800, 3 FROM (SELECT c_custkey AS k FROM customer) AS a WHERE k > 0 AND k % 3 <> 0 AND k % 11 = 0
) AS raw
"""
TRACK_TYPES = """SELECT 'c' || CAST(c_custkey AS {S}) AS node FROM customer WHERE c_mktsegment = 'BUILDING'"""

# Works on tracks: validity interval, priority, codes of both ends.
WORKS = """
SELECT o_orderkey AS obstacle_id,
  'S' || CAST(o_custkey % 100 AS {S}) AS source, 'S' || CAST((o_custkey * 7 + o_orderkey) % 100 AS {S}) AS target,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 24 WHEN 1 THEN 37 WHEN 2 THEN 63 WHEN 3 THEN 65 WHEN 4 THEN 70 ELSE 80 END AS priority,
  CAST(o_orderkey % 3 AS INT) AS category, o_orderpriority AS summary,
  CAST(o_orderkey % 25 AS INT) AS start_day, CAST(1 + o_orderkey % 4 AS INT) AS days,
  {N} '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(o_orderkey % 25 AS INT) AS from_time,
  {N} '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(o_orderkey % 25 + 1 + o_orderkey % 4 AS INT) AS to_time
FROM orders
"""

VIEWS = {
    "stops": STOPS, "stations": STATIONS, "points": POINTS, "edges": EDGES,
    "tracks": TRACKS, "track_types": TRACK_TYPES, "works": WORKS,
}


def render(name: str, engine: str) -> str:
    text = VIEWS[name]
    for key, word in WORDS[engine].items():
        text = text.replace("{" + key + "}", word)
    return text.strip()
