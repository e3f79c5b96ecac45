"""Windows, sorts, top-k and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stopwise.operators import aggregate, dedup, filters, lookup, numbering
from stopwise.functions import timecols
from stopwise.plans.aggregates import rounded
from stopwise.plans.registry import query


@query("latest_version", """
SELECT name, ds100, valid_from FROM (SELECT name, ds100, coalesce(valid_from, TIMESTAMP '0001-01-01') AS valid_from,
  row_number() OVER (PARTITION BY name ORDER BY coalesce(valid_from, TIMESTAMP '0001-01-01') DESC) AS rn FROM stations) WHERE rn = 1""", views="stations")
def _(t):
    return lookup.latest_version(t.stations, "name").select("name", "ds100", "valid_from")


@query("dedup_keep_last", "SELECT station, c, hash_id, ar_ct FROM (SELECT *, row_number() OVER (PARTITION BY station, c ORDER BY hash_id DESC) AS rn FROM stops) WHERE rn = 1", views="stops")
def _(t):
    return dedup.last_per_key(t.stops.select("station", "c", "hash_id", "ar_ct"), ["station", "c"], [F.col("hash_id")])


@query("dedup_keep_first", "SELECT station, c, hash_id, ar_ct FROM (SELECT *, row_number() OVER (PARTITION BY station, c ORDER BY hash_id) AS rn FROM stops) WHERE rn = 1", views="stops")
def _(t):
    return dedup.first_per_key(t.stops.select("station", "c", "hash_id", "ar_ct"), ["station", "c"], [F.col("hash_id")])


@query("sequence_id", "SELECT hash_id, row_number() OVER (ORDER BY dp_ct, hash_id) - 1 AS id FROM stops WHERE dp_ct IS NOT NULL", views="stops")
def _(t):
    rows = t.stops.select("hash_id", "dp_ct").filter("dp_ct is not null")
    return numbering.global_row_number(rows, [F.col("dp_ct"), F.col("hash_id")], "id").select("hash_id", (F.col("id") - 1).alias("id"))


@query("first_version_flag", "SELECT name, ds100, count(*) OVER (PARTITION BY name) = 1 AS is_only_version FROM stations", views="stations")
def _(t):
    return dedup.only_version(t.stations.select("name", "ds100"), ["name"])


@query("fixed_size_batches", "SELECT batch, count(*) AS n, min(hash_id) AS first_id, max(hash_id) AS last_id FROM (SELECT hash_id, (row_number() OVER (ORDER BY hash_id) - 1) // 256 AS batch FROM stops) GROUP BY batch", views="stops")
def _(t):
    batches = numbering.fixed_batches(t.stops.select("hash_id"), [F.col("hash_id")], 256)
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("hash_id").alias("first_id"), F.max("hash_id").alias("last_id"))


@query("sort_by_key", "SELECT hash_id, ar_pt FROM stops ORDER BY ar_pt NULLS FIRST, hash_id", views="stops")
def _(t):
    return t.stops.select("hash_id", "ar_pt").orderBy("ar_pt", "hash_id")


@query("stations_by_traffic", """
SELECT name, max(number_of_events) AS number_of_events FROM stations WHERE coalesce(valid_from, TIMESTAMP '0001-01-01') <= TIMESTAMP '2024-01-20'
  AND TIMESTAMP '2024-01-20' < coalesce(valid_to, TIMESTAMP '9999-12-31') GROUP BY name ORDER BY number_of_events DESC, name""", views="stations")
def _(t):
    now = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz")
    current = lookup.valid_at(t.stations, now)
    return current.groupBy("name").agg(F.max("number_of_events").alias("number_of_events")).orderBy(F.col("number_of_events").desc(), "name")


@query("top_k", "SELECT station, count(*) AS n FROM stops GROUP BY station ORDER BY n DESC, station LIMIT 50", views="stops")
def _(t):
    return t.stops.groupBy("station").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "station").limit(50)


@query("bottom_k", "SELECT n AS train, count(*) AS total FROM stops GROUP BY train ORDER BY total, train LIMIT 50", views="stops")
def _(t):
    return t.stops.groupBy(F.col("n").alias("train")).agg(F.count(F.lit(1)).alias("total")).orderBy("total", "train").limit(50)


@query("head_tail_slice", """
SELECT 'first' AS part, hash_id FROM (SELECT hash_id FROM stops ORDER BY hash_id LIMIT 100)
UNION ALL SELECT 'last', hash_id FROM (SELECT hash_id FROM stops ORDER BY hash_id DESC LIMIT 100)
UNION ALL SELECT 'all_but_last', hash_id FROM (SELECT hash_id, row_number() OVER (ORDER BY hash_id DESC) AS r FROM stops) WHERE r > 3000
UNION ALL SELECT 'range', hash_id FROM (SELECT hash_id, row_number() OVER (ORDER BY hash_id) AS r FROM stops) WHERE r > 200 AND r <= 300""", views="stops")
def _(t):
    rows, order = t.stops.select("hash_id"), [F.col("hash_id")]
    part = lambda name, df: df.select(F.lit(name).alias("part"), "hash_id")
    return (part("first", rows.orderBy("hash_id").limit(100))
            .union(part("last", rows.orderBy(F.col("hash_id").desc()).limit(100)))
            .union(part("all_but_last", numbering.row_slice(rows, order, first=3000, from_end=True)))
            .union(part("range", numbering.row_slice(rows, order, 200, 300))))


@query("top_of_group_means", "SELECT o, round(avg(ar_delay), 6) AS mean FROM delayed WHERE o IS NOT NULL GROUP BY o ORDER BY round(avg(ar_delay), 6) DESC, o LIMIT 30", views="delayed")
def _(t):
    means = filters.drop_null_group(t.delayed.groupBy("o").agg(F.round(F.avg("ar_delay"), 6).alias("mean")), "o")
    return means.orderBy(F.col("mean").desc(), "o").limit(30)


@query("union_all", "SELECT hash_id, station, ar_pp AS platform FROM stops WHERE f = 'F' UNION ALL SELECT hash_id, station, NULL FROM stops WHERE f = 'N'", views="stops")
def _(t):
    a = t.stops.filter("f = 'F'").select("hash_id", "station", F.col("ar_pp").alias("platform"))
    return a.unionByName(t.stops.filter("f = 'N'").select("station", "hash_id"), allowMissingColumns=True)


SOURCES = """
WITH a AS (SELECT hash_id, 'a' AS origin FROM stops WHERE hash_id % 2 = 0), b AS (SELECT hash_id, 'b' AS origin FROM stops WHERE hash_id % 3 = 0),
u AS (SELECT *, 0 AS rank FROM a UNION ALL SELECT *, 1 FROM b)
SELECT hash_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY rank {way}) AS rn FROM u) WHERE rn = 1"""


def _origins(t):
    ids = t.stops.select("hash_id")
    return [ids.filter("hash_id % 2 = 0").withColumn("origin", F.lit("a")), ids.filter("hash_id % 3 = 0").withColumn("origin", F.lit("b"))]


@query("union_first_wins", SOURCES.format(way="ASC"), views="stops")
def _(t):
    return dedup.union_first_wins(_origins(t), ["hash_id"])


@query("union_last_wins", SOURCES.format(way="DESC"), views="stops")
def _(t):
    return dedup.union_last_wins(_origins(t), ["hash_id"])


@query("distinct_union", "SELECT u AS node FROM edges UNION SELECT v FROM edges", views="edges")
def _(t):
    return t.edges.select(F.col("u").alias("node")).union(t.edges.select("v")).distinct()


@query("difference", "SELECT DISTINCT station FROM stops EXCEPT SELECT name FROM stations", views="stops stations")
def _(t):
    return t.stops.select("station").subtract(t.stations.select(F.col("name").alias("station")))
