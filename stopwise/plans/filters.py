"""Filters and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stopwise.operators import aggregate, dedup, filters, spatial
from stopwise.functions.geo import in_box
from stopwise.plans.columns import raw_change
from stopwise.operators.clean import CHANGE_SCHEMA, OBSTACLE_COLUMNS
from stopwise.plans.registry import query

ANY = "(" + " OR ".join(f"coalesce({c} > 0, FALSE)" for c in OBSTACLE_COLUMNS) + ")"


@query("keep_active_groups", """
SELECT station, date_id, CAST(sum(CAST(ar_happened AS INT)) AS BIGINT) AS ar_happened_sum, CAST(sum(CAST(dp_happened AS INT)) AS BIGINT) AS dp_happened_sum
FROM delayed GROUP BY station, date_id HAVING sum(CAST(ar_happened AS INT)) > 0 OR sum(CAST(dp_happened AS INT)) > 0""", views="delayed")
def _(t):
    groups = t.delayed.groupBy("station", "date_id").agg(
        F.sum(F.col("ar_happened").cast("int")).alias("ar_happened_sum"), F.sum(F.col("dp_happened").cast("int")).alias("dp_happened_sum"))
    return filters.keep_active_groups(groups)


@query("drop_null_group", "SELECT o, count(*) AS n FROM stops WHERE o IS NOT NULL GROUP BY o", views="stops")
def _(t):
    return filters.drop_null_group(t.stops.groupBy("o").agg(F.count(F.lit(1)).alias("n")), "o")


@query("split_by_obstacle", f"SELECT hash_id, {ANY} AS has_obstacle FROM stops", views="stops")
def _(t):
    return t.stops.select("hash_id", filters.has_obstacle().alias("has_obstacle"))


@query("outlier_range", "SELECT hash_id, ar_delay, dp_delay FROM delayed WHERE ar_delay BETWEEN -5 AND 100 AND dp_delay BETWEEN -1 AND 100", views="delayed")
def _(t):
    return filters.without_outliers(t.delayed).select("hash_id", "ar_delay", "dp_delay")


@query("open_interval", "SELECT hash_id, ar_ct FROM stops WHERE ar_ct > TIMESTAMP '2024-01-10' AND ar_ct < TIMESTAMP '2024-01-28'", views="stops")
def _(t):
    at = lambda day: F.lit(dt.datetime(2024, 1, day)).cast("timestamp_ntz")
    return filters.open_interval(t.stops.select("hash_id", "ar_ct"), "ar_ct", at(10), at(28))


@query("in_list", "SELECT hash_id, station FROM stops WHERE station IN ('S1', 'S2', 'S77')", views="stops")
def _(t):
    return filters.in_list(t.stops.select("hash_id", "station"), "station", ["S1", "S2", "S77"])


@query("not_in_list", "SELECT hash_id, c FROM stops WHERE c NOT IN ('view', 'click')", views="stops")
def _(t):
    return filters.not_in_list(t.stops.select("hash_id", "c"), "c", ["view", "click"])


@query("drop_records_with_field", "SELECT hash_id FROM stops WHERE hash_id % 4 <> 1 AND (hash_id % 3 <> 0 OR ar_ct IS NULL)", views="stops")
def _(t):
    changes = raw_change(t).select("hash_id", F.from_json("change", CHANGE_SCHEMA).alias("change"))
    return changes.filter(F.get("change.ar", F.lit(0))["m"].isNull()).select("hash_id")


@query("substring_search", "SELECT name FROM points WHERE contains(lower(name), '77') ORDER BY name LIMIT 20", views="points")
def _(t):
    return filters.substring_search(t.points.select("name"), "name", "77")


@query("usable_for_label", "SELECT hash_id FROM (SELECT *, CASE WHEN ar_pt IS NOT NULL THEN ar_delay END AS d FROM delayed) WHERE d IS NOT NULL OR ar_cs IS NOT DISTINCT FROM 'c'", views="delayed")
def _(t):
    rows = t.delayed.withColumn("ar_delay", F.when(F.col("ar_pt").isNotNull(), F.col("ar_delay")))
    return filters.usable_for_label(rows, "ar").select("hash_id")


@query("with_coordinates", "SELECT ds100, lat, lon FROM points WHERE lat IS NOT NULL AND lon IS NOT NULL", views="points")
def _(t):
    return filters.with_coordinates(t.points.select("ds100", "lat", "lon"))


@query("construction_only", "SELECT obstacle_id, source, target FROM works WHERE category = 1 AND source <> target", views="works")
def _(t):
    return filters.construction_only(t.works).select("obstacle_id", "source", "target")


@query("drop_any_null", "SELECT hash_id, o, ar_pp, dp_pp, ar_pt FROM stops WHERE o IS NOT NULL AND ar_pp IS NOT NULL AND dp_pp IS NOT NULL AND ar_pt IS NOT NULL", views="stops")
def _(t):
    return t.stops.select("hash_id", "o", "ar_pp", "dp_pp", "ar_pt").dropna("any")


@query("bounding_box", "SELECT ds100, lat, lon FROM points WHERE lat BETWEEN 47.2 AND 55.1 AND lon BETWEEN 5.7 AND 10.5", views="points")
def _(t):
    return t.points.select("ds100", "lat", "lon").filter(in_box(F.col("lat"), F.col("lon"), 47.2, 55.1, 5.7, 10.5))


@query("at_most_one_match", "SELECT name, count(*) AS matches FROM stations GROUP BY name HAVING count(*) > 1", views="stations")
def _(t):
    return dedup.keys_with_many_rows(t.stations, ["name"])
