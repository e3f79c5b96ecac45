"""Aggregations by category, time and place."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stopwise.operators import aggregate, clean, dedup, filters, lookup
from stopwise.plans.joins import NEWEST
from stopwise.plans.registry import query


def rounded(df, digits=6):
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


def _stats_sql(key: str) -> str:
    parts = [f"count({e}_delay) AS {e}_delay_count, round(avg({e}_delay), 6) AS {e}_delay_mean, round(avg(CAST({e}_happened AS INT)), 6) AS {e}_happened_mean" for e in clean.ENDS]
    return f"SELECT {key}, {', '.join(parts)} FROM delayed WHERE {key} IS NOT NULL GROUP BY {key}"


for _name, _key in (("per_station", "station"), ("per_train_type", "c"), ("per_operator", "o"), ("per_f", "f"), ("per_t", "t"),
                    ("per_train_number", "n"), ("per_platform", "pp")):
    query(_name, _stats_sql(_key), views="delayed")(lambda t, key=_key: rounded(aggregate.category_stats(t.delayed, key)))


def _uncommon_sql(key: str, k: int) -> str:
    parts = [f"CAST(sum({e}_delay_count) AS BIGINT) AS {e}_delay_count, round(sum({e}_delay_mean * {e}_delay_count) / sum({e}_delay_count), 6) AS {e}_delay_mean, "
             f"round(sum({e}_happened_mean * {e}_delay_count) / sum({e}_delay_count), 6) AS {e}_happened_mean" for e in clean.ENDS]
    exact = _stats_sql(key).replace("round(", "(").replace(", 6)", ")")
    return f"""WITH s AS ({exact}), cut AS (SELECT max(n) AS cutoff FROM (SELECT ar_delay_count + dp_delay_count AS n FROM s ORDER BY n LIMIT {k}))
SELECT {key}, {', '.join(parts)} FROM (SELECT * REPLACE (CASE WHEN ar_delay_count + dp_delay_count <= cutoff THEN 'other' ELSE {key} END AS {key}) FROM s, cut) GROUP BY {key}"""


@query("group_uncommon", _uncommon_sql("n", 50), views="delayed")
def _(t):
    return rounded(aggregate.group_uncommon(aggregate.category_stats(t.delayed, "n"), "n", 50))


@query("group_uncommon_stations", _uncommon_sql("station", 100), views="delayed")
def _(t):
    return rounded(aggregate.group_uncommon(aggregate.category_stats(t.delayed, "station"), "station", 100))


def measures_sql(source: str, key: str) -> str:
    parts = []
    for e in clean.ENDS:
        parts.append(f"count({e}_delay) AS {e}_delay_count, avg({e}_delay) AS {e}_delay_mean, avg(CAST({e}_happened AS INT)) AS {e}_happened_mean, "
                     f"CAST(sum(CAST({e}_happened AS INT)) AS BIGINT) AS {e}_happened_sum, avg(CAST({e}_delay <= 5 AS INT)) AS {e}_on_time_mean, "
                     f"avg(CAST({e}_cs IS NOT DISTINCT FROM 'c' AS INT)) AS {e}_cancelled_mean")
    return f"SELECT {key} AS bucket, {', '.join(parts)} FROM (SELECT *, coalesce(ar_pt, dp_pt) AS p FROM {source}) WHERE p IS NOT NULL GROUP BY 1"


def _measure_columns(expression: str) -> str:
    return ", ".join(f"round({expression.format(c=c)}, 6) AS {c}" if c in aggregate.ROLLED else c for c in aggregate.MEASURES)


def rolled_sql(key: str, window: int) -> str:
    k = window // 2
    frame = f"OVER (ORDER BY pos ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    rolled = ", ".join(f"CASE WHEN count({c}) {frame} = {window} THEN round(avg({c}) {frame}, 6) END AS {c}" if c in aggregate.ROLLED else c for c in aggregate.MEASURES)
    return f"""WITH g AS ({measures_sql('delayed', key)}), x AS (SELECT *, row_number() OVER (ORDER BY bucket) AS pos, count(*) OVER () AS n FROM g),
padded AS (SELECT * FROM x UNION ALL SELECT * REPLACE (pos - n AS pos) FROM x WHERE pos > n - {k} UNION ALL SELECT * REPLACE (pos + n AS pos) FROM x WHERE pos <= {k})
SELECT * EXCLUDE (pos, n) FROM (SELECT bucket, {rolled}, pos, n FROM padded) WHERE pos BETWEEN 1 AND n"""


MINUTE = "CAST(extract(minute FROM p) AS INT)"
TEN_DAY = "CAST((extract(hour FROM p) * 60 + extract(minute FROM p)) // 10 * 10 AS INT)"
TEN_WEEK = f"CAST((isodow(p) - 1) * 1440 + {TEN_DAY} AS INT)"


@query("over_hour", rolled_sql(MINUTE, 3), views="delayed")
def _(t):
    return rounded(aggregate.over_hour(t.delayed))


@query("over_day", rolled_sql(TEN_DAY, 5), views="delayed")
def _(t):
    return rounded(aggregate.over_day(t.delayed))


@query("over_week", rolled_sql(TEN_WEEK, 5), views="delayed")
def _(t):
    return rounded(aggregate.over_week(t.delayed))


@query("over_year", "SELECT bucket, " + _measure_columns("{c}") + " FROM (" + measures_sql("delayed", "CAST(date_trunc('day', p) AS TIMESTAMP)") + ")", views="delayed")
def _(t):
    return rounded(aggregate.over_year(t.delayed))


@query("over_year_weekly", "SELECT bucket, " + _measure_columns("{c}") + " FROM (" + measures_sql("delayed", "CAST(time_bucket(INTERVAL '7' DAY, p, TIMESTAMP '1970-01-01') AS TIMESTAMP)") + ")", views="delayed")
def _(t):
    return rounded(aggregate.over_year(t.delayed, weekly=True))


@query("time_measures", "SELECT bucket, " + _measure_columns("{c}") + " FROM (" + measures_sql("delayed", "CAST(hour(p) AS INT)") + ")", views="delayed")
def _(t):
    return rounded(aggregate.over_time(t.delayed, F.hour))


@query("circular_rolling_mean", rolled_sql("CAST(hour(p) AS INT)", 7), views="delayed")
def _(t):
    return rounded(aggregate.circular_rolling_mean(aggregate.over_time(t.delayed, F.hour), "bucket", aggregate.ROLLED, 7))


def _overview_sql() -> str:
    parts = []
    recent = "(ar_pt >= TIMESTAMP '2024-01-19' OR dp_pt >= TIMESTAMP '2024-01-19') AND (ar_pt < TIMESTAMP '2024-01-20' OR dp_pt < TIMESTAMP '2024-01-20')"
    for scope, inside in (("all", "TRUE"), ("new", recent)):
        for e in clean.ENDS:
            data, cancel, late = (f"count(*) FILTER (WHERE ({inside}) AND {x})" for x in (f"{e}_happened", f"{e}_cs = 'c'", f"{e}_delay > 5"))
            parts += [f"{data} AS {scope}_num_{e}_data", f"{cancel} AS {scope}_num_{e}_cancel",
                      f"max({e}_delay) FILTER (WHERE {inside}) AS {scope}_max_{e}_delay",
                      f"round_even(avg({e}_delay) FILTER (WHERE {inside}), 2) AS {scope}_avg_{e}_delay",
                      f"round_even({late} / CAST({data} AS DOUBLE) * 100, 2) AS {scope}_perc_{e}_delay",
                      f"round_even({cancel} / CAST({data} + {cancel} AS DOUBLE) * 100, 2) AS {scope}_perc_{e}_cancel"]
    return "SELECT " + ", ".join(parts) + " FROM delayed"


@query("stats_overview", _overview_sql(), views="delayed")
def _(t):
    return aggregate.stats_overview(t.delayed, dt.datetime(2024, 1, 20, 9, 30))


@query("per_delay", """
SELECT ar_delay, count(ar_pt) AS ar_count, CAST(sum(CAST(ar_happened AS INT)) AS BIGINT) AS ar_happened_sum, count(dp_pt) AS dp_count,
  CAST(sum(CAST(dp_happened AS INT)) AS BIGINT) AS dp_happened_sum FROM delayed WHERE ar_delay IS NOT NULL GROUP BY ar_delay ORDER BY ar_count DESC, ar_delay LIMIT 50""", views="delayed")
def _(t):
    return aggregate.per_delay(t.delayed)


STATION_DAY = "WITH " + NEWEST + """,
p AS (SELECT d.*, newest.lat, newest.lon, epoch(coalesce(ar_pt, dp_pt)) AS s FROM delayed d LEFT JOIN newest ON name = station),
q AS (SELECT *, floor(s / 86400) AS b, s - floor(s / 86400) * 86400 AS r FROM p),
days AS (SELECT station, CAST(make_timestamp(CAST((b + CASE WHEN r > 43200 OR (r = 43200 AND b % 2 = 1) THEN 1 ELSE 0 END) * 86400000000 AS BIGINT)) AS TIMESTAMP) AS stop_day,
  avg(ar_delay) AS ar_delay_mean, CAST(sum(CAST(ar_happened AS INT)) AS BIGINT) AS ar_happened_sum,
  avg(dp_delay) AS dp_delay_mean, CAST(sum(CAST(dp_happened AS INT)) AS BIGINT) AS dp_happened_sum, max(lat) AS lat, max(lon) AS lon
  FROM q GROUP BY 1, 2 HAVING sum(CAST(ar_happened AS INT)) > 0 OR sum(CAST(dp_happened AS INT)) > 0)
"""


def _station_day(t):
    return aggregate.station_day(lookup.add_coordinates(t.delayed, t.stations))


@query("station_day", STATION_DAY + "SELECT * REPLACE (round(ar_delay_mean, 6) AS ar_delay_mean, round(dp_delay_mean, 6) AS dp_delay_mean, round(lat, 6) AS lat, round(lon, 6) AS lon) FROM days", views="delayed stations")
def _(t):
    return rounded(_station_day(t))


@query("station_range", STATION_DAY + """
SELECT station, round(coalesce(sum(ar_delay_mean * ar_happened_sum) / nullif(sum(ar_happened_sum), 0), 0), 6) AS ar_delay_mean, CAST(sum(ar_happened_sum) AS BIGINT) AS ar_happened_sum,
  round(coalesce(sum(dp_delay_mean * dp_happened_sum) / nullif(sum(dp_happened_sum), 0), 0), 6) AS dp_delay_mean, CAST(sum(dp_happened_sum) AS BIGINT) AS dp_happened_sum,
  round(coalesce(max(lat), 0), 6) AS lat, round(coalesce(max(lon), 0), 6) AS lon, round(sum(ar_happened_sum + dp_happened_sum) / 7.0 / 2000 * 70, 6) AS size
FROM days WHERE stop_day >= TIMESTAMP '2024-01-10' AND stop_day < TIMESTAMP '2024-01-17' GROUP BY station""", views="delayed stations")
def _(t):
    return rounded(aggregate.station_range(_station_day(t), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 17)))


@query("date_limits", STATION_DAY + "SELECT min(stop_day) AS min, max(stop_day) AS max, 24 AS freq FROM days", views="delayed stations")
def _(t):
    return aggregate.date_limits(_station_day(t))


@query("group_midpoint", "SELECT meta_eva, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM stations GROUP BY meta_eva", views="stations")
def _(t):
    return rounded(t.stations.groupBy("meta_eva").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")))


def _effect_sql(sampled: bool) -> str:
    anyone = "(" + " OR ".join(f"coalesce({c} > 0, FALSE)" for c in clean.OBSTACLE_COLUMNS) + ")"
    names = [(c, f"{c} > 0") for c in clean.OBSTACLE_COLUMNS] + [("all", "hit")]
    aggs = lambda side: (f"avg(ar_delay) AS ar_delay_{side}, avg(dp_delay) AS dp_delay_{side}, avg(CAST(ar_cs IS NOT DISTINCT FROM 'c' AS INT)) AS ar_cancel_{side}, "
                         f"avg(CAST(dp_cs IS NOT DISTINCT FROM 'c' AS INT)) AS dp_cancel_{side}")
    parts = []
    for name, condition in names:
        free = f"WHERE NOT hit AND rank <= (SELECT count(*) FROM x WHERE {condition})" if sampled else "WHERE NOT hit"
        parts.append(f"SELECT '{name}' AS priority, * FROM (SELECT count(*) AS n, {aggs('with')} FROM x WHERE {condition}), (SELECT {aggs('without')} FROM x {free})")
    measures = ("ar_delay", "dp_delay", "ar_cancel", "dp_cancel")
    columns = ", ".join(f"round({m}_with, 6) AS {m}_with, round({m}_without, 6) AS {m}_without, round({m}_with - {m}_without, 6) AS {m}_delta" for m in measures)
    return f"""WITH y AS (SELECT *, {anyone} AS hit FROM delayed WHERE ar_delay BETWEEN -5 AND 100 AND dp_delay BETWEEN -1 AND 100),
x AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY md5('0:' || CAST(hash_id AS VARCHAR)), hash_id) AS rank FROM y)
SELECT priority, n, {columns} FROM ({' UNION ALL '.join(parts)})"""


@query("obstacle_effect", _effect_sql(False), views="delayed")
def _(t):
    return rounded(aggregate.obstacle_effect(t.delayed))


@query("obstacle_effect_sampled", _effect_sql(True), views="delayed")
def _(t):
    return rounded(aggregate.obstacle_effect(t.delayed, sampled=True))


@query("delay_histogram", "SELECT ar_delay, (" + " OR ".join(f"coalesce({c} > 0, FALSE)" for c in clean.OBSTACLE_COLUMNS) + ") AS has_obstacle, count(ar_pt) AS n FROM delayed WHERE ar_delay IS NOT NULL GROUP BY 1, 2", views="delayed")
def _(t):
    return aggregate.delay_histogram(t.delayed)


CORR = ["ar_delay", "dp_delay", "distance_to_start", "distance_to_last", "obstacles_priority_37"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM delayed" for i, a in enumerate(CORR) for b in CORR[i + 1:]), views="delayed")
def _(t):
    return rounded(aggregate.corr_matrix(t.delayed, CORR))


OBSTACLE_SUMMARY = "SELECT summary, count(*) AS n, avg(category) AS category FROM {works} WHERE category = 0 GROUP BY summary ORDER BY summary DESC"


@query("obstacle_summary", OBSTACLE_SUMMARY.replace("{works}", "works"), views="works")
def _(t):
    return t.spark.sql(OBSTACLE_SUMMARY, works=t.works)


@query("station_event_count", "SELECT station, count(ar_delay) + count(dp_delay) AS number_of_events FROM delayed GROUP BY station", views="delayed")
def _(t):
    stats = aggregate.category_stats(t.delayed, "station")
    return stats.select("station", (F.col("ar_delay_count") + F.col("dp_delay_count")).alias("number_of_events"))


def _bubble_sql(measure: str) -> str:
    source = f"{{e}}_delay" if measure == "delay" else "CAST({e}_happened AS INT)"
    return f"""WITH b AS (SELECT c, (avg({source.format(e='ar')}) + avg({source.format(e='dp')})) / 2 AS value, count(ar_delay) + count(dp_delay) AS size FROM delayed GROUP BY c)
SELECT c, round(value, 6) AS value, size, round((value - (SELECT min(value) FROM b)) / (SELECT max(value) - min(value) FROM b), 6) AS colour FROM b"""


@query("bubble_frame", _bubble_sql("delay"), views="delayed")
def _(t):
    return rounded(aggregate.bubble_frame(aggregate.category_stats(t.delayed, "c"), "c", "delay"))


@query("bubble_frame_happened", _bubble_sql("happened"), views="delayed")
def _(t):
    return rounded(aggregate.bubble_frame(aggregate.category_stats(t.delayed, "c"), "c", "happened"))


@query("label_base_rate", """
SELECT n, round(avg(CAST(ar_delay <= 5 AS INT)), 6) AS base_rate, round(sum(CAST(ar_delay <= 5 AS INT)) / CAST(nullif(sum(CAST(ar_delay > 5 AS INT)), 0) AS DOUBLE), 6) AS ratio
FROM delayed GROUP BY n""", views="delayed")
def _(t):
    good = (F.col("ar_delay") <= 5).cast("int")
    return rounded(t.delayed.groupBy("n").agg(F.avg(good).alias("base_rate"), (F.sum(good) / F.nullif(F.sum(1 - good), F.lit(0))).alias("ratio")))


@query("group_mean_std", "SELECT o, round(avg(ar_delay), 6) AS mean, round(stddev_samp(ar_delay), 6) AS std FROM delayed WHERE o IS NOT NULL GROUP BY o", views="delayed")
def _(t):
    groups = t.delayed.groupBy("o").agg(F.avg("ar_delay").alias("mean"), F.stddev_samp("ar_delay").alias("std"))
    return rounded(filters.drop_null_group(groups, "o"))


@query("mean_if", "SELECT round(avg(ar_delay) FILTER (WHERE distance_to_last <> 0), 6) AS moving, round(avg(ar_delay) FILTER (WHERE distance_to_last = 0), 6) AS starting FROM delayed", views="delayed")
def _(t):
    return rounded(t.delayed.agg(F.avg(F.when(F.col("distance_to_last") != 0, F.col("ar_delay"))).alias("moving"),
                                 F.avg(F.when(F.col("distance_to_last") == 0, F.col("ar_delay"))).alias("starting")))


@query("duplicate_count", "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")
def _(t):
    return dedup.duplicate_count(t.lineitem, "l_orderkey")


@query("distinct_values", "SELECT count(DISTINCT station) AS stations, count(DISTINCT n) AS trains, count(DISTINCT o) AS operators FROM stops", views="stops")
def _(t):
    counts = aggregate.distinct_counts(t.stops, ["station", "n", "o"])
    return counts.withColumnsRenamed({"station": "stations", "n": "trains", "o": "operators"})


@query("flatten_names", """
SELECT c, count(ar_delay) AS ar_delay_count, round(avg(ar_delay), 6) AS ar_delay_mean, max(dp_delay) AS dp_delay_max, c AS first_c FROM delayed GROUP BY c""", views="delayed")
def _(t):
    rows = t.delayed.withColumn("first_c", F.col("c"))
    return rounded(rows.groupBy("c").agg(*aggregate.flat_aggregates({"ar_delay": ["count", "mean"], "dp_delay": ["max"], "first_c": ["first"]})))


@query("variance", "SELECT station, round(var_pop(ar_delay), 6) AS variance, round(stddev_pop(ar_delay), 6) AS deviation FROM delayed GROUP BY station", views="delayed")
def _(t):
    return rounded(t.delayed.groupBy("station").agg(F.var_pop("ar_delay").alias("variance"), F.stddev_pop("ar_delay").alias("deviation")))


@query("download_stats", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS cycles, round(avg(value), 9) AS mean_download, round(avg(value / 10), 9) AS mean_upload FROM events GROUP BY 1""")
def _(t):
    log = t.events.select("ts", F.col("value").alias("download"), (F.col("value") / 10).alias("upload"))
    return rounded(aggregate.download_stats(log), 9)
