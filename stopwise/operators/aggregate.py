"""Delay statistics by category, time and place."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.functions import timecols
from stopwise.functions.scoring import marker_size_per_day
from stopwise.operators.clean import ENDS, OBSTACLE_COLUMNS, is_cancelled, planned_time, status_flags
from stopwise.operators.filters import drop_null_group, has_obstacle, keep_active_groups, without_outliers
from stopwise.operators.numbering import exact_samples


def _share(flag: Column | str) -> Column:
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("int"))


def category_stats(stops: DataFrame, key: str) -> DataFrame:
    """Count and mean of delays, and the share of stops that happened, per value of ``key``."""
    measures = []
    for end in ENDS:
        measures += [F.count(f"{end}_delay").alias(f"{end}_delay_count"), F.avg(f"{end}_delay").alias(f"{end}_delay_mean"),
                     _share(f"{end}_happened").alias(f"{end}_happened_mean")]
    return drop_null_group(stops.groupBy(key).agg(*measures), key)


def group_uncommon(stats: DataFrame, key: str, smallest: int, other: str = "other") -> DataFrame:
    """Merge rare groups into one.

    The cutoff is the total count of the ``smallest``-th rarest group; every group
    with at most that many rows is merged. Counts add up; means are weighted by the
    delay count of their end.
    """
    total = F.col("ar_delay_count") + F.col("dp_delay_count")
    rare = stats.select(total.alias("n")).orderBy("n").limit(smallest)  # top-k, k is the parameter
    marked = stats.withColumn(key, F.when(total <= rare.agg(F.max("n")).scalar(), other).otherwise(F.col(key).cast("string")))
    measures = []
    for end in ENDS:
        count = F.col(f"{end}_delay_count")
        weighted = lambda c: F.sum(F.col(c) * count) / F.nullif(F.sum(count), F.lit(0))
        measures += [F.sum(count).alias(f"{end}_delay_count"), weighted(f"{end}_delay_mean").alias(f"{end}_delay_mean"),
                     weighted(f"{end}_happened_mean").alias(f"{end}_happened_mean")]
    return marked.groupBy(key).agg(*measures)


def bubble_frame(stats: DataFrame, key: str, measure: str) -> DataFrame:
    """Size and 0-1 colour per category from ``delay`` or ``happened`` means; categories without both are dropped."""
    value = (F.col(f"ar_{measure}_mean") + F.col(f"dp_{measure}_mean")) / 2
    rows = stats.select(key, value.alias("value"), (F.col("ar_delay_count") + F.col("dp_delay_count")).alias("size"))
    rows = rows.filter(F.col("value").isNotNull())
    span = rows.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    return rows.withColumn("colour", (F.col("value") - span["low"]) / F.nullif(span["high"] - span["low"], F.lit(0.0)))


# --- over time -------------------------------------------------------------------------


def time_measures() -> list[Column]:
    measures = []
    for end in ENDS:
        measures += [
            F.count(f"{end}_delay").alias(f"{end}_delay_count"), F.avg(f"{end}_delay").alias(f"{end}_delay_mean"),
            _share(f"{end}_happened").alias(f"{end}_happened_mean"),
            F.sum(F.col(f"{end}_happened").cast("bigint")).alias(f"{end}_happened_sum"),
            _share(f"{end}_on_time").alias(f"{end}_on_time_mean"), _share(f"{end}_is_cancelled").alias(f"{end}_cancelled_mean")]
    return measures


MEASURES = [f"{e}_{m}" for e in ENDS for m in ("delay_count", "delay_mean", "happened_mean", "happened_sum", "on_time_mean", "cancelled_mean")]
ROLLED = [m for m in MEASURES if m.endswith("_mean")]


def over_time(stops: DataFrame, period: Callable[[Column], Column], name: str = "bucket") -> DataFrame:
    """The twelve measures per value of ``period(planned time)``."""
    keyed = status_flags(stops).withColumn(name, period(planned_time()))
    return drop_null_group(keyed.groupBy(name).agg(*time_measures()), name)


def minute_of_hour(ts: Column) -> Column:
    return F.minute(ts)


def ten_minutes_of_day(ts: Column) -> Column:
    minute = timecols.minute_of_day(ts)
    return minute - minute % 10


def ten_minutes_of_week(ts: Column) -> Column:
    return timecols.weekday_from_monday(ts) * 1440 + ten_minutes_of_day(ts)


def day(ts: Column) -> Column:
    return timecols.floor_to_seconds(ts, 86400)


def seven_days(ts: Column) -> Column:
    """Weeks counted from 1970-01-01, a Thursday."""
    return timecols.floor_to_seconds(ts, 7 * 86400)


def circular_rolling_mean(rows: DataFrame, key: str, columns: list[str], window: int = 3) -> DataFrame:
    """Centred rolling mean over a period that closes in itself; null if any value in the frame is null.

    ``rows`` is one row per bucket of a period (at most a few thousand). Each row adds
    its values to the ``window`` positions around it, counted modulo the number of rows.
    """
    if window % 2 == 0:
        raise ValueError("window must be odd")
    half = window // 2
    numbered = rows.withColumn("_i", F.row_number().over(W.orderBy(key)) - 1)
    numbered = numbered.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    spread = numbered.withColumn("_p", F.explode(F.sequence(F.col("_i") - half, F.col("_i") + half)))
    spread = spread.withColumn("_at", F.pmod("_p", "_n"))
    full = lambda c: F.when(F.count(c) == window, F.avg(c)).alias(c)
    own = lambda c: F.max(F.when(F.col("_p") == F.col("_i"), F.col(c))).alias(c)
    rolled = spread.groupBy("_at").agg(*[full(c) if c in columns else own(c) for c in rows.columns])
    return rolled.drop("_at")


def over_hour(stops: DataFrame) -> DataFrame:
    return circular_rolling_mean(over_time(stops, minute_of_hour), "bucket", ROLLED, 3)


def over_day(stops: DataFrame) -> DataFrame:
    return circular_rolling_mean(over_time(stops, ten_minutes_of_day), "bucket", ROLLED, 5)


def over_week(stops: DataFrame) -> DataFrame:
    return circular_rolling_mean(over_time(stops, ten_minutes_of_week), "bucket", ROLLED, 5)


def over_year(stops: DataFrame, weekly: bool = False) -> DataFrame:
    return over_time(stops, seven_days if weekly else day)


# --- one-row overviews -----------------------------------------------------------------


def stats_overview(stops: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Totals over all data (``all_*``) and over the day before ``as_of`` (``new_*``), from one scan."""
    today = F.lit(as_of.replace(hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz")
    yesterday = F.lit(as_of.replace(hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=1)).cast("timestamp_ntz")
    recent = ((F.col("ar_pt") >= yesterday) | (F.col("dp_pt") >= yesterday)) & ((F.col("ar_pt") < today) | (F.col("dp_pt") < today))
    totals, shares = [], []
    for scope, inside in (("all", F.lit(True)), ("new", F.coalesce(recent, F.lit(False)))):
        for end in ENDS:
            pick = lambda c: F.when(inside, c)
            count = lambda c: F.count(F.when(inside & c, 1))
            delay = F.col(f"{end}_delay")
            n, name = f"{scope}_num_{end}", f"{scope}_{{}}_{end}_{{}}"
            totals += [
                count(F.col(f"{end}_happened")).alias(f"{n}_data"), count(is_cancelled(F.col(f"{end}_cs"))).alias(f"{n}_cancel"),
                F.max(pick(delay)).alias(f"{scope}_max_{end}_delay"), F.bround(F.avg(pick(delay)), 2).alias(f"{scope}_avg_{end}_delay"),
                count(delay > 5).alias(f"_{scope}_{end}_late")]
            shares += [
                F.bround(F.col(f"_{scope}_{end}_late") / F.nullif(f"{n}_data", F.lit(0)) * 100, 2).alias(f"{scope}_perc_{end}_delay"),
                F.bround(F.col(f"{n}_cancel") / F.nullif(F.col(f"{n}_data") + F.col(f"{n}_cancel"), F.lit(0)) * 100, 2).alias(f"{scope}_perc_{end}_cancel")]
    row = stops.agg(*totals)
    return row.select(*[c for c in row.columns if not c.startswith("_")], *shares)


def per_delay(stops: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` most frequent arrival delays with their counts, in order of delay."""
    counts = stops.groupBy("ar_delay").agg(
        F.count("ar_pt").alias("ar_count"), F.sum(F.col("ar_happened").cast("bigint")).alias("ar_happened_sum"),
        F.count("dp_pt").alias("dp_count"), F.sum(F.col("dp_happened").cast("bigint")).alias("dp_happened_sum"))
    return drop_null_group(counts, "ar_delay").orderBy(F.col("ar_count").desc(), "ar_delay").limit(top).orderBy("ar_delay")


# --- place and day ---------------------------------------------------------------------


def station_day(stops: DataFrame) -> DataFrame:
    """Per station and planned day (nearest midnight): mean delays, stops that happened, coordinates."""
    keyed = stops.withColumn("stop_day", timecols.round_to_day(planned_time()))
    measures = []
    for end in ENDS:
        measures += [F.avg(f"{end}_delay").alias(f"{end}_delay_mean"), F.sum(F.col(f"{end}_happened").cast("bigint")).alias(f"{end}_happened_sum")]
    groups = keyed.groupBy("station", "stop_day").agg(
        *measures, F.first("lat", ignorenulls=True).alias("lat"), F.first("lon", ignorenulls=True).alias("lon"))
    return keep_active_groups(groups)


def station_range(days: DataFrame, start: dt.datetime, end: dt.datetime, freq_hours: int = 24) -> DataFrame:
    """Station-days in [start, end) as one row per station; short spans are extended by one step."""
    if start + dt.timedelta(hours=freq_hours) > end:
        end = end + dt.timedelta(hours=freq_hours)
    low, high = (F.lit(d).cast("timestamp_ntz") for d in (start, end))
    rows = days.filter((F.col("stop_day") >= low) & (F.col("stop_day") < high))
    measures = []
    for e in ENDS:
        weight = F.col(f"{e}_happened_sum")
        mean = F.sum(F.col(f"{e}_delay_mean") * weight) / F.nullif(F.sum(weight), F.lit(0))
        measures += [F.coalesce(mean, F.lit(0.0)).alias(f"{e}_delay_mean"), F.sum(weight).alias(f"{e}_happened_sum")]
    groups = rows.groupBy("station").agg(*measures, F.first("lat", ignorenulls=True).alias("lat"), F.first("lon", ignorenulls=True).alias("lon"))
    span = max((end - start).days, 1)
    size = marker_size_per_day(F.col("ar_happened_sum") + F.col("dp_happened_sum"), F.lit(span))
    return groups.fillna(0.0, subset=["lat", "lon"]).withColumn("size", size)


def date_limits(days: DataFrame, freq_hours: int = 24) -> DataFrame:
    return days.agg(F.min("stop_day").alias("min"), F.max("stop_day").alias("max"), F.lit(freq_hours).alias("freq"))


# --- works on the track ----------------------------------------------------------------

EFFECT_ROWS = [*OBSTACLE_COLUMNS, "all"]
EFFECTS = ("ar_delay", "dp_delay", "ar_cancel", "dp_cancel")


def _effect_values() -> dict[str, Column]:
    values = [F.col("ar_delay"), F.col("dp_delay"), *[is_cancelled(F.col(f"{e}_cs")).cast("int") for e in ENDS]]
    return dict(zip(EFFECTS, values))


def obstacle_effect(stops: DataFrame, key: str = "hash_id", sampled: bool = False, seed: int = 0) -> DataFrame:
    """Delays and cancellations with and without works, per priority and over all.

    One scan: stops are summed up per combination of the six flags (64 groups at
    most), and all priorities are read off those. With ``sampled`` the side without
    works is an exact sample as large as the other side.
    """
    flags = {c: F.coalesce(F.col(c) > 0, F.lit(False)) for c in OBSTACLE_COLUMNS}
    values = _effect_values()
    rows = without_outliers(stops)
    groups = rows.groupBy(*[flag.alias(c) for c, flag in flags.items()]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(m) for m, v in values.items()])
    anyone = F.greatest(*[F.col(c) for c in OBSTACLE_COLUMNS])
    inside = {c: F.col(c) for c in OBSTACLE_COLUMNS} | {"all": anyone, "none": ~anyone}
    total = lambda c, keep: F.sum(F.when(keep, F.col(c)).otherwise(0))
    cells = [F.struct(F.lit(name).alias("priority"), total("n", keep).alias("n"), *[(total(m, keep) / F.nullif(total("n", keep), F.lit(0))).alias(m) for m in EFFECTS]).alias(name)
             for name, keep in inside.items()]
    one = groups.agg(*cells)
    table = one.select(F.inline(F.array(*[F.col(name) for name in EFFECT_ROWS])), *[F.col(f"none.{m}").alias(f"{m}_without") for m in EFFECTS])
    table = table.withColumnsRenamed({m: f"{m}_with" for m in EFFECTS})
    if sampled:
        free = rows.filter(~has_obstacle()).select(key, "ar_delay", "dp_delay", "ar_cs", "dp_cs")
        sizes = table.select(F.col("priority").alias("sample"), F.col("n").alias("size"))
        drawn = exact_samples(free, key, sizes, seed).groupBy(F.col("sample").alias("priority")).agg(
            *[F.avg(v).alias(f"{m}_without") for m, v in values.items()])
        table = table.drop(*[f"{m}_without" for m in EFFECTS]).join(drawn, "priority", "left")
    return table.select("*", *[(F.col(f"{m}_with") - F.col(f"{m}_without")).alias(f"{m}_delta") for m in EFFECTS])


def delay_histogram(stops: DataFrame) -> DataFrame:
    counts = stops.groupBy("ar_delay", has_obstacle().alias("has_obstacle")).agg(F.count("ar_pt").alias("n"))
    return counts.filter(F.col("ar_delay").isNotNull())


def corr_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlation in long form, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = rows.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(cells))


def distinct_counts(rows: DataFrame, columns: list[str], error: float | None = None) -> DataFrame:
    """Number of distinct values per column; with ``error`` from a sketch of that relative deviation."""
    count = (lambda c: F.count_distinct(c)) if error is None else (lambda c: F.approx_count_distinct(c, error))
    return rows.agg(*[count(c).alias(c) for c in columns])


def flat_aggregates(spec: dict[str, list[str]]) -> list[Column]:
    """``{column: [function, ...]}`` as aggregates called ``column_function``; ``first`` keeps the bare name."""
    return [getattr(F, f)(c).alias(c if f == "first" else f"{c}_{f}") for c, functions in spec.items() for f in functions]


def download_stats(runs: DataFrame, time: str = "ts") -> DataFrame:
    """Cycles and mean times per hour of a run log with columns download and upload."""
    hour = timecols.floor_to_seconds(F.col(time), 3600)
    return runs.groupBy(hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("cycles"), F.avg("download").alias("mean_download"), F.avg("upload").alias("mean_upload"))
