"""Timetable statistics on stop times (GTFS shape).

``stop_times``: trip_id, seq (rising in a trip, gaps allowed), stop, lat, lon, at, route. Distances are
whole millimetres while they are summed, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.functions import timecols
from stopwise.functions.geo import distance_m
from stopwise.operators.ranges import point_in_interval_join


CHUNK = 1000  # stops of a trip that are ordered together


def legs(stop_times: DataFrame) -> DataFrame:
    """Each stop with the one before it on its trip.

    Trips are cut into chunks of CHUNK numbers, so a window never holds more stops than that;
    the first stop of a chunk follows the last one of the chunk before, however far that is.
    """
    rows = stop_times.withColumn("_chunk", F.floor(F.col("seq") / CHUNK))
    carried = ("lat", "lon", "at")
    ends = rows.groupBy("trip_id", "_chunk").agg(F.max_by(F.struct(*carried), "seq").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(W.partitionBy("trip_id").orderBy("_chunk")))  # one row per chunk
    ordered = W.partitionBy("trip_id", "_chunk").orderBy("seq")
    rows = rows.withColumns({"_n": F.row_number().over(ordered), "_last": F.lag(F.struct(*carried)).over(ordered)}).join(ends, ["trip_id", "_chunk"])
    before = F.when(F.col("_n") == 1, F.col("_end")).otherwise(F.col("_last"))
    rows = rows.withColumns({f"{c}0": before[c] for c in carried}).drop("_n", "_last", "_end")
    length = F.round(distance_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) * 1000).cast("bigint")
    return rows.withColumn("leg_mm", F.coalesce(length, F.lit(0)))


def stop_distances(stop_times: DataFrame) -> DataFrame:
    """Metres from the start of the trip to each stop: running sum in the chunk plus all chunks before."""
    moved = legs(stop_times)
    running = F.sum("leg_mm").over(W.partitionBy("trip_id", "_chunk").orderBy("seq"))
    before = W.partitionBy("trip_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)  # one row per chunk
    chunks = moved.groupBy("trip_id", "_chunk").agg(F.sum("leg_mm").alias("_mm"))
    offsets = chunks.select("trip_id", "_chunk", F.coalesce(F.sum("_mm").over(before), F.lit(0)).alias("_before"))
    summed = moved.withColumn("_run", running).join(offsets, ["trip_id", "_chunk"])
    return summed.select(*stop_times.columns, ((F.col("_run") + F.col("_before")) / 1000).alias("distance_m"))


def trip_stats(stop_times: DataFrame) -> DataFrame:
    """Stops, start, end, minutes, metres and speed per trip."""
    stats = legs(stop_times).groupBy("trip_id", "route").agg(
        F.count(F.lit(1)).alias("stops"), F.min("at").alias("start"), F.max("at").alias("end"), (F.sum("leg_mm") / 1000).alias("distance_m"))
    minutes = (timecols.epoch_seconds(F.col("end")) - timecols.epoch_seconds(F.col("start"))) / 60
    return stats.withColumn("minutes", minutes).withColumn("speed_kmh", F.col("distance_m") / 1000 / F.nullif(minutes / 60, F.lit(0.0)))


def time_series(trips: DataFrame, hours: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """Trips, metres and minutes per time bin (of the start of the trip), over all or per ``by``."""
    binned = trips.withColumn("bin", timecols.floor_to_seconds(F.col("start"), hours * 3600))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("trips"), F.sum("distance_m").alias("distance_m"), F.sum("minutes").alias("minutes"))


def downsample(series: DataFrame, hours: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """Wider bins from narrower ones."""
    binned = series.withColumn("bin", timecols.floor_to_seconds(F.col("bin"), hours * 3600))
    return binned.groupBy(*by, "bin").agg(F.sum("trips").alias("trips"), F.sum("distance_m").alias("distance_m"), F.sum("minutes").alias("minutes"))


def cross_section(series: DataFrame, indicator: str, routes: list[str]) -> DataFrame:
    """One column per route with one indicator per bin."""
    return series.groupBy("bin").pivot("route", routes).agg(F.sum(indicator))


def locate_trips(stop_times: DataFrame, times: DataFrame) -> DataFrame:
    """Position of each running trip at each of the given times (column ``asked``), linear between stops.

    At a stop the later leg counts, at the last stop the last one.
    """
    last = stop_times.groupBy("trip_id").agg(F.max("seq").alias("_last"))
    moves = legs(stop_times).filter("at0 is not null").join(last, "trip_id").select("trip_id", "seq", "lat0", "lon0", "at0", "lat", "lon", "at", "_last")
    s = lambda c: timecols.epoch_seconds(F.col(c))
    found = point_in_interval_join(moves, times, [], s("at0"), s("at"), s("asked"), width=3600)
    found = found.filter((F.col("asked") < F.col("at")) | (F.col("seq") == F.col("_last")))
    part = F.coalesce((s("asked") - s("at0")) / F.nullif(s("at") - s("at0"), F.lit(0)), F.lit(1.0))
    between = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * part
    return found.select("trip_id", "asked", between("lat0", "lat").alias("lat"), between("lon0", "lon").alias("lon"))


def route_timetable(stop_times: DataFrame, route: Column) -> DataFrame:
    """Stops and times of all trips of a route, trips in order of their start."""
    rows = stop_times.filter(F.col("route") == route)
    starts = rows.groupBy("trip_id").agg(F.min("at").alias("start"))
    return rows.join(starts, "trip_id").select("start", "trip_id", "seq", "stop", "at").orderBy("start", "trip_id", "seq")
