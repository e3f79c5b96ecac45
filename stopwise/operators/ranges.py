"""Range joins as equi joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions import timecols


def point_in_interval_join(intervals: DataFrame, points: DataFrame, keys: list[str], low: Column, high: Column,
                           point: Column, width: int, how: str = "inner") -> DataFrame:
    """Pairs with equal ``keys`` and ``low <= point <= high`` (numbers).

    Each interval has a level: buckets of ``width`` are doubled until one is as long as the
    interval, so it touches at most two of them however long it is. A point lies in one bucket
    of each level in use (at most one level per doubling), so each pair is found once. The
    bucket splits a hot key by its range, and AQE splits what is still too large. Column names
    of both sides must differ except for ``keys``.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("only inner and left_semi keep pairs unique")
    bucket = lambda value: F.floor(value / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level")))).cast("bigint")
    left = intervals.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    left = left.withColumn("_level", F.ceil(F.log2(F.greatest((F.col("_high") - F.col("_low")) / width, F.lit(1.0)))).cast("int"))
    levels = left.agg(F.collect_set("_level")).scalar()
    left = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high")))))
    right = points.withColumn("_point", point).withColumn("_level", F.explode(levels)).withColumn("_bucket", bucket(F.col("_point")))
    joined = left.join(right, [*keys, "_level", "_bucket"], "inner")
    return joined.filter((F.col("_low") <= F.col("_point")) & (F.col("_point") <= F.col("_high"))).drop(
        "_low", "_high", "_level", "_bucket", "_point")


def connecting_trains(stops: DataFrame, columns: list[str], least: int = 2, most: int = 10, key: str = "hash_id") -> DataFrame:
    """Arrivals with the departures at the same station ``least`` to ``most`` minutes later.

    One wide row per pair with ``ar_*`` and ``dp_*`` sides; a train does not connect to itself.
    """
    side = lambda e: stops.filter(F.col(f"{e}_pt").isNotNull()).select(
        "station", F.col(f"{e}_pt").alias(f"{e}_time"), *[F.col(c).alias(f"{e}_side_{c}") for c in {key: 0, **dict.fromkeys(columns)}])
    arrival = timecols.epoch_seconds(F.col("ar_time"))
    pairs = point_in_interval_join(
        side("ar"), side("dp"), ["station"], arrival + least * 60, arrival + most * 60,
        timecols.epoch_seconds(F.col("dp_time")), width=most * 60)
    return pairs.filter(F.col(f"ar_side_{key}") != F.col(f"dp_side_{key}"))


WEEK = 7 * 86400  # works of up to a week have one level, so a use of an edge is one row for all of them


def obstacles_on_edges(edge_uses: DataFrame, obstacles: DataFrame, time: str) -> DataFrame:
    """Uses of an edge at a time with the obstacles valid then (both ends inclusive)."""
    seconds = lambda c: timecols.epoch_seconds(F.col(c))
    return point_in_interval_join(obstacles, edge_uses, ["edge_id"], seconds("from_time"), seconds("to_time"),
                                  seconds(time), width=WEEK)


PRIORITIES = (24, 37, 63, 65, 70, 80)


def obstacle_lengths(paths: DataFrame, obstacles: DataFrame, key: str, path: str, time: str) -> DataFrame:
    """Length of obstacles per priority and ``key``, summed over all its paths; keys without any are absent.

    ``obstacles`` holds edge_id, priority, length, from_time, to_time. An edge that
    a path uses twice counts twice.
    """
    uses = paths.filter(F.col(path).isNotNull() & F.col(time).isNotNull()).select(key, time, F.explode(path).alias("edge_id"))
    hits = obstacles_on_edges(uses, obstacles.select("edge_id", "priority", "length", "from_time", "to_time"), time)
    total = lambda p: F.sum(F.when(F.col("priority") == p, F.col("length")).otherwise(F.lit(0.0)))
    return hits.groupBy(key).agg(*[total(p).alias(f"priority_{p}") for p in PRIORITIES])


def obstacles_on_path(paths: DataFrame, obstacles: DataFrame, key: str, path: str, time: str) -> DataFrame:
    """Rows with the length of obstacles per priority on their path; 0 where there are none."""
    joined = paths.join(obstacle_lengths(paths, obstacles, key, path, time), key, "left")
    return joined.fillna(0.0, subset=[f"priority_{p}" for p in PRIORITIES])
