"""Lookups in station and operating-point dimensions, with and without validity.

No side is hinted as broadcast: Spark broadcasts a dimension when its size is
below the threshold, and otherwise joins by sort-merge with AQE skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators.dedup import last_per_key

def _from(column: str = "valid_from") -> Column:
    return F.coalesce(F.col(column), F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))


def _to(column: str = "valid_to") -> Column:
    return F.coalesce(F.col(column), F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00")))


def with_open_validity(stations: DataFrame) -> DataFrame:
    """A missing start means always, a missing end means still valid."""
    return stations.withColumns({"valid_from": _from(), "valid_to": _to()})


def valid_at(stations: DataFrame, date: Column) -> DataFrame:
    open_ended = with_open_validity(stations)
    return open_ended.filter((F.col("valid_from") <= date) & (date < F.col("valid_to")))


def latest_version(stations: DataFrame, key: str) -> DataFrame:
    """The version with the greatest ``valid_from`` per key."""
    return last_per_key(with_open_validity(stations), [key], [F.col("valid_from")])


def station_lookup(requests: DataFrame, stations: DataFrame, key: str, date: str, wanted: list[str],
                   how: str = "left") -> DataFrame:
    """Station attributes as they were at ``date``; ``key`` is name, eva or ds100.

    Requests must not already hold the wanted columns.
    """
    versions = with_open_validity(stations).select(
        F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *wanted)
    match = (F.col(key) == F.col("_key")) & (F.col("_from") <= F.col(date)) & (F.col(date) < F.col("_to"))
    wanted = [c for c in wanted if c != key]
    return requests.join(versions, match, how).select(*requests.columns, *wanted)


def station_lookup_latest(requests: DataFrame, stations: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Attributes of the newest version of each key."""
    versions = latest_version(stations, key).select(F.col(key).alias("_key"), *wanted)
    return requests.join(versions, F.col(key) == F.col("_key"), "left").drop("_key")


def station_lookup_pairs(requests: DataFrame, stations: DataFrame, keys: str, dates: str, key: str,
                         wanted: list[str]) -> DataFrame:
    """Array columns of keys and dates: the i-th date belongs to the i-th key."""
    pairs = F.arrays_zip(F.col(keys).alias(key), F.col(dates).alias("date"))
    rest = [c for c in requests.columns if c not in (keys, dates)]
    rows = requests.select(*rest, F.posexplode(pairs).alias("position", "_pair"))
    rows = rows.select(*rest, "position", F.col(f"_pair.{key}").alias(key), F.col("_pair.date").alias("date"))
    return station_lookup(rows, stations, key, "date", wanted)


def add_coordinates(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Coordinates of the newest version of the station; unknown stations get nulls."""
    newest = latest_version(stations, "name").select(F.col("name").alias("station"), "lat", "lon")
    return stops.join(newest, "station", "left")


def dimension_lookup(requests: DataFrame, dimension: DataFrame, key: str, dimension_key: str, wanted: list[str]) -> DataFrame:
    """Plain left lookup; missing keys give nulls."""
    side = dimension.select(F.col(dimension_key).alias("_key"), *[F.col(w).alias(f"found_{w}") for w in wanted])
    return requests.join(side, F.col(key) == F.col("_key"), "left").drop("_key")


def fallback_lookup(requests: DataFrame, first: DataFrame, first_on: tuple[str, str], second: DataFrame,
                    second_on: tuple[str, str], value: str, name: str) -> DataFrame:
    """``value`` by one key from ``first``, else by another key from ``second``."""
    a = first.select(F.col(first_on[1]).alias("_k1"), F.col(value).alias("_v1"))
    b = second.select(F.col(second_on[1]).alias("_k2"), F.col(value).alias("_v2"))
    joined = requests.join(a, F.col(first_on[0]) == F.col("_k1"), "left").join(b, F.col(second_on[0]) == F.col("_k2"), "left")
    return joined.withColumn(name, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def coordinates_with_fallback(stations: DataFrame, first: DataFrame, second: DataFrame, group: str) -> DataFrame:
    """Location from ``first``, else ``second``, else the own value, else the midpoint of the group.

    ``location_source`` tells which one was used; ``missing`` marks rows without any.
    """
    found = stations
    for i, side in enumerate((first, second), start=1):
        renamed = side.select("eva", F.col("lat").alias(f"_lat{i}"), F.col("lon").alias(f"_lon{i}"))
        found = found.join(renamed, "eva", "left")
    middle = first.join(stations.select("eva", group).distinct(), "eva").groupBy(group).agg(
        F.avg("lat").alias("_lat3"), F.avg("lon").alias("_lon3"))
    found = found.join(middle, group, "left")
    order = [("first", "_lat1", "_lon1"), ("second", "_lat2", "_lon2"), ("own", "lat", "lon"), ("group", "_lat3", "_lon3")]
    source = F.coalesce(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(n)) for n, a, b in order], F.lit("missing"))
    found = found.withColumn("location_source", source)
    pick = lambda i: F.coalesce(*[F.when(F.col("location_source") == o[0], F.col(o[i])) for o in order])
    return found.select(*[c for c in stations.columns if c not in ("lat", "lon")],
                        pick(1).alias("lat"), pick(2).alias("lon"), "location_source")
