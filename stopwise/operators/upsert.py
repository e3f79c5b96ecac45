"""Merging rows into a keyed table, reading by key, and refreshing a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.operators.dedup import last_per_key
from stopwise.session import cut_lineage
from stopwise.sources.files import DATE_LAYOUT, date_folder, remove_folder, with_dates


def upsert_update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or overwrite by key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert only rows whose key is absent."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def lookup_by_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_semi")


def plan_of_station(plan: DataFrame, station: str, date1: dt.datetime | None = None,
                    date2: dt.datetime | None = None, time: str = "date_id") -> DataFrame:
    """All rows of a station, those at exactly ``date1``, or those in [date1, date2)."""
    rows = plan.filter(F.col("station") == station)
    if date1 is None:
        return rows
    low = F.lit(date1).cast("timestamp_ntz")
    if date2 is None:
        return rows.filter(F.col(time) == low)
    return rows.filter((F.col(time) >= low) & (F.col(time) < F.lit(date2).cast("timestamp_ntz")))


def key_chunks(table: DataFrame, key: str, rows_per_chunk: int = 20000) -> DataFrame:
    """Adds ``chunk``: equally wide half-open key ranges, the last one closed."""
    span = table.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    chunks = max((span["n"] or 0) // rows_per_chunk, 1)
    lo, width = span["lo"] or 0, max(((span["hi"] or 0) - (span["lo"] or 0)) / chunks, 1)
    chunk = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(float(width))), F.lit(chunks - 1))
    return table.withColumn("chunk", chunk.cast("bigint"))


def high_water_mark(stops: DataFrame, column: str = "ar_pt") -> dt.datetime | None:
    return stops.agg(F.max(column)).first()[0]


def incremental_refresh(old: DataFrame, source: DataFrame, keys: list[str],
                        overlap: dt.timedelta = dt.timedelta(days=2)) -> DataFrame:
    """Take source rows planned after the high-water mark minus ``overlap``; they replace old ones.

    The mark is one value, so the source filter carries a literal and is pushed down.
    """
    mark = high_water_mark(old)
    if mark is None:
        return source
    low = F.lit(mark - overlap).cast("timestamp_ntz")
    fresh = source.filter((F.col("ar_pt") > low) | (F.col("dp_pt") > low))
    return upsert_update(old, fresh, keys)


def refresh_by_date(spark: SparkSession, path: str, source: DataFrame, keys: list[str], overlap: dt.timedelta = dt.timedelta(days=2)) -> list[tuple]:
    """The same refresh on a table stored in date folders at ``path``; files of folders it does not touch stay as they are.

    Touched are the folders of the fresh rows, and those that hold an older version of one of them. One job writes them anew
    beside the table, and its commit puts them in the place of the old ones, so a job that fails leaves the table as it
    was; a folder that lost all its rows goes after that. Gives the touched (last_date, first_date).
    """
    old = spark.read.schema(with_dates(source).schema).parquet(path)  # the folders of an empty table say nothing of types
    mark = high_water_mark(old)
    fresh = source
    if mark is not None:
        low = F.lit(mark - overlap).cast("timestamp_ntz")
        fresh = source.filter((F.col("ar_pt") > low) | (F.col("dp_pt") > low))
    fresh = cut_lineage(with_dates(fresh))
    replaced = old.select(*keys, *DATE_LAYOUT).join(fresh.select(*keys), keys, "left_semi")
    folders = lambda rows: {tuple(r) for r in rows.select(*DATE_LAYOUT).distinct().collect()}  # one row per pair of days
    filled = folders(fresh)
    touched = sorted(filled | folders(replaced), key=str)

    def inside(days: list[tuple]) -> Column:
        found = F.lit(False)
        for last, first in days:
            found = found | (F.col("last_date").eqNullSafe(F.lit(last)) & F.col("first_date").eqNullSafe(F.lit(first)))
        return found

    days = F.col("last_date").isin([last for last, _ in touched if last]) | F.col("last_date").isNull()  # opens these folders only
    kept = old.filter(days).filter(inside(touched)).join(fresh.select(*keys), keys, "left_anti")
    emptied = set(touched) - filled
    if emptied:
        emptied -= folders(kept.filter(inside(list(emptied))))
    kept.unionByName(fresh.select(*old.columns)).hint("rebalance", *DATE_LAYOUT).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*DATE_LAYOUT).parquet(path)
    for last, first in emptied:
        remove_folder(spark, f"{path}/{date_folder(last, first)}")
    spark.catalog.refreshByPath(path)
    return touched


def refresh_counts(old: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Rows before, after, and added."""
    both = old.select(F.lit(1).alias("before"), F.lit(0).alias("after")).unionByName(
        refreshed.select(F.lit(0).alias("before"), F.lit(1).alias("after")))
    return both.agg(F.sum("before").alias("rows_before"), F.sum("after").alias("rows_after"),
                    (F.sum("after") - F.sum("before")).alias("rows_new"))


def latest_wins(updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return last_per_key(updates, keys, order)
