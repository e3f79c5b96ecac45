"""History-keeping update of the station dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.operators.lookup import with_open_validity

COLUMNS = ["eva", "name", "ds100", "valid_from", "valid_to", "platforms", "db", "iris"]
PLACE = ["lat", "lon", "number_of_events"]  # kept through versions, where the table has them


def scd2_update(current: DataFrame, incoming: DataFrame, now: dt.datetime) -> DataFrame:
    """New versions of the dimension at ``now``.

    ``current`` holds COLUMNS, and may hold PLACE and meta; ``incoming`` eva, name, ds100, created, platforms, db,
    and may hold meta. Gone stations are closed, those closed before stay as they were; unknown ones start at their creation; unchanged
    ones get new attributes; changed ones are closed and continue in a new version.
    A station with a single version starts no earlier than its creation.
    """
    now_ts = F.lit(now).cast("timestamp_ntz")
    place, meta = [c for c in PLACE if c in current.columns], [c for c in ("meta",) if c in current.columns]
    columns = [*COLUMNS, *place, *meta]
    rows = with_open_validity(current).select(*columns)
    versions = rows.groupBy("eva").agg(F.max("valid_from").alias("_latest"), F.count(F.lit(1)).alias("_versions"))
    marked = rows.join(versions, "eva")
    older = marked.filter("valid_from < _latest").select(*columns)
    latest = marked.filter("valid_from = _latest").drop("_latest")
    told = [c for c in meta if c in incoming.columns]
    new = incoming.select("eva", *[F.col(c).alias(f"in_{c}") for c in ("name", "ds100", "created", "platforms", "db", *told)], F.lit(True).alias("in_known"))
    both = latest.join(new, "eva", "full_outer")
    known, found = F.col("name").isNotNull() | F.col("valid_from").isNotNull(), F.coalesce("in_known", F.lit(False))
    same = F.col("in_name").eqNullSafe(F.col("name")) & F.col("in_ds100").eqNullSafe(F.col("ds100"))
    later = (F.col("_versions") == 1) & (F.col("in_created") > F.col("valid_from"))
    start = F.when(found & later, F.col("in_created")).otherwise(F.col("valid_from"))
    pick = lambda column: F.when(found & same, F.col(f"in_{column}")).otherwise(F.col(column))
    kept = F.struct(
        "eva", "name", "ds100", start.alias("valid_from"), F.when((found & same) | (F.col("valid_to") <= now_ts), F.col("valid_to")).otherwise(now_ts).alias("valid_to"),
        pick("platforms").alias("platforms"), pick("db").alias("db"),
        F.when(~found, F.lit(False)).when(same, F.lit(True)).otherwise(F.col("iris")).alias("iris"),
        *place, *[(pick(c) if c in told else F.col(c)).alias(c) for c in meta])
    forever = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))
    added = F.struct(
        "eva", F.col("in_name").alias("name"), F.col("in_ds100").alias("ds100"),
        F.when(known, now_ts).otherwise(F.col("in_created")).alias("valid_from"), forever.alias("valid_to"),
        F.col("in_platforms").alias("platforms"), F.col("in_db").alias("db"), F.lit(True).alias("iris"),
        *place, *[F.col(f"in_{c}" if c in told else c).alias(c) for c in meta])
    versions_now = F.array_compact(F.array(F.when(known, kept), F.when(found & ~F.coalesce(known & same, F.lit(False)), added)))
    return older.unionByName(both.select(F.inline(versions_now)))
