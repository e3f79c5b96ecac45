"""Model input: features, labels and splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators import clean, encoding
from stopwise.operators.numbering import exact_samples, sample_key
from stopwise.sources.files import in_date_range

CATEGORICAL = ["station", "o", "c", "n", "pp"]
BASE = ["station", "lat", "lon", "o", "c", "n", "distance_to_start", "distance_to_end", "pp", "stop_id", "minute", "day", "stay_time"]
THRESHOLDS = range(15)


def ml_frame(stops: DataFrame, encode: bool = True, status: bool = False, times: bool = False, date_id: bool = False,
             keep: tuple[str, ...] = (), encoders: DataFrame | None = None) -> DataFrame:
    """The 13 base features, the 6 obstacle lengths and both delays; text columns as codes."""
    columns = [*keep, *BASE, *clean.OBSTACLE_COLUMNS, "ar_delay", "dp_delay"]
    columns += ["ar_cs", "dp_cs"] if status else []
    columns += ["ar_pt", "ar_ct", "dp_pt", "dp_ct"] if times else []
    columns += ["date_id"] if date_id else []
    frame = clean.fill_obstacles(clean.time_features(stops)).select(*columns)
    if not encode:
        return frame
    encoders = encoders if encoders is not None else encoding.build_encoders(stops, CATEGORICAL)
    coded = encoding.encode(frame, encoders, CATEGORICAL)
    return coded.select(*[F.col(f"{c}_code").alias(c) if c in CATEGORICAL else F.col(c) for c in columns])


def delay_labels(thresholds=THRESHOLDS) -> dict[str, Column]:
    """``ar_m``: arrived at most m minutes late; ``dp_m+1``: left at least m+1 minutes late; cancelled never counts."""
    happened = {e: ~clean.is_cancelled(F.col(f"{e}_cs")) for e in clean.ENDS}
    labels = {f"ar_{m}": F.coalesce(F.col("ar_delay") <= m, F.lit(False)) & happened["ar"] for m in thresholds}
    labels |= {f"dp_{m + 1}": F.coalesce(F.col("dp_delay") >= m + 1, F.lit(False)) & happened["dp"] for m in thresholds}
    return labels


def split_by_date(stops: DataFrame, current: dt.datetime, train_days: int, test_days: int = 14) -> tuple[DataFrame, DataFrame]:
    """The days before ``current`` and the days after it."""
    train = in_date_range(stops, current - dt.timedelta(days=train_days), current)
    return train, in_date_range(stops, current, current + dt.timedelta(days=test_days))


def random_split(rows: DataFrame, key: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """Adds ``is_train`` from a hash of the key: the same row always falls on the same side."""
    bucket = F.conv(F.substring(sample_key(F.col(key), seed), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("is_train", bucket < int(share * 2 ** 32))


def fold_of(key: Column, folds: int = 5, seed: int = 0) -> Column:
    return (F.conv(F.substring(sample_key(key, seed), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def balance_undersample(rows: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """All rows of the rarer class and an equally large sample of the other, for a 0/1 label."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.select(F.col(label).alias("sample"), F.lit(counts.agg(F.min("n")).first()[0]).alias("size"))
    return exact_samples(rows.filter(F.col(label).isNotNull()), key, sizes, seed, group=label).drop("sample")


def held_out(rows: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """Train on all other values of a column, test on one."""
    same = F.col(column).eqNullSafe(F.lit(value))
    return rows.filter(~same), rows.filter(same)
