"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators.clean import OBSTACLE_COLUMNS, is_cancelled


def keep_active_groups(groups: DataFrame) -> DataFrame:
    """Groups in which at least one arrival or departure happened."""
    return groups.filter((F.col("ar_happened_sum") > 0) | (F.col("dp_happened_sum") > 0))


def drop_null_group(groups: DataFrame, key: str) -> DataFrame:
    return groups.filter(F.col(key).isNotNull())


def has_obstacle() -> Column:
    """Any obstacle length above 0; null counts as none."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in OBSTACLE_COLUMNS])


def without_outliers(stops: DataFrame) -> DataFrame:
    return stops.filter(F.col("ar_delay").between(-5, 100) & F.col("dp_delay").between(-1, 100))


def open_interval(rows: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    return rows.filter((F.col(column) > low) & (F.col(column) < high))


def in_list(rows: DataFrame, column: str, values: list) -> DataFrame:
    return rows.filter(F.col(column).isin(values))


def not_in_list(rows: DataFrame, column: str, values: list) -> DataFrame:
    return rows.filter(~F.col(column).isin(values))


def substring_search(names: DataFrame, column: str, text: str, first: int = 20) -> DataFrame:
    """Case-insensitive contains; the first matches in name order."""
    return names.filter(F.lower(column).contains(text.lower())).orderBy(column).limit(first)


def usable_for_label(stops: DataFrame, end: str) -> DataFrame:
    """Rows with a known delay, or cancelled."""
    return stops.filter(F.col(f"{end}_delay").isNotNull() | is_cancelled(F.col(f"{end}_cs")))


def with_coordinates(points: DataFrame) -> DataFrame:
    return points.dropna(subset=["lat", "lon"])


def construction_only(works: DataFrame) -> DataFrame:
    return works.filter((F.col("category") == 1) & (F.col("source") != F.col("target")))


def match_review(matches: DataFrame, near_m: float = 1000, far_m: float = 10000) -> DataFrame:
    """Matches by place that are neither clear nor absurd and whose names differ."""
    return matches.filter((F.col("distance_m") > near_m) & (F.col("distance_m") < far_m) & (F.col("similarity") < 1))
