"""One row per key, set operations, and checks on keys.

Picking a row is an aggregate (``max_by`` / ``min_by``), so equal keys shrink on
the map side and a hot key never lands in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(rows: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    choose = F.max_by if last else F.min_by
    picked = rows.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest ``order``, which must be unique within a key."""
    return _pick(rows, keys, order, last=True)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(rows, keys, order, last=False)


def union_by_rank(frames: list[DataFrame], keys: list[str], order: list[str], last_wins: bool) -> DataFrame:
    """Union of frames where the first (or last) frame with a key wins; ``order`` decides inside one frame."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    rows = ranked[0]
    for frame in ranked[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return _pick(rows, keys, [F.col("_rank"), *map(F.col, order)], last_wins).drop("_rank")


def union_first_wins(frames: list[DataFrame], keys: list[str], order: list[str] = ()) -> DataFrame:
    return union_by_rank(frames, keys, list(order), last_wins=False)


def union_last_wins(frames: list[DataFrame], keys: list[str], order: list[str] = ()) -> DataFrame:
    return union_by_rank(frames, keys, list(order), last_wins=True)


def keys_with_many_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break the rule of at most one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches")).filter("matches > 1")


def only_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows plus ``is_only_version``: the key has exactly one row."""
    counts = rows.groupBy(*keys).agg((F.count(F.lit(1)) == 1).alias("is_only_version"))
    return rows.join(counts, keys)


def duplicate_count(rows: DataFrame, key: str) -> DataFrame:
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def unmatched_keys(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys without a partner."""
    return rows.select(*keys).distinct().join(known, keys, "left_anti")
