"""Integer codes for text columns, and scaling of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators.numbering import global_row_number
from stopwise.session import cut_lineage

UNKNOWN = -1


def build_encoders(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``name, value, code``: values of each column in text order from 0; the null value has -1.

    All columns are numbered in one pass: a value's code is its position among all
    (name, value) pairs minus the position of the first pair of its name.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = rows.select(F.inline(pairs)).filter("value is not null").distinct()
    placed = global_row_number(distinct, [F.col("name"), F.col("value")], "_n")
    first = placed.groupBy("name").agg(F.min("_n").alias("_first"))  # one row per column
    codes = placed.join(F.broadcast(first), "name").select("name", "value", (F.col("_n") - F.col("_first")).alias("code"))
    nulls = first.select("name", F.lit(None).cast("string").alias("value"), F.lit(UNKNOWN).cast("bigint").alias("code"))
    return cut_lineage(codes.unionByName(nulls))


def encode(rows: DataFrame, encoders: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    """Adds the code of each column; null and unknown values give -1.

    Whether a dictionary is broadcast is left to Spark's threshold on its bytes.
    """
    for column in columns:
        codes = encoders.filter((F.col("name") == column) & F.col("value").isNotNull()).select(
            F.col("value").alias(column), F.col("code").alias(f"{column}{suffix}"))
        rows = rows.join(codes, column, "left")
        rows = rows.withColumn(f"{column}{suffix}", F.coalesce(f"{column}{suffix}", F.lit(UNKNOWN)).cast("int"))
    return rows


def label_encode(rows: DataFrame, columns: list[str]) -> DataFrame:
    return encode(rows, build_encoders(rows, columns), columns)


def min_max_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(x - min) / (max - min)``; null where all values are equal.

    The bounds are one fetched row, so the scaled frame is a plain projection.
    """
    bounds = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(c: str) -> Column:
        low, high = F.lit(bounds[f"lo_{c}"]), F.lit(bounds[f"hi_{c}"])
        return (F.col(c) - low) / F.nullif(high - low, F.lit(0))

    return rows.withColumns({f"{c}_scaled": scaled(c) for c in columns})


def standard_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores with the population deviation; null where all values are equal."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("dev", F.stddev_pop))]).first()
    return rows.withColumns({
        f"{c}_scaled": (F.col(c) - F.lit(stats[f"avg_{c}"])) / F.nullif(F.lit(stats[f"dev_{c}"]), F.lit(0.0)) for c in columns})
