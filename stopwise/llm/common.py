"""Helpers the operators share: stored tables, ranks inside classes, plain columns."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.session import fresh_path

ARROW_ROWS = "512"  # rows per Arrow batch, so that a batch of long texts stays small in a Python worker


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Python workers import this package: send it once per application, unless their path has it already."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "stopwise"), "zip", root, "stopwise")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Stored rows with a unique ``_row``: number of the writing task in the upper bits, position below."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()), name)


def rank_in_class(rows: DataFrame, cls: str, name: str = "rank") -> DataFrame:
    """0-based gapless rank of each row of a numbered table inside its class.

    Rows are ranked inside (task, class), which no class can make larger than a task's rows, and
    shifted by the counts of the tasks before: one row per task and class meets in a window.
    """
    task = F.shiftright("_row", 33)
    counts = rows.groupBy(F.col(cls), task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(cls).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(cls).alias("_c"), "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_task", cls).orderBy("_row"))
    ranked = rows.withColumn("_task", task).withColumn("_inside", inside)
    joined = ranked.join(offsets.withColumnRenamed("_task", "_t"), (F.col("_task") == F.col("_t")) & F.col(cls).eqNullSafe(F.col("_c")))
    return joined.withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_task", "_t", "_c", "_before", "_inside")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
