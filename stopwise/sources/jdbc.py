"""Scans and writes over JDBC; the driver jar comes with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def range_options(url: str, table: str, key: str, lower: int, upper: int, partitions: int = 200) -> dict[str, str]:
    """Options of a scan in ``partitions`` key ranges."""
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": "20000"}


def read_ranges(spark: SparkSession, url: str, table: str, key: str = "hash_id", lower: int = -(2 ** 63),
                upper: int = 2 ** 63 - 1, partitions: int = 200, **more: str) -> DataFrame:
    options = {**range_options(url, table, key, lower, upper, partitions), **more}
    return spark.read.format("jdbc").options(**options).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "overwrite", batch: int = 10000, **more: str) -> None:
    options = {"url": url, "dbtable": table, "batchsize": str(batch), "truncate": "true", **more}
    df.write.format("jdbc").options(**options).mode(mode).save()
