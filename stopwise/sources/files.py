"""Reading and writing files: Parquet, CSV, JSON text, XML text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


DATE_LAYOUT = ["last_date", "first_date"]


def with_dates(stops: DataFrame) -> DataFrame:
    """Adds first_time and last_time of arrival and departure, and their dates to partition by; null without any time."""
    first, last = F.least("ar_pt", "dp_pt"), F.greatest("ar_pt", "dp_pt")  # both skip nulls
    return stops.withColumns({"first_time": first, "last_time": last, "last_date": F.to_date(last), "first_date": F.to_date(first)})


def write_by_date(stops: DataFrame, path: str) -> str:
    """Folders by date, so that a question about some days opens only those."""
    with_dates(stops).hint("rebalance", *DATE_LAYOUT).write.partitionBy(*DATE_LAYOUT).parquet(path)
    return path


def date_folder(last: dt.date | None, first: dt.date | None) -> str:
    name = lambda day: "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
    return f"last_date={name(last)}/first_date={name(first)}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Through the file system of the path, which need not be a local one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def in_date_range(stops: DataFrame, min_date: dt.datetime | None = None,
                  max_date: dt.datetime | None = None) -> DataFrame:
    """Arrival or departure on or after ``min_date``, and arrival or departure before ``max_date``.

    A table stored by date is filtered by its folders first: one of two times is late enough if the later
    one is, and early enough if the earlier one is.
    """
    keep: list[Column] = []
    if set(DATE_LAYOUT) <= set(stops.columns):
        if min_date is not None:
            keep += [F.col("last_date") >= F.lit(min_date.date()), F.col("last_time") >= F.lit(min_date).cast("timestamp_ntz")]
        if max_date is not None:
            keep += [F.col("first_date") <= F.lit(max_date.date()), F.col("first_time") < F.lit(max_date).cast("timestamp_ntz")]
        for condition in keep:
            stops = stops.filter(condition)
        return stops
    return stops.filter(date_range(min_date, max_date))


def date_range(min_date: dt.datetime | None = None, max_date: dt.datetime | None = None) -> Column:
    """The same range as a condition on the planned times."""
    keep = F.lit(True)
    if min_date is not None:
        low = F.lit(min_date).cast("timestamp_ntz")
        keep = keep & ((F.col("ar_pt") >= low) | (F.col("dp_pt") >= low))
    if max_date is not None:
        high = F.lit(max_date).cast("timestamp_ntz")
        keep = keep & ((F.col("ar_pt") < high) | (F.col("dp_pt") < high))
    return keep


def long_distance(stops: DataFrame) -> DataFrame:
    return stops.filter(F.col("f") == "F")


def load_stops(stops: DataFrame, columns: list[str] | None = None, min_date: dt.datetime | None = None,
               max_date: dt.datetime | None = None, long_distance_only: bool = False) -> DataFrame:
    """Filters come before the projection, so they may use columns that are not returned."""
    found = in_date_range(stops, min_date, max_date)
    if long_distance_only:
        found = long_distance(found)
    return found.select(*columns) if columns else found


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header and a given schema, so nothing is read twice to guess types."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True).withColumnsRenamed(rename or {})


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.csv(path, sep=sep, header=True)
    return path


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))


def parse_xml(df: DataFrame, column: str, schema: str) -> DataFrame:
    """XML text to a struct: attributes are plain fields, repeated tags become arrays."""
    return df.withColumn(column, F.from_xml(column, F.lit(schema), {"attributePrefix": ""}))


# fixed values: markup of the attribute tables
ATTRIBUTE_NAME = r'<span class="atr-name">(.*?)</span>'
ATTRIBUTE_VALUE = r'<span class="atr-value">(.*?)</span>'


def html_attributes(df: DataFrame, html: str, names: list[str], name_pattern: str = ATTRIBUTE_NAME,
                    value_pattern: str = ATTRIBUTE_VALUE) -> DataFrame:
    """One column per name in ``names``; the i-th name belongs to the i-th value, the last one wins."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(name_pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all(html, F.lit(value_pattern), F.lit(1)).alias("value"))
    staged = df.withColumn("_pairs", pairs)
    pick = lambda n: F.try_element_at(F.filter("_pairs", lambda p: p["name"] == n), F.lit(-1))["value"]
    return staged.withColumns({n: pick(n) for n in names}).drop("_pairs")


# fixed values: rows that make a key worth another file, and files that a task writes
FILE_ROWS = 1_000_000
FILES_PER_TASK = 200


def write_partitioned(df: DataFrame, path: str, key: str, file_rows: int = FILE_ROWS) -> str:
    """One folder per key, as deep in files as its rows need. Opening files takes most of the time, so tasks are dealt by
    files and not by bytes, and each puts its files in place itself instead of leaving all of them to the driver."""
    files = F.ceil(F.count(F.lit(1)) / file_rows)
    counts = df.groupBy(key).agg(files.alias("_files"))
    number = counts.agg(F.sum("_files")).first()[0] or 1
    tasks = max(min(number, df.sparkSession.sparkContext.defaultParallelism), -(-number // FILES_PER_TASK))
    hot = counts.filter("_files > 1").withColumnRenamed(key, "_key")  # one row per file_rows rows at most
    spread = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left")
    part = F.when(F.col("_files").isNotNull(), F.pmod(F.xxhash64(*df.columns), F.col("_files"))).otherwise(0)
    dealt = spread.repartition(tasks, F.col(key), part).select(*df.columns)
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).parquet(path)
    return path


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A table of many folders: they are listed by a few tasks per core, not by a task each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(name, before)


def write_compact(df: DataFrame, path: str, files: int = 100) -> str:
    df.repartition(files).write.parquet(path)
    return path


def append_rows(df: DataFrame, path: str) -> str:
    df.write.mode("append").parquet(path)
    return path
