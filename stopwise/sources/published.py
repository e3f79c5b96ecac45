"""Small result tables: generate once, publish, read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopwise.session import fresh_path


def publish_table(df: DataFrame, name: str) -> DataFrame:
    """Replace table ``name``. Rows go to a new folder first, then the catalog entry moves there in one step.

    Only a table with other columns is made anew. The former folder stays for readers that still use it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if spark.catalog.tableExists(name):
        if [f.jsonValue()["type"] for f in spark.table(name).schema] == [f.jsonValue()["type"] for f in df.schema] and spark.table(name).columns == df.columns:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(name)
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    return spark.catalog.createTable(name, path=path, source="parquet")


def materialized_table(spark: SparkSession, name: str, table_generator: Callable[[], DataFrame] | None = None,
                       source: Callable[[], DataFrame] | None = None, use_cache: bool = True,
                       prefer_cache: bool = False, generate: bool = False, push: bool = True) -> DataFrame:
    """Read-through access to a published table.

    Forced generation comes first, then a preferred published copy, then the
    source (whose rows are published again), then any published copy, then the
    generator; with none of them the table does not exist.
    """
    def build() -> DataFrame:
        if table_generator is None:
            raise ValueError(f"no generator for table {name}")
        made = table_generator()
        return publish_table(made, name) if push else made

    if generate:
        return build()
    published = spark.catalog.tableExists(name)
    if prefer_cache and published:
        return spark.table(name)
    if source is not None:
        found = source()
        return publish_table(found, name) if use_cache else found
    if use_cache and published:
        return spark.table(name)
    if table_generator is not None:
        return build()
    raise FileNotFoundError(f"table {name} is neither published nor can it be made")
