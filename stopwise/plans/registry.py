"""Named queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stopwise.session import SETTINGS
from stopwise.sources.stand_ins import render
from stopwise.sources.tables import Tables

DELAYED = """
SELECT a.* EXCLUDE (raw_ar, raw_dp), coalesce(ar_pp, dp_pp) AS pp,
  CASE WHEN raw_dp >= -1 THEN raw_ar ELSE 0 END AS ar_delay, CASE WHEN raw_dp >= -1 THEN raw_dp ELSE 0 END AS dp_delay,
  (ar_cs IS NOT DISTINCT FROM 'c') AS ar_cancelled, (dp_cs IS NOT DISTINCT FROM 'c') AS dp_cancelled,
  (ar_cs IS DISTINCT FROM 'c' AND raw_ar IS NOT NULL) AS ar_happened,
  (dp_cs IS DISTINCT FROM 'c' AND raw_dp IS NOT NULL) AS dp_happened
FROM (SELECT *, CAST(floor((epoch(ar_ct) - epoch(ar_pt)) / 60) AS INT) AS raw_ar,
        CAST(floor((epoch(dp_ct) - epoch(dp_pt)) / 60) AS INT) AS raw_dp FROM stops) AS a
"""


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])
        return self.build(Tables(spark, folder))


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a query. ``views`` lists the stand-in views the SQL text uses."""

    def keep(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, build, with_views(sql, views) if sql else None)
        return build

    return keep


def with_views(sql: str, views: str) -> str:
    parts = []
    for view in views.split():
        if view == "delayed":
            if "stops" not in views.split():
                parts.append(f"stops AS ({render('stops', 'duckdb')})")
            parts.append(f"delayed AS ({DELAYED.strip()})")
        else:
            parts.append(f"{view} AS ({render(view, 'duckdb')})")
    text = sql.strip()
    if not parts:
        return text
    head = "WITH "
    if text[:14].upper() == "WITH RECURSIVE":
        head, text = "WITH RECURSIVE ", ", " + text[14:].strip()
    elif text[:5].upper() == "WITH ":
        text = ", " + text[5:].strip()
    return head + ",\n".join(parts) + "\n" + text
