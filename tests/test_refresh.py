"""A refresh by date folder gives the rows of the plain one and leaves other folders alone."""

import datetime as dt
import os

from stopwise.operators import upsert
from stopwise.sources import files

DAY = lambda d, h=12: dt.datetime(2024, 1, d, h)


def tree(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_folders_keep_their_files(spark, tmp_path):
    schema = "k int, v string, ar_pt timestamp_ntz, dp_pt timestamp_ntz"
    old = spark.createDataFrame([(1, "a", DAY(1), DAY(1)), (2, "b", DAY(2), None), (3, "c", DAY(5), DAY(6, 1)), (4, "d", DAY(9), DAY(9)), (5, "e", None, None), (6, "f", DAY(3), None)], schema)
    source = spark.createDataFrame([(1, "A", DAY(1), DAY(1)), (4, "D", DAY(10), DAY(10)), (7, "G", DAY(8), DAY(8)), (6, "F", DAY(12), None), (8, "H", None, DAY(11))], schema)
    path = files.write_by_date(old, f"{tmp_path}/t")
    before, want = tree(path), upsert.incremental_refresh(old, source, ["k"]).collect()
    touched = upsert.refresh_by_date(spark, path, source, ["k"])
    found = spark.read.parquet(path).select(*old.columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, want), key=str) and {r.v for r in found} == {"a", "b", "c", "e", "D", "G", "F", "H"}
    days = {str(last) for last, _ in touched}
    assert days == {"2024-01-03", "2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11", "2024-01-12"}
    after = tree(path)
    same = {f for f in before if not any(f"last_date={d}" in f for d in days)}
    assert len(same) == 4 and all(after.get(f) == before[f] for f in same)
    assert not any("last_date=2024-01-09" in f or "last_date=2024-01-03" in f for f in after)  # emptied folders are gone


def test_the_first_refresh_takes_everything(spark, tmp_path):
    schema = "k int, v string, ar_pt timestamp_ntz, dp_pt timestamp_ntz"
    source = spark.createDataFrame([(1, "a", DAY(1), None), (2, "b", None, None)], schema)
    path = files.write_by_date(spark.createDataFrame([(9, "z", None, None), (2, "y", None, None)], schema), f"{tmp_path}/t")
    upsert.refresh_by_date(spark, path, source, ["k"])
    again = spark.read.schema(source.schema).parquet(path)
    assert {(r.k, r.v) for r in again.collect()} == {(9, "z"), (1, "a"), (2, "b")}
