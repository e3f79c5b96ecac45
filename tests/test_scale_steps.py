"""Steps whose cost grew faster than their tables."""

from threading import Barrier

from pyspark.sql import functions as F

from stopwise.functions import timecols
from stopwise.operators import models, ranges
from stopwise.plans import nested
from stopwise.sources.tables import Tables


def test_routes_are_spread_before_they_become_texts(spark, folder):
    plan = nested.make_connections(Tables(spark, folder))._jdf.queryExecution().analyzed().toString()
    assert plan.index("to_json") < plan.index("Repartition")  # the plan reads from its end to its start


def test_durations_have_two_digits_for_minutes(spark):
    rows = spark.createDataFrame([(0,), (59,), (60,), (3600 * 23 + 540,), (90000,), (-60,), (-90000,), (200000,), (None,)], "s long")
    told = [r[0] for r in rows.select(timecols.duration_text(F.col("s"))).collect()]
    assert told == ["0:00", "0:00", "0:01", "23:09", "1 day, 1:00", "-1 day, 23:59", "-2 days, 23:00", "2 days, 7:33", None]


def test_works_of_a_week_are_met_by_one_row_per_use(spark, monkeypatch):
    day = 86400
    works = [(w % 3, 24, 1.0, w * 5000, w * 5000 + (1 + w % 7) * day) for w in range(40)] + [(1, 37, 2.0, 0, 60 * day)]
    uses = [(k, k % 3, k * 9000) for k in range(60)]
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz").alias(c)
    obstacles = spark.createDataFrame(works, "edge_id long, priority int, length double, from_time long, to_time long").select(
        "edge_id", "priority", "length", at("from_time"), at("to_time"))
    widths = []
    monkeypatch.setattr(ranges, "point_in_interval_join", lambda *a, real=ranges.point_in_interval_join, **k: widths.append(k["width"]) or real(*a, **k))
    found = ranges.obstacles_on_edges(spark.createDataFrame(uses, "k long, edge_id long, at long").select("k", "edge_id", at("at")), obstacles, "at")
    expected = sorted((k, p) for k, e, t in uses for f, p, _, low, high in works if e == f and low <= t <= high)
    assert sorted((r.k, r.priority) for r in found.collect()) == expected
    assert widths == [7 * day]


def test_classifiers_are_fitted_side_by_side(spark, monkeypatch):
    both = Barrier(2, timeout=20)  # breaks when one fit waits for the other to end
    monkeypatch.setattr(models, "classifiers", lambda *a, **k: {"one": (1.0, False), "two": (0.5, True)})
    monkeypatch.setattr(models, "fit", lambda train, columns, classifier, scaled: both.wait() * 0 + classifier)
    monkeypatch.setattr(models, "accuracy", lambda model, test, columns: model)
    rows = spark.createDataFrame([(1.0, 1), (5.0, 0), (None, 0)], "x double, label int")
    told = models.compare_classifiers(rows, rows, ["x"]).collect()
    assert [tuple(r) for r in told[:2]] == [("one", 1.0), ("two", 0.5)] and told[2].classifier == "nearest_centroid"
