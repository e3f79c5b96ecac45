"""The levelled log, keyed lookups, messages sent twice, restarts, and alerts for silence."""

import datetime as dt
import random
import re
import time

from pyspark.sql import functions as F

from stopwise.streaming import feeds
from stopwise.streaming.log import BatchLog

NOON = dt.datetime(2024, 1, 1, 12)


def test_a_long_log_is_read_from_few_files(spark, tmp_path):
    rng, want = random.Random(1), {}
    log = BatchLog(spark, f"{tmp_path}/log", ["k"], fanout=3)
    for batch in range(14):
        rows = {rng.randrange(200): batch for _ in range(12)}
        want |= rows
        log.write(spark.createDataFrame(list(rows.items()), "k int, v int").coalesce(1), batch)
    assert {(r.k, r.v) for r in log.rows().collect()} == set(want.items())
    live = log.manifest()[1]
    assert len({r.folder for r in live}) <= 2 * 3 and max(r.level for r in live) == 2  # two folders of three at most in each level
    for k in (*list(want)[:3], 999):
        assert [(r.k, r.v) for r in log.lookup([k]).collect()] == ([(k, want[k])] if k in want else [])
        assert len(log.files_for([k])) <= 2 * 3 < len(live) or len(live) <= 2 * 3
    log.write(spark.createDataFrame([(5000, 0)], "k int, v int"), 0)  # a replay of a merged batch
    assert log.lookup([5000]).count() == 0
    log.write(spark.createDataFrame([(5000, 1)], "k int, v int"), 14)
    log.write(spark.createDataFrame([(5000, 1)], "k int, v int"), 14)
    assert [r.v for r in log.lookup([5000]).collect()] == [1]


def test_a_lookup_opens_the_folders_of_its_keys(spark, tmp_path):
    table = feeds.KeyBuckets(spark, f"{tmp_path}/t", "hash_id", buckets=16).append(spark.range(500).selectExpr("id as hash_id", "id * 2 as v"))
    table.append(spark.createDataFrame([(7, 0)], "hash_id bigint, v bigint"))
    found = table.rows(spark.createDataFrame([(7,), (7,), (8,), (9999,)], "hash_id bigint"))
    assert sorted((r.hash_id, r.v) for r in found.collect()) == [(7, 0), (7, 14), (8, 16)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    numbers, *_ = re.findall(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)", plan)
    assert len(numbers.split(",")) <= 3
    assert table.rows(spark.createDataFrame([], "hash_id bigint")).count() == 0


def test_keys_sent_twice_are_handled_once_also_after_a_restart(spark, tmp_path):
    path, target, offsets = (f"{tmp_path}/{n}" for n in ("keys", "out", "offsets"))
    handled = []

    def run():
        def transform(keys):
            handled.append(sorted(r.hash_id for r in keys.collect()))
            return keys

        feed = feeds.once(feeds.read_feed(spark, path, feeds.KEY_FEED), ["hash_id"])
        feeds.start_upserts(feed, ["hash_id"], [F.col("at")], target, offsets, transform).awaitTermination()

    first = spark.createDataFrame([(1,), (2,)], "hash_id bigint")
    feeds.publish_keys(first, path, NOON)
    feeds.publish_keys(first, path, NOON)
    run()
    feeds.publish_keys(first, path, NOON)  # the publisher tries again after the restart
    feeds.publish_keys(spark.createDataFrame([(2,), (3,)], "hash_id bigint"), path, NOON + dt.timedelta(minutes=5))
    run()
    assert handled == [[1, 2], [2, 3]]  # the later change of 2 is handled, the repeated messages are not
    assert sorted(r.hash_id for r in feeds.current_rows(spark, target, ["hash_id"]).collect()) == [1, 2, 3]


def test_an_alert_for_silence_needs_no_row(spark, tmp_path):
    path = f"{tmp_path}/ticks"
    now = int(time.time())
    spark.createDataFrame([("plans", now - 6), ("plans", now - 6), ("plans", now)], "feed string, s bigint").selectExpr(
        "feed", "cast(timestamp_seconds(s) as timestamp_ntz) as ts").write.parquet(path)
    feed = feeds.read_feed(spark, path, "feed string, ts timestamp_ntz")
    alerts = feeds.silence_alerts(feed, 2, dt.timedelta(seconds=2))
    stream = alerts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/offsets").trigger(processingTime="1 second").start(f"{tmp_path}/alerts")
    deadline, rows = time.time() + 60, []
    while time.time() < deadline and sum(r.n == 0 for r in rows) < 5:
        time.sleep(2)
        rows = spark.read.schema(feeds.SILENCE).parquet(f"{tmp_path}/alerts").collect() if stream.lastProgress else []
    stream.stop()
    rows.sort(key=lambda r: r.period)
    first = dt.datetime.fromtimestamp((now - 6) // 2 * 2, dt.timezone.utc).replace(tzinfo=None)
    assert [(r.period - first).total_seconds() for r in rows] == [2 * (k + 1) for k in range(len(rows))]  # the first period had two rows
    assert [r.n for r in rows][:3] == [0, 0, 1] and sum(r.n == 0 for r in rows) >= 5  # periods without any row, by the clock


def test_no_task_merges_more_rows_than_it_should(spark, tmp_path, monkeypatch):
    from stopwise.streaming import log as module

    monkeypatch.setattr(module, "ROWS_PER_TASK", 50, raising=False)
    log = BatchLog(spark, f"{tmp_path}/log", ["k"], fanout=4)
    for batch in range(4):
        log.write(spark.range(batch * 90, batch * 90 + 100).selectExpr("id as k", f"{batch} as v", "'x' as w"), batch)
    live = log.manifest()[1]
    assert {r.level for r in live} == {1} and len(live) >= 6  # 400 rows, which one task used to sort and write
    rows = log.rows(["v"])
    assert rows.columns == ["k", "v"] and rows.rdd.getNumPartitions() >= 7
    assert {(r.k, r.v) for r in rows.collect()} == {(k, min(k // 90, 3)) for k in range(370)}
    table = feeds.KeyBuckets(spark, f"{tmp_path}/t", "k", buckets=4).append(spark.range(500).selectExpr("id as k", "id * 2 as v"))
    found = table.rows(spark.range(300).selectExpr("id as k"))
    assert found.rdd.getNumPartitions() == 6 and {(r.k, r.v) for r in found.collect()} == {(k, 2 * k) for k in range(300)}
