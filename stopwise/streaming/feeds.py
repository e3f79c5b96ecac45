"""Change feeds with Structured Streaming.

Sources are file drops (or any stream with the same columns); offsets live in the
checkpoint. Keyed results are a log of batches (``BatchLog``): a replayed batch replaces
itself, and readers take the newest batch per key of a few merged folders. Messages that a
publisher sent twice are dropped by keyed state that forgets after a watermark.
Tables that a stream looks keys up in are stored by key bucket, so a
micro-batch opens only the folders of its keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stopwise.operators import clean
from stopwise.operators.dedup import last_per_key
from stopwise.session import fresh_path
from stopwise.streaming.log import BatchLog, dealt


def read_feed(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


KEY_FEED = "hash_id bigint, at timestamp"


def publish_keys(keys: DataFrame, path: str, at: dt.datetime | None = None) -> str:
    """Append changed keys to a feed folder, with the time of their publication; a retry passes the same time."""
    told = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    keys.select("hash_id", told.alias("at")).write.mode("append").parquet(path)
    return path


def once(feed: DataFrame, keys: list[str], time: str = "at", late: str = "1 hour") -> DataFrame:
    """A stream without the messages that came before; state is kept for ``late`` behind the newest time."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, time])


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current rows of a plain log of ``batch_id`` folders: the newest batch wins per key."""
    log = spark.read.parquet(path)
    return last_per_key(log, keys, [F.col("batch_id")]).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: list[str]) -> str:
    """The current rows as the first batch of a new plain log."""
    target = fresh_path(spark, "log")
    write_batch(latest_rows(spark, path, keys), 0, target)
    return target


def current_rows(spark: SparkSession, path: str, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Current rows of what ``start_upserts`` has written, or some columns of them."""
    return BatchLog(spark, path, keys).rows(columns)


class KeyBuckets:
    """A table in folders by bucket of its key: rows of a few keys are found in the folders of their buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> KeyBuckets:
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return self

    def rows(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys in ``keys``, as the table is now; folders of other buckets are not listed in the plan.

        Both sides are dealt by the key alone, so that a join of two tables on it needs no other shuffle.
        """
        wanted = keys.select(self.key).distinct()
        counts = {r.bucket: r["count"] for r in wanted.groupBy(self.bucket().alias("bucket")).count().collect()}  # at most ``buckets`` rows
        stored = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(sorted(counts))).drop("bucket")
        deal = lambda rows: dealt(rows, [self.key], sum(counts.values()))
        return deal(stored).join(deal(wanted), [self.key], "left_semi")


def start_upserts(feed: DataFrame, keys: list[str], order: list[Column], target: str, checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame] | None = None, seconds: int | None = None) -> StreamingQuery:
    """Stream ``feed`` into a batch log; within a batch the greatest ``order`` wins per key.

    ``transform`` maps the deduplicated batch to the rows to store. Without ``seconds``
    the query handles what is there and ends, else it runs on at that interval.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():  # a batch that only moves the watermark
            return
        rows = last_per_key(batch, keys, order)
        BatchLog(batch.sparkSession, target, keys).write(transform(rows) if transform else rows, batch_id)

    writer = feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def parse_changed_keys(plan: KeyBuckets, change: KeyBuckets) -> Callable[[DataFrame], DataFrame]:
    """Transform for a feed of keys: plan and change of the keys as they are now, parsed, with delays."""
    def transform(keys: DataFrame) -> DataFrame:
        return clean.add_delays(clean.parse_stops(plan.rows(keys), change.rows(keys)))

    return transform


def continuous_parse(keys: DataFrame, plan: KeyBuckets, change: KeyBuckets, target: str, checkpoint: str,
                     seconds: int | None = 60, late: str = "1 hour") -> StreamingQuery:
    """Parse changed stops as their keys arrive; a message sent twice is parsed once, a later change of a key again."""
    return start_upserts(once(keys, ["hash_id"], late=late), ["hash_id"], [F.col("at")], target, checkpoint, parse_changed_keys(plan, change), seconds)


def hourly_counts(rows: DataFrame, time: str = "ts", late: str | None = None) -> DataFrame:
    """Rows per hour; with ``late`` set (streams) rows older than that are dropped by watermark."""
    if late:  # watermarks need a zoned timestamp
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = rows.groupBy(F.window(time, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


# fixed values: least rows per hour
PLAN_PER_HOUR = 500
CHANGE_PER_HOUR = 1000


def every_hour(counts: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Counts of all hours from the first one to ``as_of`` (or the last one), 0 where no row came."""
    end = F.max("hour") if as_of is None else F.date_trunc("hour", F.lit(as_of)).cast("timestamp_ntz")
    bounds = counts.agg(F.min("hour").alias("first"), end.alias("last")).filter("first <= last")
    hours = bounds.select(F.explode(F.expr("sequence(first, last, interval 1 hour)")).alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def freshness_alert(counts: DataFrame, threshold: int, what: str, as_of: dt.datetime | None = None) -> DataFrame:
    """Hours with too few rows, silent ones too, with a text for people. Of a stream, its written counts are read here."""
    counts = every_hour(counts, as_of)
    text = F.format_string(f"%d {what} in the hour from %s, expected at least {threshold}", F.col("n"),
                           F.date_format("hour", "yyyy-MM-dd HH:mm"))
    return counts.filter(F.col("n") < threshold).select("hour", "n", text.alias("alert"))


SILENCE = "feed string, period timestamp_ntz, n bigint"


def silence_alerts(feed: DataFrame, threshold: int, period: dt.timedelta, name: str = "feed", time: str = "ts") -> DataFrame:
    """Stream of periods with fewer than ``threshold`` rows, also of those in which no row came at all.

    State is one open period and its count per feed. A row of a later period closes the open one and reports the silent ones between.
    When no row comes for a period, a timer of the state store closes the open one by the clock, again and
    again until a row comes; a row of a period already closed is late and changes nothing.
    """
    seconds = int(period.total_seconds())

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []

        def close(number: int, rows: int) -> None:
            if rows < threshold:
                out.append((key[0], pd.Timestamp(number * seconds, unit="s"), rows))

        if state.hasTimedOut:
            number, rows = state.get
            close(number, rows)
            number, rows = number + 1, 0
        else:
            counts = pd.concat(list(batches)).groupby("period").size()
            number, rows = state.get if state.exists else (int(counts.index.min()), 0)
            for found, n in counts.sort_index().items():
                while number < found:
                    close(number, rows)
                    number, rows = number + 1, 0
                rows += int(n) if found == number else 0
        state.update((number, rows))
        state.setTimeoutDuration(1000 * seconds)
        yield pd.DataFrame(out, columns=["feed", "period", "n"])

    number = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds).cast("bigint")
    rows = feed.select(F.col(name).cast("string").alias("feed"), number.alias("period"))
    return rows.groupBy("feed").applyInPandasWithState(watch, SILENCE, "number bigint, rows bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
