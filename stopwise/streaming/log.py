"""A keyed log of micro-batches that stays quick to read: levels of sorted segments.

Each micro-batch writes one folder of level 0. When a level has ``fanout`` folders, they are merged into one folder of the
next level, newest row per key, sorted by the first key. So a reader opens at most ``fanout`` folders per level, and
there are as many levels as digits in the number of batches. A row is rewritten once per level, not once per batch.

What is live stands in a manifest, written whole after every change under a new number; folders are never changed in
place, so a reader that holds an older manifest still finds its files, and a replayed batch replaces itself.
The manifest has the key range of every file, and files have a Bloom filter on the first key: a lookup
opens only files whose range holds one of its keys, and in them only row groups whose filter does.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.operators.dedup import last_per_key

FANOUT = 8
ROWS_PER_TASK = 200_000  # of the newest rows that one task puts together
MANIFEST = "level int, last_batch bigint, folder string, file string, low string, high string"


def tasks_for(number: int) -> int:
    return -(-number // ROWS_PER_TASK)


def dealt(rows: DataFrame, keys: list[str], number: int) -> DataFrame:
    """Rows dealt by key to more tasks than a shuffle has, if there are too many rows for these."""
    tasks = tasks_for(number)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


class BatchLog:
    """Keyed rows below ``path``. Key values are compared as text in the ranges of the manifest."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fanout: int = FANOUT):
        self.spark, self.path, self.keys, self.fanout = spark, path.rstrip("/"), keys, fanout

    def manifest(self) -> tuple[int, list]:
        """Number and rows of the newest manifest; one row per live file."""
        try:
            told = self.spark.read.schema(MANIFEST + ", version bigint").json(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        newest = told.agg(F.max("version")).first()[0] or 0
        return newest, told.filter(F.col("version") == newest).drop("version").collect()

    def record(self, version: int, rows: list) -> None:
        frame = self.spark.createDataFrame([tuple(r) for r in rows], MANIFEST)
        frame.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")

    def described(self, level: int, last_batch: int, folder: str) -> list[tuple]:
        """Key range of every file of a folder, from its key column alone."""
        key = F.col(self.keys[0]).cast("string")
        files = self.spark.read.parquet(folder).select(F.input_file_name().alias("file"), key.alias("k")).groupBy("file")
        found = [(level, last_batch, folder, r.file, r.low, r.high) for r in files.agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()]
        return found or [(level, last_batch, folder, None, None, None)]

    def put(self, rows: DataFrame, folder: str) -> None:
        option = f"parquet.bloom.filter.enabled#{self.keys[0]}"
        rows.write.mode("overwrite").option(option, "true").parquet(folder)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch, which has one row per key, and merge levels that are full."""
        version, live = self.manifest()
        folder = f"{self.path}/level=0/batch={batch_id}"
        if any(r.level > 0 and r.last_batch >= batch_id for r in live):
            return  # a replay of a batch that has been merged already
        self.put(rows, folder)
        live = [tuple(r) for r in live if r.folder != folder] + self.described(0, batch_id, folder)
        version += 1
        self.record(version, live)
        level = 0
        while len({r[2] for r in live if r[0] == level}) >= self.fanout:
            live = self.merged(live, level)
            version, level = version + 1, level + 1
            self.record(version, live)

    def merged(self, live: list[tuple], level: int) -> list[tuple]:
        """The folders of a level as one folder of the next."""
        full = [r for r in live if r[0] == level]
        last = max(r[1] for r in full)
        folder = f"{self.path}/level={level + 1}/batch={last}"
        rows = self.newest(full)
        parts = max(1, len({r[2] for r in full if r[3]}) ** level, tasks_for(self.raw(full).count()))
        self.put(rows.repartitionByRange(parts, F.col(self.keys[0]).cast("string")).sortWithinPartitions(F.col(self.keys[0]).cast("string")), folder)
        return [r for r in live if r[0] != level] + self.described(level + 1, last, folder)

    def raw(self, entries: list[tuple], only: Column | None = None) -> DataFrame:
        """All rows of the files of some entries with the ``_batch`` they came in."""
        rows = None
        for batch in sorted({r[1] for r in entries}):
            files = [r[3] for r in entries if r[1] == batch and r[3]]
            part = self.spark.read.parquet(*(files or [r[2] for r in entries if r[1] == batch]))
            part = (part if only is None else part.filter(only)).withColumn("_batch", F.lit(batch))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return rows

    def newest(self, entries: list[tuple], only: Column | None = None, columns: list[str] | None = None) -> DataFrame:
        """The newest row per key of the files of some entries; ``columns`` are the only ones read, where given."""
        rows = self.raw(entries, only)
        if columns:
            rows = rows.select(*dict.fromkeys([*self.keys, *columns, "_batch"]))
        if only is None:  # the number stands in the footers of the files
            rows = dealt(rows, self.keys, rows.count())
        return last_per_key(rows, self.keys, [F.col("_batch")]).drop("_batch")

    def rows(self, columns: list[str] | None = None) -> DataFrame:
        """The current row of every key, or some columns of it."""
        _, live = self.manifest()
        if not live:
            raise FileNotFoundError(f"no batch in {self.path}")
        return self.newest([tuple(r) for r in live], columns=columns)

    def files_for(self, values: list) -> list[tuple]:
        wanted = [str(v) for v in values]
        return [tuple(r) for r in self.manifest()[1] if r.file and any(r.low <= v <= r.high for v in wanted)]

    def lookup(self, values: list) -> DataFrame:
        """Current rows of a few values of the first key; opens the files that may hold them."""
        entries = self.files_for(values)
        if not entries:
            return self.rows().limit(0)
        return self.newest(entries, F.col(self.keys[0]).isin(values))
