"""Row numbers, running sums and exact samples over a whole table.

A window without partitions would move every row to one task. Here rows are
range-partitioned into slices instead; each slice is numbered on its own and
shifted by the totals of the slices before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.session import cut_lineage


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """Adds one inclusive running sum per entry of ``sums``.

    ``order`` must be unique per row: it then also splits rows with equal leading
    keys over slices. The sliced rows are checkpointed, because the totals and the
    rows must see the same slices.
    """
    slices = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v_{name}": value for name, value in sums.items()}
    sliced = rows.withColumns(values).repartitionByRange(slices, *order)
    sliced = cut_lineage(sliced.withColumn("_slice", F.spark_partition_id()))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    totals = sliced.groupBy("_slice").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select("_slice", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{v}") for v in values])
    inside = W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = sliced.join(F.broadcast(offsets), "_slice")  # as many rows as slices
    joined = joined.withColumns({name: F.sum(f"_v_{name}").over(inside) + F.col(f"_o_v_{name}") for name in sums})
    return joined.select(*rows.columns, *sums)


def global_row_number(rows: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position of each row in a unique order, with one shuffle.

    The rows are range-partitioned and sorted; a row's position in its slice is in the lower bits of its
    monotonic id, and the slice in the upper ones.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumn("_slice", F.shiftright("_id", 33))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    counts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), "_slice")  # as many rows as slices
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*rows.columns, (F.col("_before") + inside + 1).alias(name))


def fixed_batches(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Consecutive groups of ``size`` rows, numbered from 0."""
    numbered = global_row_number(rows, order, "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def row_slice(rows: DataFrame, order: list[Column], first: int = 0, stop: int | None = None,
              from_end: bool = False) -> DataFrame:
    """Rows ``first`` (0-based) up to ``stop`` in order; counted from the end with ``from_end``."""
    numbered = global_row_number(rows, [c.desc() for c in order] if from_end else order, "_n")
    keep = F.col("_n") > first
    if stop is not None:
        keep = keep & (F.col("_n") <= stop)
    return numbered.filter(keep).drop("_n")


def ordered_split(rows: DataFrame, order: list[Column], share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: the first ``share`` of the rows in order."""
    numbered = global_row_number(rows, order, "_n")
    cut = numbered.agg(F.floor(F.count(F.lit(1)) * share)).scalar()
    return numbered.withColumn("is_train", F.col("_n") <= cut).drop("_n")


BUCKET_DIGITS = 4  # hex digits, so 65 536 buckets


def sample_key(key: Column, seed: int) -> Column:
    """A repeatable, evenly spread order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def exact_samples(rows: DataFrame, key: str, sizes: DataFrame, seed: int = 0, group: str | None = None) -> DataFrame:
    """Exact samples of several sizes; ``sizes`` is a short table of (sample, size).

    Sample s is the ``size`` rows with the smallest hash of the unique ``key`` (all
    rows if there are fewer); with ``group`` it takes only rows whose group is s.
    Counts per hash bucket tell in which bucket each sample ends (one row per sample, joined
    to the rows), and only the rows of those buckets are ordered.
    """
    hashed = rows.withColumn("_h", sample_key(F.col(key), seed))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS)).withColumn("_g", F.col(group) if group else F.lit(0))
    counts = hashed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_bucket = W.partitionBy("_g").orderBy("_b")  # at most 65 536 rows per sample
    ends = counts.withColumns({"_end": F.sum("_n").over(by_bucket), "_next": F.lead("_b").over(by_bucket)})
    ends = ends.withColumn("_w", sizes.agg(F.collect_list(F.struct("sample", "size"))).scalar())
    own = (lambda s: s["sample"] == F.col("_g")) if group else (lambda s: F.lit(True))
    ends_here = lambda s: own(s) & (s["size"] > F.col("_end") - F.col("_n")) & ((s["size"] <= F.col("_end")) | F.col("_next").isNull())
    found = ends.withColumn("_s", F.explode(F.filter("_w", ends_here))).select(
        F.col("_s.sample").alias("sample"), F.col("_b").alias("edge"), (F.col("_s.size") - F.col("_end") + F.col("_n")).alias("left"))
    edges = cut_lineage(found.groupBy("sample").agg(F.max("edge").alias("edge"), F.max_by("left", "edge").alias("left")))
    inside = F.col("edge") >= F.col("_b")
    # without groups the table of edges is as short as the one of sizes; with them it is joined by group
    taken = hashed.join(edges, (F.col("sample") == F.col("_g")) & inside) if group else hashed.join(F.broadcast(edges), inside)
    whole = taken.filter("edge > _b")
    rank = F.row_number().over(W.partitionBy("sample", "_b").orderBy("_h", key))
    part = taken.filter("edge = _b").withColumn("_r", rank).filter("_r <= left").drop("_r")
    return whole.unionByName(part).select(*rows.columns, "sample")


def exact_sample(rows: DataFrame, key: str, size: Column | int, seed: int = 0) -> DataFrame:
    """One exact sample of ``size`` rows."""
    size = F.lit(size) if isinstance(size, int) else size
    sizes = rows.sparkSession.range(1).select(F.lit("one").alias("sample"), size.alias("size"))
    return exact_samples(rows, key, sizes, seed).drop("sample")
