"""Weighted rendezvous hashing: stable shards for record keys, in column expressions only.

Every (key, shard) pair has its own hash; a record goes to the shard with the smallest
-ln(u) / weight. Adding a shard moves a record only if the new shard wins, so rows move into the
new shard and nowhere else, and a shard's share follows its weight.

Defined results: a null key is a key like any other; rows with one key share one shard (that is the
law of the method); null text counts 16 bytes; ties of the hash go to the smaller shard number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import numbered, rank_in_class, table, text_or_empty

SHARDS = 40
OVERHEAD = 16  # bytes a record takes besides its text


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number for a key; ``weights`` has one positive weight per shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def cost(s: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.log(unit) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, cost))["shard"]


def assign(records: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """All columns of the records and their shard; a column of that name is replaced."""
    return records.withColumn(name, shard_of(F.col(key), weights))


def with_slots(sharded: DataFrame, shard: str = "shard", name: str = "slot") -> DataFrame:
    """A gapless position inside the shard, from 0; the rows are stored once so that it stays the same."""
    return rank_in_class(numbered(sharded, "sharded"), shard, name).drop("_row")


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard; a shard of any size is written by several tasks."""
    sharded.write.partitionBy(shard).parquet(path)


def op8_rendezvous_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = text_or_empty()
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    sharded = assign(docs, "doc_id", [1.0] * SHARDS)
    sharded = assign(sharded, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    placed = with_slots(sharded)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
