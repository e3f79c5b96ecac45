"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity, so sizes are partitioned. Items fall into
classes by their number of shingles, 2^(k-1) < n <= 2^k. For each class in use a document is read in windows
of 2^(k+1) shingles, 2^k apart: every run of 2^k shingles lies whole in one of them. Against a window an item
with containment t has Jaccard similarity of at least t / (4 + 1 - t), 0.19 for t = 0.8, so one equal value
among 64 MinHashes misses it with a chance below 2 in a million. Where an item's shingles lie in several windows,
each of them may propose it: a shingle with the item's smallest value is the smallest of its window with a chance
of n / (n + 2^(k+1)), a fifth at least, so 80 % of the shingles, wherever they are, miss 64 times with a chance of
(1 - 0.8 / 5)^64, below 2 in 100 000. A filter of fixed size with the items' values goes to every task and only
documents that meet it go on; they are joined to the items by value, and the share of the item's different
five-word shingles is counted over the whole document.

Defined results: an item is found in a document if the document holds at least 80 % of its different shingles,
together or apart; window_start is the first word of the window that holds most of them, the first such window;
items of under five words have no shingle and are never found; null and empty texts hold nothing; equal items
(the same words) are one, under their smallest id, but the query lists every id of theirs; rows that repeat a
doc_id give the largest containment of one row; texts of any length are read whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import numbered, stored, table
from stopwise.llm.shingles import permutations, shingle_hashes, words

CONTAINMENT = 0.8
HASHES = 64
FILTER_BITS = 24  # the filter has 2^24 bits, whatever the number of items
SALTS = 8  # parts of a value that very many windows share
FACTORS = permutations(HASHES)
CELLS = 4_000_000  # hash values held at once for one text


def size_class(shingles: int) -> int:
    return max(shingles - 1, 0).bit_length()


def window_minima(hashes: np.ndarray, classes: list[int]) -> dict[int, np.ndarray]:
    """Per class the MinHashes (windows x HASHES) of all windows of a text."""
    factors = FACTORS
    smallest = 1 << classes[0]
    starts = np.arange(0, len(hashes), smallest)
    step = max(1, CELLS // max(len(hashes), 1))
    blocks = np.concatenate([
        np.minimum.reduceat(factors[i:i + step, None] * hashes, starts, axis=1)
        for i in range(0, HASHES, step)])
    out, k = {}, classes[0]
    while True:
        if k in classes:
            out[k] = (np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks).T
        if k == classes[-1]:
            return out
        if blocks.shape[1] % 2:
            blocks = np.concatenate([blocks, blocks[:, -1:]], axis=1)
        blocks, k = np.minimum(blocks[:, ::2], blocks[:, 1::2]), k + 1


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _keyed(values: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """A value together with its hash function and class."""
    return values * _SPREAD + (which.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))


def _first_probe(keyed: np.ndarray) -> np.ndarray:
    return keyed >> np.uint64(64 - FILTER_BITS)


def _second_probe(keyed: np.ndarray) -> np.ndarray:
    return (keyed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - FILTER_BITS)


def item_signatures(items: DataFrame) -> DataFrame:
    """(item_id, words, k, values) of the items with at least one shingle."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                found = words(text)
                hashes = shingle_hashes(found)
                if len(hashes):
                    minima = (FACTORS[:, None] * hashes).min(1)
                    rows.append((item, " ".join(found), size_class(len(hashes)), minima.view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "words", "k", "values"])

    texts = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return texts.mapInPandas(sign, "item_id bigint, words string, k int, values array<bigint>")


def value_filter(signatures: DataFrame) -> np.ndarray:
    """Bits of all items' values. Tasks return set positions, so at most 2^FILTER_BITS rows come back."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            which, places = np.arange(HASHES), [np.empty(0, np.uint64)]
            for k, values in zip(batch["k"], batch["values"]):
                keyed = _keyed(np.asarray(values, np.int64).view(np.uint64), which, k)
                places += [_first_probe(keyed), _second_probe(keyed)]
            yield pd.DataFrame({"bit": np.unique(np.concatenate(places)).astype(np.int64)})

    out = np.zeros(1 << FILTER_BITS, bool)
    out[signatures.select("k", "values").mapInPandas(bits, "bit bigint").distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    return np.packbits(out)


def _windows(classes: list[int], shared):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(shared.value).view(bool)
        is_set = lambda place: bits[place.view(np.int64)]
        salts = {k: _keyed(np.zeros(1, np.uint64), np.arange(HASHES), k)[:, None] for k in classes}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = words(text)
                hashes = shingle_hashes(found)
                if not len(hashes):
                    continue
                met = set()
                for k, minima in window_minima(hashes, classes).items():
                    values = minima.T  # one row per hash function
                    keyed = (values * _SPREAD + salts[k]).ravel()
                    hits = np.flatnonzero(is_set(_first_probe(keyed)))
                    if not len(hits):
                        continue
                    hits = hits[is_set(_second_probe(keyed[hits]))]
                    which, window = np.divmod(hits, values.shape[1])
                    met.update((k, i, v) for i, v in zip(which.tolist(), values[which, window].view(np.int64).tolist()))
                if met:
                    rows.append((doc, " ".join(found), sorted(met)))
            out = pd.DataFrame(rows, columns=["doc_id", "words", "hits"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return meet


def fullest_window(places: np.ndarray, which: np.ndarray, shingles: int, k: int) -> int:
    """Start of the first window that holds most of an item; shingle ``which`` of the item stands at each of ``places``."""
    last = max((shingles - 1 >> k) - 1, 0)
    block = places >> k
    windows, which = np.concatenate([np.minimum(block, last), np.maximum(block - 1, 0)]), np.concatenate([which, which])
    number, counts = np.unique(np.unique(np.column_stack([windows, which]), axis=0)[:, 0], return_counts=True)
    return int(number[counts.argmax()]) << k


def _held(at_least: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, ids, kinds, texts in zip(batch["doc_id"], batch["words"], batch["ids"], batch["kinds"], batch["texts"]):
                hashes = shingle_hashes(text.split(" "))
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                for item, k, wanted in zip(ids, kinds, texts):
                    own = np.unique(shingle_hashes(wanted.split(" ")))
                    first, end = (np.searchsorted(ordered, own, side) for side in ("left", "right"))
                    share = float((end > first).sum() / len(own))
                    if share >= at_least:
                        places = np.concatenate([order[a:b] for a, b in zip(first, end)])
                        rows.append((doc, item, share, fullest_window(places, np.repeat(np.arange(len(own)), end - first), len(hashes), int(k))))
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "containment", "window_start"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return verify


def matches(docs: DataFrame, items: DataFrame, at_least: float = CONTAINMENT, every_id: bool = False) -> DataFrame:
    """(doc_id, item_id, containment, window_start) of every document and item found in it.

    Equal items are listed under their smallest id, or with ``every_id`` under each of their ids.
    """
    spark = docs.sparkSession
    each = stored(item_signatures(items), "items")
    signed = stored(each.groupBy("words", "k", "values").agg(F.min("item_id").alias("item_id")), "different_items")
    classes = sorted(r["k"] for r in signed.select("k").distinct().collect())  # one per power of two
    if not classes:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, containment double, window_start bigint")
    shared = spark.sparkContext.broadcast(value_filter(signed))  # fixed size
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kinds = "doc_id bigint, words string, hits array<struct<k int, i int, v bigint>>"
    met = stored(texts.mapInPandas(_windows(classes, shared), kinds).withColumn("wid", F.monotonically_increasing_id()), "met")
    values = signed.select("item_id", "k", F.posexplode("values").alias("i", "v")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = met.select("wid", F.inline("hits")).withColumn("salt", F.pmod(F.xxhash64("wid"), F.lit(SALTS)).cast("int"))
    pairs = hits.join(values, ["k", "i", "v", "salt"]).select("wid", "item_id").distinct()
    wanted = pairs.join(signed.select("item_id", "k", "words"), "item_id").groupBy("wid").agg(F.collect_list(F.struct("item_id", "k", "words")).alias("wanted"))
    wanted = wanted.select("wid", F.col("wanted.item_id").alias("ids"), F.col("wanted.k").alias("kinds"), F.col("wanted.words").alias("texts"))
    checked = met.select("wid", "doc_id", "words").join(wanted, "wid").select("doc_id", "words", "ids", "kinds", "texts").mapInPandas(
        _held(at_least), "doc_id bigint, item_id bigint, containment double, window_start bigint")
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", (-F.col("window_start")).alias("back"))).alias("best")).select(
        "doc_id", "item_id", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("window_start"))
    if not every_id:
        return best
    same = signed.select("words", F.col("item_id").alias("_first")).join(each.select("words", "item_id").distinct(), "words").drop("words")
    return best.withColumnRenamed("item_id", "_first").join(same, "_first").select("doc_id", "item_id", "containment", "window_start")


def without_items(docs: DataFrame, items: DataFrame, at_least: float = CONTAINMENT) -> DataFrame:
    """Rows that hold no item; rows are told apart by number, so rows that share a doc_id, or have none, go each for itself."""
    own = numbered(docs.withColumnRenamed("_row", "_given") if "_row" in docs.columns else docs, "documents")
    bad = matches(own.select(F.col("_row").alias("doc_id"), "text"), items, at_least).select(F.col("doc_id").alias("_row")).distinct()
    left = own.join(bad, "_row", "left_anti").drop("_row")
    return left.withColumnRenamed("_given", "_row").select(*docs.columns)


def op5_containment_search(spark: SparkSession, folder: str) -> DataFrame:
    return matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), every_id=True)
