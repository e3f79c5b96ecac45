"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

A largest inner product becomes a smallest distance by one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm. Vectors are put into the list of their nearest centroid and turned by a random rotation, so
that a part of the coordinates tells how long the whole difference is. Inside each probed list the columns
are read in blocks; after each block a hypothesis test drops every candidate whose distance, estimated from
the columns so far, is too large for the query's current 20th distance. What is left is scored exactly, in
double precision, on the original vectors.

Equal vectors are one candidate with its smallest ids, so a vector that many rows share is scanned once. A
list of any length is scanned in blocks of rows, and the queries of a list in blocks too.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, and
neither do vectors of another length than most; ties go to the smaller id; fewer candidates than asked for
give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.llm.common import stored, table

NEAREST = 20
FIT_ROWS = 20_000  # at most so many vectors fit the centroids; every vector is put into a list
PER_LIST = 512  # vectors a list has on average
MOST_LISTS = 2_000  # bound of the table of centroids
PROBED = 0.65  # share of the lists that a query reads
COLUMNS = 16  # columns of a block
CONFIDENCE = 2.1  # how far a partial distance may lie above the bound, in deviations
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
SEED = 7


@dataclass(frozen=True)
class Index:
    """Bounded by its parameters: at most ``MOST_LISTS`` centroids and one rotation."""

    centroids: np.ndarray
    rotation: np.ndarray
    largest: float

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """With the coordinate that turns inner products into distances."""
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.largest**2 - (vectors**2).sum(1), 0))
        return np.column_stack([vectors, last])

    def to_lists(self, lifted: np.ndarray) -> np.ndarray:
        return (lifted**2).sum(1)[:, None] - 2 * lifted @ self.centroids.T + (self.centroids**2).sum(1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v as doubles, of the rows that take part."""
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0)).filter(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(sizes.select("d")), F.size("v") == F.col("d")).drop("d")  # one row


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, v, ids): each different vector once, with its ``keep`` smallest ids and a number of its own."""
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))  # limited before the shuffle
    few = rows.withColumn("n", first).filter(F.col("n") <= keep)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most ``keep``
    return stored(classes.select(F.monotonically_increasing_id().alias("cid"), "v", "ids"), "vectors")


def fit(classes: DataFrame, fit_rows: int = FIT_ROWS, per_list: int = PER_LIST) -> Index | None:
    """Centroids from a bounded sample by hash; the rotation is random but always the same."""
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not facts["n"]:
        return None
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(fit_rows).select("v").toPandas()  # bounded
    index = Index(np.empty((0, 0)), np.empty((0, 0)), float(np.sqrt(facts["m"])))
    points = index.lifted(np.stack(sample["v"].to_numpy()))
    rng = np.random.default_rng(SEED)
    lists = max(1, min(MOST_LISTS, facts["n"] // per_list, len(points) // 8))
    centroids = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(8):
        near = np.argmin(Index(centroids, index.rotation, index.largest).to_lists(points), axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=lists)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    rotation = np.linalg.qr(rng.standard_normal((points.shape[1], points.shape[1])))[0]
    return Index(centroids, rotation, index.largest)


def adaptive_scan(queries: np.ndarray, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) positions that survive all tests; rotated vectors, ``bound`` is a squared distance per query."""
    width = queries.shape[1]
    partial = np.zeros((len(queries), len(points)))
    q, p = None, None
    for start in range(0, width, COLUMNS):
        a, b = queries[:, start:start + COLUMNS], points[:, start:start + COLUMNS]
        seen = min(start + COLUMNS, width)
        slack = 1.0 if seen == width else (1 + CONFIDENCE / np.sqrt(seen)) ** 2
        if q is None:
            partial = np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)
            q, p = np.nonzero(partial * (width / seen) <= (bound * slack)[:, None] + 1e-9)
            partial = partial[q, p]
        else:
            partial = partial + ((a[q] - b[p]) ** 2).sum(1)
            stay = partial * (width / seen) <= bound[q] * slack + 1e-9
            q, p, partial = q[stay], p[stay], partial[stay]
    return q, p


def _probe(index: Index, share: float):
    """Lists of each query, nearest first."""
    wanted = max(1, int(np.ceil(len(index.centroids) * share)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            order = np.argsort(index.to_lists(index.lifted(np.stack(batch["v"].to_numpy()), query=True)), axis=1, kind="stable")[:, :wanted]
            yield pd.DataFrame({"cid": np.repeat(batch["cid"].to_numpy(), wanted), "list": order.ravel(), "near": np.tile(np.arange(wanted), len(batch))})

    return probe


def _place(index: Index):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = index.to_lists(index.lifted(np.stack(batch["v"].to_numpy()))).argmin(1)
                yield pd.DataFrame({"cid": batch["cid"], "list": near, "v": batch["v"]})

    return place


def _scan(index: Index, nearest: int):
    def scan(_key: tuple, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "far": pd.Series(dtype="float64")})
        if not len(queries) or not len(points):
            return empty
        a, b = np.stack(queries["v"].to_numpy()), np.stack(points["v"].to_numpy())
        turned_a, turned_b = index.lifted(a, query=True) @ index.rotation, index.lifted(b) @ index.rotation
        q, p = adaptive_scan(turned_a, turned_b, queries["bound"].to_numpy())
        score = np.einsum("ij,ij->i", a[q], b[p])
        order = np.lexsort((-score, q))
        q, p, score = q[order], p[order], score[order]
        position = np.arange(len(q)) - np.searchsorted(q, q)
        keep = position <= nearest  # one more than asked for, as one may be the query itself
        q, p, score = q[keep], p[keep], score[keep]
        far = (a[q] ** 2).sum(1) + index.largest**2 - 2 * score
        return pd.DataFrame({"query": queries["cid"].to_numpy()[q], "cid": points["cid"].to_numpy()[p], "score": score, "far": far})

    return scan


def _read_lists(queries: DataFrame, points: DataFrame, sizes: DataFrame, index: Index, nearest: int) -> DataFrame:
    """queries (cid, v, list, bound) against points (cid, v, list), in blocks of rows and of queries."""
    row_blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    asked = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    sizes = F.broadcast(sizes.join(asked, "list"))  # at most MOST_LISTS rows
    pick = lambda blocks: F.pmod(F.xxhash64("cid"), blocks).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    left = queries.join(sizes, "list").withColumn("qb", pick(F.col("query_blocks"))).withColumn("rb", spread(row_blocks)).drop("rows", "query_blocks")
    right = points.join(sizes, "list").withColumn("rb", pick(row_blocks)).withColumn("qb", spread(F.col("query_blocks"))).drop("rows", "query_blocks")
    keys = ["list", "rb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_scan(index, nearest), "query bigint, cid bigint, score double, far double")


def search(rows: DataFrame, key: str = "id", vector: str = "v", every: int = 20, nearest: int = NEAREST, probed: float = PROBED) -> DataFrame:
    """The ``nearest`` of every row whose key is divisible by ``every``: (query_id, rank, id, score)."""
    spark = rows.sparkSession
    rows = usable(rows, key, vector)
    classes = distinct_vectors(rows, nearest + 1)
    index = fit(classes)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    points = stored(classes.select("cid", "v").mapInPandas(_place(index), "cid bigint, list int, v array<double>"), "lists")
    sizes = stored(points.groupBy("list").agg(F.count(F.lit(1)).alias("rows")), "list_sizes")
    asked = rows.filter(F.col("id") % every == 0).join(classes.select("cid", F.col("v").alias("_v")), F.col("v") == F.col("_v")).select(F.col("id").alias("query_id"), "cid")
    asked = stored(asked, "queries")
    queries = asked.select("cid").distinct().join(classes.select("cid", "v"), "cid")
    probes = stored(queries.mapInPandas(_probe(index, probed), "cid bigint, list int, near int"), "probes")
    of = lambda p: p.join(classes.select("cid", "v"), "cid")
    # the nearest list gives each query its first bound: the distance of one class more than asked for
    first = of(probes.filter("near = 0")).withColumn("bound", F.lit(float("inf"))).select("cid", "v", "list", "bound")
    found = stored(_read_lists(first, points, sizes, index, nearest), "nearest_list")
    place = F.row_number().over(W.partitionBy("query").orderBy("far"))
    bounds = found.withColumn("n", place).filter(F.col("n") <= nearest + 1).groupBy("query").agg(
        F.max("far").alias("bound"), F.count(F.lit(1)).alias("n"))
    bounds = bounds.select(F.col("query").alias("cid"), F.when(F.col("n") > nearest, F.col("bound")).alias("known"))
    rest = of(probes.filter("near > 0")).join(bounds, "cid", "left").withColumn("bound", F.coalesce("known", F.lit(float("inf"))))
    found = found.unionByName(_read_lists(rest.select("cid", "v", "list", "bound"), points, sizes, index, nearest))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cid"))
    found = found.withColumn("n", best).filter(F.col("n") <= nearest + 1).select("query", F.col("cid").alias("other"), "score")
    pairs = found.join(classes.select(F.col("cid").alias("other"), "ids"), "other").withColumn("id", F.explode("ids"))
    # queries with one vector share what was found for it
    pairs = asked.join(pairs, F.col("cid") == F.col("query")).filter("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "id", "score")


def exact(rows: DataFrame, key: str = "id", vector: str = "v", every: int = 20, nearest: int = NEAREST) -> pd.DataFrame:
    """Brute force on the driver, for tests and for measuring recall on tables that fit there."""
    data = usable(rows, key, vector).toPandas()
    ids, vectors = data["id"].to_numpy(), np.stack(data["v"].to_numpy())
    out = []
    for i in np.flatnonzero(ids % every == 0):
        score = np.einsum("ij,j->i", vectors, vectors[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:nearest]
        out += [(ids[i], r + 1, ids[j], score[j]) for r, j in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "id", "score"])


def op4_adaptive_dimension_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = search(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
