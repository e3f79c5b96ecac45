"""Near-duplicate documents: n-gram Jaccard join with Bayesian pruning of candidates.

Texts with the same set of five-word shingles are one class from the start. The representatives get MinHash
values; bands of them propose candidates. A candidate pair is compared a few hash values at a time: after n
values with m equal ones, the chance that its similarity reaches the threshold follows from a uniform prior as
P(Binomial(n + 1, threshold) <= m), and the pair is dropped once that falls below the tolerance. What is left is
verified on the shingle sets.

Inside a bucket of a band the members are compared with one centre, not with each other, so a bucket of any size
proposes as many pairs as it has members. Members that the links found so far do not join are then compared with
the rest of their bucket, in blocks that prune and verify in place and return links that join groups, never pairs.
Two texts that are linked, directly or through others, get one class.

Similar texts are in one class, so the links of a text are counted inside its class: the class is cut into blocks,
every pair of blocks compares all its shingle sets in one matrix product, and only sums per text leave the task.

Defined results: texts of one to four words have one shingle, all their words; texts without a word, null ones
too, are a class of their own each; similarity is over different shingles of lower-case words; rows that repeat
are members of one class; the class id is the smallest doc_id, null only if all are null; an empty table gives
no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import numbered, stored, table
from stopwise.llm.shingles import HASHES as WORD_HASHES
from stopwise.llm.shingles import WIDTH, mixed, permutations, shingle_hashes, words
from stopwise.operators.graph import connected_groups

THRESHOLD = 0.8
BANDS, ROWS = 28, 6  # a pair at the threshold shares a band with a chance of 0.9998
TOLERANCE = 1e-4  # least chance of reaching the threshold that keeps a pair
BLOCK = 256  # members compared with as many others at a time
STEP = 24  # hash values compared at a time
CELLS = 4_000_000  # hash values held at once for one text
MEMBERS = 1024  # texts of a class in one block when links are counted
BLOCK_BYTES = 16 << 20  # shingle sets in one block


def shingle_set(text: str) -> np.ndarray:
    """Sorted different shingles."""
    found = words(text)
    if 0 < len(found) < WIDTH:
        joined = " ".join(found)
        return mixed(np.array([int.from_bytes(WORD_HASHES[joined], "big") ^ 0x5DEECE66D], np.uint64))
    return np.unique(shingle_hashes(found))


def minhash(hashes: np.ndarray, number: int = BANDS * ROWS) -> np.ndarray:
    factors = permutations(number, seed=23)
    step = max(1, CELLS // len(hashes))
    minima = [(factors[i:i + step, None] * hashes).min(1) for i in range(0, number, step)]
    return (np.concatenate(minima) >> np.uint64(32)).astype("<u4")


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def least_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, number: int = BANDS * ROWS) -> np.ndarray:
    """For 1..number compared values the fewest equal ones that keep a pair."""
    out = np.zeros(number + 1, np.int64)
    for n in range(1, number + 1):
        chance, m = 0.0, 0
        while True:  # P(Binomial(n + 1, threshold) <= m)
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance or m == n:
                break
            m += 1
        out[n] = m
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, minima) of every row, and its ``_own`` if there is one; key and minima are null for texts without a word."""
    kept = [c for c in docs.columns if c == "_own"]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text or "") for text in batch["text"]]
            yield pd.DataFrame({
                **{c: batch[c] for c in kept}, "doc_id": batch["doc_id"].astype("Int64"), "key": [set_key(s) if len(s) else None for s in sets],
                "minima": [minhash(s).tobytes() if len(s) else None for s in sets]})

    kinds = "".join(f"{c} bigint, " for c in kept) + "doc_id bigint, key binary, minima binary"
    return docs.select(*kept, F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(sign, kinds)


def pruned(pairs: DataFrame, minima: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that the incremental comparison of hash values keeps."""
    fewest = least_equal(threshold)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            left = np.frombuffer(b"".join(batch["left"]), "<u4").reshape(len(batch), -1)
            right = np.frombuffer(b"".join(batch["right"]), "<u4").reshape(len(batch), -1)
            alive, equal = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for start in range(0, left.shape[1], STEP):
                end = min(start + STEP, left.shape[1])
                equal = equal + (left[alive, start:end] == right[alive, start:end]).sum(1)
                keep = equal >= fewest[end]
                alive, equal = alive[keep], equal[keep]
            yield batch.iloc[alive][["a", "b"]]

    side = lambda node, name: minima.select(F.col("node").alias(node), F.col("minima").alias(name))
    return pairs.join(side("b", "right"), "b").join(side("a", "left"), "a").select("a", "b", "left", "right").mapInPandas(prune, "a bigint, b bigint")


def shingle_sets(needed: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, hashes) of the needed nodes, read from their texts only."""
    wanted = stored(needed.join(reps.select("node", "key", "doc"), "node"), "needed")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    found = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("doc"))).select("node", "key", "text")  # one plan at every size

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text) for text in batch["text"]]
            same = [set_key(s) == key for s, key in zip(sets, batch["key"])]  # another row may have the doc_id
            yield pd.DataFrame({"node": batch["node"], "hashes": [s.tobytes() for s in sets]})[same]

    return stored(found.mapInPandas(read, "node bigint, hashes binary").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs whose shingle sets are similar enough."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for left, right in zip(batch["left"], batch["right"]):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= threshold * (len(a) + len(b) - common) - 1e-9)
            yield batch[np.array(keep, bool)][["a", "b"]]

    side = lambda node, name: sets.select(F.col("node").alias(node), F.col("hashes").alias(name))
    return pairs.join(side("b", "right"), "b").join(side("a", "left"), "a").select("a", "b", "left", "right").mapInPandas(verify, "a bigint, b bigint")


def _band_rows(reps: DataFrame) -> DataFrame:
    """(bucket, node): the bucket of each band; its last five bits are the number of the band."""
    value = lambda i: F.xxhash64(i, F.substring("minima", i * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.shiftleft(value(i), 5).bitwiseOR(i))
    return reps.filter("minima is not null").select(F.explode(bands).alias("bucket"), "node")


def central_pairs(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each member of a bucket with the bucket's smallest node, and the members of buckets of three or more."""
    centres = stored(bands.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "centres")
    members = stored(bands.join(centres, "bucket"), "members")
    pairs = members.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    return pairs, members.filter("n > 2").select("bucket", "node", "a")


def apart(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (bucket, node, label, main) of buckets whose members are in several groups, without the centre.

    ``main`` is the group that most of the bucket belongs to.
    """
    placed = members.join(groups, "node", "left").select("bucket", "a", "node", F.coalesce("label", "node").alias("label"))
    counts = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = stored(counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1"), "largest")
    return stored(placed.join(largest.drop("groups"), "bucket").filter("node <> a").drop("a"), "outsiders")


def joining(pairs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Pairs that join groups which the pairs before them have not joined; ``labels`` has the groups of their ends."""
    parent: dict[int, int] = {}

    def top(label: int) -> int:
        while parent.setdefault(label, label) != label:
            parent[label] = label = parent[parent[label]]
        return label

    kept = []
    for i in np.unique(np.sort(labels, axis=1), axis=0, return_index=True)[1]:  # one pair for every two groups
        one, two = top(int(labels[i, 0])), top(int(labels[i, 1]))
        if one != two:
            parent[one] = two
            kept.append(i)
    return pairs[kept]


def remaining_links(placed: DataFrame, minima: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links between the groups that meet in a bucket; ``placed`` is the result of ``apart``.

    The members outside the main group and all members of a bucket are cut into blocks, and a pair of blocks is
    one unit: hash values are compared a few at a time, what is left is verified on the sets there, and only the
    links that join groups leave the unit. So a bucket of n members moves n rows for every block of outsiders and
    returns fewer links than it has groups. A pair is verified in the first band that both share.
    """
    outside = F.col("label") != F.col("main")
    weighed = placed.join(sets.select("node", F.length("hashes").alias("bytes")), "node")
    blocks = lambda kind: F.greatest(F.ceil(F.count(kind) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(kind.isNotNull(), F.col("bytes"))), F.lit(0)) / BLOCK_BYTES)).cast("int")
    sizes = stored(weighed.groupBy("bucket").agg(
        blocks(F.lit(1)).alias("mbs"), blocks(F.when(outside, 1)).alias("obs"), F.sum("bytes").alias("bytes")).filter("obs > 0"), "bucket_sizes")
    moved = sizes.agg(F.sum(F.col("bytes") * F.col("obs"))).first()[0] or 0
    parts = max(8, moved // BLOCK_BYTES)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = placed.join(sizes.drop("bytes"), "bucket")
    left = both.filter(outside).withColumn("ob", own("obs")).withColumn("mb", every("mbs"))
    right = both.withColumn("mb", own("mbs")).withColumn("ob", every("obs"))
    part = F.pmod(F.xxhash64("bucket", "ob", "mb"), F.lit(parts)).cast("int").alias("part")
    columns = ["bucket", "ob", "mb", "node", "label"]
    units = left.select(part, *columns, F.lit(True).alias("outside")).unionByName(right.select(part, *columns, F.lit(False).alias("outside")))
    rows = units.join(minima.join(sets, "node"), "node").select("part", *columns, "outside", "minima", "hashes")
    fewest = least_equal(threshold)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.empty((0, 2), np.int64)]
        for (bucket, _, _), unit in rows.groupby(["bucket", "ob", "mb"]):
            mine, theirs = unit[unit["outside"]], unit[~unit["outside"]]
            if not len(mine) or not len(theirs):
                continue
            one, two = (np.frombuffer(b"".join(x["minima"]), "<u4").reshape(len(x), -1) for x in (mine, theirs))
            labels, others = mine["label"].to_numpy(), theirs["label"].to_numpy()
            i, j = np.nonzero(labels[:, None] != others[None, :])
            equal = np.zeros(len(i), np.int64)
            for start in range(0, one.shape[1], STEP):
                end = min(start + STEP, one.shape[1])
                equal = equal + (one[i, start:end] == two[j, start:end]).sum(1)
                keep = equal >= fewest[end]
                i, j, equal = i[keep], j[keep], equal[keep]
            if not len(i):
                continue
            banded = (one[i] == two[j]).reshape(len(i), BANDS, ROWS).all(2)
            first = banded.argmax(1) == bucket & 31
            i, j = i[first], j[first]
            if not len(i):
                continue
            (us, u), (vs, v) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            a, b = ([np.frombuffer(x, np.uint64) for x in side["hashes"].to_numpy()[k]] for side, k in ((mine, us), (theirs, vs)))
            common = common_counts(a, b)[u, v].astype(np.int64)
            either = np.array([len(x) for x in a])[u] + np.array([len(x) for x in b])[v] - common
            similar = common >= threshold * either - 1e-9
            ends = np.column_stack([mine["node"].to_numpy()[i], theirs["node"].to_numpy()[j]])[similar]
            found.append(joining(ends, np.column_stack([labels[i], others[j]])[similar]))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return rows.groupBy("part").applyInPandas(compare, "a bigint, b bigint")


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Number of values that each set of ``one`` shares with each of ``two``."""
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    out = np.zeros((len(one), len(two)), np.float32)
    step = max(1, CELLS // max(len(one), len(two)))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        held = shared[at] == values
        return rows[held], at[held]

    def part(found: tuple[np.ndarray, np.ndarray], number: int, start: int) -> np.ndarray:
        rows, at = found
        inside = (at >= start) & (at < start + step)
        cells = np.zeros((number, min(step, len(shared) - start)), np.float32)
        cells[rows[inside], at[inside] - start] = 1
        return cells

    if len(shared):
        left, right = places(one), places(two)
        for start in range(0, len(shared), step):
            out += part(left, len(one), start) @ part(right, len(two), start).T
    return out


def link_counts(groups: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, n_links) of every node of groups (node, label): similar texts among those of its class."""
    weighed = groups.join(sets.select("node", F.length("hashes").alias("bytes")), "node")
    sizes = stored(weighed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(
        "label", "n", "bytes", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "class_sizes")
    moved = sizes.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    parts = max(8, moved // BLOCK_BYTES)
    placed = groups.join(sizes, "label")
    pairs = placed.filter("n = 2").select("node", F.lit(1).cast("bigint").alias("n_links"))  # two texts make a class by one link
    blocked = placed.filter("n > 2").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = blocked.select("node", "label", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    rows = units.join(sets, "node").select(F.pmod(F.xxhash64("label", "p", "q"), F.lit(parts)).cast("int").alias("part"), "label", "p", "q", "own", "node", "hashes")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"node": np.empty(0, np.int64), "n_links": np.empty(0, np.int64)})]
        for (_, p, q), unit in rows.groupby(["label", "p", "q"]):
            mine, theirs = unit[unit["own"] == p], unit[unit["own"] == q]
            if not len(mine) or not len(theirs):
                continue
            one, two = ([np.frombuffer(x, np.uint64) for x in side["hashes"]] for side in (mine, theirs))
            common = common_counts(one, two).astype(np.int64)
            either = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :] - common
            similar = common >= threshold * either - 1e-9
            if p == q:
                np.fill_diagonal(similar, False)
            else:
                found.append(pd.DataFrame({"node": theirs["node"], "n_links": similar.sum(0)}))
            found.append(pd.DataFrame({"node": mine["node"], "n_links": similar.sum(1)}))
        return pd.concat(found).groupby("node", as_index=False)["n_links"].sum()

    counted = rows.groupBy("part").applyInPandas(count, "node bigint, n_links bigint").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return pairs.unionByName(counted)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, _row, node, label, and _own if docs have it), groups (node, label) of linked representatives, and their sets (node, hashes).

    ``node`` is the representative of a row's text, ``label`` the class of the node.
    """
    rows = numbered(signed(docs), "signed")
    grouped = rows.withColumn("_key", F.coalesce("key", F.col("_row").cast("string").cast("binary")))
    reps = stored(grouped.groupBy("_key").agg(
        F.min("_row").alias("node"), F.min_by("minima", "_row").alias("minima"), F.min_by("doc_id", "_row").alias("doc"),
        F.min_by("key", "_row").alias("key")), "representatives")
    minima = reps.select("node", "minima")

    pairs, members = central_pairs(_band_rows(reps))
    kept = stored(pruned(pairs, minima, threshold), "kept")
    ends = kept.select(F.explode(F.array("a", "b")).alias("node"))
    sets = shingle_sets(ends.unionByName(members.select("node")).distinct(), reps, docs)
    links = stored(verified(kept, sets, threshold), "links")
    groups = connected_groups(links)
    placed = apart(members, groups)
    if not placed.isEmpty():
        links = links.unionByName(stored(remaining_links(placed, minima, sets, threshold), "more_links"))
        groups = connected_groups(links)
    labels = stored(reps.join(groups, "node", "left").select("_key", "node", F.coalesce("label", "node").alias("label")), "labels")
    return stored(grouped.drop("key", "minima").join(labels, "_key").drop("_key"), "classes"), groups, sets


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row: its class, links of its text to other texts, rows with its text."""
    rows, groups, sets = classes(docs, threshold)
    ids = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    ends = link_counts(groups, sets, threshold)
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"), F.min("label").alias("label"))
    facts = stored(copies.join(ends, "node", "left").join(ids, "label").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "facts")
    return rows.select("doc_id", "node").join(facts, "node").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: of the rows with the smallest doc_id (null only if all are null) the first one.

    Rows are told apart by number, so rows that share a doc_id, or have none, stay or go each for itself.
    """
    own = numbered(docs.withColumnRenamed("_row", "_given") if "_row" in docs.columns else docs, "documents")
    rows, _, _ = classes(own.select(F.col("_row").alias("_own"), "doc_id", "text"), threshold)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_own")
    first = rows.groupBy("label").agg(F.min(order).getField("_own").alias("kept"))
    gone = rows.join(first, "label").filter("_own <> kept").select(F.col("_own").alias("_row"))
    left = own.join(gone, "_row", "left_anti").drop("_row")
    return left.withColumnRenamed("_given", "_row").select(*docs.columns)


def op10_bayesian_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return linked(table(spark, folder, "documents"))
