"""Runs of repeated words by longest common extensions, and texts with each run cut to its first period.

A run is a maximal stretch of words with smallest period ``q`` that repeats it at least ``REPEATS`` times. Every run holds a
Lyndon root: the longest Lyndon word that starts somewhere inside, under the order of the words or the reversed one. So
each position gives one candidate per order. A candidate is extended to the right by the longest common extension of two
suffixes and to the left by that of two suffixes of the reversed words; both are the depth of a lowest common ancestor in
a suffix tree, read in constant time from the Euler tour. The tour is kept from leaf to leaf, by the shallowest node between
two leaves, which is all that an ancestor of leaves needs.

Trees cost far more than reading, so they are built on the parts of a text that can hold a run: inside a run of period
``q`` each word but the last ``q`` comes again within ``q`` words, and these words are at least three quarters of the run. A stretch
of words that come again within a third of its length is a part; all other words can neither be in such a run nor
extend one (``parts``). The result is that of the whole text.

Work is by document and on Spark's partitions, without a shuffle. Time and memory are linear in a text.

Defined results: null and empty texts have no words and no runs; words are parted by ASCII white space; texts of any
length are read whole; rows that repeat are judged each for itself; a null doc_id stays null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import table

SHORTEST = 6  # words of a run
REPEATS = 4
TREE_WORDS = 8192  # short parts are searched together, in trees of about this size
HELD_WORDS = 200_000  # words read before their documents are searched
FAR = np.iinfo(np.int64).max
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """Ukkonen's tree of positive symbols, closed by a 0 that is smaller than all of them."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        size, width = len(text), max(symbols, default=0) + 1
        begin, end, link, mark, edges = [0], [0], [0], [0], {}  # mark: depth of an inner node, ~suffix of a leaf
        node = edge = length = left = 0
        for i, symbol in enumerate(text):
            left += 1
            inner = 0  # the last inner node made for this symbol, without a suffix link yet
            while left:
                if length == 0:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    begin.append(i)
                    end.append(size)
                    link.append(0)
                    mark.append(left - i - 2)
                    if inner:
                        link[inner] = node
                    inner = node
                else:
                    at = begin[child]
                    span = end[child] - at
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    if text[at + length] == symbol:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    split = len(begin)
                    edges[key] = split
                    begin += (at, i)
                    end += (at + length, size)
                    link += (0, 0)
                    mark += (left - 1, left - i - 2)
                    edges[split * width + symbol] = split + 1
                    begin[child] = at + length
                    edges[split * width + text[at + length]] = child
                    if inner:
                        link[inner] = split
                    inner = split
                left -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.size, self.begin, self.mark = size, begin, mark
        self.child = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        self.first = np.searchsorted(keys[order] // width, np.arange(len(begin) + 1)).tolist()

    def leaves(self, turned: bool = False) -> tuple[list[int], list[int]]:
        """Suffixes in order, and the depth of the shallowest node on the way from the leaf before.

        ``turned`` reverses the order of symbols; the end of the text stays the smallest.
        """
        begin, child, first, mark, closing = self.begin, self.child, self.first, self.mark, self.size - 1
        suffixes, shallow, nodes, lows = [], [], [0], [0]
        while nodes:
            node, low = nodes.pop(), lows.pop()
            depth = mark[node]
            if depth < 0:
                suffixes.append(~depth)
                shallow.append(low)
                continue
            below = child[first[node]:first[node + 1]]
            if not turned:
                below.reverse()
            elif begin[below[0]] == closing:
                below.append(below.pop(0))
            nodes += below
            lows += [depth] * (len(below) - 1)
            lows.append(low)
        return suffixes, shallow


class Extensions:
    """Longest common extension of pairs of suffixes: the depth of their lowest common ancestor, by a range minimum."""

    def __init__(self, suffixes: list[int], shallow: list[int]):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[np.array(suffixes)] = np.arange(len(suffixes))
        row = np.array(shallow, np.int32)
        self.least, span = [row], 1
        while len(row) > span:
            row = np.minimum(row[:-span], row[span:])
            self.least.append(row)
            span *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``i`` and ``j`` differ in every pair."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in range(len(self.least)):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each position the next one with a smaller rank, or the length: where its longest Lyndon word ends."""
    ends, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            ends[open_.pop()] = i
        open_.append(i)
    return np.array(ends, np.int64)


def runs_of_symbols(symbols: np.ndarray, shortest: int, repeats: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of positive symbols, by start and period."""
    n = len(symbols)
    tree = SuffixTree(symbols.tolist())
    order = tree.leaves()
    ahead = Extensions(*order)
    behind = Extensions(*SuffixTree(symbols[::-1].tolist()).leaves())
    found = []
    for suffixes in (order[0], tree.leaves(turned=True)[0]):
        rank = np.empty(n + 1, np.int64)
        rank[np.array(suffixes)] = np.arange(n + 1)
        ends = next_smaller(rank[:n].tolist())
        root = np.flatnonzero(ends < n)
        period = ends[root] - root
        right = ahead.of(root, root + period)
        left = np.zeros(len(root), np.int64)
        inner = np.flatnonzero(root > 0)
        left[inner] = behind.of(n - root[inner], n - root[inner] - period[inner])  # the words before the root and before its end
        length = left + period + right
        long = (length >= shortest) & (length >= repeats * period)
        found.append(np.stack([root - left, period, length], 1)[long])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def parts(ids: np.ndarray, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, end with one longest period more) of the stretches that can hold a run."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, FAR)
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    gap[order[same]] = order[same + 1] - order[same]
    alive = gap <= n // repeats
    while True:
        edge = np.diff(np.concatenate([[0], alive.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bound = np.zeros(n, np.int64)
        bound[alive] = np.repeat((ends - starts) // (repeats - 1), ends - starts)
        still = gap <= bound
        if still.sum() == alive.sum():
            break
        alive = still
    for a, b in zip(starts.tolist(), ends.tolist()):
        yield a, b, min(n, b + (b - a) // (repeats - 1))


def runs_of_all(texts: list[list], shortest: int = SHORTEST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """All (start, length, period) of each text, by start and period, of runs of ``shortest`` words and ``repeats`` (2 or more) periods.

    Short parts share a tree, each closed by a symbol of its own, which no extension can pass.
    """
    found, held, size = [[] for _ in texts], [], 0

    def search() -> None:
        top = max((int(s.max()) for *_, s in held), default=0)
        joined = np.concatenate([np.append(s, top + 1 + k) for k, (*_, s) in enumerate(held)])
        begins = np.cumsum([0] + [len(s) + 1 for *_, s in held])
        rows = runs_of_symbols(joined, shortest, repeats)
        at = np.searchsorted(begins, rows[:, 0], "right") - 1
        for (s, length, period), k in zip(rows.tolist(), at.tolist()):
            text, start, end, _ = held[k]
            s += start - int(begins[k])
            if s < end:  # the others belong to the next part
                found[text].append((s, length, period))

    numbered_words, top = [], 0
    for words in texts:  # texts share no number, and a number that comes once stands between two of them
        numbers: dict = {}
        numbered_words.append(np.array([numbers.setdefault(w, len(numbers)) for w in words] + [len(numbers)], np.int64) + top)
        top += len(numbers) + 1
    begins = np.cumsum([0] + [len(ids) for ids in numbered_words])
    ids = np.concatenate([*numbered_words, np.zeros(0, np.int64)])
    for start, end, more in parts(ids, repeats):
        text = int(np.searchsorted(begins, start, "right")) - 1
        first, last = int(begins[text]), int(begins[text + 1]) - 1
        more = min(more, last)
        if more - start >= max(shortest, repeats):
            held.append((text, start - first, end - first, np.unique(ids[start:more], return_inverse=True)[1] + 1))
            size += more - start
            if size >= TREE_WORDS:
                search()
                held, size = [], 0
    if held:
        search()
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def runs(words: list, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    return runs_of_all([words], shortest, repeats)[0]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """Words that no run repeats: a run keeps its first period."""
    out, at = [], 0
    for start, end in sorted((s + q, s + length) for s, length, q in found):
        if end > at:
            out += words[at:max(start, at)]
            at = end
    return out + words[at:]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS, change: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """doc_id, ``runs`` and ``text`` with every run cut to its first period, words joined by one space.

    ``change`` may give other words for a document's id and words before they are searched.
    """
    types = pa.schema([("doc_id", pa.int64()), ("runs", RUN_TYPE), ("text", pa.binary())])

    def result(ids: list, texts: list[list]) -> pa.RecordBatch:
        found = runs_of_all(texts, shortest, repeats)
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
        kept = [b" ".join(collapsed(words, f)) for words, f in zip(texts, found)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, RUN_TYPE), pa.array(kept, pa.binary())], schema=types)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or b"").split()
                ids.append(doc_id)
                texts.append(change(doc_id, words) if change else words)
                size += len(words)
                if size >= HELD_WORDS:
                    yield result(ids, texts)
                    ids, texts, size = [], [], 0
            yield result(ids, texts)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(search, f"doc_id bigint, runs {RUNS}, text binary").withColumn("text", F.col("text").cast("string"))


def repeated_tail(doc_id: int | None, words: list) -> list:
    """The damage of the query: in one of ten documents the words from some point on repeat their beginning."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a:a + p] * (-(-(n - a) // p)))[:n]


def op12_lyndon_lce_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(table(spark, folder, "documents"), change=repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).cast("bigint").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
