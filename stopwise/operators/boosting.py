"""Many boosted classifiers grown together on one stored, binned frame.

The frame is cut into bins once, by edges shared by all models, and stored in chunks of rows beside the labels and the
row masks. A round adds one tree to every model. Nodes with many rows are split level by level: each task
sends one histogram per model and node, histograms are summed by node, and the best split of each comes back.
Nodes with at most ``node_rows`` rows are finished in one task each, which gets just their rows and sums histograms of the
smaller child of a split only; the other child has the rest of its parent. So a round takes a few
passes over the data for all models, and no task or driver ever holds more than ``node_rows`` rows of a node or one tree per
model. Margins are kept per row and model, so training goes on where it stopped, also for only some of the models.

Splits follow second-order boosting with logistic loss: gain GL2/(HL+1) + GR2/(HR+1) - G2/(H+1), which must reach ``gain``,
with a summed hessian of 1 on both sides, and leaves of -rate * G/(H+1). Gradients are whole multiples of
2^-20, so sums are exact and trees do not depend on how rows are dealt. Nulls count as -1.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.session import cut_lineage

UNIT = float(2 ** 20)
LEAST_WEIGHT = 1.0  # summed hessian of a child
SMOOTHING = 1.0  # added to the hessian of a leaf
NODE_ROWS = 1_000_000  # rows that a task may hold: about 100 bytes each
CHUNK_ROWS = 16_384
CHUNK_BYTES = 4 << 20  # margins of a chunk: with many models it has fewer rows
BATCH_BYTES = 16 << 20  # margins that go to or from a Python worker at once
HELD_BYTES = 64 << 20  # histograms that a task holds before it sends them
TASK_ROWS = 1000  # rows of the frame that make a task worth starting
TASK_BYTES = 64 << 20  # margins that a task reads
ROUNDS_PER_WRITE = 20
FEW_ROWS = 400  # rows for which going down a tree one node at a time no longer pays
SLOT_BLOCK = 256  # nodes whose splits are weighed at a time
BINS = 64


@dataclass(frozen=True)
class Spec:
    """One model: label and masks are names given to ``Boosting``."""

    name: str
    label: str
    train: str
    depth: int
    trees: int = 100
    rate: float = 0.4
    gain: float = 0.0


@dataclass
class Tree:
    """Nodes as arrays; ``left`` is 0 at a leaf, the right child follows the left one. ``cut`` is the last bin that goes left."""

    feature: array = field(default_factory=lambda: [0])
    cut: array = field(default_factory=lambda: [0])
    left: array = field(default_factory=lambda: [0])
    value: array = field(default_factory=lambda: [0.0])
    gain: array = field(default_factory=lambda: [0.0])

    def __post_init__(self) -> None:
        for name, kind in zip(self.__dataclass_fields__, "hhidd"):
            setattr(self, name, array(kind, getattr(self, name)))

    def packed(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name in self.__dataclass_fields__]

    @staticmethod
    def unpacked(columns: Iterable[bytes]) -> Tree:
        return Tree(*(array(kind, bytes(c)) for kind, c in zip("hhidd", columns)))

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> int:
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.left)
        for column, more in ((self.feature, (0, 0)), (self.cut, (0, 0)), (self.left, (0, 0)), (self.gain, (0.0, 0.0)), (self.value, values)):
            column.extend(more)
        return self.left[node]

    def graft(self, node: int, other: Tree) -> None:
        """Put ``other`` in the place of a leaf."""
        shift = len(self.left) - 1  # node k of the other becomes k + shift, its root stays here
        for column, more in ((self.feature, other.feature), (self.cut, other.cut), (self.gain, other.gain), (self.value, other.value)):
            column[node] = more[0]
            column.extend(more[1:])
        lefts = np.array(other.left)
        lefts[lefts > 0] += shift
        self.left[node] = lefts[0]
        self.left.extend(lefts[1:].tolist())

    def nodes_of(self, lines: np.ndarray) -> np.ndarray:
        """The node in which each row ends; ``lines`` has one line of bins per feature."""
        at, ahead, rest = np.zeros(lines.shape[1], np.int64), [(0, np.arange(lines.shape[1]))], []
        while ahead:
            node, rows = ahead.pop()
            first = self.left[node]
            if not first or len(rows) < FEW_ROWS:
                at[rows] = node
                if first:
                    rest.append(rows)
                continue
            high = lines[self.feature[node]][rows] > self.cut[node]
            ahead += [(first, rows[~high]), (first + 1, rows[high])]
        if rest:
            rows, flat = np.concatenate(rest), lines.reshape(-1)
            start, cut, left = np.array(self.feature, np.int64) * lines.shape[1], np.array(self.cut), np.array(self.left)
            here = at[rows]
            while len(rows):
                here = left[here] + (flat[start[here] + rows] > cut[here])
                at[rows] = here
                more = left[here] > 0
                rows, here = rows[more], here[more]
        return at

    def toward(self, nodes: Iterable[int]) -> set[int]:
        """The nodes on the ways from the root to some nodes."""
        found = set(nodes)
        for node in range(len(self.left) - 1, -1, -1):
            if self.left[node] and (self.left[node] in found or self.left[node] + 1 in found):
                found.add(node)
        return found

    def rows_in(self, nodes: set[int], toward: set[int], lines: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Which of some rows are in each of some leaves; goes down only ``toward`` them."""
        ahead = [(0, rows)]
        while ahead:
            node, rows = ahead.pop()
            if node not in toward or not len(rows):
                continue
            if node in nodes:
                yield node, rows
                continue
            high = lines[self.feature[node]][rows] > self.cut[node]
            ahead += [(self.left[node], rows[~high]), (self.left[node] + 1, rows[high])]


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chance = 1 / (1 + np.exp(-margin.astype(np.float64)))
    return np.rint((chance - label) * UNIT), np.rint(np.maximum(chance * (1 - chance), 1 / UNIT) * UNIT)


def bin_starts(edges: list[np.ndarray]) -> np.ndarray:
    """Where the bins of each feature start when all stand in one line, and where the last ends."""
    return np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])


def histograms(lines: np.ndarray, slot: np.ndarray | None, number: int, weights: tuple, starts: np.ndarray) -> np.ndarray:
    """Sums of each weight (rows for None): [weights, slots, bins of all features]."""
    out = np.empty((len(weights), number, starts[-1]))
    for f, (first, last) in enumerate(zip(starts, starts[1:])):
        at = lines[f].astype(np.int64) if slot is None else slot * (last - first) + lines[f]
        for k, w in enumerate(weights):
            out[k, :, first:last] = np.bincount(at, w, number * (last - first)).reshape(number, -1)
    return out


@dataclass
class Splits:
    """Per slot: whether it splits, feature, cut, gain, and the sums of the left and the right child."""

    found: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    low: np.ndarray
    high: np.ndarray


def best_splits(sums: np.ndarray, least_gain: float, starts: np.ndarray) -> Splits:
    feature = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    score = lambda s: (s[0] / UNIT) ** 2 / (s[1] / UNIT + SMOOTHING)
    parts = []
    for first in range(0, sums.shape[1], SLOT_BLOCK):
        block = sums[:, first:first + SLOT_BLOCK]
        total = block[:, :, :starts[1]].sum(-1, keepdims=True)  # every feature has the same totals
        low = block.cumsum(-1)
        low -= total * feature
        high = total - low
        gain = score(low) + score(high) - score(total)
        gain[(low[1] < LEAST_WEIGHT * UNIT) | (high[1] < LEAST_WEIGHT * UNIT)] = -np.inf
        best, slots = gain.argmax(1), np.arange(block.shape[1])
        most = gain[slots, best]
        parts.append(((most > 1e-6) & (most >= least_gain), feature[best], best - starts[feature[best]], most, low[:, slots, best], high[:, slots, best]))
    return Splits(*(np.concatenate(p, -1) for p in zip(*parts)))


def leaf(sums: np.ndarray, rate: float) -> float:
    return float(-rate * sums[0] / (sums[1] + SMOOTHING * UNIT))


def grown(lines: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least_gain: float, rate: float, starts: np.ndarray) -> Tree:
    """The whole tree of a bounded number of rows."""
    number, flat = lines.shape[1], lines.reshape(-1)
    rows, slot = np.arange(number), np.zeros(number, np.int64)
    totals = np.array([[g.sum()], [h.sum()]])  # of the nodes of a level
    open_ = np.flatnonzero(totals[1] >= 2 * LEAST_WEIGHT * UNIT)  # of these nodes, those that may split; slots are places herein
    sums = histograms(lines, slot, 1, (g, h), starts) if depth and len(open_) else None
    levels, nodes = [], 0
    for level in range(depth + 1):
        size = totals.shape[1]
        feature, cut, left = (np.zeros(size, np.int64) for _ in range(3))
        gain, value = np.zeros(size), -rate * totals[0] / (totals[1] + SMOOTHING * UNIT)
        levels.append((feature, cut, left, value, gain))
        nodes += size
        if level == depth or not len(open_):
            break
        best = best_splits(sums, least_gain, starts)
        split = open_[best.found]
        if not len(split):
            break
        feature[split], cut[split], gain[split] = best.feature[best.found], best.cut[best.found], best.gain[best.found]
        left[split] = nodes + 2 * np.arange(len(split))
        totals = np.stack([best.low[:, best.found], best.high[:, best.found]], 2).reshape(2, -1)
        if level + 1 == depth:
            continue
        pairs = (totals[1] >= 2 * LEAST_WEIGHT * UNIT).reshape(-1, 2).any(1)  # of these children one may split
        place = np.full(len(best.found), -1)
        place[np.flatnonzero(best.found)[pairs]] = np.arange(pairs.sum())
        stay = place[slot] >= 0
        rows, slot = rows[stay], slot[stay]
        slot = 2 * place[slot] + (flat[best.feature[slot] * number + rows] > best.cut[slot])
        open_ = np.flatnonzero(np.repeat(pairs, 2))
        if not len(open_):
            continue
        few = np.bincount(slot, minlength=len(open_)).reshape(-1, 2).argmin(1)  # the child of fewer rows is summed, the other is the rest
        mine = few[slot >> 1] == (slot & 1)
        summed, pair = rows[mine], slot[mine] >> 1
        part = histograms(lines[:, summed], pair, len(few), (g[summed], h[summed]), starts)
        parents = sums[:, np.flatnonzero(best.found)[pairs]]
        sums = np.empty((2, len(open_), starts[-1]))
        each = np.arange(len(few))
        sums[:, 2 * each + few] = part
        sums[:, 2 * each + 1 - few] = parents - part
    return Tree(*(np.concatenate(c).tolist() for c in zip(*levels)))


def bin_edges(frame: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each column, from one pass of quantile sketches."""
    quantiles = frame.select(*columns).fillna(-1).approxQuantile(columns, [k / bins for k in range(1, bins)], 0.001)
    return [np.unique(q) for q in quantiles]


def binned(values: pd.DataFrame, columns: list[str], edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[c].to_numpy("float64", na_value=-1.0), "left") for c, e in zip(columns, edges)], 1).astype("u1")


CHUNK = "chunk bigint, n int, bins binary, labels binary, masks binary"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(method: Callable) -> Callable:
    """Runs a method of ``Boosting`` so that Python workers get and give few chunks at a time: a task's margins at once would be held several times over."""
    @functools.wraps(method)
    def run(self, *args):
        before = self.spark.conf.get(ARROW_ROWS)
        self.spark.conf.set(ARROW_ROWS, str(max(1, BATCH_BYTES // max(1, 4 * len(self.specs) * self.chunk_rows))))
        try:
            return method(self, *args)
        finally:
            self.spark.conf.set(ARROW_ROWS, before)

    return run


class Boosting:
    """Models of ``specs`` on ``frame``; ``labels`` and ``masks`` are boolean columns by name."""

    def __init__(self, frame: DataFrame, columns: list[str], labels: dict[str, Column], masks: dict[str, Column], specs: Iterable[Spec],
                 bins: int = BINS, node_rows: int = NODE_ROWS, chunk_rows: int = CHUNK_ROWS, edges: list[np.ndarray] | None = None, keep_trees: bool = True):
        self.spark, self.columns, self.specs = frame.sparkSession, columns, list(specs)
        self.labels, self.masks = list(labels), list(masks)
        self.node_rows, self.keep_trees = node_rows, keep_trees  # who only reads margins needs no trees of past rounds
        self.edges = edges or bin_edges(frame, columns, bins)
        self.starts = bin_starts(self.edges)
        self.trees: dict[str, list[Tree]] = {s.name: [] for s in self.specs}
        self.chunk_rows = max(1, min(chunk_rows, CHUNK_BYTES // max(1, 4 * len(self.specs))))
        self.state = cut_lineage(self.chunks(frame, labels, masks, self.chunk_rows))
        self.held: list[DataFrame] = []
        self.round = 0

    def chunks(self, frame: DataFrame, labels: dict[str, Column], masks: dict[str, Column], size: int) -> DataFrame:
        columns, edges, models = self.columns, self.edges, len(self.specs)
        bits = lambda named: F.array(*[F.coalesce(c, F.lit(False)).cast("tinyint") for c in named.values()])

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            number, held, rows = TaskContext.get().partitionId() << 32, [], 0

            def chunk() -> pd.DataFrame:
                values = pd.concat(held)
                flags = [np.stack(values[c].to_list()).astype("u1").T.tobytes() for c in ("_labels", "_masks")]
                return pd.DataFrame([(number, len(values), binned(values, columns, edges).T.tobytes(), *flags, bytes(4 * models * len(values)))],
                                    columns=["chunk", "n", "bins", "labels", "masks", "margins"])

            for batch in batches:
                first = 0
                while first < len(batch):
                    held.append(batch[first:first + size - rows])
                    first, rows = first + len(held[-1]), rows + len(held[-1])
                    if rows == size:
                        yield chunk()
                        number, held, rows = number + 1, [], 0
            if rows:
                yield chunk()

        numbers = [F.col(c).cast("double").alias(c) for c in columns]
        number, rows, parallel = frame.rdd.getNumPartitions(), frame.count(), self.spark.sparkContext.defaultParallelism
        worth = max(1, rows // TASK_ROWS)  # tasks that the rows are worth
        asked = min(worth, max(2 * parallel, math.ceil(4 * models * rows / TASK_BYTES)))
        if number > worth:
            frame = frame.coalesce(worth)
        elif number < asked:
            frame = frame.repartition(asked)
        return frame.select(*numbers, bits(labels).alias("_labels"), bits(masks).alias("_masks")).mapInPandas(cut, CHUNK + ", margins binary")

    def views(self) -> Callable:
        """Reader of a chunk: one line of bins per feature, and (spec, label, train mask, margin) by model."""
        specs, labels, masks, features = list(self.specs), self.labels, self.masks, len(self.columns)

        def read(row) -> tuple[np.ndarray, list[tuple]]:
            lines = np.frombuffer(row.bins, "u1").reshape(features, row.n)
            y, use = (np.frombuffer(b, "u1").reshape(-1, row.n) for b in (row.labels, row.masks))
            margins = np.frombuffer(row.margins, "<f4").reshape(len(specs), row.n)
            return lines, [(s, y[labels.index(s.label)], use[masks.index(s.train)] > 0, margins[k]) for k, s in enumerate(specs)]

        return read

    def parts(self, groups: int, rows: float = math.inf) -> int:
        """Tasks for some groups, fewer where all of them have few rows."""
        return max(1, int(min(groups, 4 * self.spark.sparkContext.defaultParallelism, rows // (10 * TASK_ROWS))), groups // 50)

    def sizes(self) -> dict[str, float]:
        """Rows that each model learns from."""
        read = self.views()

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(spec.name, float(use.sum())) for row in batch.itertuples() for spec, _, use, _ in read(row)[1]], columns=["model", "n"])

        return dict(map(tuple, self.state.mapInPandas(count, "model string, n double").groupBy("model").agg(F.sum("n")).collect()))  # one row per model

    def node_sums(self, trees: dict[str, Tree], open_: dict[str, list[int]]) -> DataFrame:
        """(model, node, sums): the histogram of each open node over the rows of a task; what a task holds is sent early only beyond HELD_BYTES."""
        read, starts = self.views(), self.starts
        ways = {name: (trees[name], set(nodes), trees[name].toward(nodes)) for name, nodes in open_.items()}
        most = max(1, HELD_BYTES // (24 * int(starts[-1])))

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[str, int], np.ndarray] = {}

            def told() -> Iterator[pd.DataFrame]:
                keys = list(held)
                for first in range(0, len(keys), 256):
                    some = keys[first:first + 256]
                    yield pd.DataFrame([(*key, held.pop(key).tobytes()) for key in some], columns=["model", "node", "sums"])

            for batch in batches:
                for row in batch.itertuples():
                    lines, models = read(row)
                    for spec, y, use, margin in models:
                        if spec.name not in ways:
                            continue
                        tree, nodes, toward = ways[spec.name]
                        for node, rows in tree.rows_in(nodes, toward, lines, np.flatnonzero(use)):
                            sums = histograms(lines[:, rows], None, 1, (*gradients(margin[rows], y[rows]), None), starts)
                            key = spec.name, node
                            if key in held:
                                held[key] += sums
                            else:
                                held[key] = sums
                        if len(held) >= most:
                            yield from told()
            yield from told()

        return self.state.mapInPandas(send, "model string, node bigint, sums binary")

    def level(self, trees: dict[str, Tree], open_: dict[str, list[int]]) -> dict[tuple[str, int], tuple]:
        """Sums and best split of nodes, from histograms that the tasks send and that are summed by node."""
        starts = self.starts
        gains = {s.name: s.gain for s in self.specs}

        def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((3, 1, starts[-1]))
            for data in rows["sums"]:
                total += np.frombuffer(data).reshape(total.shape)
            best = best_splits(total, gains[key[0]], starts)
            columns = ["model", "node", "found", "feature", "cut", "gain", "own", "low", "high"]
            own = total[:, 0, :starts[1]].sum(-1)
            return pd.DataFrame([(*key, best.found[0], best.feature[0], best.cut[0], best.gain[0], own, best.low[:, 0], best.high[:, 0])], columns=columns)

        sent = self.node_sums(trees, open_)
        dealt = sent.repartition(self.parts(math.ceil(sum(map(len, open_.values())) / 8)), "model", "node")  # a node has one histogram of a few KB per task
        schema = "model string, node bigint, found boolean, feature int, cut int, gain double, own array<double>, low array<double>, high array<double>"
        told = dealt.groupBy("model", "node").applyInPandas(choose, schema).collect()  # one row per open node
        return {(r.model, r.node): (np.array(r.own), (r.feature, r.cut, r.gain, np.array(r.low), np.array(r.high)) if r.found else None) for r in told}

    def finish(self, trees: dict[str, Tree], small: dict[str, list[tuple[int, int]]], total: float) -> None:
        """Grow the rest of the trees below nodes of few rows, one task per node."""
        read, features, starts = self.views(), len(self.columns), self.starts
        left = {(name, node): depth for name, nodes in small.items() for node, depth in nodes}
        rates = {s.name: (s.gain, s.rate) for s in self.specs}
        ways = {}
        for name, nodes in small.items():
            wanted = {node for node, _ in nodes}
            ways[name] = trees[name], wanted, trees[name].toward(wanted)

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    lines, models = read(row)
                    out = []
                    for spec, y, use, margin in models:
                        if spec.name not in ways:
                            continue
                        tree, nodes, toward = ways[spec.name]
                        for node, rows in tree.rows_in(nodes, toward, lines, np.flatnonzero(use)):
                            out.append((spec.name, node, lines[:, rows].tobytes(), y[rows].tobytes(), margin[rows].tobytes()))
                    yield pd.DataFrame(out, columns=["model", "node", "bins", "labels", "margins"])

        def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            lines = np.concatenate([np.frombuffer(b, "u1").reshape(features, -1) for b in rows["bins"]], 1)
            y, margin = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("labels", "u1"), ("margins", "<f4")))
            tree = grown(lines, *gradients(margin, y), left[key], *rates[key[0]], starts)
            return pd.DataFrame([(*key, *tree.packed())], columns=["model", "node", *Tree.__dataclass_fields__])

        sent = self.state.mapInPandas(send, "model string, node bigint, bins binary, labels binary, margins binary").repartition(self.parts(len(left), total), "model", "node")
        schema = "model string, node bigint, feature binary, cut binary, left binary, value binary, gain binary"
        for r in sent.groupBy("model", "node").applyInPandas(grow, schema).collect():  # one tree per model, or its branches
            trees[r.model].graft(r.node, Tree.unpacked(r[2:]))

    def add_trees(self, trees: dict[str, Tree]) -> None:
        """Margins move by the new trees; the state before is let go once the new one is held."""
        read = self.views()

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                moved = []
                for row in batch.itertuples():
                    lines, models = read(row)
                    margins = [m + np.array(trees[s.name].value, "f4")[trees[s.name].nodes_of(lines)] if s.name in trees else m for s, _, _, m in models]
                    moved.append(np.array(margins, "<f4").tobytes())
                yield batch.assign(margins=moved)

        new = self.state.mapInPandas(move, self.state.schema)
        self.round += 1
        if self.round % ROUNDS_PER_WRITE == 0:
            self.state = cut_lineage(new)
            self.release()
        else:
            self.state = new.persist(StorageLevel.MEMORY_AND_DISK)
            self.held.append(self.state)
            if len(self.held) > 2:
                self.held.pop(0).unpersist()

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    @in_small_batches
    def grow(self, rounds: int) -> Boosting:
        """``rounds`` more trees for each model that still wants some."""
        sizes = self.sizes() if self.specs else {}
        for _ in range(rounds):
            wanting = [s for s in self.specs if len(self.trees[s.name]) < s.trees and sizes.get(s.name)]
            if not wanting:
                break
            trees = {s.name: Tree() for s in wanting}
            nodes = {s.name: [(0, sizes[s.name])] for s in wanting}  # with their rows
            rates = {s.name: s.rate for s in wanting}
            small: dict[str, list[tuple[int, int]]] = {}
            total = 0.0  # rows of small nodes
            deepest = max(s.depth for s in wanting)
            for depth in range(deepest + 1):
                open_ = {}
                for s in wanting:
                    few = [(node, s.depth - depth) for node, n in nodes[s.name] if n <= self.node_rows and (s.depth > depth or depth == 0)]
                    many = [node for node, n in nodes[s.name] if n > self.node_rows and (s.depth > depth or depth == 0)]
                    small.setdefault(s.name, []).extend(few)
                    total += sum(n for _, n in nodes[s.name] if n <= self.node_rows)
                    if many:
                        open_[s.name] = many
                if not open_:
                    break
                nodes = {s.name: [] for s in wanting}
                depths = {s.name: s.depth for s in wanting}
                for (name, node), (own, best) in self.level(trees, open_).items():
                    if not node:
                        trees[name].value[0] = leaf(own, rates[name])
                    if best and depths[name] > depth:
                        feature, cut, gain, low, high = best
                        first = trees[name].split(node, feature, cut, gain, (leaf(low, rates[name]), leaf(high, rates[name])))
                        nodes[name] += [(first, low[2]), (first + 1, high[2])]
            small = {name: found for name, found in small.items() if found}
            if small:
                self.finish(trees, small, total)
            for name, tree in trees.items():
                self.trees[name].append(tree if self.keep_trees else None)
            self.add_trees(trees)
        return self

    @in_small_batches
    def keep(self, names: list[str]) -> Boosting:
        """Go on with some of the models only; their margins stay."""
        places = [k for k, s in enumerate(self.specs) if s.name in names]
        models = len(self.specs)

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(margins=[np.frombuffer(m, "<f4").reshape(models, -1)[places].tobytes() for m in batch["margins"]])

        self.state = cut_lineage(self.state.mapInPandas(cut, self.state.schema))
        self.release()
        self.specs = [self.specs[k] for k in places]
        return self

    @in_small_batches
    def right(self, test: dict[str, str]) -> dict[str, tuple[int, int]]:
        """(right, rows) of each model on the rows of its test mask, read off the margins."""
        read, masks = self.views(), self.masks

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples():
                    use = np.frombuffer(row.masks, "u1").reshape(-1, row.n)
                    for spec, y, _, margin in read(row)[1]:
                        rows = use[masks.index(test[spec.name])] > 0
                        out.append((spec.name, int(((margin[rows] > 0) == (y[rows] > 0)).sum()), int(rows.sum())))
                yield pd.DataFrame(out, columns=["model", "right", "n"])

        counts = self.state.mapInPandas(count, "model string, right bigint, n bigint").groupBy("model").agg(F.sum("right"), F.sum("n"))
        return {r[0]: (r[1], r[2]) for r in counts.collect()}  # one row per model

    def accuracy(self, test: dict[str, str]) -> dict[str, float]:
        return {name: right / n if n else 0.0 for name, (right, n) in self.right(test).items()}

    def models(self) -> Models:
        self.release()
        return Models(self.columns, self.edges, dict(self.trees))


@dataclass
class Models:
    """Grown models by name, and the edges they share."""

    columns: list[str]
    edges: list[np.ndarray]
    trees: dict[str, list[Tree]]

    def save(self, spark: SparkSession, path: str) -> str:
        """A table keyed by model: one row per tree; the edges stand in rows of their own."""
        rows = [(name, k, *(getattr(t, c).tolist() for c in Tree.__dataclass_fields__)) for name, trees in self.trees.items() for k, t in enumerate(trees)]
        edges = [(column, -1, [], [], [], e.tolist(), [float(k)]) for k, (column, e) in enumerate(zip(self.columns, self.edges))]
        schema = "name string, tree int, feature array<int>, cut array<int>, left array<int>, value array<double>, gain array<double>"
        parts = max(1, math.ceil(len(rows) / 200))
        spark.createDataFrame(rows + edges, schema, verifySchema=False).repartition(parts).write.parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str, names: list[str] | None = None) -> Models:
        """All models of the table, or those named; a tree is a bounded row, and scoring needs them all."""
        table = spark.read.parquet(path)
        wanted = table if names is None else table.filter(F.col("name").isin(names) | (F.col("tree") < 0))
        edges, trees = [], {}
        for r in wanted.orderBy("name", "tree").toLocalIterator():
            if r.tree < 0:
                edges.append((r.gain[0], r.name, np.array(r.value)))
            else:
                trees.setdefault(r.name, []).append(Tree(*(list(r[c]) for c in Tree.__dataclass_fields__)))
        edges.sort(key=lambda e: e[0])
        return Models([e[1] for e in edges], [e[2] for e in edges], trees)

    def margins(self, bins: np.ndarray) -> dict[str, np.ndarray]:
        lines = np.ascontiguousarray(bins.T)
        return {name: sum((np.array(t.value, "f4")[t.nodes_of(lines)] for t in trees), np.zeros(len(bins), "f4")) for name, trees in self.trees.items()}

    def chances(self, rows: DataFrame) -> DataFrame:
        """Adds ``chances``: one chance of the label per model, in the order of ``trees``."""
        scorer = rows.sparkSession.sparkContext.broadcast(self)  # the models: bounded by their trees

        @F.pandas_udf("array<double>")
        def score(values: pd.DataFrame) -> pd.Series:
            own = scorer.value
            found = [1 / (1 + np.exp(-m.astype("f8"))) for m in own.margins(binned(values, own.columns, own.edges)).values()]
            return pd.Series(list(np.stack(found, 1)) if found else [[]] * len(values))

        return rows.withColumn("chances", score(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns])))

    def importance(self) -> dict[str, float]:
        """Mean gain of the splits of each feature over all trees, as shares of one."""
        total, number = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for tree in (t for trees in self.trees.values() for t in trees):
            inner = np.array(tree.left) > 0
            np.add.at(total, np.array(tree.feature)[inner], np.array(tree.gain)[inner])
            np.add.at(number, np.array(tree.feature)[inner], 1)
        mean = total / np.maximum(number, 1)
        return dict(zip(self.columns, (mean / (mean.sum() or 1)).tolist()))
