"""Repair of the role structure of conversations by a Viterbi search that emits edits while it reads.

A repaired conversation is empty or an optional system turn followed by pairs of user and assistant. The states of the
search are what the output ends with: nothing, system, user or assistant. Each row is kept, given another role or deleted;
an empty turn may be inserted anywhere. The cheapest edits win, and of equally cheap ones those
whose initials, read in order, come first.

Survivors (the best path into each state) are leaves of a tree of backpointers. A node counts its references, so
paths that lose are freed at once, and as soon as all survivors share an ancestor the edits up to it are
final: they are written, and the rows they speak of are let go. Equal edits in a row share one
node. Memory is the stretch on which survivors still differ, not the conversation. Equal costs are
decided by all the edits after the last common ancestor of both paths. Two paths of the same cost
into one state are never prefixes of each other (the longer would have paid for its inserts), so the order of
two unresolved paths is the order of the whole edit strings.

Rows are shuffled once, by conversation, and sorted by turn on disk; a task reads its conversations as a stream, so
a conversation may be longer than its memory. Its digest is one hash over all its text, which has to be read in order.

Defined results: nulls of text and role are one space, a null turn comes first; in the key of the damage, null
ids and turns are one space too. Rows of one turn are ordered by their role and text as they came, so results repeat;
repeated rows are rows of their own. A null conv_id is one conversation. Very long texts are kept whole. Rows
without any conversation left give zeros, no edits and the hash of an empty string; an empty table gives no
rows. Roles count by their first character; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopwise.llm.common import prepare, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5  # a truncated row that stays
MUST_GO = ("blank", "duplicate")
BLANKS = " \t\n\x0b\x0c\r"
STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # what an output may go on with
ENDS = ("", "a")
NAMES = {"u": "user", "a": "assistant"}

FAULTS = ("blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")

EDITS = "conv_id bigint, turn bigint, role string, text string, fault string, gone boolean, edit string, new_role string, last boolean, cost bigint"
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
EDIT_TYPES, REPORT_TYPES = (pa.schema([(n, ARROW[t]) for n, t in map(str.split, kinds.split(", "))]) for kinds in (EDITS, REPORT))


class Node:
    """``count`` equal edits after the parent's; ``refs`` children and survivors hang on it."""

    __slots__ = ("parent", "edit", "count", "refs")

    def __init__(self, parent: Node | None, edit: str):
        self.parent, self.edit, self.count, self.refs = parent, edit, 1, 1


def release(node: Node | None) -> None:
    """One reference less; nodes without any are freed up the branch."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


def branch(node: Node) -> list[Node]:
    found = []
    while node is not None:
        found.append(node)
        node = node.parent
    return found[::-1]


def first_of(one: Node, other: Node) -> Node:
    """Of two paths from one root, the one whose edits come first."""
    if one is other:
        return one
    a, b = branch(one), branch(other)
    i = 0
    while i < min(len(a), len(b)) and a[i] is b[i]:
        i += 1
    at, bt = deque((n.edit, n.count) for n in a[i:]), deque((n.edit, n.count) for n in b[i:])
    while at and bt:
        (x, m), (y, n) = at.popleft(), bt.popleft()
        if x != y:
            return one if x < y else other
        if m > n:
            at.appendleft((x, m - n))
        elif n > m:
            bt.appendleft((y, n - m))
    return one if bt or not at else other


class Repair:
    """Edits of one conversation: ``feed`` its rows in order, then ``finish``; both give final (edit, row) pairs."""

    def __init__(self):
        self.root = Node(None, "")
        self.best = {"": (0, self.root)}  # state -> (cost, node)
        self.pending: deque = deque()  # rows whose edits are open
        self.spread()

    def offer(self, options: dict, state: str, cost: int, node: Node, edit: str) -> None:
        """Keep the extended path if it is the best into the state."""
        held = options.get(state)
        if held and held[0] < cost:
            return
        made = Node(node, edit)
        node.refs += 1
        if held and (held[0] == cost and first_of(held[1], made) is held[1]):
            release(made)
            return
        if held:
            release(held[1])
        options[state] = (cost, made)

    def spread(self) -> None:
        """Inserts: two in a row are enough, as three repeat a state at a higher price."""
        for _ in range(2):
            for state in list(self.best):
                cost, node = self.best[state]
                for role in STEPS[state]:
                    if role in NAMES:
                        self.offer(self.best, STEPS[state][role], cost + COST[INSERT], node, INSERT)

    def feed(self, row: tuple, role: str, fault: str | None) -> list[tuple[str, tuple | None]]:
        self.pending.append(row)
        options: dict = {}
        stay = TRUNCATED_COST if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            self.offer(options, state, cost + COST[DELETE], node, DELETE)
            if fault not in MUST_GO:
                for to in STEPS[state]:
                    if role[:1] == to:
                        self.offer(options, STEPS[state][to], cost + COST[KEEP] + stay, node, KEEP)
                    elif to in NAMES:
                        self.offer(options, STEPS[state][to], cost + COST[REROLE] + stay, node, REROLE)
        old, self.best = self.best, options
        for _, node in old.values():
            release(node)
        self.shorten()
        self.spread()
        self.forgo()
        return self.coalesced()

    def forgo(self) -> None:
        """Outputs without a pair yet are never reached again from the others, so their paths would stay apart for good.

        What they can go on with, an output that ends with an assistant can as well, but for a system row that it would delete.
        """
        cost, node = self.best["a"]
        for state, more in (("", COST[DELETE]), ("s", 0)):
            if state in self.best:
                held, at = self.best[state]
                if cost + more < held or (state and cost == held and first_of(node, at) is node):
                    release(self.best.pop(state)[1])

    def shorten(self) -> None:
        """A survivor that repeats its parent's edit, alone on it, joins the parent's node."""
        for state, (cost, node) in self.best.items():
            up = node.parent
            if up is not None and up.parent is not None and up.edit == node.edit and up.refs == 1 and node.refs == 1:
                up.count += node.count
                self.best[state] = (cost, up)

    def coalesced(self) -> list[tuple[str, tuple | None]]:
        """Edits up to the last ancestor of all survivors: nodes with one reference lead to it."""
        if self.root.refs > 1:
            return []
        path = branch(next(iter(self.best.values()))[1])
        i = 0
        while path[i].refs == 1 and i < len(path) - 1:
            i += 1
        return self.written(path[1:i + 1])

    def written(self, nodes: list[Node]) -> list[tuple[str, tuple | None]]:
        out = []
        for node in nodes:
            for _ in range(node.count):
                out.append((node.edit, None if node.edit == INSERT else self.pending.popleft()))
        if nodes:
            self.root = nodes[-1]
            self.root.parent, self.root.edit = None, ""
        return out

    def finish(self) -> tuple[int, list[tuple[str, tuple | None]]]:
        (cost, node), *rest = [self.best[s] for s in ENDS if s in self.best]
        for other_cost, other in rest:
            if other_cost < cost or (other_cost == cost and first_of(node, other) is other):
                cost, node = other_cost, other
        return cost, self.written(branch(node)[1:])


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def fault_of(text: Column, repeated: Column) -> Column:
    """The first fault of a row, or null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return (F.when(bare == "", "blank").when(repeated, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage by crc32 of ``conv_id:turn``; dropped rows stay as marks (``gone``) of their conversation.

    ``role0``, ``text0`` and ``copy`` order the rows of one turn.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role0"), space("text").alias("text0"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role0"))
    gone = F.col("kind") == 0
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.select("conv_id", "turn", "role0", "text0", role.alias("role"), text.alias("text"), gone.alias("gone"), F.explode(copies).alias("copy"))
    return made.withColumns({c: F.when(~F.col("gone"), F.col(c)) for c in ("role0", "text0", "role", "text")})


def in_order() -> tuple[Column, ...]:
    return F.col("turn").asc_nulls_first(), F.col("role0"), F.col("text0"), F.col("copy")


def classified(rows: DataFrame) -> DataFrame:
    """Rows with their fault, each conversation in one task and in order.

    The window and the stream share the shuffle by conversation; rows seen earlier are told by a running row number.
    """
    dealt = rows.repartition("conv_id")
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(*in_order())) > 1
    told = dealt.withColumn("fault", F.when(~F.col("gone"), fault_of(F.col("text"), seen)))
    if told.sparkSession.conf.get("spark.sql.requireAllClusterKeysForDistribution", "false") == "true":
        told = told.repartition("conv_id")  # the window has dealt the rows by all its keys
    return told.sortWithinPartitions(F.col("conv_id"), F.col("gone").desc(), *in_order()).select("conv_id", "turn", "role", "text", "fault", "gone")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def edited(rows: DataFrame) -> DataFrame:
    """The edits of classified rows as a stream in the order of the output.

    One row per edit, with the row it speaks of (an insert has none) and the role it ends with; dropped rows come as
    they are, with no edit. A conversation ends with a row ``last`` that has its cost.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, conv, output, out = None, None, "", []

        def put(pairs) -> None:
            nonlocal output
            for edit, row in pairs:
                turn, role, text, fault = row or (None, None, None, None)
                new = None
                if edit != DELETE:
                    start = role[:1] if edit == KEEP else next(r for r in STEPS[output] if r in NAMES)
                    new = role if edit == KEEP else NAMES[start]
                    output = STEPS[output][start]
                out.append((conv, turn, role, text, fault, False, edit, new, False, None))

        def close() -> None:
            if search is not None:
                cost, pairs = search.finish()
                put(pairs)
                out.append((conv, None, None, None, None, False, None, None, True, cost))

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(EDIT_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, EDIT_TYPES.types)], schema=EDIT_TYPES)

        for batch in batches:
            for of, turn, role, text, fault, gone in zip(*(column(batch, c) for c in ("conv_id", "turn", "role", "text", "fault", "gone"))):
                if search is None or of != conv:
                    close()
                    search, conv, output = Repair(), of, ""
                if gone:
                    out.append((conv, turn, None, None, None, True, None, None, False, None))
                else:
                    put(search.feed((turn, role, text, fault), role, fault))
            yield batch_of()
            out = []
        close()
        yield batch_of()

    return rows.mapInArrow(stream, EDITS)


def repaired(edits: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, role, text, edit, as a stream in order."""
    stays = F.col("edit").isin(KEEP, REROLE, INSERT)
    return edits.filter(stays).select("conv_id", F.col("new_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


class Report:
    """Counts, edits and digest of one conversation, folded from its edits."""

    def __init__(self):
        self.low = self.turn = self.initial = None
        self.turns = self.illegal = self.lines = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.audit, self.hash = io.StringIO(), hashlib.sha256()

    def take(self, turn: int | None, role: str, text: str, fault: str | None, edit: str, new: str) -> None:
        self.audit.write(edit)
        if edit != INSERT:
            if turn is not None and turn != self.turn:  # rows come by turn
                self.low = turn if self.low is None else self.low
                self.turn, self.turns = turn, self.turns + 1
            if fault:
                self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
        if edit != DELETE:
            self.hash.update(f"{chr(10) * bool(self.lines)}{new}:{text or ''}".encode())
            self.lines += 1

    def row(self, conv: int | None, cost: int) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return conv, gaps, *self.faults.values(), self.illegal, cost, self.audit.getvalue(), self.hash.hexdigest()


def reported(edits: DataFrame) -> DataFrame:
    """One row per conversation, folded from the stream of its edits; must read it as ``edited`` gives it."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = Report()
        for batch in batches:
            out = []
            names = ("conv_id", "turn", "role", "text", "fault", "gone", "edit", "new_role", "last", "cost")
            for conv, turn, role, text, fault, gone, edit, new, last, cost in zip(*(column(batch, c) for c in names)):
                if last:
                    out.append(report.row(conv, cost))
                    report = Report()
                elif not gone:
                    report.take(turn, role, text, fault, edit, new)
            columns = zip(*out) if out else [()] * len(REPORT_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, REPORT_TYPES.types)], schema=REPORT_TYPES)

    return edits.mapInArrow(fold, REPORT)


def repair(conversations: DataFrame) -> DataFrame:
    """Edits of conversations as they are, without damage: conv_id, turn, role, text."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role0"), space("text").alias("text0"),
        space("role").alias("role"), space("text").alias("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))
    return edited(classified(rows))


def op11_survivor_coalescence(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    prepare(spark)
    return reported(edited(classified(damaged(conversations))))
