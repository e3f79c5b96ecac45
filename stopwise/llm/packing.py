"""Packing token sequences by best-fit decreasing.

Texts become token ids once; overlong documents are cut into full windows first, and the rest of each
document is one piece. Best-fit decreasing puts every piece, longest first, into the tightest open window
that can hold it. Pieces of one length are interchangeable, so the plan needs only how many pieces there
are of each length: at most ``window`` numbers, whatever the size of the corpus. A segment tree indexed by
remaining capacity answers "tightest open window with room for this length", and windows with the same
history are kept as one run. Runs of placements go back to the executors as a small table, and each piece
finds its window from its rank among the pieces of its length.

Defined results: null text is empty and is one separator token; the string of an added token inside a text is that token; texts of any length are read whole; rows
that repeat are separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm.common import numbered, rank_in_class, table

WINDOW = 1024
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"
NOT_LATIN = re.compile("[\u0250-\U0010ffff]")  # letters after the Latin blocks
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


class Encoder:
    """Token ids of whole texts, as the library gives them by default. The vocabulary file has a twin that lists the same tokens
    by rank and gives the same ids several times faster; it reads Latin texts, for which both splitters know the same letters,
    without strings of added tokens, which the library takes as single tokens."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([NOT_LATIN.pattern, *added]))
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.latin = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids if self.slow.search(text) else self.latin.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Full windows and the rest of each document, as little-endian 32-bit ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, encode = [], encoder(path).encode
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.asarray([*encode(text), SEPARATOR], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    rows.append((doc_id, start, len(piece), len(ids), piece.tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..top: is there an open window with that room?"""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        node = self.leaves + capacity
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` with an open window."""
        node = self.leaves + need
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, end rank, first sequence, pieces per sequence, offset) of all pieces.

    ``counts`` has the number of pieces of each length. Windows of one capacity form runs of neighbouring
    sequences; a length fills whole runs and splits at most the last one. A window that took a piece stays
    the tightest while another piece of the length fits, so it takes ``capacity // length`` pieces at once.
    """
    tree, runs, placed, sequences = CapacityTree(window), {}, [], 0

    def release(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            runs.setdefault(capacity, []).append((first, number))
            tree.set(capacity, True)

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, number = window, sequences, -(-left // (window // length))
                sequences += number
            else:
                first, number = runs[capacity].pop()
                if not runs[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            used = full * each + rest
            placed.append((length, rank, rank + used, first, each, window - capacity))
            release(capacity - each * length, first, full)
            if rest:
                release(capacity - rest * length, first + full, 1)
            release(capacity, first + full + bool(rest), number - full - bool(rest))
            rank, left = rank + used, left - used
    return placed


PLACEMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("_length", "_from", "_to", "_first", "_each", "_offset")])


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of a numbered table with a ``length`` of 1 to ``window``.

    The driver sees one count per length; the table of placements depends on the lengths, not on the rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    places = pieces.sparkSession.createDataFrame(best_fit_decreasing(counts, window), PLACEMENT)
    ranked = rank_in_class(pieces, "length", "_rank")
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    put = ranked.join(F.broadcast(places), inside)  # a few runs per length
    at = F.col("_rank") - F.col("_from")
    return put.select(
        *pieces.columns, (F.col("_first") + F.floor(at / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).alias("offset"))


def packed_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Every piece of every document with its ids, sequence and offset."""
    pieces = numbered(tokenized_pieces(docs, path, window), "pieces")
    return pack(pieces.drop("ids"), window).join(pieces.select("_row", "ids"), "_row")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order (at most one window, so the group is bounded)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = numbered(tokenized_pieces(table(spark, folder, "documents"), tokenizer_path()), "pieces")
    narrow = pieces.select("_row", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(narrow).drop("_row")
