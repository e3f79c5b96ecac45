"""Token counts of whole texts without token ids: pieces are counted once per distinct pre-token.

A word tokenizer cuts every pre-token by itself, so a text has as many tokens as its pre-tokens have pieces.
Texts are read once, in blocks of documents: a block keeps the list of its distinct pre-tokens, and each
document keeps (position in that list, frequency) pairs. Distinct pre-tokens of all blocks get their number of
pieces once; a join on the pre-token brings the numbers back to the blocks that hold it, and every
document is the sum of frequency times pieces.

A pre-token is one row per block, however many documents repeat it, so a word of every document weighs no more
than one row in some thousands; a block holds ``BLOCK_CHARS`` characters or one longer text.

Defined results: null text is empty and has no tokens; texts of any length are counted whole; special strings inside
a text are one token each and cut the text, as the library does by default; rows that repeat (also with one
doc_id or none) are counted each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import prepare, stored, table, text_or_empty
from stopwise.llm.packing import tokenizer_path

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
BLOCK_CHARS = 32_000_000
BLOCKS = "kind string, block bigint, spot int, word string, doc_id string, n_bytes bigint, n_special bigint, spots binary, counts binary"

# fixed values: the splitting pattern of the vocabulary, with its classes written out for characters below U+0180
SPACE = "\t-\r \x85\xa0"
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
LATIN_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_STEPS = ["NFC", "Replace", "Lowercase"]
NOT_LATIN = re.compile("[ƀ-\U0010ffff]")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class PreTokens:
    """Pre-tokens of a text in the letters of the vocabulary, and pieces of a pre-token."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, byte_letters()
        added = self.whole.get_added_tokens_decoder().values()
        if any(a.normalized or a.single_word or a.lstrip or a.rstrip for a in added):
            raise ValueError("only added tokens that are matched as they stand are supported")
        names = sorted((a.content for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = [s["type"] for s in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [s.get("pattern", {}).get("Regex") for s in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.latin = steps == LATIN_STEPS and splits[:1] == [LATIN_RULE]

    def spelled(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else word.encode("utf-8").decode("latin-1").translate(self.letters)

    def plain(self, part: str) -> list[str]:
        if self.latin and not NOT_LATIN.search(part):
            return LATIN_WORDS.findall(part.lower())
        rest = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
        return [rest[start:end] for _, (start, end) in self.whole.pre_tokenizer.pre_tokenize_str(rest)] if rest else []

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Frequency of each pre-token, and the number of special strings."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        found = Counter()
        for part in parts:
            found.update(self.plain(part))
        return found, len(parts) - 1

    def pieces(self, word: str) -> int:
        return len(self.model.tokenize(self.spelled(word)))


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on: the upper ones are mostly zero and take no room once compressed."""
    return numbers.astype("<i4").view("u1").reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<i4").ravel()


class Block:
    """Documents read together: their distinct pre-tokens, and positions and frequencies of each document."""

    def __init__(self, number: int):
        self.number, self.chars, self.words, self.docs = number, 0, {}, []

    def add(self, doc_id, n_bytes: int, text: str, split) -> None:
        found, special = split(text)
        place, words = self.words.setdefault, self.words
        spots = np.fromiter((place(w, len(words)) for w in found), "<i4", len(found))
        counts = np.fromiter(found.values(), "<i4", len(found))
        order = np.argsort(spots)
        self.docs.append((doc_id, n_bytes, special, planes(np.diff(spots[order], prepend=np.int32(0))), planes(counts[order])))
        self.chars += len(text) + 16  # documents without text fill a block too

    def frame(self) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "n_bytes", "n_special", "spots", "counts"]
        docs = pd.DataFrame(self.docs, columns=columns).assign(kind="doc", block=self.number, spot=None, word=None)
        words = pd.DataFrame({"word": list(self.words), "spot": np.arange(len(self.words), dtype="i4")})
        words = words.assign(kind="word", block=self.number, **dict.fromkeys(columns))
        order = ["kind", "block", "spot", "word", *columns]
        yield docs[order]
        for start in range(0, len(words), 100_000):
            yield words[order].iloc[start:start + 100_000]


def blocks(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of kind ``doc`` and ``word``, by block."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, number = pre_tokens(path).frequencies, TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            for doc_id, n_bytes, text in zip(batch["doc_id"], batch["n_bytes"], batch["text"]):
                block.add(doc_id, n_bytes, text, split)
                if block.chars >= block_chars:
                    yield from block.frame()
                    number += 1
                    block = Block(number)
        if block.docs:
            yield from block.frame()

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInPandas(read, BLOCKS)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(word, pieces), once per distinct word. Reads all columns of ``words``, so that a shuffle by word serves the join as well."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pre_tokens(path).pieces
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "pieces": np.fromiter(map(pieces, batch["word"]), "i4", len(batch))})

    once = words.groupBy("word").agg(F.min("block").alias("block"), F.min("spot").alias("spot"))
    return once.filter("block is not null and spot is not null").select("word").mapInPandas(count, "word string, pieces int")


def sums(docs: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """Tokens of each document of one block."""
    of = np.zeros(len(pieces), "i8")
    of[pieces["spot"].to_numpy()] = pieces["pieces"].to_numpy()
    spots = [np.cumsum(from_planes(s)) for s in docs["spots"]]
    n_tokens = [int(of[s] @ from_planes(c)) + n for s, c, n in zip(spots, docs["counts"], docs["n_special"])]
    return pd.DataFrame({"doc_id": docs["doc_id"], "n_bytes": docs["n_bytes"], "n_tokens": n_tokens})


def token_counts(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    made = stored(blocks(docs, path, block_chars), "pre-tokens")
    words = made.filter("kind = 'word' and word is not null").select("block", "spot", "word").repartition("word")
    counted = words.join(piece_counts(words, path), "word").select(F.col("block").alias("of_block"), "spot", "pieces")
    held = made.filter("kind = 'doc'").select("block", "doc_id", "n_bytes", "n_special", "spots", "counts")
    summed = held.groupBy("block").cogroup(counted.groupBy("of_block")).applyInPandas(sums, "doc_id string, n_bytes bigint, n_tokens bigint")
    return summed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op13_pretoken_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts(table(spark, folder, "documents"), tokenizer_path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
