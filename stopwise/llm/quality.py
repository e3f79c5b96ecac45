"""Quality by the votes of nearest labelled neighbours in a latent semantic space.

A text becomes a vector of term weights: words, and the shapes of words (capitals, digits, marks, repeats),
which carry what makes a text readable or not. A truncated decomposition of the weights of a bounded sample
of labelled texts gives the latent space. The labelled vectors are broadcast, bounded by ``LABELLED`` rows of
``LATENT`` numbers; every document meets all of them in blocks of exact cosine products, and the labels of
its nearest neighbours vote with their similarity.

Defined results: null text is empty text, whose score is the share of good labels; texts of any length are
read whole; without any labelled row every score is 0.5; of neighbours that tie for the last place one votes;
labels of rows that repeat a doc_id count once, the smallest; rows that repeat are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import table

LABELLED = 6_000  # labelled rows that fit the space and vote, at most
LATENT = 48
ROUNDS, SEED = 6, 3  # of the subspace iteration
NEIGHBOURS = 15
SHARPNESS = 8.0  # power of the similarity a vote weighs
SHAPE_TERMS, WORD_TERMS = 1024, 2048
WORD_WEIGHT = 0.35
THRESHOLD = 0.3
MEMO = 500_000  # words a worker remembers
RUN = re.compile(r"(.)\1+")


class _Shapes(dict):
    """Characters by kind; built as characters are met, at most one entry per code point."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = char if char.isspace() else "A" if char.isupper() else "a" if char.isalpha() else "0" if char.isdigit() else char
        self[code] = kind
        return kind


SHAPES = _Shapes()


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass"))


class _Words(dict):
    """A number for each word met, with the hashes of the word and of its shape; starts anew when it is full."""

    def __init__(self):
        super().__init__()
        self.hashes = np.empty((1 << 12, 2), np.int64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[n] = _hash(word.lower()), _hash(RUN.sub(r"\1", word.translate(SHAPES)))
        self[word] = n
        return n


WORDS = _Words()


def _terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts per column of shape terms and of words."""
    if len(WORDS) > MEMO:
        WORDS.clear()
    words = text.split()
    numbers = np.fromiter(map(WORDS.__getitem__, words), np.int64, len(words))
    word, shape = WORDS.hashes[numbers].T
    pairs = (shape[:-1] * 31 + shape[1:]) % SHAPE_TERMS
    counts = np.bincount(np.concatenate([shape % SHAPE_TERMS, pairs]), minlength=SHAPE_TERMS).astype(np.float32)
    lines = [line for line in text.split("\n") if line]
    facts = {"same word again": int((numbers[1:] == numbers[:-1]).sum()), "same line again": len(lines) - len(set(lines))}
    if words:
        facts[f"different words {len(np.unique(numbers)) * 10 // len(words)}"] = len(words)
        facts[f"word length {min((len(text) + 1) // len(words), 20)}"] = len(words)
        facts[f"size {len(words).bit_length()}"] = len(words)
    for fact, n in facts.items():
        counts[_hash(fact) % SHAPE_TERMS] += n
    return counts, np.bincount(word % WORD_TERMS, minlength=WORD_TERMS)


def term_weights(texts: list[str]) -> np.ndarray:
    """A row per text: log counts of shape terms, then of words."""
    out = np.zeros((len(texts), SHAPE_TERMS + WORD_TERMS), np.float32)
    for row, text in zip(out, texts):
        row[:SHAPE_TERMS], row[SHAPE_TERMS:] = _terms(text)
    return np.log1p(out, out=out)


@dataclass(frozen=True)
class Space:
    """Everything the tasks need; its size follows from the parameters alone."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @staticmethod
    def parts(weights: np.ndarray, rarity: np.ndarray) -> np.ndarray:
        weighted = weights * rarity
        for part, share in ((weighted[:, :SHAPE_TERMS], 1.0), (weighted[:, SHAPE_TERMS:], WORD_WEIGHT)):
            part *= share / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return weighted

    def project(self, texts: list[str]) -> np.ndarray:
        latent = self.parts(term_weights(texts), self.rarity) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosine = self.project(texts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** SHARPNESS + 1e-6
        score = (votes * self.labels[near]).sum(1) / votes.sum(1)
        return np.where([bool(t.strip()) for t in texts], score, self.prior)


def fit(texts: list[str], labels: np.ndarray) -> Space:
    if not len(texts):
        return Space(np.ones(SHAPE_TERMS + WORD_TERMS, np.float32), np.zeros((SHAPE_TERMS + WORD_TERMS, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0), 0.5)
    parts = [term_weights(texts[i:i + 512]) for i in range(0, len(texts), 512)]
    WORDS.clear()
    rarity = np.log((1 + len(texts)) / (1 + sum((part > 0).sum(0) for part in parts))).astype(np.float32) + 1
    # truncated decomposition by subspace iteration: no more memory than the weights and a few columns
    basis = np.random.default_rng(SEED).standard_normal((SHAPE_TERMS + WORD_TERMS, LATENT + 16)).astype(np.float32)
    for _ in range(ROUNDS):
        turned = sum((w.T @ (w @ basis) for w in (Space.parts(part, rarity) for part in parts)), np.zeros_like(basis))
        basis = np.linalg.qr(turned)[0]
    small = sum(w.T @ w for w in (Space.parts(part, rarity) @ basis for part in parts))
    axes = np.ascontiguousarray(basis @ np.linalg.eigh(small)[1][:, ::-1][:, :LATENT])
    latent = np.concatenate([Space.parts(part, rarity) @ axes for part in parts])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Space(rarity, axes, latent, labels.astype(float), float(labels.mean()))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> pd.DataFrame:
    """At most ``rows`` labelled training texts (doc_id, text, label), chosen by hash; labels beyond are not used."""
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(label).alias("label"))
    marks = marks.filter(train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = F.broadcast(marks).join(texts, "doc_id")  # ``rows`` ids and labels at most
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).toPandas().sort_values("doc_id")


def remainder(key: Column, parts: int) -> Column:
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % parts


def fitted(docs: DataFrame, labels: DataFrame, train: Column, rows: int = LABELLED) -> Space:
    data = labelled_rows(docs, labels, "quality", train, rows)
    return fit(data["text"].tolist(), data["label"].to_numpy())


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """All columns of docs and ``score``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    return docs.withColumn("score", F.pandas_udf(score, "double")(F.coalesce("text", F.lit(""))))


def op9_neighbour_voting(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    space = fitted(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return scored(rows, space).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
