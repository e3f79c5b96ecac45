"""Toxicity of texts whose words may be disguised: noisy-channel decoding, then a learned lexicon.

Writers hide words by leetspeak (1d10t), spacing (i d i o t), marks (id.iot, id*ot) and repetition (idiooot). A
token with such signs becomes a lattice: each character may stand for itself, for the letters it imitates, for
any letter (a star), or for nothing (a separator); a run of one letter may be one or two of it. The Viterbi path
through the lattice under a character trigram model, counted over the whole corpus, is the restored word. Other
tokens have a lattice with a single path. Restored words are looked up among words and word beginnings that
labelled toxic texts have far more often than clean ones.

Defined results: null and empty texts get the score of a text without any such word; texts of any length are read
whole; without labels every score is 0.5; rows that repeat a text count once when words are learned; labels of
rows that repeat a doc_id count once, the largest; rows that repeat are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import stored, table
from stopwise.llm.quality import remainder

# fixed values: what a character may imitate
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¥": "y"}
SEPARATORS = "._-*~'`^/,​"
LETTERS = " abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôûùñáíóú?"  # "?" is any other letter, " " the edge of a word
STAR = "*"
COST = {"same": 0.0, "imitates": 0.7, "drops": 0.4, "star": 1.5, "repeats": 0.3}  # minus log of a channel step
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ ._*-]{1,2}){3,}[^\W_](?![^\W_])")
RUN = re.compile(r"(.)\1{2,}")
EDGE = "\"#%&'()*,-./:;?[]{}«»“”„…¿"

CANDIDATES = 200_000  # features of toxic texts that are weighed, at most, the most frequent first
FEWEST = 4  # different toxic texts a feature needs
SHARES = (0.1, 0.03, 0.01, 0.0)  # of the toxic texts, that a word must be in, the common ones first
PURITY = 0.9  # share of toxic ones among the texts with a feature
LEAST_WEIGHT = 2.5  # log odds a feature needs
STRONGEST = 3  # features that count for one text
MEMO = 500_000
THRESHOLD = 0.3


# --- character model


class _Codes(dict):
    def __init__(self):
        super().__init__({ord(c): i for i, c in enumerate(LETTERS)})

    def __missing__(self, code: int) -> int:
        value = self[code] = LETTERS.index("?") if chr(code).isalpha() else 0
        return value


CODES = _Codes()


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """Counts of letter trigrams, with edges of words, of all texts."""
    size, total = len(LETTERS), np.zeros(len(LETTERS) ** 3, np.int64)
    for text in texts:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, place = np.unique(raw, return_inverse=True)
        codes = np.concatenate([[0, 0], np.array([CODES[int(k)] for k in kinds], np.int64)[place] if len(raw) else [], [0]]).astype(np.int64)
        keep = np.ones(len(codes), bool)
        keep[2:] = (codes[2:] != 0) | (codes[1:-1] != 0)  # one edge between words
        codes = codes[keep]
        total += np.bincount(codes[:-2] * size * size + codes[1:-1] * size + codes[2:], minlength=size**3)
    return total


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Over every text. The result has one count per trigram of the alphabet, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(LETTERS) ** 3, np.int64)
        for batch in batches:
            total += trigram_counts(batch["text"])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some, "n": total[some]})

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(len(LETTERS) ** 3, np.int64)
    for gram, n in counts.collect():  # at most one row per trigram
        out[gram] = n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with shorter contexts."""
    size = len(LETTERS)
    three = counts.reshape(size, size, size).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + 5 * p1) / (two + 5 * p1).sum(1, keepdims=True)
    p3 = (three + 5 * p2) / (three + 5 * p2).sum(2, keepdims=True)
    return np.log(p3)


# --- decoding


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each unit of a token the strings it may stand for, with costs."""
    units, i = [], 0
    while i < len(token):
        char, end = token[i], i + 1
        while end < len(token) and token[end] == char:
            end += 1
        run, i = end - i, end
        if char.isalpha():
            options = [(char * min(run, 2), COST["same"])] if run < 3 else []
            if run >= 3:
                options = [(char, COST["repeats"]), (char * 2, COST["repeats"])]
        else:
            options = [(letter * min(run, 2), COST["imitates"] * min(run, 2)) for letter in LEET.get(char, "")]
            options += [(letter, COST["imitates"] + COST["repeats"]) for letter in LEET.get(char, "") if run > 1]
            if char == STAR and run <= 2:
                options += [(letter, COST["star"]) for letter in LETTERS[1:27]]
            if char in SEPARATORS or not options:
                options.append(("", COST["drops"]))
        units.append(options)
    return units


def viterbi(token: str, model: np.ndarray) -> str:
    """The likeliest word for a token: best path per pair of last letters."""
    best = {(0, 0): (0.0, "")}
    for options in lattice(token):
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (logp, word) in best.items():
            for letters, cost in options:
                x, y, value = a, b, logp - cost
                for letter in letters:
                    code = CODES[ord(letter)]
                    value += model[x, y, code]
                    x, y = y, code
                if (x, y) not in step or value > step[x, y][0]:
                    step[x, y] = (value, word + letters)
        best = step
    return max(best.items(), key=lambda s: s[1][0] + model[s[0][0], s[0][1], 0])[1][1]


def disguised(core: str) -> bool:
    """Letters together with marks or digits, or a letter three times in a row."""
    return bool(RUN.search(core)) if core.isalpha() else any(c.isalpha() for c in core)


def restore(token: str, model: np.ndarray) -> list[str]:
    """Readings of a token in lower case: as it stands, and as decoded where it is disguised."""
    token = token.lower()
    core = token.strip(EDGE)
    found = [core] if core else []
    for reading in {core, token.strip(",.;:?\"")} if disguised(core) else ():
        if reading:
            found.append(viterbi(reading, model))
    return found


def spaced_words(text: str) -> list[str]:
    """Words whose letters stand apart, with the gaps taken out."""
    return [re.sub(r"[ ._*-]", "", found) for found in SPACED.findall(text)]


# --- learned words


def features(word: str) -> list[str]:
    """The word and its beginnings; a beginning ends in a star."""
    return [word, *(f"{word[:n]}*" for n in range(4, min(len(word), 8)))] if len(word) >= 3 else [word]


@dataclass
class Reader:
    """Features of texts; remembers tokens it has decoded."""

    model: np.ndarray
    memo: dict[str, frozenset] = field(default_factory=dict)

    def token_features(self, token: str) -> frozenset:
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo[token] = frozenset(f for word in restore(token, self.model) for f in features(word))
        return known

    def text_features(self, text: str) -> set:
        tokens = set(text.split())
        tokens.update(spaced_words(text))
        return set().union(*map(self.token_features, tokens))


@dataclass
class Scorer:
    """Log odds per feature; of one token the strongest feature counts, of a text the strongest tokens."""

    model: np.ndarray
    weights: dict[str, float]
    prior: float
    memo: dict[str, tuple[float, str]] = field(default_factory=dict)

    def token_weight(self, token: str) -> tuple[float, str]:
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = [(self.weights[f], f) for word in restore(token, self.model) for f in features(word) if f in self.weights]
            known = self.memo[token] = max(found, default=(0.0, ""))
        return known

    def score(self, text: str) -> float:
        tokens = set(text.split())
        tokens.update(spaced_words(text))
        strong = {hit for hit in map(self.token_weight, tokens) if hit[0]}
        value = self.prior + sum(sorted((w for w, _ in strong), reverse=True)[:STRONGEST])
        return 1 / (1 + math.exp(-max(min(value, 30.0), -30.0)))

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}


def _counts_by_feature(rows: DataFrame, model: np.ndarray, wanted: set[str] | None, known: Iterable[str]) -> DataFrame:
    """(feature, n): in how many texts without a known feature each feature is; counted per task before the shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast((model, wanted, frozenset(known)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, only, explained = shared.value
        reader, found = Reader(model), Counter()
        for batch in batches:
            for text in batch["text"]:
                mine = reader.text_features(text)
                if mine.isdisjoint(explained):
                    found.update(mine if only is None else mine & only)
            if len(found) > MEMO:
                yield pd.DataFrame(found.items(), columns=["feature", "n"])
                found = Counter()
        yield pd.DataFrame(found.items(), columns=["feature", "n"]).astype({"feature": str, "n": "int64"})

    return rows.mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Scorer:
    """Every labelled training text counts once. What stays is at most ``CANDIDATES`` weighed features."""
    model = log_model(corpus_trigrams(docs))
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(train)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text <> ''")
    hashes = texts.select("doc_id", F.xxhash64("text").alias("h1"), F.crc32(F.encode("text", "utf-8")).alias("h2"))
    first = hashes.join(marks, "doc_id").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    known = stored(texts.join(first.select("doc_id", "toxic"), "doc_id").select("text", "toxic"), "labelled_texts")  # the one shuffle of texts
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Scorer(model, {}, 0.0 if not bad and not good else 30.0 if bad else -30.0)
    rows = lambda kind: known.filter(F.col("toxic") == kind).select("text")
    log_odds = lambda n, m: math.log((n + 0.5) / (bad + 1)) - math.log((m + 0.5) / (good + 1))
    often = _counts_by_feature(rows(1), model, None, ()).filter(F.col("n") >= FEWEST).orderBy(F.desc("n"), "feature").limit(CANDIDATES)
    toxic = {r["feature"]: r["n"] for r in often.collect()}  # bounded by CANDIDATES
    toxic = {f: n for f, n in toxic.items() if log_odds(n, 0) >= LEAST_WEIGHT}
    clean = {r["feature"]: r["n"] for r in _counts_by_feature(rows(0), model, set(toxic), ()).collect()}  # a part of those
    weights = {f: log_odds(n, clean.get(f, 0)) for f, n in toxic.items()}
    weights = {f: w for f, w in weights.items() if w >= LEAST_WEIGHT and toxic[f] >= PURITY * (toxic[f] + clean.get(f, 0) + 1)}
    # words that stand beside a toxic word in copies of one text are no sign of their own: once the common
    # toxic words are taken, a rarer one has to be in texts without them
    taken: dict[str, float] = {}
    for share in SHARES:
        left = _counts_by_feature(rows(1), model, set(weights), taken) if taken else None
        unexplained = {r["feature"]: r["n"] for r in left.collect()} if left else toxic
        taken |= {f: w for f, w in weights.items() if unexplained.get(f, 0) >= max(FEWEST, share * bad)}
    return Scorer(model, taken, math.log(bad / good) - 2.0)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = shared.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [scorer.score(t) for t in batch["text"]]})

    return rows.mapInPandas(score, "doc_id bigint, score double")


def op6_noisy_channel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scorer = learn(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return scored(docs, scorer).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
