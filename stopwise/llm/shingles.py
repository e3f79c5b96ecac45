"""Words and five-word shingles of texts as hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WIDTH = 5  # words of a shingle
WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
MEMO = 500_000


class _Hashes(dict):
    """The eight bytes of a word's hash, kept for words that come again."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_digest(word)
        return value


HASHES = _Hashes()


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their order is random."""
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(found: list[str], width: int = WIDTH) -> np.ndarray:
    """A hash per shingle in text order; none for fewer words than a shingle has."""
    if len(found) < width:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(b"".join(map(HASHES.__getitem__, found)), ">u8").astype(np.uint64)
    number = len(found) - width + 1
    total = codes[:number] * _MIX[0]
    for i in range(1, width):
        total += codes[i:number + i] * (_MIX[i % len(_MIX)] + np.uint64(2 * (i // len(_MIX))))
    return mixed(total)


def permutations(number: int, seed: int = 11) -> np.ndarray:
    """Odd factors; each permutes the mixed hashes by multiplication."""
    return np.random.default_rng(seed).integers(0, 2**63, number, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
