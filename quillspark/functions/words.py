"""Words and tokens, for Spark columns (Java patterns) and for Python batches.

A *token* is one ideograph, one run of ASCII letters, digits and underscores, or any other single
character that is no white space. A *word* is a run of Unicode letters and digits; an ideograph is
a word by itself.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.isspace has it; Java's and RE2's \s know ASCII only.
_SPACE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
TOKEN_JAVA = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+|[^" + _SPACE + "]"
TOKEN_RE2 = TOKEN_JAVA
TOKEN = re.compile(r"[一-鿿]|[A-Za-z0-9_]+|\S")

_HAN = "㐀-䶿一-鿿豈-﫿"
WORD = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
WORD_RE2 = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|(?:[\p{L}\p{N}])+"


def token_count(text: Column) -> Column:
    """Tokens of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_JAVA)), F.lit(0))


def longer_than(text: Column, tokens: int) -> Column:
    """Whether a text has more tokens than given; texts with no more characters skip the count."""
    return (F.length(text) > tokens) & (token_count(text) > tokens)


class WordHashes:
    """64-bit hashes of words, remembered per worker up to a bounded number of words."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
