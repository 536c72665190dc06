"""Scalar text functions as Spark columns."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Beginnings of lines that name a file.
FILE_LINES = ("文件名：", "文件路径：", "压缩包内文件：")

# Letters with marks and their base letter, by the decomposition of each character of the Latin blocks.
_MARKED = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
MARKED, BASE = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only, as a LIKE that ignores the case of ASCII letters compares."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def contains_like(text: Column, part: Column) -> Column:
    """Whether text holds part, ASCII case aside; % and _ mean themselves."""
    return F.contains(ascii_lower(text), ascii_lower(part))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def normalize_text(text: Column) -> Column:
    """Each line collapsed, blank lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), collapse), lambda x: x != ""), "\n")


def display_text(text: Column) -> Column:
    """Without lines that name a file; line ends trimmed; repeated paragraphs dropped."""
    named = lambda line: F.array_contains(F.transform(F.array(*map(F.lit, FILE_LINES)), lambda p: F.startswith(F.trim(line), p)), True)
    lines = F.filter(F.split(text, "\n"), lambda x: ~named(x))
    return unique_paragraphs(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"))


def unique_paragraphs(text: Column) -> Column:
    """Paragraphs, apart by blank lines, of which the first of equal ones (white space aside) is kept."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    keyed = F.transform(parts, lambda x: F.struct(F.regexp_replace(x, r"\s+", "").alias("key"), x.alias("part")))
    keys = lambda: F.transform(keyed, lambda x: x["key"])
    first = F.filter(keyed, lambda x, i: F.array_position(keys(), x["key"]) == i + 1)
    return F.array_join(F.transform(first, lambda x: x["part"]), "\n\n")


def text_key(text: Column) -> Column:
    """Lower-case ASCII letters, digits and ideographs of the displayed text."""
    return F.regexp_replace(F.lower(display_text(text)), r"[^a-z0-9\x{4e00}-\x{9fff}]", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, '' without one or if the name begins with its only dot."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters and digits in lower case without marks; a run of ideographs is one."""
    plain = F.translate(F.lower(text), MARKED, BASE)
    return F.regexp_extract_all(F.regexp_replace(plain, r"\p{M}+", ""), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences of part that don't overlap, case counts."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def excerpt(text: Column, part: Column, around: int = 100, otherwise: int = 200) -> Column:
    """The text around the first occurrence of part, with dots where cut; else its beginning."""
    at = F.instr(text, part)
    begin, end = F.greatest(at - around, F.lit(1)), F.least(at + F.length(part) - 1 + around, F.length(text))
    cut = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, end - begin + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, otherwise))


def hash_embedding(text: Column, size: int = 32) -> Column:
    """A deterministic embedding: bytes of each word's SHA-256, minus a half, summed at index mod size, scaled to length 1."""
    words = F.filter(F.split(collapse(text), " "), lambda x: x != "")
    words = F.when(F.size(words) > 0, words).otherwise(F.array(text))
    places = F.sequence(F.lit(0), F.lit(31))
    byte = lambda h, k: F.conv(F.substring(h, 2 * k + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5
    values = F.transform(F.transform(words, lambda w: F.sha2(w, 256)), lambda h: F.transform(places, lambda k: byte(h, k)))
    if size != 32:
        at = F.sequence(F.lit(0), F.lit(size - 1))
        fold = lambda v: F.transform(at, lambda i: F.aggregate(F.filter(v, lambda _, k: k % size == i), F.lit(0.0), lambda s, x: s + x))
        values = F.transform(values, fold)
    vectors = values
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return unit(total)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    """hash_embedding of size 32 for long texts: each word of a batch is hashed once."""
    known: dict[str, np.ndarray] = {}
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        total = np.zeros(32)
        for word in text.split() or [text]:
            v = known.get(word)
            if v is None:
                v = known[word] = np.frombuffer(hashlib.sha256(word.encode()).digest(), np.uint8) / 255.0 - 0.5
            total += v
        norm = np.sqrt(total @ total)
        out.append((total / norm if norm else total).tolist())
    return pd.Series(out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector of length 1; a vector of zeros stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))
