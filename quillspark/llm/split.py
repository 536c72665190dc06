"""Splitting oversized texts at their strongest boundaries.

The cut is looked up in a sparse table for range maxima over boundary strengths: of all cuts that
leave a permissible piece the strongest is taken, of equally strong ones the rightmost; the next
piece begins ``overlap`` tokens before it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.words import TOKEN, longer_than

LIMIT, OVERLAP = 650, 40
PIECES = "array<struct<piece:int,text:string,token_count:int,begin:int,end:int>>"

# Boundary strengths: paragraph, heading or list line, line, sentence, clause, space, none.
PARAGRAPH, ITEM, LINE, SENTENCE, CLAUSE, SPACE = 6, 5, 4, 3, 2, 1
_ITEM = re.compile(r"(?:#{1,6}|[-*•+]|\d{1,3}[.)])[ \t]")
_TITLE = re.compile(r"#{1,6}[ \t]")
_CLOSERS = "\"'”’)]」』）"


class RangeMaximum:
    """Sparse table: the rightmost place of the maximum of any range in constant time."""

    def __init__(self, values: np.ndarray):
        self.values, self.levels = values, [np.arange(len(values))]
        half = 1
        while 2 * half <= len(values):
            left, right = self.levels[-1][:-half], self.levels[-1][half:]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            half *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Of lo..hi, both included."""
        level = (hi - lo + 1).bit_length() - 1
        left, right = int(self.levels[level][lo]), int(self.levels[level][hi - (1 << level) + 1])
        return right if self.values[right] >= self.values[left] else left


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The strength of a cut before each token; at 0 and behind the end 0."""
    out = np.zeros(len(spans) + 1, np.int8)
    title = bool(_TITLE.match(text, spans[0][0])) if spans else False
    for i in range(1, len(spans)):
        end, begin = spans[i - 1][1], spans[i][0]
        gap = text[end:begin]
        if "\n" in gap:
            after_title, title = title, bool(_TITLE.match(text, begin))
            if after_title:  # a heading stays with what follows it
                out[i] = SPACE
                continue
        if gap.count("\n") > 1 or "\u2029" in gap:
            out[i] = PARAGRAPH
            continue
        at = end - 1
        while at > 0 and text[at] in _CLOSERS:
            at -= 1
        last = text[at]
        if "\n" in gap:
            out[i] = ITEM if _ITEM.match(text, begin) else LINE
        elif last in "。！？" and text[begin] not in _CLOSERS or (gap and last in ".!?…"):
            out[i] = SENTENCE
        elif last in "，；：、" and text[begin] not in _CLOSERS or (gap and last in ",;:"):
            out[i] = CLAUSE
        elif gap:
            out[i] = SPACE
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(begin, end, first token, token behind the last) of each piece, in order. No token, no piece."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    out, start, n = [], 0, len(spans)
    best = RangeMaximum(strengths(text, spans)) if n > limit else None
    while best and n - start > limit:
        cut = best.argmax(start + max(overlap + 1, limit // 2), start + limit)
        out.append((spans[start][0], spans[cut - 1][1], start, cut))
        start = cut - overlap
    if n:
        out.append((spans[start][0], spans[-1][1], start, n))
    return out


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces of a text as an array; null for null."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half of limit")

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if t is None else [{"piece": k, "text": t[b:e], "token_count": j - i, "begin": b, "end": e} for k, (b, e, i, j) in enumerate(split_text(t, limit, overlap))]
                for t in texts
            ]
        )

    return cut(text)


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk whose text has more than ``limit`` tokens, whatever ``token_count`` says.

    One row per piece: chunk_id, document_version_id, chunk_index, piece (from 0), n_pieces, text,
    token_count, begin and end (character offsets in the chunk's text), section_path as in the chunk,
    previous_chunk_index (the chunk's own for piece 0, else the chunk's index: the piece before is
    of the same chunk) and previous_piece (null for piece 0). Repeated rows of an id count once.
    Chunks within the limit, and null or blank texts, give no row; a null id counts as a key of its own.
    Only oversized texts leave the JVM. Other columns of the table are ignored.
    """
    columns = ["id", "document_version_id", "chunk_index", "section_path", "previous_chunk_index", "text"]
    over = chunks.select(*columns).filter(longer_than(F.col("text"), limit)).dropDuplicates(["id"])
    cut = over.withColumn("_pieces", pieces(F.col("text"), limit, overlap)).drop("text")
    return cut.select("*", F.size("_pieces").alias("n_pieces"), F.explode("_pieces").alias("_p")).select(
        F.col("id").alias("chunk_id"),
        "document_version_id",
        "chunk_index",
        "_p.piece",
        "n_pieces",
        "_p.text",
        "_p.token_count",
        "_p.begin",
        "_p.end",
        "section_path",
        F.when(F.col("_p.piece") == 0, F.col("previous_chunk_index")).otherwise(F.col("chunk_index")).alias("previous_chunk_index"),
        F.when(F.col("_p.piece") > 0, F.col("_p.piece") - 1).alias("previous_piece"),
    )


def oversized_ids(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id of every chunk that split_oversized cuts."""
    return split_oversized(chunks, limit, overlap).filter((F.col("piece") == 0) & (F.col("n_pieces") > 1)).select("chunk_id")
