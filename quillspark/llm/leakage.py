"""Evaluation passages inside corpus documents, found by spaced seeds.

Texts become words that ignore case, punctuation, spacing, line breaks and look-alike characters. A
window of ``span`` words is hashed under fixed masks, each of which leaves some of its positions out,
so a substituted word at such a position doesn't change the hash: any ``substitutions`` places are
left out together by at least one mask. Documents' windows that share a hash with an item's window are
compared word by word; the window leaks if at most ``substitutions`` words differ. Leaking windows that
overlap at the same distance between document and item are one passage.

Windows whose hash no item has are dropped where they arise, by a bit filter of the items' hashes whose
size is bounded; what passes it by chance falls out of the join by hash behind it. A word broken over
lines is read joined, and also in two parts where an item may write the parts with a hyphen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.words import WORD, WordHashes, mix64
from quillspark.llm.lookalike import TO_LATIN, fold
from quillspark.session import cut_lineage

SPAN = 12
_LATIN = str.maketrans(TO_LATIN)
_BROKEN = re.compile("([^\\W_]+)[-‐‑–¬\xad][^\\S\n]*\n\\s*([^\\W_]+)")
_COMPOUND = re.compile("(?=(?<![^\\W_])([^\\W_]+)[-‐‑]([^\\W_]+))")
_LEAST_BITS, _MOST_BITS = 20, 30


def masks(span: int = SPAN, substitutions: int = 1) -> list[list[int]]:
    """Kept positions of each mask. Positions fall into blocks in turn; a mask leaves out ``substitutions``
    blocks, one at least, and every choice of blocks has a mask."""
    blocks, out = (3, 1) if substitutions <= 1 else (2 * substitutions, substitutions)
    return [[k for k in range(span) if k % blocks not in left] for left in combinations(range(blocks), out)]


def plain(text: str) -> str:
    """The text as far as it is compared, line breaks included."""
    return unicodedata.normalize("NFC", fold(text).translate(_LATIN).casefold()) if not text.isascii() else text.lower()


def words_of(text: str) -> list[str]:
    """Words; a word broken over lines is one word."""
    return WORD.findall(plain(_BROKEN.sub(r"\1\2", text) if "\n" in text else text))


def units_of(text: str, may_part) -> list[tuple[str, ...]]:
    """The words as words_of has them, each a tuple: (word,), or (word, part, part ...) if it is broken over
    lines and ``may_part("a-b")`` holds."""
    out, end = [], 0
    for m in _BROKEN.finditer(text):
        whole = WORD.findall(plain(m[1] + m[2]))
        out += [(w,) for w in WORD.findall(plain(text[end : m.start()]))]
        if len(whole) == 1 and may_part(plain(f"{m[1]}-{m[2]}")):
            out.append((whole[0], *WORD.findall(plain(f"{m[1]} {m[2]}"))))
        else:
            out += [(w,) for w in whole]
        end = m.end()
    return out + [(w,) for w in WORD.findall(plain(text[end:]))]


def _ahead(units: list[tuple[str, ...]], i: int, n: int) -> Iterator[list[str]]:
    """All readings of n words from unit i on."""
    if n <= 0:
        yield []
    elif i < len(units):
        for reading in (units[i][:1], units[i][1:]):
            if reading:
                for rest in _ahead(units, i + 1, n - len(reading)):
                    yield [*reading, *rest][:n]


def parted_windows(units: list[tuple[str, ...]], span: int) -> Iterator[tuple[int, list[str]]]:
    """(place of the first word, words) of the windows in which at least one word is read in parts."""
    for i, (_, *parts) in enumerate(units):
        if parts:
            before = [u[0] for u in units[max(0, i - span + 1) : i]]
            for k in range(len(before) + 1):
                for rest in _ahead(units, i + 1, span - k - len(parts)):
                    yield i - k, [*before[len(before) - k :], *parts, *rest][:span]
            for skip in range(1, len(parts)):
                for rest in _ahead(units, i + 1, span - len(parts) + skip):
                    yield i, [*parts[skip:], *rest][:span]


class BitFilter:
    """A set of 64-bit hashes that may hold others too: two bits a hash, at most 2 ** _MOST_BITS bits."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def size_for(n: int) -> int:
        return int(np.clip(np.ceil(np.log2(16.0 * max(n, 1))), _LEAST_BITS, _MOST_BITS))

    @classmethod
    def of(cls, hashes: DataFrame, column: str, n: int) -> BitFilter:
        """The filter of a column of longs, set by the executors; what comes to the driver is the filter itself."""
        bits = cls.size_for(n)
        first, second = F.shiftrightunsigned(column, 64 - bits), F.shiftrightunsigned(F.shiftleft(column, 32), 64 - bits)
        at = hashes.select(F.explode(F.array(first + 1, second + 1)).alias("p"))  # buckets count from 1
        parts = at.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).toPandas()
        words = np.zeros((1 << bits) // 8, np.uint8)
        for b, m in zip(parts["b"], parts["m"]):
            begin = (b - 1) * 4096
            words[begin : begin + 4096] = np.frombuffer(m, np.uint8)[: len(words) - begin]
        return cls(bits, words)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that may be in the set."""
        shift = np.uint64(64 - self.bits)
        here = lambda p: (self.words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
        some = np.flatnonzero(here(hashes >> shift))
        return some[here((hashes[some] << np.uint64(32)) >> shift)]


def _windows(texts: list[str | None], may_part, hashes: WordHashes, span: int, kept: list[list[int]]):
    """(word hashes, where in them each window begins, its row, place of its first word in the text, hashes of windows by mask)."""
    split, odd = [], []
    for n, text in enumerate(texts):
        if not text:
            split.append([])
        elif "\n" in text and any(may_part(plain(f"{m[1]}-{m[2]}")) for m in _BROKEN.finditer(text)):
            units = units_of(text, may_part)
            split.append([u[0] for u in units])
            odd += [(n, at, words) for at, words in parted_windows(units, span) if len(words) == span]
        else:
            split.append(words_of(text))
    sizes = np.array([len(x) for x in split], np.int64)
    flat = hashes([w for x in split for w in x])
    counts = np.maximum(sizes - span + 1, 0)
    row = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place + (np.cumsum(sizes) - sizes)[row]
    if odd:
        flat = np.concatenate([flat, hashes([w for _, _, words in odd for w in words])])
        at = np.concatenate([at, sizes.sum() + span * np.arange(len(odd))])
        row, place = np.concatenate([row, [n for n, _, _ in odd]]), np.concatenate([place, [k for _, k, _ in odd]])
    factor = mix64(np.arange(1, span + 1, dtype=np.uint64)) | np.uint64(1)
    out = []
    for m, places in enumerate(kept):
        h = np.full(len(at), m, np.uint64)
        for k in places:
            h += flat[at + k] * factor[k]
        out.append(mix64(h))
    return flat, at, row, place, out


_ROWS = pa.schema([("key", pa.string()), ("hash", pa.int64()), ("at", pa.int32()), ("window", pa.list_(pa.int64()))])
_DDL = "key string, hash long, at int, window array<long>"


def _emit(span: int, kept: list[list[int]], compounds, wanted):
    """mapInArrow: (key, text) to (key, hash, place and words of the window), only of hashes that may be wanted if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, some = WordHashes(), WordHashes(), wanted.value if wanted else None
        pairs = compounds.value if compounds else None
        may_part = (lambda c: True) if pairs is None else (lambda c: len(pairs(parts([c]))) > 0)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                flat, at, row, place, by_mask = _windows(part.column("text").to_pylist(), may_part, hashes, span, kept)
                keys = part.column("key")
                for h in by_mask:
                    hit = np.arange(len(h)) if some is None else some(h)
                    if not len(hit):
                        continue
                    window = flat[at[hit][:, None] + np.arange(span)].view(np.int64)
                    arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, span * len(hit) + 1, span, dtype=np.int32)), pa.array(window.ravel()))
                    yield pa.record_batch([keys.take(pa.array(row[hit])), pa.array(h[hit].view(np.int64)), pa.array(place[hit].astype(np.int32)), arrays], _ROWS)

    return run


def _compounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (key, text) to the hash of each pair of words that a text writes with a hyphen."""
    hashes = WordHashes()
    for batch in batches:
        found = [f"{m[1]}-{m[2]}" for t in batch.column("text").to_pylist() for m in _COMPOUND.finditer(plain(t))]
        yield pa.record_batch([pa.array(hashes(found).view(np.int64))], names=["hash"])


def item_texts(cases: DataFrame) -> DataFrame:
    """(key, text): the question and every evidence text of each case; a case may repeat."""
    parts = F.concat(F.array("question"), F.coalesce(F.transform("relevant_sources", lambda s: s["evidence_text"]), F.array().cast("array<string>")))
    return cases.select(F.col("id").alias("key"), F.explode(parts).alias("text")).filter("key is not null and text is not null").distinct()


def _matches(documents: DataFrame, items: DataFrame, span: int, substitutions: int, differing: int) -> DataFrame:
    """(doc_id, item, at, item_at) of the windows of documents that are those of an item's text but for ``differing`` words."""
    context, kept = documents.sparkSession.sparkContext, masks(span, substitutions)
    texts = items.select(F.xxhash64("text").cast("string").alias("key"), "text").dropDuplicates(["key"])
    pairs = cut_lineage(texts.filter(F.col("text").rlike("[-‐‑]")).mapInArrow(_compounds, "hash long").distinct())
    compounds = context.broadcast(BitFilter.of(pairs, "hash", pairs.count()))
    asked = texts.mapInArrow(_emit(span, kept, None, None), _DDL).distinct()
    asked = cut_lineage(asked.select(F.col("key").alias("item"), "hash", F.col("at").alias("item_at"), F.col("window").alias("wanted")))
    wanted = context.broadcast(BitFilter.of(asked, "hash", asked.count()))
    docs = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("string").alias("key"), "text")
    hits = docs.mapInArrow(_emit(span, kept, compounds, wanted), _DDL)
    differ = F.size(F.filter(F.zip_with("window", "wanted", lambda a, b: a != b), lambda x: x))
    both = hits.join(asked, "hash").filter(differ <= differing)
    return both.select(F.col("key").cast(dict(documents.dtypes)["doc_id"]).alias("doc_id"), "item", "at", "item_at")


def _cases(items: DataFrame) -> DataFrame:
    return items.select(F.col("key").cast("string").alias("case_id"), F.xxhash64("text").cast("string").alias("item")).distinct()


def leaked(documents: DataFrame, items: DataFrame, span: int = SPAN, substitutions: int = 1, differing: int = 0) -> DataFrame:
    """(doc_id, case_id) of documents (doc_id, text) that hold ``span`` consecutive words of an item (key, text),
    up to ``differing`` of them replaced.

    The seeds tolerate ``substitutions`` replaced words, at least as many as the check behind them. Null texts
    and texts of fewer words give nothing; repeated rows count once; null ids are left out.
    """
    found = _matches(documents, items, span, max(substitutions, differing), differing).select("doc_id", "item").distinct()
    return found.join(_cases(items), "item").select("doc_id", "case_id").distinct()


def leaked_passages(documents: DataFrame, items: DataFrame, span: int = SPAN, substitutions: int = 1) -> DataFrame:
    """(doc_id, case_id, passages, words): how many passages of an item a document holds, each of at least
    ``span`` words with up to ``substitutions`` replaced in any ``span`` of them, and the words of the longest.

    Windows that match at the same distance between document and item and overlap or touch are one passage.
    Null texts and texts of fewer words give nothing; repeated rows count once; null ids are left out.
    """
    found = _matches(documents, items, span, substitutions, substitutions).distinct().withColumn("shift", F.col("at") - F.col("item_at"))
    one = Window.partitionBy("doc_id", "item", "shift").orderBy("at")
    found = found.withColumn("new", F.coalesce(F.col("at") > F.lag("at").over(one) + span, F.lit(True)))
    runs = found.withColumn("run", F.sum(F.col("new").cast("int")).over(one)).groupBy("doc_id", "item", "shift", "run").agg((F.max("at") - F.min("at") + span).alias("words"))
    best = runs.join(_cases(items), "item").groupBy("doc_id", "case_id")
    return best.agg(F.count("*").cast("int").alias("passages"), F.max("words").alias("words"))
