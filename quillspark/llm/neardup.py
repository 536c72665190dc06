"""Near-duplicate texts: BagMinHash signatures, banding, exact check.

A text is a bag of shingles (runs of consecutive lower-cased words). BagMinHash gives each shingle
a Poisson process of points (time, register, level); a point counts if its level lies below the
shingle's weight, and a register keeps the earliest time. Levels are cut into the intervals [0,1),
[1,2), [2,4), [4,8) ..., each with a process of its own whose rate is its length, so a weight
touches few processes, and points of a process are drawn in rising time only until none of them can
change a register. Two registers agree with the weighted Jaccard similarity as probability.

A set is a bag of weights 1, with the same process. Texts are told apart by two hashes of their lower-cased
text (``cls`` and ``sub``, 128 bits); exact copies form one class before anything is paired, so only
different texts are compared. Bands carry ``cls`` alone: should two texts share it, both are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.words import WORD, WordHashes, mix64
from quillspark.llm.components import connected_components
from quillspark.session import cut_lineage

WORDS, THRESHOLD, ROWS, AGREE, MISSED, HOT = 5, 0.8, 3, 3, 0.005, 1000
_WORDED = r"[\p{L}\p{N}]"
_ONE = np.uint64(1)


def bands_needed(threshold: float, rows: int = ROWS, agree: int = AGREE, missed: float = MISSED) -> int:
    """Bands of ``rows`` registers so that a pair at the threshold agrees in fewer than ``agree`` of
    them with a probability of at most ``missed``."""
    p, bands = threshold**rows, agree
    while sum(comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(agree)) > missed:
        bands += 1
    return bands


def shingles(texts: list[str | None], words: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of the distinct shingles of each text, sorted by row and hash.

    A text of fewer words than a shingle, but at least one, is a single shingle; null or wordless
    texts have none.
    """
    split = [WORD.findall((t or "").lower()) for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    flat = hashes([w for x in split for w in x])
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[row]
    end = starts[row] + sizes[row]
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = at + k < end
        h = np.where(inside, mix64(h ^ flat[np.minimum(at + k, max(len(flat) - 1, 0))]), h) if len(flat) else h
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    places = np.flatnonzero(first)
    return row[first], h[first], np.diff(np.append(places, len(h)))


def bag_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Signatures (n_rows x registers, uint64) of bags given as (row, element, weight >= 1) triples.

    Rows without elements get the largest value in every register.
    """
    # One process per element and level interval that the weight reaches into.
    top = np.floor(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    top[weight <= 1] = 0
    level = np.arange(int((top + 1).sum())) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    of = np.repeat(np.arange(len(row)), top + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    keep = low < weight[of]
    of, level, low = of[keep], level[keep], low[keep]
    width = np.maximum(low, 1)
    p_row, limit = row[of], weight[of]
    state = mix64(element[of] ^ mix64(level.astype(np.uint64)))
    time = np.zeros(len(of))
    best = np.full(n_rows * registers, np.inf)
    step, gap = 0, np.uint64(0xD1B54A32D192ED03)
    while len(p_row):
        # The next point of every process still running.
        state = state + gap
        draw = mix64(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
        place = mix64(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        register = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
        accepted = slice(None)
        if (width > 1).any():
            accepted = low + ((place >> np.uint64(32)).astype(np.int64) & (width - 1)) < limit
        np.minimum.at(best, (p_row * registers + register.astype(np.int64))[accepted], time[accepted])
        step += 1
        if step & (step - 1) == 0 or step % 8 == 0:
            latest = best.reshape(n_rows, registers).max(axis=1)
            on = time <= latest[p_row]
            p_row, time, state, width, low, limit = p_row[on], time[on], state[on], width[on], low[on], limit[on]
    return best.view(np.uint64).reshape(n_rows, registers)


def _bands(words: int, bands: int, rows: int, multiset: bool):
    """mapInArrow: (cls, text) to one row (cls, band), a 64-bit key, for each band of a text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        schema = pa.schema([("cls", pa.int64()), ("band", pa.int64())])
        salt = mix64(np.arange(bands, dtype=np.uint64))[None, :]
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                row, h, count = shingles(part.column("text").to_pylist(), words, hashes)
                full = np.unique(row)
                if not len(full):
                    continue
                signature = bag_min_hash(np.searchsorted(full, row), h, count if multiset else np.ones_like(count), len(full), bands * rows)
                signature = signature.reshape(len(full), bands, rows)
                key = np.zeros((len(full), bands), np.uint64) + salt
                for k in range(rows):
                    key = mix64(key ^ signature[:, :, k])
                cls = part.column("cls").to_numpy()[full]
                yield pa.record_batch([pa.array(np.repeat(cls, bands)), pa.array(key.ravel().view(np.int64))], schema)

    return run


def _overlap(words: int, multiset: bool):
    """Pandas: the (weighted) Jaccard similarity of two text columns."""

    def part(a: list[str], b: list[str], hashes: WordHashes) -> np.ndarray:
        n = len(a)
        row, h, count = shingles(a + b, words, hashes)
        if not multiset:
            count = np.ones_like(count)
        total = np.bincount(row, count, 2 * n)
        pair = row % n
        order = np.lexsort((h, pair))
        pair, h, count = pair[order], h[order], count[order]
        same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
        both = np.bincount(pair[1:][same], np.minimum(count[1:], count[:-1])[same], n)
        return both / np.maximum(total[:n] + total[n:] - both, 1)

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        hashes, step = WordHashes(), 256
        return pd.Series(np.concatenate([np.zeros(0), *(part(a[i : i + step].tolist(), b[i : i + step].tolist(), hashes) for i in range(0, len(a), step))]))

    return of


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, cls, sub; texts: cls, sub, text) of a table (id, text); cls and sub hash the lower-cased text.

    The text of a class comes from one member; a repeated id with several texts joins each of their classes.
    """
    low = F.lower("text")
    hashed = docs.select("id", "text").filter(F.col("text").isNotNull()).withColumns({"cls": F.xxhash64(low), "sub": F.xxhash64(F.lit("second"), low)})
    return hashed.select("id", "cls", "sub"), hashed.groupBy("cls", "sub").agg(F.min("text").alias("text"))


def candidates(banded: DataFrame, agree: int, hot: int = HOT) -> DataFrame:
    """(cls_a < cls_b) that share at least ``agree`` bands of a table (cls, band).

    Bands of a single text, nearly all of them, are dropped where they lie. Of a band of more than ``hot``
    texts one side is parted by hash and the other repeated for each part, so no task holds a hot band.
    """
    banded = banded.repartition("band")
    # Counting cls, not rows, keeps both columns, so that counting and joining read one and the same shuffle.
    counts = banded.groupBy("band").agg(F.count("cls").alias("n")).filter("n > 1")
    shared = cut_lineage(banded.join(counts.hint("merge"), "band").select("cls", "band", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    left = shared.select("band", F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part"), F.col("cls").alias("cls_a"))
    right = shared.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("cls").alias("cls_b"))
    both = left.join(right.hint("merge"), ["band", "part"]).filter("cls_a < cls_b")
    return both.groupBy("cls_a", "cls_b").agg(F.count("*").alias("n")).filter(F.col("n") >= agree).drop("n")


def similar_classes(texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, rows: int = ROWS, agree: int = AGREE, missed: float = MISSED, multiset: bool = True, hot: int = HOT) -> DataFrame:
    """Pairs (cls_a, sub_a, cls_b, sub_b, similarity), cls_a < cls_b, of different texts whose similarity is at least the threshold.

    Pairs that share ``agree`` bands are candidates: a pair at the threshold is missed with a
    probability of at most ``missed``, and texts that share only a few stock phrases rarely agree
    so often. Every candidate is checked exactly. ``multiset`` compares bags of shingles, otherwise sets.
    """
    bands = bands_needed(threshold, rows, agree, missed)
    found = candidates(texts.select("cls", "text").mapInArrow(_bands(words, bands, rows, multiset), "cls long, band long"), agree, hot)
    # Only texts of candidates are gathered again: the semi-join lies below the grouping of the texts.
    found = cut_lineage(found)
    needed = texts.join(found.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct(), "cls", "left_semi")
    of = lambda x: needed.select(*(F.col(c).alias(f"{c}_{x}") for c in ("cls", "sub", "text")))
    similarity = _overlap(words, multiset)(F.col("text_a"), F.col("text_b"))
    out = found.join(of("a"), "cls_a").join(of("b"), "cls_b").select("cls_a", "sub_a", "cls_b", "sub_b", similarity.alias("similarity"))
    return out.filter(F.col("similarity") >= threshold)


def similar_pairs(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, multiset: bool = True, **options) -> DataFrame:
    """All pairs (id_a < id_b) of a table (id, text) at or above the threshold, copies of equal texts included.

    Null ids and texts and texts without a word take no part; repeated rows count once. The pairs of
    copies grow with the square of the copies by definition; near_duplicates gives groups instead.
    """
    members, texts = classes(docs.filter(F.col("id").isNotNull()))
    members = members.distinct()
    pairs = similar_classes(texts, words, threshold, multiset=multiset, **options).drop("similarity")
    both = {c: F.col(c[:3]).alias(c) for c in ("cls_a", "sub_a", "cls_b", "sub_b")}
    several = members.groupBy("cls", "sub").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    worded = texts.filter(F.regexp_like("text", F.lit(_WORDED))).join(several, ["cls", "sub"], "left_semi").select(*both.values())
    a, b = (members.select(F.col("id").alias(name), F.col("cls").alias(f"cls_{x}"), F.col("sub").alias(f"sub_{x}")) for name, x in (("x", "a"), ("y", "b")))
    linked = pairs.unionByName(worded).join(a, ["cls_a", "sub_a"]).join(b, ["cls_b", "sub_b"])
    linked = linked.filter((F.col("cls_a") != F.col("cls_b")) | (F.col("x") < F.col("y"))).filter("x != y")
    return linked.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per id of a table (id, text): id, group_id (the smallest id of the group), links, copies.

    Groups are the connected components over pairs at or above the threshold; ``links`` counts the
    other different texts the id's text is linked to, ``copies`` the other ids with an equal text.
    Null ids take no part; a null or wordless text is a group of its own with no links; repeated
    rows count once. An id repeated with different texts takes part with the smallest of them.
    """
    rows_in = docs.select("id", "text").filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("text").alias("text"))
    members, texts = classes(rows_in)
    node = lambda x="": F.struct(F.col(f"cls{x}").alias("cls"), F.col(f"sub{x}").alias("sub"))
    pairs = cut_lineage(similar_classes(texts, words, threshold, **options).select(node("_a").alias("a"), node("_b").alias("b")))
    component = connected_components(pairs).withColumnRenamed("node", "class")
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    per_class = members.groupBy(node().alias("class")).agg(F.min("id").alias("least"), F.count("*").alias("n"))
    per_class = per_class.join(component, "class", "left").join(links, "class", "left").withColumn("component", F.coalesce("component", "class"))
    group = per_class.groupBy("component").agg(F.min("least").alias("group_id"))
    per_class = per_class.join(group, "component").select("class", "group_id", F.coalesce("links", F.lit(0)).alias("links"), (F.col("n") - 1).alias("copies"))
    hashed = rows_in.withColumns({"cls": F.xxhash64(F.lower("text")), "sub": F.xxhash64(F.lit("second"), F.lower("text"))})
    out = hashed.select("id", F.when(F.regexp_like("text", F.lit(_WORDED)), node()).alias("class")).join(per_class, "class", "left")
    return out.select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(0)).alias("copies"))
