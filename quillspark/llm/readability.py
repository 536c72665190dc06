"""Reading level by a Rasch model of words and documents.

Every occurrence of a word rates its document: a word of difficulty b occurs at level k with a
probability proportional to base_k * exp((k - 3) * b), a Rasch rating scale whose sufficient statistic
is the mean level of the word's documents. A document's place on the scale is the mean difficulty of its
words; the steps between levels on that scale are fitted on rated documents. Difficulties and levels are
estimated in turn until the difficulties settle: levels of all documents given the words and steps, those of
rated documents staying at their rating, then difficulties from the levels of all documents.

Which documents are English is a two-class model of word occurrences, fitted on the language column, which
has errors, and refitted on its own decisions until they stand still.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.words import WORD, WordHashes
from quillspark.session import cut_lineage

LEVELS = np.arange(1.0, 6.0)
BITS, RATED, LABELLED, ROUNDS, SETTLED, PRIOR, SMOOTH, LEAST_WORDS = 18, 20_000, 20_000, 12, 0.01, 3.0, 0.02, 60
_BROKEN = re.compile("(?<=[^\\W\\d_])[-‐‑–¬\xad][^\\S\n]*\n\\s*(?=[^\\W\\d_])")


def words_of(text: str) -> list[str]:
    return WORD.findall((_BROKEN.sub("", text) if "\n" in text else text).lower())


def language_label(lang: Column) -> Column:
    """1 for a label that begins with "en", 0 for another, null without one or if it is undetermined."""
    low = F.lower(F.trim(lang))
    return F.when(low.isin("", "und"), None).when(low.startswith("en"), 1).when(low.isNotNull(), 0)


_BAG = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("words", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())])
_BAG_DDL = "doc_id long, label int, words int, high binary, low binary, counts binary, more binary"


def _bag(bits: int):
    """mapInArrow: (doc_id, text, label) to a row with the text's hashed words and their counts.

    The sorted hashes are stored by their low 16 bits and how many there are for each of the higher bits; counts
    are bytes, the excess over 255 in ``more``. Three bytes a word in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shift = WordHashes(), np.uint64(64 - bits)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                size, high, low, counts, more = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text or "")
                    t, n = np.unique((hashes(words) >> shift).astype(np.int64), return_counts=True)
                    size.append(len(words))
                    high.append(np.bincount(t >> 16, minlength=1 << (bits - 16)).astype(np.uint32).tobytes())
                    low.append((t & 0xFFFF).astype(np.uint16).tobytes())
                    counts.append(np.minimum(n, 255).astype(np.uint8).tobytes())
                    more.append((n[n >= 255] - 255).astype(np.uint32).tobytes())
                yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(size, pa.int32()), *(pa.array(x, pa.binary()) for x in (high, low, counts, more))], schema=_BAG)

    return run


def flat_bags(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all bags of a batch."""
    joined = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
    high = joined("high", np.uint32).reshape(batch.num_rows, 1 << (bits - 16)).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), high.sum(1))
    term = (np.repeat(np.tile(np.arange(high.shape[1]), batch.num_rows), high.ravel()) << 16) + joined("low", np.uint16)
    count = joined("counts", np.uint8).astype(np.float64)
    count[count == 255] += joined("more", np.uint32)
    return row, term, count


class Steps:
    """The places of the levels on the difficulty scale, and the cuts between them, from rated documents."""

    def __init__(self, x: np.ndarray, level: np.ndarray):
        self.known = np.array([k for k in range(1, 6) if (level == k).any()], float)
        self.places = np.maximum.accumulate([np.median(x[level == k]) for k in self.known])
        order = np.argsort(x, kind="stable")
        xs, cuts = x[order], []
        for k in range(1, 5):
            above = level[order] > k
            wrong = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([[0], np.cumsum((~above)[::-1])])[::-1]
            at = int(np.argmin(wrong))
            cuts.append(-np.inf if at == 0 else np.inf if at == len(xs) else (xs[at - 1] + xs[at]) / 2)
        self.cuts = np.maximum.accumulate(cuts)

    def expected(self, x: np.ndarray) -> np.ndarray:
        """A level between 1 and 5, in proportion between the places of two levels."""
        return np.interp(x, self.places, self.known)

    def level(self, x: np.ndarray) -> np.ndarray:
        return 1 + (x[:, None] > self.cuts[None]).sum(1)


def places(row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, b: np.ndarray) -> np.ndarray:
    """The mean difficulty of each of n bags."""
    return np.bincount(row, count * b[term], n) / np.maximum(np.bincount(row, count, n), 1)


def difficulties(total: np.ndarray, number: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The b of each word whose expected level is the mean of its documents', drawn to the base by PRIOR occurrences."""
    mean = (total + PRIOR * (LEVELS * base).sum()) / (number + PRIOR)
    mean, b = np.clip(mean, 1.02, 4.98), np.zeros(len(total))
    for _ in range(30):
        p = base[:, None] * np.exp((LEVELS[:, None] - 3) * b[None])
        p /= p.sum(0)
        now = (LEVELS[:, None] * p).sum(0)
        spread = (LEVELS[:, None] ** 2 * p).sum(0) - now**2
        b = np.clip(b + np.clip((mean - now) / np.maximum(spread, 0.05), -1, 1), -6, 6)
    return b


def english_weights(row: np.ndarray, term: np.ndarray, count: np.ndarray, label: np.ndarray, bits: int, rounds: int = 20) -> np.ndarray:
    """log P(word | English) - log P(word | not) of each word, of bags whose label is 1, 0 or nan.

    Fitted on the labels, then on its own decisions on all bags, until they stand still.
    """
    weights, kind = np.zeros(1 << bits), label
    for _ in range(rounds):
        logs = []
        for k in (1, 0):
            n = np.bincount(term, count * (kind[row] == k), 1 << bits) + SMOOTH
            logs.append(np.log(n / n.sum()))
        weights = logs[0] - logs[1]
        now = (np.bincount(row, count * weights[term], len(label)) > 0).astype(float)
        if (now == kind).all():
            break
        kind = now
    return weights


def _statistics(shared, bits: int):
    """mapInArrow: sums of levels and occurrences by word, over a task's English documents; without steps over the rated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b, steps = shared.value
        total, number = np.zeros(1 << bits), np.zeros(1 << bits)
        for batch in batches:
            row, term, count = flat_bags(batch, bits)
            level = batch.column("rating").to_numpy(zero_copy_only=False).astype(np.float64)
            if steps is not None:
                level = np.where(np.isnan(level), steps.expected(places(row, term, count, batch.num_rows, b)), level)
            level[np.bincount(row, count * weights[term], batch.num_rows) <= 0] = np.nan
            use = ~np.isnan(level[row])
            total += np.bincount(term[use], (count * level[row])[use], 1 << bits)
            number += np.bincount(term[use], count[use], 1 << bits)
        seen = np.flatnonzero(number)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen]), pa.array(number[seen])], names=["term", "total", "number"])

    return run


def _levels(shared, bits: int):
    """mapInArrow: a bag to its level, its place in levels and its mean difficulty; null if not English."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b, steps = shared.value
        for batch in batches:
            row, term, count = flat_bags(batch, bits)
            english = np.bincount(row, count * weights[term], batch.num_rows) > 0
            x = places(row, term, count, batch.num_rows, b)
            none = ~english if steps is not None else np.ones(len(x), bool)
            level, estimate = (steps.level(x), steps.expected(x)) if steps is not None else (x, x)
            columns = (pa.array(level.astype(np.int32), mask=none), pa.array(estimate, mask=none), pa.array(x, mask=none))
            yield pa.record_batch([batch.column("doc_id"), batch.column("words"), pa.array(english), *columns], names=["doc_id", "words", "english", "level", "estimate", "difficulty"])

    return run


def mean_ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, level) of every rated document: the mean of its ratings."""
    means = labels.filter("doc_id is not null and reading_level between 1 and 5").select("doc_id", "rater", "reading_level").distinct()
    return means.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("reading_level").alias("level"))


def _drawn(bags: DataFrame, most: int, seed: int, bits: int):
    """(row, term, count), labels and ratings of at most ``most`` bags, chosen by a hash of the id; others don't leave their partition."""
    share = min(1.0, (most + 5 * most**0.5) / max(bags.count(), 1))
    some = bags.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 40)) < int(share * (1 << 40)))
    some = some.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).toArrow().combine_chunks()
    if not some.num_rows:
        return None
    batch = some.to_batches()[0]
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    return (*flat_bags(batch, bits), column("label"), column("rating"))


def reading_levels(documents: DataFrame, labels: DataFrame, rated: int = RATED, labelled: int = LABELLED, rounds: int = ROUNDS, settled: float = SETTLED, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, words, english, level (1 to 5), estimate (a number between 1 and 5), difficulty (mean of its words).

    level, estimate and difficulty are null for documents that are not English or have no words (null
    or blank texts included), and for all if no English document is rated. Repeated rows stay. Rated documents
    count as labelled English; without a column lang they alone are. Words are hashed into 2**bits difficulties,
    so what is sent to executors and driver has a fixed size. ``rated`` bounds the rated documents the steps are
    fitted on and ``labelled`` the documents the language model is fitted on; difficulties and levels
    come from all documents and all ratings. Ends when the difficulties change by ``settled`` on average, at the
    latest after ``rounds``.
    """
    context = documents.sparkSession.sparkContext
    means = mean_ratings(labels)
    label = language_label(F.col("lang")) if "lang" in documents.columns else F.lit(None)
    bags = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", label.cast("int").alias("label")).mapInArrow(_bag(bits), _BAG_DDL)
    bags = bags.join(means.withColumnRenamed("level", "rating"), "doc_id", "left").withColumn("label", F.coalesce("label", F.when(F.col("rating").isNotNull(), 1)))
    bags = cut_lineage(bags)
    out = "doc_id long, words int, english boolean, level int, estimate double, difficulty double"
    some, known = _drawn(bags.filter("words > 0"), labelled, 5, bits), _drawn(bags.filter("rating is not null and words > 0"), rated, 3, bits)
    weights, b, steps = (np.zeros(1 << bits) if some is None else english_weights(*some[:4], bits)), np.zeros(1 << bits), None
    if known is not None:
        row, term, count, _, level = known
        n = len(level)
        english = np.bincount(row, count * weights[term], n) > 0
        shares = {int(r["level"]): r["count"] for r in means.groupBy(F.rint("level").alias("level")).count().collect()}
        base = np.array([shares.get(k, 0) for k in range(1, 6)]) + 1.0
        base /= base.sum()
        for _ in range(rounds if english.any() else 0):
            sums = bags.mapInArrow(_statistics(context.broadcast((weights, b, steps)), bits), "term long, total double, number double").groupBy("term").agg(F.sum("total").alias("total"), F.sum("number").alias("number")).toPandas()
            at, number, before = sums["term"].to_numpy(np.int64), sums["number"].to_numpy(), b
            b = np.zeros(1 << bits)
            b[at] = difficulties(sums["total"].to_numpy(), number, base)
            first, steps = steps is None, Steps(places(row, term, count, n, b)[english], np.rint(level)[english])
            if not first and (number * np.abs(b - before)[at]).sum() <= settled * number.sum():
                break
    return bags.mapInArrow(_levels(context.broadcast((weights, b, steps)), bits), out)


def documents_of_level(documents: DataFrame, labels: DataFrame, level: int = 5, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """doc_id of the English documents of at least ``least_words`` words that are of the level."""
    return reading_levels(documents, labels, **options).filter((F.col("level") == level) & (F.col("words") >= least_words)).select("doc_id").distinct()
