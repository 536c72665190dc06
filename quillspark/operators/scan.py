"""The best rows of every query of a stated set, in one pass over the rows for each block of queries.

The queries of a block go to all executors; a task keeps the k best rows of each query so far, so what is
shuffled is k rows a query and task, however many rows match. Scope and access are met before any limit.
Terms are found by one automaton over all terms of the block, vectors compared by matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, STEP = 1000, 256  # queries of a block, rows scored at once


def _places(lists: list[list[tuple[str, float]]]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct terms, and for each where its queries and weights are (offsets, queries, weights)."""
    of: dict[str, dict[int, float]] = {}
    for q, pairs in enumerate(lists):
        for term, weight in pairs:
            if term:
                mine = of.setdefault(term, {})
                mine[q] = mine.get(q, 0.0) + weight
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in of.values()])]).astype(np.int64)
    queries = np.array([q for x in of.values() for q in x], np.int64)
    return {t: i for i, t in enumerate(of)}, offsets, queries, np.array([w for x in of.values() for w in x.values()])


class Terms:
    """Sums of the weights of a query's terms that a text column holds; no hit where it holds none."""

    def __init__(self, lists: list[list[tuple[str, float]]], column: str):
        self.n, self.column = len(lists), column
        self.numbers, self.offsets, self.queries, self.weights = _places(lists)

    def start(self) -> Callable[[pa.RecordBatch], np.ndarray]:
        find = ahocorasick.Automaton()
        for term, i in self.numbers.items():
            find.add_word(term, i)
        find.make_automaton()

        def score(batch: pa.RecordBatch) -> np.ndarray:
            texts = batch.column(self.column).to_pylist()
            found = [list({i for _, i in find.iter(t)}) if t and self.numbers else [] for t in texts]
            row, term = np.repeat(np.arange(len(texts)), [len(x) for x in found]), np.array([i for x in found for i in x], np.int64)
            size = self.offsets[term + 1] - self.offsets[term]
            at = np.repeat(self.offsets[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total = np.bincount(np.repeat(row, size) * self.n + self.queries[at], self.weights[at], len(texts) * self.n).reshape(len(texts), self.n)
            return np.where(total > 0, total, -np.inf)

        return score


class Bm25:
    """Scores, to 9 digits, of documents given as lists of phrases and their frequencies, and the document's length."""

    def __init__(self, lists: list[list[str]], idf: dict[str, float], mean_size: float, k1: float, b: float):
        self.n, self.mean, self.k1, self.b = len(lists), mean_size, k1, b
        self.numbers, self.offsets, self.queries, self.weights = _places([[(p, 1.0) for p in x if p in idf] for x in lists])
        self.idf = np.array([idf[p] for p in self.numbers])

    def start(self) -> Callable[[pa.RecordBatch], np.ndarray]:
        def score(batch: pa.RecordBatch) -> np.ndarray:
            phrases, sizes = batch.column("phrases").to_pylist(), batch.column("size").to_numpy()
            row = np.repeat(np.arange(len(phrases)), [len(x) for x in phrases])
            term = np.array([self.numbers.get(x, -1) for y in phrases for x in y], np.int64)
            tf = np.array([x for y in batch.column("tf").to_pylist() for x in y], np.float64)
            row, term, tf = row[term >= 0], term[term >= 0], tf[term >= 0]
            part = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * sizes[row] / self.mean))
            size = self.offsets[term + 1] - self.offsets[term]
            at = np.repeat(self.offsets[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total = np.bincount(np.repeat(row, size) * self.n + self.queries[at], np.repeat(part, size) * self.weights[at], len(phrases) * self.n).reshape(len(phrases), self.n)
            return np.where(total > 0, np.round(total, 9), -np.inf)

        return score


def _unit(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(1, keepdims=True)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


class Cosine:
    """Cosine similarity; no hit where a vector is null, zero, not finite or of another length."""

    def __init__(self, vectors: list, column: str):
        self.n, self.column, by_size = len(vectors), column, {}
        for q, v in enumerate(vectors):
            x = None if v is None or any(y is None for y in v) else np.asarray(v, np.float64)
            if x is not None and np.isfinite(x).all() and x.any():
                by_size.setdefault(len(x), []).append((q, x))
        self.blocks = {d: (np.array([q for q, _ in own]), _unit(np.stack([x for _, x in own]))) for d, own in by_size.items()}

    def start(self) -> Callable[[pa.RecordBatch], np.ndarray]:
        def score(batch: pa.RecordBatch) -> np.ndarray:
            lists = batch.column(self.column).to_pylist()
            out, sizes = np.full((len(lists), self.n), -np.inf), np.array([-1 if v is None or None in v else len(v) for v in lists])
            for d, (queries, known) in self.blocks.items():
                rows = np.flatnonzero(sizes == d)
                if len(rows):
                    x = np.array([lists[r] for r in rows], np.float64)
                    good = np.isfinite(x).all(1) & x.any(1)
                    out[np.ix_(rows[good], queries)] = _unit(x[good]) @ known.T
            return out

        return score


class Scope:
    """Which rows each query may have: those of its values, and of its list of allowed ones (null: all)."""

    def __init__(self, queries: pd.DataFrame, same: list[str], allow: tuple[str, str] | None):
        self.n, self.same, self.allow = len(queries), same, allow
        self.codes = {v: i for i, v in enumerate(dict.fromkeys(zip(*(queries[c] for c in same))))} if same else {}
        self.own = np.array([self.codes[v] for v in zip(*(queries[c] for c in same))]) if same else None
        self.lists = [] if allow is None else [(q, frozenset(x)) for q, x in enumerate(queries[allow[1]]) if x is not None]

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.ones((batch.num_rows, self.n), bool)
        if self.same:
            have = np.array([self.codes.get(v, -1) for v in zip(*(batch.column(c).to_pylist() for c in self.same))])
            out &= have[:, None] == self.own[None]
        if self.lists:
            names = batch.column(self.allow[0]).to_pylist()
            for q, some in self.lists:
                out[:, q] &= np.fromiter((n in some for n in names), bool, len(names))
        return out


def _best(frame: pd.DataFrame, k: int, order: list[str]) -> pd.DataFrame:
    """The k first rows of each query: by score, falling, then the order, nulls first."""
    frame = frame.sort_values(["q", "score", *order], ascending=[True, False, *[True] * len(order)], na_position="first", kind="stable")
    return frame.groupby("q", sort=False).head(k)


def _whole(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _run(shared, k: int, order: list[str], adjust: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scorer, meets, bonus = shared.value
        score, kept = scorer.start(), None
        least = np.full(len(ids), -np.inf)
        for whole in batches:
            for begin in range(0, whole.num_rows, STEP):
                batch = whole.slice(begin, STEP)
                points = score(batch)
                points[~meets(batch)] = -np.inf
                if adjust:
                    points += batch.column("bonus").to_numpy(zero_copy_only=False)[:, None] * bonus[None]
                if len(points) > k:
                    least = np.maximum(least, np.partition(points, len(points) - k, axis=0)[len(points) - k])
                row, q = np.nonzero((points >= least[None]) & (points > -np.inf))
                if not len(row):
                    continue
                new = pd.DataFrame({"q": q, "score": points[row, q]} | {c: batch.column(c).take(pa.array(row)).to_pandas(types_mapper=pd.ArrowDtype) for c in order})
                kept = _best(new if kept is None else pd.concat([kept, new], ignore_index=True), k, order)
                full = kept.groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                least[full.index.to_numpy()] = np.maximum(least[full.index.to_numpy()], full["min"].to_numpy())
        if kept is not None:
            columns = [ids.take(pa.array(kept["q"].to_numpy())), pa.array(kept["score"].to_numpy(np.float64)), *(_whole(pa.array(kept[c])) for c in order)]
            yield pa.record_batch(columns, names=["query_id", "score", *order])

    return run


def top_by_scan(queries: DataFrame, rows: DataFrame, scorer: Callable[[pd.DataFrame], Terms | Cosine], k: int, order: list[str], same: list[str] = (), allow: tuple[str, str] | None = None, bonus: str | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, score, the order's columns, rank): the k best rows of each query, by score, then by ``order``.

    scorer(block of queries) gives the points by row and query, -inf where a row isn't a hit. ``same`` names columns that must be equal in query and row (null equals
    none), ``allow`` the row's column and the query's list it must be in (a null list allows all, an empty one
    none). Where the query's column ``bonus`` holds, the row's column "bonus" is added. Queries are taken by blocks, each a scan.
    """
    session, kinds = rows.sparkSession, dict(rows.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, score double, " + ", ".join(f"{c} {kinds[c]}" for c in order)
    asked = queries.filter(F.col("query_id").isNotNull())
    for c in same:
        asked = asked.filter(F.col(c).isNotNull())
    blocks = -(-asked.count() // block)
    found = session.createDataFrame([], schema)
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        own = asked.filter(part == b).toArrow()
        if own.num_rows:
            frame = own.to_pandas()
            plus = frame[bonus].fillna(False).to_numpy(bool).astype(np.float64) if bonus else None
            ids = own.column("query_id").combine_chunks()
            shared = session.sparkContext.broadcast((ids, scorer(frame), Scope(frame, list(same), allow), plus))
            found = found.unionByName(rows.mapInArrow(_run(shared, k, list(order), bonus is not None), schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *order)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
