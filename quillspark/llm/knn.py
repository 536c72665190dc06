"""The k most similar vectors of every vector: inverted file with product-quantised residuals.

Vectors are scaled to length 1. Coarse centroids and residual codebooks are fitted on a sample; every
vector is then assigned to its nearest centroid and coded. A query visits the ``probes`` nearest lists;
in a list all entries are scored by asymmetric distance tables (query against codewords), the best
``rerank``, or the best eighth of a longer list, are scored again with the exact vectors, and the k best
over all lists remain. There are about twice the root of the number of vectors lists: beyond what the
driver's sample can fit, each first-level cell is parted again by centroids fitted on its own sample, in
a task of its own. Lists are cut into blocks of bounded size by a hash of the vector, so a hot list
becomes many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

K, SAMPLE, PER_LIST, PARTS, CODES, PROBES, RERANK, BLOCK = 5, 20_000, 16, 24, 256, 6, 100, 4096


@dataclass
class Codebooks:
    """Centroids (lists x d) in the order of their first-level cell, the cells' centroids and where their lists
    begin (one more than cells), residual codewords (parts x codes x d / parts)."""

    cells: np.ndarray
    begins: np.ndarray
    centroids: np.ndarray
    codewords: np.ndarray

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of unit rows, nearest first; fewer than asked come as -1. With two levels only the lists of the nearest cells are looked at."""
        if len(self.cells) == len(self.centroids):
            return nearest(x, self.centroids, probes)
        take = min(2 * probes, len(self.cells))
        cells, score = nearest(x, self.cells, take), np.full((len(x), probes), np.inf, np.float32)
        lists = np.full((len(x), probes), -1, np.int64)
        for cell in np.unique(cells):
            rows, (lo, hi) = np.flatnonzero((cells == cell).any(1)), self.begins[cell : cell + 2]
            c = self.centroids[lo:hi]
            both = np.concatenate([score[rows], (c**2).sum(1)[None] - 2 * x[rows] @ c.T], 1)
            names = np.concatenate([lists[rows], np.broadcast_to(np.arange(lo, hi), (len(rows), hi - lo))], 1)
            best = np.argsort(both, axis=1, kind="stable")[:, :probes]
            score[rows], lists[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        return lists


def nearest(x: np.ndarray, centre: np.ndarray, take: int) -> np.ndarray:
    """The rows of ``centre`` nearest to each row of x, nearest first."""
    score = (centre**2).sum(1)[None] - 2 * x @ centre.T
    take = min(take, len(centre))
    near = np.argpartition(score, take - 1, axis=1)[:, :take]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct random rows; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(1)[None] - 2 * x @ centre.T, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def fit(sample: np.ndarray, lists: int, parts: int, codes: int, seed: int = 7) -> Codebooks:
    """One level of centroids, and codewords of the residuals to them."""
    lists = max(1, min(lists, len(sample)))
    centroids = k_means(sample, lists, 8, seed)
    return with_codewords(Codebooks(centroids, np.arange(lists + 1), centroids, np.zeros((parts, 0, 0))), sample, codes, seed)


def with_codewords(books: Codebooks, sample: np.ndarray, codes: int, seed: int = 7) -> Codebooks:
    parts = len(books.codewords)
    residual = (sample - books.centroids[books.nearest(sample, 1)[:, 0]]).reshape(len(sample), parts, -1)
    codes = min(codes, len(sample))
    return Codebooks(books.cells, books.begins, books.centroids, np.stack([k_means(residual[:, p], codes, 6, seed + p) for p in range(parts)]))


def _rows(v: pd.Series, kind=np.float32) -> np.ndarray:
    """Byte strings of equal length as the rows of a matrix."""
    return np.frombuffer(b"".join(v), kind).reshape(len(v), -1)


def _parted(per_list: int):
    """applyInPandas: the sample of one first-level cell to its own centroids, one for every ``per_list`` rows."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _units(_rows(rows["v"])).astype(np.float32)
        fitted = k_means(x, max(1, len(x) // per_list), 8, int(key[0]))
        return pd.DataFrame({"cell": key[0], "centroid": [c.tobytes() for c in fitted]})

    return run


def _cells(cells: np.ndarray):
    """mapInPandas: v to (cell, v), the nearest first-level cell."""

    def run(batches):
        for batch in batches:
            if len(batch):
                raw = np.stack(batch["v"].to_numpy()).astype(np.float32)
                yield pd.DataFrame({"cell": nearest(_units(raw).astype(np.float32), cells, 1)[:, 0].astype(np.int32), "v": [r.tobytes() for r in raw]})

    return run


def usable(records: DataFrame, size: int) -> DataFrame:
    """(id, v) of the rows whose vector has ``size`` finite numbers, not all 0. One row per id."""
    good = (F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = records.select("id", "vector").filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.groupBy("id").agg(F.min(F.col("vector").cast("array<float>")).alias("v"))


def wide_hash(*columns: str | Column) -> Column:
    """128 bits by which values are told apart: two 64-bit hashes of different seeds, as binary."""
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(half(F.xxhash64(*columns)), half(F.xxhash64(F.lit("second"), *columns))))


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of 32-bit numbers as rows of length 1 (64-bit)."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the square
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(shared, probes: int):
    """mapInPandas: adds the query's lists, nearest first, and the codes of the residual in the first."""

    def run(batches):
        books: Codebooks = shared.value
        w = books.codewords
        parts, _, width = w.shape
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                part = batch.iloc[begin : begin + 4096]
                raw = np.stack(part["v"].to_numpy()).astype(np.float32)
                x = _units(raw).astype(np.float32)
                near = books.nearest(x, probes)
                residual = (x - books.centroids[near[:, 0]]).reshape(len(x), parts, width)
                code = np.stack([np.argmin((w[p] ** 2).sum(1)[None] - 2 * residual[:, p] @ w[p].T, axis=1) for p in range(parts)], 1).astype(np.uint8)
                yield pd.DataFrame({"cls": part["cls"], "v": [r.tobytes() for r in raw], "code": [r.tobytes() for r in code], "lists": [r[r >= 0] for r in near.astype(np.int32)]})

    return run


def _search(shared, k: int, rerank: int):
    """One block of base rows against one block of queries of the same list: the k best of each query, and what is as similar as the k-th."""

    def run(key: tuple, queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(base):
            return pd.DataFrame({"cls": pd.Series(dtype="object"), "other": pd.Series(dtype="object"), "similarity": pd.Series(dtype="float64")})
        w = shared.value.codewords
        parts, codes, width = w.shape
        exact, code = _units(_rows(base["v"])), _rows(base["code"], np.uint8).T.astype(np.intp)
        own, theirs = queries["q_cls"].to_numpy(), base["cls"].to_numpy()
        place = dict(zip(theirs, range(len(theirs))))
        itself = np.array([place.get(c, -1) for c in own])
        raw = queries["q_v"]
        take, out = min(max(rerank, len(base) // 8) + 1, len(base)), []
        for begin in range(0, len(own), 256):
            x = _units(_rows(raw.iloc[begin : begin + 256]))
            if take < len(base):
                table = np.einsum("qpw,pcw->pqc", x.reshape(len(x), parts, width).astype(np.float32), w, optimize=True)
                score = np.take(table[0], code[0], axis=1)
                for p in range(1, parts):
                    score += np.take(table[p], code[p], axis=1)
                best = np.argpartition(-score, take - 1, axis=1)[:, :take]
                similarity = np.matmul(exact[best], x[:, :, None])[:, :, 0]
            else:
                best = np.broadcast_to(np.arange(len(base)), (len(x), len(base)))
                similarity = x @ exact.T
            similarity[best == itself[begin : begin + 256, None]] = -np.inf
            keep = min(k, take)
            least = np.partition(similarity, take - keep, axis=1)[:, take - keep]
            row, col = np.nonzero((similarity >= least[:, None]) & np.isfinite(similarity))
            out.append(pd.DataFrame({"cls": own[begin + row], "other": theirs[best[row, col]], "similarity": similarity[row, col]}))
        return pd.concat(out)

    return run


def _fitted(members: DataFrame, total: int, sample: int, lists: int | None) -> Codebooks | None:
    """Codebooks of about ``lists`` lists (twice the root of the number of different vectors if not given)."""
    lists = lists or max(1, int(2 * total**0.5))

    def drawn(most: int, seed: int) -> DataFrame:
        """About ``most`` different vectors by hash; copies count once."""
        share = F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, (most + 4 * most**0.5) / max(total * 0.9, 1)) * (1 << 40))
        return members.filter(share).groupBy("cls").agg(F.any_value("v").alias("v"))

    first = drawn(sample, 11).orderBy(F.xxhash64("cls", F.lit(12))).limit(sample).select("v").toPandas()["v"]
    if not len(first):
        return None
    x = _units(np.stack(first.to_numpy()).astype(np.float32)).astype(np.float32)
    flat = max(1, sample // PER_LIST)
    if lists <= flat:
        return fit(x, lists, PARTS, CODES)
    cells = k_means(x, max(1, min(int(lists**0.5), flat, len(x))), 8, 7)
    second = drawn(PER_LIST * lists, 13).select("v").mapInPandas(_cells(cells), "cell int, v binary")
    fine = second.groupBy("cell").applyInPandas(_parted(PER_LIST), "cell int, centroid binary").toPandas().sort_values("cell", kind="stable")
    begins = np.searchsorted(fine["cell"].to_numpy(), np.arange(len(cells) + 1))
    return with_codewords(Codebooks(cells, begins, _rows(fine["centroid"]), np.zeros((PARTS, 0, 0))), x, CODES)


def neighbours(records: DataFrame, k: int = K, size: int = 48, sample: int = SAMPLE, probes: int = PROBES, rerank: int = RERANK, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """(id, rank, other, similarity): the k most cosine-similar other ids of every usable vector.

    Only vectors of ``size`` finite numbers, not all 0, with an id take part; a repeated id counts
    once. Equal vectors form one class that is searched once; the members of a class are neighbours
    of each other first, the smaller id first. At most 1 + k ids of a class can be among anyone's
    neighbours, so larger classes cost nothing more. Fewer than k others give fewer rows. Of equally
    similar records the smaller id goes first. Every row is indexed. The driver fits on at most ``sample``
    different vectors; if there are more lists than a sixteenth of that, tasks fit them on sixteen vectors a
    list. What is broadcast is the centroids, about twice the root of the number of vectors times their size.
    """
    context = records.sparkSession.sparkContext
    members = cut_lineage(usable(records, size).withColumn("cls", wide_hash("v")))
    books = _fitted(members, members.agg(F.approx_count_distinct("cls", 0.02)).first()[0], sample, lists)
    if books is None:
        return records.sparkSession.createDataFrame([], f"id {dict(records.dtypes)['id']}, rank int, other {dict(records.dtypes)['id']}, similarity double")
    shared = context.broadcast(books)
    first = members.groupBy("cls").agg(F.any_value("v").alias("v"))
    coded = cut_lineage(first.mapInPandas(_assign(shared, probes), "cls binary, v binary, code binary, lists array<int>"))

    # Blocks of a list: as many as its rows need.
    sizes = coded.groupBy(F.col("lists")[0].alias("list")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    salt = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), n).cast("int")
    q_sizes = coded.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / (block * 4)).cast("int").alias("parts"))
    plan = cut_lineage(sizes.join(q_sizes, "list"))
    base = coded.select(F.col("lists")[0].alias("list"), "cls", "v", "code").join(plan, "list")
    base = base.select("list", salt(F.col("blocks"), 1).alias("b"), "cls", "v", "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    visits = coded.select("cls", "v", F.explode("lists").alias("list")).join(plan, "list")
    visits = visits.select("list", "cls", "v", salt(F.col("parts"), 2).alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    visits = visits.toDF("q_list", "q_cls", "q_v", "q_q", "q_b")
    found = visits.groupBy("q_list", "q_b", "q_q").cogroup(base.groupBy("list", "b", "q")).applyInPandas(_search(shared, k, rerank), "cls binary, other binary, similarity double")

    # The k + 1 smallest ids of a class can be neighbours; ties beyond the k-th class go by id as well.
    ranked = Window.partitionBy("cls").orderBy("id")
    few = members.select("id", "cls").withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= k + 1).drop("n")
    best = Window.partitionBy("cls").orderBy(F.desc("similarity"))
    near = found.withColumn("n", F.rank().over(best)).filter(F.col("n") <= k).drop("n")
    own = coded.select("cls", F.col("cls").alias("other"), F.lit(1.0).alias("similarity"))
    near = near.unionByName(own)
    options = near.join(few.select(F.col("cls").alias("other"), F.col("id").alias("other_id")), "other").select("cls", "other_id", "similarity")
    top = Window.partitionBy("cls").orderBy(F.desc("similarity"), "other_id")
    options = options.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
    lists_of = options.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("n", "other_id", "similarity"))).alias("near"))
    joined = members.select("id", "cls").join(lists_of, "cls")
    kept = F.slice(F.filter("near", lambda x: x["other_id"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(kept).alias("p", "x")).select("id", (F.col("p") + 1).alias("rank"), F.col("x.other_id").alias("other"), F.col("x.similarity").alias("similarity"))


def neighbour_pairs(records: DataFrame, k: int = K, **options) -> DataFrame:
    """(id_a < id_b) where one is among the k nearest of the other."""
    found = neighbours(records, k, **options)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
