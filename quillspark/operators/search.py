"""Batch retrieval: exact, BM25, weighted contains and cosine lists, fused, scored and diversified.

Every stage works on a table of queries (query_id, ...), so a batch is one plan. Queries are the stated
side: texts are scanned once against the batch's terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import ASCII_LOWER, ASCII_UPPER, ascii_lower, collapse, contains_like, display_text, file_name, index_tokens, occurrences, excerpt, text_key
from quillspark.operators import terms
from quillspark.operators.catalog import allowed
from quillspark.operators.scan import Bm25, Cosine, Terms, top_by_scan
from quillspark.session import cut_lineage

K1, B, RRF, LEAST_IDF = 1.2, 0.75, 60, 1e-6
LIST_K, CANDIDATES, SIMPLE_CANDIDATES, PER_DOCUMENT, FINAL_K, MOST_K = 40, 12, 6, 3, 10, 50


def indexed_text(chunks: DataFrame) -> Column:
    """The text that is indexed: name and path of the file, section, text."""
    section = F.when(F.size("section_path") > 0, F.concat(F.lit("位置："), F.array_join("section_path", " / ")))
    return F.concat_ws("\n", F.concat(F.lit("文件名："), file_name(F.col("canonical_path"))), F.concat(F.lit("文件路径："), "canonical_path"), section, "text")


def top(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The k first rows of each query, with rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def bm25_hits(queries: DataFrame, documents: DataFrame, k: int = LIST_K, places: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best documents (id, indexed) that hold at least one of a query's terms; ties to the smaller id.

    A term is a phrase of index tokens; a phrase's frequency counts its places. Statistics are over all
    documents given; with ``places`` (id, document_id, knowledge_base_id) only those that a query may see are
    hits. queries: query_id, fts array<string>. Terms without a token find nothing. Tokens that no query asks for
    are dropped where the text is read; pairs of query and document only exist within a scan's batch.
    """
    phrase = lambda t: F.array_join(index_tokens(t), " ")
    asked = cut_lineage(queries.withColumn("phrases", F.filter(F.transform(F.array_distinct("fts"), phrase), lambda x: x != "")))
    wanted = asked.select(F.explode("phrases").alias("phrase")).distinct().withColumn("tokens", F.split("phrase", " "))
    parts = wanted.select("phrase", F.size("tokens").alias("len"), F.posexplode("tokens").alias("offset", "token"))
    docs = documents.select("id", index_tokens(F.col("indexed")).alias("tokens"))
    found = docs.select("id", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token")).join(parts, "token")
    single = found.filter("len = 1").groupBy("id", "size", "phrase").agg(F.count("*").alias("tf"))
    # A phrase is where all its tokens stand at their offsets from one place.
    begins = found.filter("len > 1").groupBy("id", "size", "phrase", "len", (F.col("at") - F.col("offset")).alias("begin")).agg(F.count("*").alias("n"))
    tf = single.unionByName(begins.filter("n = len").groupBy("id", "size", "phrase").agg(F.count("*").alias("tf")))
    rows = cut_lineage(tf.groupBy("id", "size").agg(F.collect_list("phrase").alias("phrases"), F.collect_list("tf").alias("tf")))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    df = rows.select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df")).toPandas()
    value = np.log((stats["n"] - df["df"] + 0.5) / (df["df"] + 0.5))
    idf = dict(zip(df["phrase"], np.where(value > 0, value, LEAST_IDF)))
    keep, scope = [], {}
    if places is not None:
        rows, keep, scope = rows.join(places.select("id", "document_id", "knowledge_base_id"), "id"), ["knowledge_base_id", "allowed_document_ids"], _scoped(queries)
    return top_by_scan(asked.select("query_id", "phrases", *keep), rows, lambda f: Bm25(list(f["phrases"]), idf, stats["mean"] or 1.0, K1, B), k, ["id"], **scope)


def restrict(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk is active in the query's knowledge base and allowed to it, with document_id."""
    q = queries.select("query_id", F.col("knowledge_base_id").alias("_kb"), "allowed_document_ids")
    c = chunks.select("id", "document_id", "knowledge_base_id")
    return hits.join(q, "query_id").join(c, "id").filter((F.col("_kb") == F.col("knowledge_base_id")) & allowed(F.col("document_id"), F.col("allowed_document_ids"))).drop("_kb", "allowed_document_ids", "knowledge_base_id")


def _low(term: str) -> str:
    return term.translate(_LOWER)


_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
ACCESS = ("document_id", "allowed_document_ids")


def _scoped(queries: DataFrame) -> dict:
    """Base and access, of queries that have them."""
    return {"same": ["knowledge_base_id"] if "knowledge_base_id" in queries.columns else [], "allow": ACCESS if "allowed_document_ids" in queries.columns else None}


def exact_hits(queries: DataFrame, chunks: DataFrame, k: int = LIST_K) -> DataFrame:
    """(query_id, id, chunk_index, score, rank): the k best chunks that hold an exact term in their indexed text,
    ASCII case aside; longer terms weigh more, tables 100 for table questions."""
    rows = chunks.select("id", "chunk_index", "document_id", "knowledge_base_id", ascii_lower(F.col("indexed")).alias("low"), F.when(F.col("content_type") == "table", 100.0).otherwise(0.0).alias("bonus"))
    terms_of = lambda f: Terms([[(_low(t), float(len(t))) for t in x] for x in f["exact"]], "low")
    keep = ["query_id", "exact", "table", *(c for c in ("knowledge_base_id", "allowed_document_ids") if c in queries.columns)]
    return top_by_scan(queries.select(*keep), rows, terms_of, k, ["chunk_index", "id"], bonus="table", **_scoped(queries))


def contains_hits(queries: DataFrame, chunks: DataFrame, k: int = LIST_K) -> DataFrame:
    """(query_id, id, token_count, chunk_index, score, rank): the k chunks of the greatest sum of weights of the terms they hold, ASCII case aside."""
    keep = [c for c in ("knowledge_base_id", "allowed_document_ids") if c in queries.columns]
    rows = chunks.select("id", "chunk_index", "token_count", *([ACCESS[0], "knowledge_base_id"] if keep else []), ascii_lower(F.col("text")).alias("low"))
    terms_of = lambda f: Terms([[(_low(t["term"]), t["weight"]) for t in x] for x in f["weighted"]], "low")
    return top_by_scan(queries.select("query_id", "weighted", *keep), rows, terms_of, k, ["token_count", "chunk_index", "id"], **_scoped(queries))


def vector_hits(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k most cosine-similar vectors of each query, all vectors compared.

    queries: query_id, vector, optional filter columns that must equal the vectors' of the same name, and optional
    allowed_document_ids, which are met before the limit. Ties go to the smaller id.
    """
    shared = [c for c in queries.columns if c in vectors.columns and c not in ("vector", "query_id")]
    allow = ACCESS if ACCESS[1] in queries.columns else None
    rows = vectors.select("id", "vector", *shared, *([ACCESS[0]] if allow else []))
    return top_by_scan(queries, rows, lambda f: Cosine(list(f["vector"]), "vector"), k, ["id"], same=shared, allow=allow)


def fuse(lists: dict[str, DataFrame], k: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of lists (query_id, id, rank): query_id, id, score, sources, position.

    Ties keep the order in which the ids appear, list by list.
    """
    every = None
    for n, (name, ranked) in enumerate(lists.items()):
        part = ranked.select("query_id", "id", "rank", F.lit(name).alias("source"), F.lit(n).alias("n"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(F.struct("n", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen", "id")
    return fused.withColumn("position", F.row_number().over(order)).drop("seen")


def overlap_score(weighted: Column, text: Column) -> Column:
    """Sum of the weights of the terms in the collapsed text; case counts."""
    bare = collapse(text)
    return F.aggregate(F.filter(weighted, lambda t: F.contains(bare, t["term"])), F.lit(0.0), lambda s, t: s + t["weight"])


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def structure_bonus(query: Column, weighted: Column, content_type: Column, section_path: Column) -> Column:
    """What a chunk's section and kind add for a query."""
    low = F.lower(query)
    section = F.when(F.size(section_path) > 0, F.least(overlap_score(weighted, F.array_join(section_path, " / ")), F.lit(1.5))).otherwise(0.0)
    table, image = content_type == "table", content_type == "image"
    one = lambda when, value: F.when(when, value).otherwise(0.0)
    return section + one(table & _any(low, terms.TABLE_WORDS), 20.0) + one(table & _any(low, terms.TABLE_MARKS), 2.0) + one(image & _any(low, terms.IMAGE_MARKS), 2.0)


def exact_field_bonus(quoted: Column, text: Column) -> Column:
    bare = collapse(text)
    return 100.0 * F.size(F.filter(quoted, lambda p: F.contains(bare, p)))


def table_total_bonus(query: Column, text: Column) -> Column:
    bare = collapse(text)
    asked = _any(query, terms.TOTAL_WORDS) & F.contains(bare, F.lit("序号：合计"))
    return F.when(asked, 20.0 + F.when(F.contains(bare, F.lit("计算值：")), 10.0).otherwise(0.0) + F.when(F.contains(bare, F.lit("医院总价：")), 5.0).otherwise(0.0)).otherwise(0.0)


def near_duplicate(a: str, b: str) -> bool:
    """Of two text keys: equal, or the shorter, of 60 characters or more and 0.78 of the longer, is part of it."""
    short, long = sorted((a, b), key=len)
    return short == long or (len(short) >= 60 and len(short) >= 0.78 * len(long) and short in long)


def _diversify(per_document: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "position"], ascending=[False, True], kind="stable")
        taken, keys, used, most = [], [], {}, int(group["most"].iloc[0])
        for row, doc, key in zip(range(len(group)), group["document_id"], group["key"]):
            if len(taken) == most:
                break
            if not key or used.get(doc, 0) >= per_document or any(near_duplicate(key, k) for k in keys):
                continue
            taken.append(row)
            keys.append(key)
            used[doc] = used.get(doc, 0) + 1
        out = group.iloc[taken][["query_id", "id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return run


def diversify(candidates: DataFrame, per_document: int = PER_DOCUMENT, limit: int = FINAL_K) -> DataFrame:
    """The best candidates (query_id, id, document_id, key, score, position), at most per_document of one document
    and none nearly equal to a better one; of each query its ``most``, if there is such a column, else ``limit``.
    A query has at most MOST_K candidates, so a group is small."""
    kind = dict(candidates.dtypes)
    schema = f"query_id {kind['query_id']}, id {kind['id']}, score double, rank int"
    most = F.col("most") if "most" in candidates.columns else F.lit(limit).alias("most")
    return candidates.select("query_id", "id", "document_id", "key", "score", "position", most).groupBy("query_id").applyInPandas(_diversify(per_document), schema)


@F.pandas_udf(T.StringType())
def focused_quote(text: pd.Series, weighted: pd.Series) -> pd.Series:
    """Of displayed texts of more than three paragraphs the best one by the query's terms with two on either side, at most 900 characters."""
    out = []
    for t, pairs in zip(text, weighted):
        parts = [p for p in (t or "").split("\n\n") if p.strip()]
        if len(parts) > 3:
            score = [sum(x["weight"] for x in pairs if x["term"] in p) for p in parts]
            best = score.index(max(score))
            t = "\n\n".join(parts[max(0, best - 2) : best + 3])
            t = t if len(t) <= 900 else t[:900].rstrip() + "..."
        out.append(t)
    return pd.Series(out)


def search(queries: DataFrame, chunks: DataFrame, everything: DataFrame, vectors: DataFrame | None = None, list_k: int = LIST_K, candidates: int = CANDIDATES, simple: int = SIMPLE_CANDIDATES, per_document: int = PER_DOCUMENT, limit: int = FINAL_K, rerank=None) -> DataFrame:
    """Hits of a batch: query_id, rank, id, document_id, score, sources, quote.

    queries: query_id, knowledge_base_id, query, allowed_document_ids, and vector if vectors are given; chunks:
    active chunks; everything: all indexed chunks (id, indexed), over which BM25 counts; vectors: id, vector,
    knowledge_base_id, document_id, of which stale ones take up places as well. Access is met before every limit. A query with exact hits uses them as full-text and contains lists and skips the vectors.
    A rerank column function of (query, text) replaces the lexical score by its own. Blank queries find nothing.
    A query's top_k, if queries have that column and it isn't null, replaces ``limit`` and raises the candidates of a
    complex query to as many; a simple query keeps its own. A query whose top_k isn't in 1 to MOST_K finds nothing.
    """
    asked_k = F.col("top_k").cast("int") if "top_k" in queries.columns else F.lit(None).cast("int")
    queries = queries.withColumn("top_k", asked_k).filter(F.col("top_k").isNull() | F.col("top_k").between(1, MOST_K))
    chunks = chunks.withColumn("indexed", indexed_text(chunks))
    q = cut_lineage(queries.withColumn("p", terms.parse("query")).select("*", "p.*").drop("p"))
    exact = cut_lineage(exact_hits(q, chunks, list_k).select("query_id", "id", "rank"))
    rest = q.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    fts = bm25_hits(rest, everything, list_k, chunks)
    contains = contains_hits(rest, chunks, list_k)
    pick = ["query_id", "id", "rank"]
    lists = {"fts": exact.unionByName(fts.select(*pick)), "contains": exact.unionByName(contains.select(*pick))}
    if vectors is not None:
        asked = rest.filter("vector is not null").select("query_id", "vector", "knowledge_base_id", "allowed_document_ids")
        lists["vector"] = vector_hits(asked, vectors, list_k)
    fused = fuse(lists).join(q.select("query_id", "complex", "query", "weighted", "quoted", "top_k"), "query_id")
    most = F.greatest(F.lit(candidates), F.col("top_k"))
    fused = fused.filter(F.col("position") <= F.when(F.col("complex"), most).otherwise(F.least(most, F.lit(simple))))
    loaded = restrict(fused, queries, chunks.select("id", "document_id", "knowledge_base_id")).join(chunks.select("id", "text", "content_type", "section_path"), "id")
    bonus = structure_bonus(F.col("query"), F.col("weighted"), F.col("content_type"), F.col("section_path"))
    if rerank is None:
        score = F.col("score") + overlap_score(F.col("weighted"), F.col("text")) + bonus
    else:
        score = rerank(F.col("query"), F.col("text")) + 0.01 * F.col("score") + exact_field_bonus(F.col("quoted"), F.col("text")) + table_total_bonus(F.col("query"), F.col("text")) + bonus
    loaded = cut_lineage(loaded.withColumn("score", score).withColumn("key", text_key(F.col("text"))).withColumn("shown", display_text(F.col("text"))))
    best = diversify(loaded.withColumn("most", F.coalesce("top_k", F.lit(limit))), per_document, limit)
    out = best.join(loaded.select("query_id", "id", "document_id", "sources", "shown", "weighted"), ["query_id", "id"])
    return out.select("query_id", "rank", "id", "document_id", "score", "sources", focused_quote("shown", "weighted").alias("quote"))


def field_search(fields: DataFrame, chunks: DataFrame, most: int | None = 300) -> DataFrame:
    """Fields (query_id, knowledge_base_id, field) in active chunks: per document matched_chunks, occurrences (case
    counts), and page, section and excerpt of the first chunk. At most ``most`` chunks of a field, by path, then index;
    with None all, for which nothing is sorted."""
    c = chunks.select("id", "document_id", "knowledge_base_id", "canonical_path", "chunk_index", "page_no", "section_path", "text")
    hit = c.join(fields, "knowledge_base_id").filter(contains_like(F.col("text"), F.col("field")))
    order = ("canonical_path", "chunk_index", "id")
    some = hit if most is None else top(hit, most, *map(F.col, order))
    one = some.withColumn("n", occurrences(F.col("text"), F.col("field"))).withColumn("e", excerpt(F.col("text"), F.col("field")))
    first = F.min_by(F.struct("page_no", F.array_join("section_path", " / ").alias("section"), "e"), F.struct(*order))
    out = one.groupBy("query_id", "document_id", "canonical_path").agg(F.count("*").alias("matched_chunks"), F.sum("n").alias("occurrences"), first.alias("f"))
    return out.select("query_id", "document_id", "canonical_path", "matched_chunks", "occurrences", "f.page_no", "f.section", F.col("f.e").alias("excerpt"))
