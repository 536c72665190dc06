"""Scans of rows for a stated set of queries: scope, ties, blocks, against brute force."""

import random

import numpy as np
import pytest

from quillspark.operators import search
from quillspark.operators.scan import Cosine, Terms, top_by_scan

ROW = "id string, document_id string, knowledge_base_id string, chunk_index int, token_count int, text string"


@pytest.mark.parametrize("block", [3, 1000])
def test_terms_as_brute_force(spark, block):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"c{i:03}", f"d{i % 9}", rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice([None, 5, 6]), " ".join(rng.choices(words, k=4)) if i % 17 else None) for i in range(400)]
    asked = []
    for q in range(10):
        allow = [None, [], ["d1", "d2"], ["zzz"]][q % 4]
        asked.append((q, rng.choice("ab"), allow, [(w, float(rng.randint(1, 3))) for w in rng.sample(words, 3)] + [("", 9.0)]))
    queries = spark.createDataFrame([(q, kb, a, [{"term": t, "weight": w} for t, w in x]) for q, kb, a, x in asked], "query_id int, knowledge_base_id string, allowed_document_ids array<string>, weighted array<struct<term: string, weight: double>>")
    out = top_by_scan(queries, spark.createDataFrame(rows, ROW).repartition(3), lambda f: Terms([[(t["term"], t["weight"]) for t in x] for x in f["weighted"]], "text"), 6, ["token_count", "chunk_index", "id"], ["knowledge_base_id"], ("document_id", "allowed_document_ids"), block=block)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    low = lambda x: (x is not None, x or 0)
    for q, kb, allow, terms in asked:
        hits = []
        for id_, doc, base, index, tokens, text in rows:
            score = sum(w for t, w in terms if t and text and t in text)
            if score and base == kb and (allow is None or doc in allow):
                hits.append((-score, low(tokens), low(index), id_))
        assert got.get(q, []) == [(h[3], -h[0]) for h in sorted(hits)[:6]]
    assert top_by_scan(queries.limit(0), spark.createDataFrame(rows, ROW), lambda f: Terms([], "text"), 6, ["id"]).count() == 0


def test_access_is_met_before_the_limit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    order = np.argsort(-(x @ x[0]) / np.linalg.norm(x, axis=1))
    vectors = spark.createDataFrame([(f"v{i:02}", f"d{i}", "kb", v.tolist()) for i, v in enumerate(x)], "id string, document_id string, knowledge_base_id string, vector array<double>")
    late = int(order[55])
    asked = [(1, "kb", None, x[0].tolist()), (2, "kb", [f"d{late}"], x[0].tolist()), (3, "kb", [], x[0].tolist()), (4, "other", None, x[0].tolist()), (5, "kb", None, [0.0] * 8), (6, "kb", None, [None] * 8)]
    q = spark.createDataFrame(asked, "query_id int, knowledge_base_id string, allowed_document_ids array<string>, vector array<double>")
    got = {}
    for r in search.vector_hits(q, vectors, 40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [f"v{i:02}" for i in order[:40]], 2: [f"v{late:02}"]}


def test_an_allowed_document_far_down_the_vectors_is_found(spark):
    rows = [(f"c{i:02}", f"d{i}", f"d{i}", "kb", f"f/d{i}.txt", 0, f"text {i}", [], "text", 2, 1, [1.0, i / 100]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "id string, document_version_id string, document_id string, knowledge_base_id string, canonical_path string, chunk_index int, text string, section_path array<string>, content_type string, token_count int, page_no int, vector array<double>")
    q = spark.createDataFrame([(1, "kb", "zzz", ["d55"], [1.0, 0.0])], "query_id int, knowledge_base_id string, query string, allowed_document_ids array<string>, vector array<double>")
    hits = search.search(q, chunks.drop("vector"), chunks.select("id", search.indexed_text(chunks).alias("indexed")), chunks.select("id", "vector", "knowledge_base_id", "document_id")).collect()
    assert [(r.id, r.sources) for r in hits] == [("c55", ["vector"])]


def test_vectors_of_other_sizes_and_kinds(spark):
    score = Cosine([[1.0, 0.0], [1.0, 0.0, 0.0], None, [float("nan"), 1.0]], "v").start()
    import pyarrow as pa

    out = score(pa.record_batch([pa.array([[2.0, 0.0], None, [0.0, 0.0], [0.0, 3.0, 4.0], [1e300, 1e300]])], names=["v"]))
    assert out[0, 0] == 1.0 and out[3, 1] == 0.0 and abs(out[4, 0] - 0.5**0.5) < 1e-12 and np.isinf(out).sum() == 20 - 3
