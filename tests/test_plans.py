"""Registered queries do their whole job, on small folders of tables."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans import pages, retrieval

CHUNK = "id string, document_version_id string, chunk_index int, text string, section_path array<string>, content_type string, token_count int, page_no int"
VERSION = "id string, document_id string, state string, created_at timestamp_ntz"
RECORD = "id string, vector array<double>, payload struct<document_id: string, knowledge_base_id: string, canonical_path: string>"


@pytest.fixture
def folder(spark, tmp_path):
    """Two documents of three chunks, the second one without a vector record, and a failed one that has neither."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    texts = ["the pump leaks oil", "a valve closes", "gear wheel"]
    write("chunks", [(f"c{d}{i}", f"v{d}", i, t, [], "text", len(t.split()), 1) for d in (1, 2) for i, t in enumerate(texts)], CHUNK)
    write("document_versions", [(f"v{d}", f"d{d}", state, None) for d, state in ((1, "ready"), (2, "ready"), (3, "failed"))], VERSION)
    write("vector_records", [("c10", [1.0, 0.0], ("d1", "kb", "f/d1.txt"))], RECORD)
    return str(tmp_path), write


def test_every_chunk_has_a_context(spark, folder):
    got = retrieval.context_windows(spark, folder[0]).filter("anchor_id like 'c1%'").collect()
    assert {(r.anchor_id, r.id) for r in got} == {(f"c1{i}", f"c1{j}") for i in range(3) for j in range(3)}
    runs = retrieval.context_segments(spark, folder[0]).filter("document_version_id = 'v1'").collect()
    assert [(r.first_index, r.last_index, r.chunks) for r in runs] == [(0, 2, 3)] * 3 and len({r.text_md5 for r in runs}) == 3
    assert {r.id for r in pages.chunk_previews(spark, folder[0]).collect()} == {f"c{d}{i}" for d in (1, 2) for i in range(3)}


def test_contains_search_asks_every_question(spark, folder):
    folder[1]("eval_cases", [("q1", "Which pump leaks?"), ("q10", "Where is the valve?")], "id string, question string")
    got = {(r.query_id, r.id) for r in retrieval.contains_search(spark, folder[0]).filter("rank = 1").collect()}
    assert got == {("q1", "c10"), ("q10", "c11")}


def test_top_k_of_a_request(spark, folder):
    path, write = folder
    names = "alpha beta gamma delta omega sigma kappa lambda zeta theta iota rho tau phi chi psi".split()
    write("chunks", [(f"c{i:02}", f"v{i}", 0, f"pump station {name} {name * 2}", [], "text", 4, 1) for i, name in enumerate(names)], CHUNK)
    write("document_versions", [(f"v{i}", f"d{i}", "ready", None) for i in range(len(names))], VERSION)
    write("vector_records", [(f"c{i:02}", [1.0, 0.0], (f"d{i}", "kb", f"f/d{i}.txt")) for i in range(len(names))], RECORD)
    long, simple = "compare which pump and which station is where and list the differences between them all", "pump"
    asked = [(100 * n, "kb", q, None, k) for n, (q, k) in enumerate([(long, None), (long, 20), (long, 5), (long, 0), (long, 51), (simple, 20), (simple, None)], 1)]
    write("search_requests", asked, "request_id long, knowledge_base_id string, query string, allowed_document_ids array<string>, top_k int")
    got = {r.query_id // 100: r["count"] for r in retrieval.hybrid_search(spark, path).groupBy("query_id").count().collect()}
    assert got == {1: 10, 2: 16, 3: 5, 6: 6, 7: 6}
    answered = {r.query_id // 100: r for r in retrieval.answered_requests(spark, path).collect()}
    assert set(answered) == set(range(1, 8)) and answered[4].answer == answered[1].answer


def test_ranking_by_the_sources_of_all_cases(spark, folder):
    path, write = folder
    cases = [
        ("q1", "Which pump leaks?", "a", True, [("x\\d1.txt", None, None), ("f\\d1.txt", None, None)]),
        ("q2", "Where is the valve?", "a", True, [(None, "d2", None)]),
        ("q3", "zzz", "a", True, [("f/d1.txt", None, None)]),
        ("q4", "gear", "a", None, [(None, "", "c12")]),
        ("q5", "gear", "b", False, None),
    ]
    write("eval_cases", cases, "id string, question string, category string, validated boolean, relevant_sources array<struct<document_path: string, document_id: string, chunk_id: string>>")
    got = {(r.validated, r.category, r.k): r for r in retrieval.ranking_metrics(spark, path).collect()}
    assert set(got) == {(v, c, k) for v, c in ((True, "a"), (False, "a"), (False, "b")) for k in (1, 3, 5, 10, 15)}
    one, all_ = got[True, "a", 1], got[True, "a", 15]
    assert (one.cases, one.hit, one.recall, one.precision) == (3, 0.333333, 0.166667, 0.333333)
    assert (all_.hit, all_.mrr, all_.precision) == (0.666667, 0.5, 0.066667)
    assert (got[False, "a", 1].recall, got[False, "a", 1].ndcg, got[False, "b", 15].recall) == (1.0, 1.0, 0.0)


def test_ranking_is_fifteen_deep(spark, folder):
    path, write = folder
    write("chunks", [(f"c{i:02}", "v1", i, "pump", [], "text", 1, 1) for i in range(20)], CHUNK)
    write("eval_cases", [("q", "pump", "a", True, [(None, None, "c12")])], "id string, question string, category string, validated boolean, relevant_sources array<struct<document_path: string, document_id: string, chunk_id: string>>")
    got = {r.k: r.hit for r in retrieval.ranking_metrics(spark, path).collect()}
    assert (got[10], got[15]) == (0.0, 1.0)


def test_documents_without_a_vector_count(spark, folder):
    got = {r.document_id: (r.knowledge_base_id, r.state, r.chunk_count) for r in retrieval.document_status(spark, folder[0]).collect()}
    assert got == {"d1": ("kb", "ready", 3), "d2": (None, "ready", 3), "d3": (None, "failed", 0)}
    summary = {r.knowledge_base_id: (r.documents, r.ready, r.failed, r.pending) for r in retrieval.status_summary(spark, folder[0]).collect()}
    assert summary == {"kb": (1, 1, 0, 0), None: (2, 1, 1, 0)}
    assert {r.state: r.documents for r in retrieval.status_histogram(spark, folder[0]).collect()} == {"ready": 2, "failed": 1}
    assert retrieval.active_chunks(spark, folder[0]).filter("document_id = 'd2'").count() == 3


def test_vectors_of_all_labels_are_compared(spark, folder):
    path, write = folder
    write("embeddings", [(100, "a", [1.0, 0.0]), (1, "b", [1.0, 0.1]), (2, "a", [0.0, 1.0])], "vec_id long, label string, embedding array<float>")
    assert [r.id for r in retrieval.vector_search(spark, path).orderBy("rank").collect()] == [100, 1, 2]
    assert [r.id for r in retrieval.vector_search_filtered(spark, path).orderBy("rank").collect()] == [100, 2]
    assert {r.id for r in retrieval.fused_ranks(spark, path).collect()} == {1, 2, 100}
