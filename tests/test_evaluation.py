"""Evaluation sets, upkeep of jobs and documents, and the store."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import benchmark, metrics, sync
from quillspark.sources.store import Store

CASE = "id string, question string, category string, relevant_sources array<struct<document_path: string, evidence_text: string>>"


def test_numbers_and_aliases_in_compatible_form(spark):
    n = spark.createDataFrame([("１２ kg", "12 KG"), ("5 kg", "5"), ("7", "8"), ("none", "1"), (None, "1")], "a string, e string")
    got = [tuple(r[0]) for r in n.select(metrics.numeric_match(F.col("a"), F.col("e"))).collect()]
    assert got == [(True, True, True), (True, False, False), (False, True, False), (False, False, False), (False, False, False)]
    e = spark.createDataFrame([("AB12", "x", ["ＡＢ１２"]), ("a", "b", None), ("Ａ", "a", []), (None, "", None)], "a string, e string, l array<string>")
    assert [r[0] for r in e.select(metrics.exact_match(F.col("a"), F.col("e"), F.col("l"))).collect()] == [True, False, True, True]


def test_leakage_audit_and_gate(spark):
    cases = [
        ("a", "看“泵组的额定压力是十二”在哪里说明？", "numeric_parameter", [("f\\泵组手册.txt", "泵组的额定压力是十二兆帕")]),
        ("b", "阀门 35 关闭的条件有哪些说明？", "numeric_parameter", [("x/y.md", "阀门在 35 度时关闭，2024 年")]),
        ("c", "short", None, None),
        ("a", "看“泵组的额定压力是十二”在哪里说明？", "numeric_parameter", [("f\\泵组手册.txt", "泵组的额定压力是十二兆帕")]),
    ]
    df = spark.createDataFrame(cases, CASE)
    ranked = spark.createDataFrame([("a", 1, ["fts"], True), ("b", 2, ["vector"], True)], "id string, rank int, methods array<string>, relevant boolean")
    audit = benchmark.leakage_audit(df, ranked)
    got = {r.id: r for r in audit.collect()}
    assert got["a"].direct and got["a"].payload_coverage == 1.0 and got["a"].rank1_relevant and got["a"].shortcut and not got["a"].file_named
    assert not got["b"].shortcut and got["b"].rank1_methods is None and got["c"].category == "unknown"
    rates = {r.category: r for r in benchmark.audit_rates(audit).collect()}
    assert (rates[None].cases, rates[None].shortcut, rates["numeric_parameter"].direct) == (3, 0.333333, 0.5)
    assert [tuple(r) for r in benchmark.rank1_methods(audit).collect()] == [("fts", 1)]
    reasons = {r.id: r.reasons for r in benchmark.leakage_reasons(df).collect()}
    assert "contains_quotation" in reasons["a"] and reasons["b"] == ["contains_answer_number=35"] and reasons["c"] == ["question_length_out_of_range", "insufficient_chinese_question_text"]
    assert benchmark.leakage_audit(df.limit(0), ranked).count() == 0


def test_terms_and_quotas(spark):
    texts = spark.createDataFrame([(1, "泵组，压力"), (2, "泵组"), (3, None), (4, "一个。泵 组"), (5, "")], "doc_id int, text string")
    freq = {r.term: r.documents for r in benchmark.term_frequencies(texts).collect()}
    assert freq == {"泵组": 3, "压力": 1}
    got = [tuple(r) for r in benchmark.low_overlap_terms(texts.withColumnRenamed("doc_id", "id"), spark.createDataFrame(list(freq.items()), "term string, documents long")).collect()]
    assert got == [(1, "泵组", "压力")]
    rows = [(f"c{i}", f"d{i % 2}", "k" if i < 8 else "m", i) for i in range(10)]
    q = spark.createDataFrame([("k", 5), ("m", 5)], "category string, quota int")
    out = benchmark.with_quotas(spark.createDataFrame(rows, "id string, document_id string, category string, place int"), q, 2).collect()
    assert {(r.id, r.n, r.enough) for r in out} == {("c0", 1, False), ("c1", 2, False), ("c2", 3, False), ("c3", 4, False), ("c8", 1, False), ("c9", 2, False)}


def test_answers_gate_and_stability(spark):
    rows = [(True, ["manual"], False, ["pump manual.pdf"]), (True, ["manual"], True, ["pump manual.pdf"]), (True, None, False, ["x"]), (False, None, True, []), (False, None, True, ["x"])]
    df = spark.createDataFrame(rows, "a boolean, e array<string>, i boolean, f array<string>")
    assert [r[0] for r in df.select(benchmark.answer_passes(F.col("a"), F.col("e"), F.col("i"), F.col("f"))).collect()] == [True, False, False, True, False]
    runs = spark.createDataFrame([(5.0, False), (9.0, True), (7.123, False)], "latency_ms double, failed boolean")
    assert tuple(benchmark.stability(runs).first()) == (3, 0.333333, 7.12) and tuple(benchmark.stability(runs.limit(0)).first()) == (0, None, None)


def test_job_verbs(spark):
    jobs = spark.createDataFrame([("a", "kb", "queued", None, None, 2), ("b", "kb", "leased", "w", None, 1), ("c", "kb", "succeeded", None, None, 1), ("d", "kb", "queued", None, "old", 1)], "job_key string, knowledge_base_id string, state string, lease_owner string, error string, created_at int")
    results = spark.createDataFrame([("a", None), ("b", "boom"), ("b", None), ("c", "late"), ("zz", None)], "job_key string, error string")
    got = {r.job_key: (r.state, r.error, r.lease_owner, r.refused) for r in sync.finish_jobs(jobs, results).collect()}
    assert got == {"a": ("succeeded", None, None, False), "b": ("failed", "boom", None, False), "c": ("succeeded", None, None, True), "d": ("queued", "old", None, False)}
    assert [(r.job_key, r.place) for r in sync.runnable_jobs(jobs, "kb").orderBy("place").collect()] == [("d", 1), ("a", 2)]
    docs = spark.createDataFrame([("d1", "kb", "p1", "v1", True), ("d2", "kb", "p2", None, True), ("d3", "kb", "p3", "v3", False), ("d4", "kb", "p4", None, True)], "document_id string, knowledge_base_id string, canonical_path string, active_version_id string, visible boolean")
    versions = spark.createDataFrame([("v1", "d1", "ready", "s1", 1), ("v1b", "d1", "failed", "s1b", 2), ("v2", "d2", "failed", "s2", 1), ("v3", "d3", "ready", "s3", 1)], "id string, document_id string, state string, sha256 string, created_at int")
    jobs = {r.document_id: r for r in sync.reindex_jobs(docs, versions).collect()}
    assert {d: (r.operation, r.sha256, r.again) for d, r in jobs.items()} == {"d1": ("reindex", "s1", False), "d2": ("add", "s2", True)}
    assert {r.document_id for r in sync.reindex_jobs(docs, versions, only_failed=True).collect()} == {"d1", "d2"}
    moved = sync.move_documents(docs, spark.createDataFrame([("d1", "q1"), ("d1", "q0")], "document_id string, path string"))
    assert {r.document_id: r.canonical_path for r in moved.collect()} == {"d1": "q1", "d2": "p2", "d3": "p3", "d4": "p4"}


def test_store_publishes_whole_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert store.write("t", df) == 2
    with pytest.raises(FileExistsError):
        store.write("t", df.limit(1), upon=0)
    with pytest.raises(ValueError):
        store.write("t", df, expected=3)
    assert store.read("t").count() == 2
    before = store.read("t")
    store.upsert("t", spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "id int, v string"), "id")
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a"), (2, "y"), (3, "z")} and before.count() == 2
