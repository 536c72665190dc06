"""Queries of evaluation sets, job and document upkeep and answer review, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import benchmark, claims, metrics, review, sync
from quillspark.plans import retrieval as R
from quillspark.sources.tables import table


def _cases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_cases")


def _audit(s, d) -> DataFrame:
    """The first hit of every question by BM25, relevant if its text holds the case's first evidence."""
    texts = table(s, d, "chunks").groupBy("id").agg(F.min("text").alias("text"))
    evidence = _cases(s, d).groupBy(F.col("id").alias("query_id")).agg(F.min("relevant_sources").alias("s")).select("query_id", F.get("s", F.lit(0))["evidence_text"].alias("evidence"))
    first = R._bm25(s, d, 1).join(texts, "id").join(evidence, "query_id")
    ranked = first.select(F.col("query_id").alias("id"), "rank", F.array(F.lit("fts")).alias("methods"), F.coalesce(F.contains("text", F.col("evidence")), F.lit(False)).alias("relevant"))
    return benchmark.leakage_audit(_cases(s, d), ranked)


def leakage_audit(s, d):
    return _audit(s, d).withColumn("rank1_methods", F.array_join("rank1_methods", ","))


def leakage_rates(s, d):
    return benchmark.audit_rates(_audit(s, d))


def rank1_methods(s, d):
    return benchmark.rank1_methods(_audit(s, d))


def leakage_gate(s, d):
    return benchmark.leakage_reasons(_cases(s, d)).select("id", F.array_join("reasons", ";").alias("reasons"))


def term_frequencies(s, d):
    return benchmark.term_frequencies(table(s, d, "documents"))


def low_overlap_terms(s, d):
    t = table(s, d, "documents")
    return benchmark.low_overlap_terms(t.withColumnRenamed("doc_id", "id"), benchmark.term_frequencies(t)).withColumnRenamed("id", "doc_id")


def key_terms(s, d):
    """Whether the two terms chosen for a document can be asked by."""
    t = table(s, d, "documents")
    return low_overlap_terms(s, d).join(t, "doc_id").select("doc_id", benchmark.valid_terms(F.col("first"), F.col("second"), F.col("text")).alias("valid"))


def candidate_cases(s, d):
    return benchmark.candidate_cases(R._active(s, d))


def candidate_quotas(s, d):
    """Active chunks as candidates of their content type, 40 of each, three of a document."""
    c = R._active(s, d).select("id", "document_id", F.col("content_type").alias("category"), F.col("chunk_index").alias("place")).filter("category is not null")
    return benchmark.with_quotas(c, c.select("category").distinct().withColumn("quota", F.lit(40)), 3)


def overall_gate(s, d):
    return benchmark.overall_gate(_cases(s, d), metrics.chunk_health(table(s, d, "chunks")), R.document_status(s, d)).withColumn("fails", F.array_join("fails", ";"))


def request_stability(s, d):
    """Requests as runs: how long one was under way, failed if it came without a query."""
    r = table(s, d, "search_requests").select("request_id", "query", "requested_at", "received_at").dropDuplicates(["request_id"])
    ms = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("requested_at").cast("timestamp"))) / 1000.0
    return benchmark.stability(r.select(ms.alias("latency_ms"), (F.trim(F.coalesce("query", F.lit(""))) == "").alias("failed")))


def answer_matches(s, d):
    """Each case's first evidence as the answer to it, against the expected one."""
    one = _cases(s, d).groupBy("id").agg(F.min("expected_answer").alias("expected"), F.min("answer_aliases").alias("aliases"), F.min("relevant_sources").alias("s")).withColumn("answer", F.coalesce(F.get("s", F.lit(0))["evidence_text"], F.lit(""))).filter("expected is not null")
    numeric = metrics.numeric_match(F.col("answer"), F.col("expected"))
    return one.select("id", metrics.exact_match(F.col("answer"), F.col("expected"), F.col("aliases")).alias("exact"), F.round(metrics.answer_f1("answer", "expected"), 6).alias("f1"), numeric.alias("n")).select("id", "exact", "f1", "n.*")


def _jobs(s, d) -> DataFrame:
    v = table(s, d, "document_versions").groupBy("id").agg(F.min("document_id").alias("document_id"), F.min("state").alias("v"), F.min("created_at").alias("created_at"))
    state = F.when(F.col("v") == "ready", "leased").when(F.col("v") == "failed", "succeeded").otherwise("queued")
    return v.select(F.col("id").alias("job_key"), F.substring("document_id", 1, 1).alias("knowledge_base_id"), state.alias("state"), F.when(state == "leased", "w").alias("lease_owner"), F.lit(None).cast("string").alias("error"), "created_at")


def runnable_jobs(s, d):
    return sync.runnable_jobs(_jobs(s, d)).select("job_key", "knowledge_base_id", "place")


def finished_jobs(s, d):
    jobs = _jobs(s, d)
    results = jobs.select("job_key", F.when(F.col("job_key") < "8", "no reader").alias("error"))
    return sync.finish_jobs(jobs, results).select("job_key", "state", "error", "lease_owner", "refused")


def reindex_jobs(s, d):
    return sync.reindex_jobs(R._docs(s, d), table(s, d, "document_versions"))


def retry_jobs(s, d):
    return sync.reindex_jobs(R._docs(s, d), table(s, d, "document_versions"), only_failed=True)


def moved_documents(s, d):
    docs = R._docs(s, d)
    return sync.move_documents(docs, docs.filter("canonical_path is not null").select("document_id", F.concat(F.lit("moved/"), "canonical_path").alias("path"))).select("document_id", "canonical_path")


def refreshed_versions(s, d):
    v = table(s, d, "document_versions").select("id", "size_bytes", "mtime_ns").dropDuplicates(["id"])
    return sync.refresh_fingerprints(v, v.filter("size_bytes > 0").select("id", (F.col("size_bytes") + 1).alias("size_bytes"), (F.col("mtime_ns") + 1).alias("mtime_ns")))


def parsed_versions(s, d):
    v = table(s, d, "document_versions").select("id", "parser_version", "layout_version", "document_type", "document_structure_tree", "state").dropDuplicates(["id"])
    parsed = v.filter("state = 'ready'").select("id", F.lit("9").alias("parser_version"), F.lit(None).cast("string").alias("layout_version"), "document_type", F.lit("[]").alias("document_structure_tree"))
    return sync.store_parsed(v, parsed).select("id", "parser_version", "layout_version", "document_type", "document_structure_tree")


def document_outlines(s, d):
    items = review.outline(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.posexplode(items).alias("at", "x")).select("doc_id", "x.number", "x.title")


def document_claims(s, d):
    """The claims of every document's text, as if it were an answer."""
    rows = table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("draft"))
    return claims.claims(rows).groupBy(F.col("query_id").alias("doc_id")).agg(F.count("*").alias("claims"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "claim"))), lambda x: x["claim"]), "\n")).alias("md5"))


def content_terms(s, d):
    return table(s, d, "search_requests").select("request_id", "query").distinct().select("request_id", F.explode(claims.content_terms(F.col("query"))).alias("term"))



QUERIES = {
    f.__name__: f
    for f in (
        leakage_audit, leakage_rates, rank1_methods, leakage_gate, term_frequencies, low_overlap_terms, key_terms, candidate_cases, candidate_quotas, overall_gate, request_stability, answer_matches,
        runnable_jobs, finished_jobs, reindex_jobs, retry_jobs, moved_documents, refreshed_versions, parsed_versions, document_outlines, document_claims, content_terms,
    )
}

_P = "regexp_replace(lower({0}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"
_PAIRS = "CASE WHEN len({0}) = 1 THEN [{0}] ELSE list_distinct(list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i:i + 1])) END"
_COV = f"round(CASE WHEN len({{0}}) = 0 THEN 0 ELSE len(list_intersect({_PAIRS.format('{0}')}, {_PAIRS.format('{1}')})) / len({_PAIRS.format('{0}')}) END, 6)"
_ONE = f"""
    one AS (SELECT id, min(question) AS question, min(category) AS category, min(relevant_sources)[1] AS s FROM eval_cases GROUP BY id),
    n AS (SELECT id, category, question, coalesce(s.evidence_text, '') AS text, {_P.format('question')} AS q, {_P.format("trim(regexp_extract(question, '[“\"]([^”\"]+)[”\"]', 1))")} AS p,
          {_P.format("coalesce(s.evidence_text, '')")} AS e, coalesce({_P.format("string_split(replace(s.document_path, chr(92), '/'), '/')[-1]")}, '') AS f FROM one),
    starts AS (SELECT id, q, e, unnest(generate_series(1, len(q))) AS i FROM n),
    runs AS (SELECT id, max(k) AS run FROM (SELECT id, q, e, i, unnest(generate_series(1, len(q) - i + 1)) AS k FROM starts) WHERE contains(e, q[i:i + k - 1]) GROUP BY id)"""
_AUDIT = f"""{_ONE},
    b AS ({R.SQL['bm25_search'].replace('rank <= 10', 'rank <= 1')}),
    k AS (SELECT id, min(text) AS text FROM chunks GROUP BY id),
    hit AS (SELECT b.query_id AS id, 'fts' AS rank1_methods, coalesce(contains(k.text, one.s.evidence_text), false) AS rank1_relevant FROM b JOIN k USING (id) JOIN one ON one.id = b.query_id),
    a AS (SELECT n.id, coalesce(category, 'unknown') AS category, len(p) > 0 AND contains(e, p) AS direct, len(f) > 0 AND contains(q, f) AS file_named, {_COV.format('p', 'e')} AS payload_coverage, {_COV.format('q', 'e')} AS question_coverage,
          coalesce(run, 0) AS longest_run, rank1_methods, coalesce(rank1_relevant, false) AS rank1_relevant FROM n LEFT JOIN runs USING (id) LEFT JOIN hit USING (id)),
    audit AS (SELECT *, direct OR file_named OR payload_coverage >= 0.8 OR question_coverage >= 0.65 OR longest_run >= 12 AS shortcut FROM a)"""
_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_LEAK = f"""
    o AS (SELECT id, min(question) AS question, any_value(relevant_sources) AS s FROM eval_cases GROUP BY id),
    t AS (SELECT id, question, s, {_BARE.format('question')} AS q, {_BARE.format("array_to_string(list_transform(s, lambda x: x.evidence_text), chr(10))")} AS e FROM o),
    st AS (SELECT id, q, e, unnest(generate_series(1, len(q))) AS i FROM t),
    ru AS (SELECT id, max(k) AS run FROM (SELECT id, q, e, i, unnest(generate_series(1, len(q) - i + 1)) AS k FROM st) WHERE contains(e, q[i:i + k - 1]) GROUP BY id),
    cv AS (SELECT t.id, round(CASE WHEN len(q) < 2 THEN 0 ELSE len(list_intersect(list_distinct(list_transform(generate_series(1, len(q) - 1), lambda i: q[i:i + 1])), list_distinct(list_transform(generate_series(1, len(e) - 1), lambda i: e[i:i + 1]))))
           / len(list_distinct(list_transform(generate_series(1, len(q) - 1), lambda i: q[i:i + 1]))) END, 6) AS coverage, coalesce(run, 0) AS run,
           list_bool_or(list_transform(s, lambda x: contains(lower(question), lower(regexp_replace(string_split(x.document_path, '/')[-1], '[.][^.]+$', ''))))) AS file_named FROM t LEFT JOIN ru USING (id)),
    leak AS (SELECT *, coverage >= 0.65 OR run >= 12 OR coalesce(file_named, false) AS leaks FROM cv)"""
_COMMON = "(" + ", ".join(f"'{w}'" for w in benchmark.COMMON) + ")"
_GRAMS = "flatten(list_transform({0}, lambda r: flatten(list_transform([4, 3, 2], lambda n: CASE WHEN len(r) >= n THEN list_transform(generate_series(1, len(r) - n + 1), lambda i: r[i:i + n - 1]) ELSE [] END))))"
_TERMS = f"""
    c AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format("regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{2,}')")}) AS term FROM documents), cand AS (SELECT * FROM c WHERE term NOT IN {_COMMON}),
    h AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format("regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '', 'g'), '[\\x{4e00}-\\x{9fff}]{2,}')")}) AS term FROM documents),
    freq AS (SELECT term, count(*) AS documents FROM h WHERE term IN (SELECT term FROM cand) GROUP BY 1),
    few AS (SELECT c.doc_id, term, {{'a': documents = 1, 'b': abs(documents - 3), 'c': -len(term), 'd': term}} AS o FROM cand c JOIN freq USING (term) WHERE documents <= 8),
    f1 AS (SELECT doc_id, arg_min(term, o) AS first FROM few GROUP BY 1),
    f2 AS (SELECT doc_id, first, arg_min(term, o) AS second FROM few JOIN f1 USING (doc_id) WHERE NOT contains(first, term) AND NOT contains(term, first) GROUP BY 1, 2)"""
_JOBS = """j AS (SELECT id AS job_key, left(min(document_id), 1) AS kb, CASE min(state) WHEN 'ready' THEN 'leased' WHEN 'failed' THEN 'succeeded' ELSE 'queued' END AS state, min(created_at) AS created_at FROM document_versions GROUP BY id)"""
_REINDEX = f"""WITH {R._DOCS}, sel AS (SELECT d.document_id, d.knowledge_base_id AS kb, d.canonical_path AS path, a.id IS NOT NULL AS has, coalesce(a.id, l.id) AS version_id, coalesce(a.sha256, l.sha256) AS sha256, coalesce(a.state, l.state) AS st, l.state AS newest
        FROM docs d JOIN latest l USING (document_id) LEFT JOIN (SELECT DISTINCT ON (id) * FROM document_versions) a ON a.id = d.active_version_id WHERE d.visible),
    keyed AS (SELECT *, CASE WHEN has THEN 'reindex' ELSE 'add' END AS operation, sha256(concat_ws(chr(31), kb, upper(CASE WHEN has THEN 'reindex' ELSE 'add' END), path, coalesce(sha256, ''))) AS k FROM sel)
    SELECT CASE WHEN has THEN sha256(k || chr(31) || version_id) ELSE k END AS job_key, document_id, operation, path, sha256, version_id, st = 'failed' AS again FROM keyed"""
_MEAN = "round(avg({0}::DOUBLE), 6) AS {0}"

SQL = {
    "leakage_audit": f"WITH {_AUDIT} SELECT * FROM audit",
    "leakage_rates": f"WITH {_AUDIT} SELECT category, count(*) AS cases, {', '.join(_MEAN.format(c) for c in ('direct', 'file_named', 'payload_coverage', 'question_coverage', 'rank1_relevant', 'shortcut'))}, max(longest_run) AS longest_run, CASE WHEN round(avg(shortcut::DOUBLE), 6) >= 0.5 THEN 'LEAKAGE_CONFIRMED' ELSE 'NO_MATERIAL_LEAKAGE_FOUND' END AS verdict FROM audit GROUP BY ROLLUP (category)",
    "rank1_methods": f"WITH {_AUDIT} SELECT rank1_methods AS method, count(*) AS cases FROM audit WHERE rank1_methods IS NOT NULL GROUP BY 1",
    "leakage_gate": rf"""WITH {_ONE}, x AS (SELECT n.*, coalesce(run, 0) AS run, {_COV.format('q', 'e')} AS share,
            list_sort(list_filter(list_intersect(list_distinct(regexp_extract_all(question, '\d+(?:\.\d+)?')), list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?'))), lambda v: NOT regexp_full_match(v, '20\d{{2}}'))) AS told FROM n LEFT JOIN runs USING (id))
        SELECT id, concat_ws(';', CASE WHEN len(question) NOT BETWEEN 8 AND 100 THEN 'question_length_out_of_range' END, CASE WHEN len(regexp_replace(question, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) < 4 THEN 'insufficient_chinese_question_text' END,
            CASE WHEN len(f) > 0 AND contains(q, f) THEN 'contains_target_filename' END, CASE WHEN run >= 12 THEN 'longest_common_substring=' || run END, CASE WHEN share >= 0.65 THEN 'bigram_coverage=' || printf('%.3f', share) END,
            CASE WHEN regexp_matches(question, '[“”"]') THEN 'contains_quotation' END, CASE WHEN category = 'numeric_parameter' AND len(told) > 0 THEN 'contains_answer_number=' || array_to_string(told, ',') END) AS reasons FROM x""",
    "term_frequencies": f"WITH {_TERMS} SELECT term, documents FROM freq",
    "low_overlap_terms": f"WITH {_TERMS} SELECT doc_id, first, second FROM f2",
    "key_terms": rf"WITH {_TERMS} SELECT doc_id, regexp_full_match(first, '[\x{{4e00}}-\x{{9fff}}]{{2,6}}') AND regexp_full_match(second, '[\x{{4e00}}-\x{{9fff}}]{{2,6}}') AND contains(text, first) AND contains(text, second) AND first NOT IN {_COMMON} AND second NOT IN {_COMMON} AS valid FROM f2 JOIN documents USING (doc_id)",
    "candidate_cases": rf"""WITH {R._DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY knowledge_base_id ORDER BY canonical_path NULLS FIRST, chunk_index, id) AS n, trim(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g'))[:180] AS e FROM active)
        SELECT knowledge_base_id, printf('candidate-%04d', n) AS id, 'Locate the source containing this excerpt: ' || e[:60] AS question, e AS expected_answer, document_id, r.id AS chunk_id FROM r WHERE n <= 120""",
    "candidate_quotas": f"""WITH {R._DOCS}, p AS (SELECT id, document_id, content_type AS category, chunk_index AS place FROM active WHERE content_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_type, document_id ORDER BY chunk_index, id) <= 3),
        q AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY place, id) AS n FROM p QUALIFY n <= 40) SELECT *, count(*) OVER (PARTITION BY category) >= 40 AS enough FROM q""",
    "overall_gate": f"""WITH {R._DOCS}, c AS (SELECT id, bool_or(coalesce(validated, false)) AS v FROM eval_cases GROUP BY id), n AS (SELECT count(*) AS cases, count(*) FILTER (v) AS validated FROM c),
        h AS (SELECT round(count(*) FILTER (token_count > 800) / count(*), 6) AS long_rate FROM chunk), f AS (SELECT count(*) FILTER (state = 'failed') AS failed FROM status WHERE visible)
        SELECT cases, validated, long_rate, failed, concat_ws(';', CASE WHEN validated = 0 THEN 'no validated cases' END, CASE WHEN long_rate > 0.1 THEN 'more than 10 % of the chunks exceed 800 tokens' END, CASE WHEN failed > 0 THEN 'a visible document failed' END) AS fails FROM n, h, f""",
    "request_stability": """WITH r AS (SELECT DISTINCT ON (request_id) trim(coalesce(query, '')) = '' AS bad, (epoch_us(received_at) - epoch_us(requested_at)) / 1000.0 AS ms FROM search_requests)
        SELECT count(*) AS completed, round(count(*) FILTER (bad) / count(*), 6) AS failure_rate, round(max(ms) FILTER (NOT bad), 2) AS most_ms FROM r""",
    "runnable_jobs": f"WITH {_JOBS} SELECT job_key, kb AS knowledge_base_id, row_number() OVER (PARTITION BY kb ORDER BY created_at NULLS FIRST, job_key) AS place FROM j WHERE state = 'queued'",
    "finished_jobs": f"""WITH {_JOBS} SELECT job_key, CASE WHEN state = 'succeeded' THEN state WHEN job_key < '8' THEN 'failed' ELSE 'succeeded' END AS state, CASE WHEN state <> 'succeeded' AND job_key < '8' THEN 'no reader' END AS error,
        NULL::VARCHAR AS lease_owner, state = 'succeeded' AS refused FROM j""",
    "reindex_jobs": _REINDEX,
    "retry_jobs": f"{_REINDEX} WHERE newest = 'failed'",
    "moved_documents": f"WITH {R._DOCS} SELECT document_id, 'moved/' || canonical_path AS canonical_path FROM docs",
    "refreshed_versions": "SELECT DISTINCT id, CASE WHEN size_bytes > 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN size_bytes > 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns FROM document_versions",
    "parsed_versions": """SELECT DISTINCT id, CASE WHEN state = 'ready' THEN '9' ELSE parser_version END AS parser_version, CASE WHEN state = 'ready' THEN NULL ELSE layout_version END AS layout_version, document_type,
        CASE WHEN state = 'ready' THEN '[]' ELSE document_structure_tree END AS document_structure_tree FROM document_versions""",
    "content_terms": rf"""WITH q AS (SELECT DISTINCT request_id, query FROM search_requests), r AS (SELECT request_id, list_filter(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9_.-]*'), lambda x: len(x) > 1) AS w, regexp_extract_all(query, '[\x{{4e00}}-\x{{9fff}}]+') AS h FROM q),
        t AS (SELECT request_id, unnest(list_distinct(list_concat(w, flatten(list_transform(h, lambda r: CASE WHEN len(r) > 1 THEN list_transform(generate_series(1, len(r) - 1), lambda i: r[i:i + 1]) ELSE [] END))))) AS term FROM r)
        SELECT request_id, term FROM t WHERE term NOT IN ({', '.join(f"'{w}'" for w in claims.STOP)})""",
    "question_leakage": f"WITH {_LEAK} SELECT id, coverage, run, file_named, leaks FROM leak",
    "leakage_summary": f"""WITH {_LEAK}, s AS (SELECT count(*) AS cases, round(avg(coverage), 6) AS mean_coverage, max(coverage) AS most_coverage, round(avg(run), 6) AS mean_run, round(avg(leaks::INT), 6) AS shortcut_rate FROM leak)
        SELECT *, CASE WHEN shortcut_rate >= 0.5 THEN 'LEAKAGE_CONFIRMED' ELSE 'NO_LEAKAGE_CONFIRMED' END AS verdict FROM s""",
    "ranking_metrics": f"""WITH {R._DOCS}, b AS ({R.SQL['bm25_search'].replace('rank <= 10', 'rank <= 15')}),
        cs AS (SELECT id AS query_id, coalesce(max(validated), false) AS validated, min(category) AS category, min(relevant_sources) AS s FROM eval_cases GROUP BY id),
        w AS (SELECT chunk.id, v.document_id, docs.canonical_path AS path FROM chunk LEFT JOIN (SELECT DISTINCT id, document_id FROM document_versions) v ON v.id = chunk.document_version_id LEFT JOIN docs ON docs.document_id = v.document_id),
        r AS (SELECT b.query_id, b.rank, len(list_filter(s, lambda x: coalesce(x.chunk_id <> '' AND x.chunk_id = w.id, false) OR coalesce(x.document_id <> '' AND x.document_id = w.document_id, false)
              OR coalesce(x.document_path <> '' AND suffix(replace(w.path, chr(92), '/'), replace(x.document_path, chr(92), '/')), false))) > 0 AS hit FROM b JOIN cs USING (query_id) LEFT JOIN w ON w.id = b.id),
        k AS (SELECT unnest([1, 3, 5, 10, 15]) AS k),
        q AS (SELECT query_id, validated, category, coalesce(len(s), 0) AS total, k FROM cs, k),
        g AS (SELECT q.query_id, validated, category, total, q.k, count(*) FILTER (hit) AS found, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1.0)) FILTER (hit), 0) AS gain FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.rank <= q.k GROUP BY ALL),
        m AS (SELECT *, CASE WHEN total > 0 THEN list_sum(list_transform(generate_series(1, least(total, k)), lambda i: 1 / log2(i + 1.0))) END AS ideal FROM g)
        SELECT validated, category, k, count(*) AS cases, round(avg((found > 0)::INT), 6) AS hit, round(avg(CASE WHEN total > 0 THEN found / total ELSE 0 END), 6) AS recall, round(avg(found / k), 6) AS precision, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(gain / ideal, 0)), 6) AS ndcg
        FROM m GROUP BY 1, 2, 3""",
}
