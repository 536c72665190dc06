"""Queries of the retrieval engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.words import TOKEN_RE2, token_count
from quillspark.operators import answers, catalog, context, evalset, metrics, packer, search, sync, tables_qa, terms
from quillspark.session import cut_lineage
from quillspark.sources.tables import table

STEP = 100  # of the queries, those whose id is divisible by this ask all rows


def _docs(s: SparkSession, d: str) -> DataFrame:
    return catalog.documents(table(s, d, "document_versions"), table(s, d, "vector_records"))


def _active(s: SparkSession, d: str) -> DataFrame:
    return catalog.active_chunks(table(s, d, "chunks"), _docs(s, d))


def active_chunks(s, d):
    return _active(s, d).select("id", "document_id", "knowledge_base_id", "canonical_path", "chunk_index")


def document_status(s, d):
    return catalog.document_status(_docs(s, d), table(s, d, "document_versions"), table(s, d, "chunks"))


def status_summary(s, d):
    return catalog.status_summary(document_status(s, d))


def status_histogram(s, d):
    return catalog.status_histogram(document_status(s, d))


def latest_versions(s, d):
    return catalog.latest_versions(table(s, d, "document_versions")).select("id", "document_id", "state")


def index_consistency(s, d):
    return catalog.index_consistency(table(s, d, "chunks"), table(s, d, "vector_records"), table(s, d, "document_versions"))


def normalized_documents(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("text_md5"), token_count(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("sha256"))


def document_keys(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", X.file_name(F.col("canonical_path")).alias("file_name"), X.suffix(F.col("canonical_path")).alias("suffix"), F.md5(X.text_key(F.col("text"))).alias("key_md5"), sync.supported(F.col("canonical_path")).alias("supported"), catalog.under_path(F.col("canonical_path"), "corpus/contracts").alias("is_contract"))


def unique_paragraphs(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(X.unique_paragraphs(F.col("text"))).alias("text_md5"))


def document_windows(s, d):
    return packer.windows(table(s, d, "documents")).select("doc_id", "chunk_index", "token_count", "text_hash")


def packed_chunks(s, d):
    return packer.pack_blocks(table(s, d, "layout_blocks"))


def chunk_health(s, d):
    return metrics.chunk_health(table(s, d, "chunks"))


def token_distribution(s, d):
    return metrics.index_percentiles(table(s, d, "chunks").dropDuplicates(["id"]), "token_count")


def request_latency(s, d):
    r = table(s, d, "search_requests").dropDuplicates(["request_id"])
    ms = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("requested_at").cast("timestamp"))) / 1000.0
    return metrics.latency_percentiles(r, ms, ["knowledge_base_id"])


def _requests(s, d) -> DataFrame:
    r = table(s, d, "search_requests").dropDuplicates(["request_id"]).filter(F.col("request_id") % STEP == 0)
    return r.select(F.col("request_id").alias("query_id"), "knowledge_base_id", "query", "allowed_document_ids", "top_k").filter("trim(query) != ''")


def _cases(s, d) -> DataFrame:
    return table(s, d, "eval_cases").groupBy("id").agg(F.min("question").alias("query")).withColumnRenamed("id", "query_id")


def _indexed(s, d) -> DataFrame:
    places = _docs(s, d).join(table(s, d, "document_versions").select("document_id", F.col("id").alias("document_version_id")).distinct(), "document_id")
    c = table(s, d, "chunks").dropDuplicates(["id"]).join(places.select("document_version_id", "canonical_path"), "document_version_id")
    return c.select("id", search.indexed_text(c).alias("indexed"))


def _bm25(s, d, k: int) -> DataFrame:
    asked = _cases(s, d).withColumn("fts", terms.parse("query")["fts"])
    texts = table(s, d, "chunks").dropDuplicates(["id"]).select("id", F.col("text").alias("indexed"))
    return search.bm25_hits(asked, texts, k).select("query_id", "id", "rank", "score")


def bm25_search(s, d):
    """The ten best chunks for every held-out question."""
    return _bm25(s, d, 10)


def contains_search(s, d):
    """The ten chunks that hold most of a held-out question's distinct ASCII words of two characters or more, each word worth 20."""
    asked = _cases(s, d).withColumn("weighted", terms.parse("query")["weighted"])
    hits = search.contains_hits(asked, table(s, d, "chunks").dropDuplicates(["id"]), 10)
    return hits.select("query_id", "id", "rank", "score")


def field_search(s, d):
    words = s.createDataFrame([(1, "gearbox"), (2, "Pump"), (3, "50 %"), (4, "阀门")], "query_id int, field string")
    bases = table(s, d, "knowledge_bases").select(F.col("id").alias("knowledge_base_id")).distinct()
    fields = words.join(F.broadcast(bases))
    return search.field_search(fields, _active(s, d), most=None).select("query_id", "document_id", "matched_chunks", "occurrences", F.col("page_no").cast("string").alias("page"), "section")


def _near_vectors(s, d, *filters: str) -> DataFrame:
    """The ten nearest vectors of every STEP-th one, among those that agree with it in the filters."""
    e = table(s, d, "embeddings")
    asked = e.filter(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), *filters)
    return search.vector_hits(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *filters), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def vector_search(s, d):
    return _near_vectors(s, d)


def vector_search_filtered(s, d):
    """The vectors of the query's label only, as a payload filter does."""
    return _near_vectors(s, d, "label")


def fused_ranks(s, d):
    """Two rankings of the nearest vectors, by similarity and by id, fused."""
    near = vector_search(s, d)
    by_id = search.top(near.drop("rank"), 10, F.col("id"))
    return search.fuse({"vector": near, "id": by_id}).select("query_id", "id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


def _hits(s, d, requests: DataFrame) -> DataFrame:
    r = table(s, d, "vector_records").select("id", "vector", F.col("payload.knowledge_base_id").alias("knowledge_base_id")).filter("vector is not null and knowledge_base_id is not null").dropDuplicates(["id"])
    # The stored vectors come from a model that isn't here; texts and queries get the hash embedding.
    columns = ("id", "document_version_id", "document_id", "knowledge_base_id", "canonical_path", "chunk_index", "section_path", "content_type", "token_count", "page_no", "text")
    embedded = cut_lineage(_active(s, d).select(*columns))
    v = embedded.select("id", X.embed(search.indexed_text(embedded)).alias("vector"), "knowledge_base_id", "document_id").join(r.select("id"), "id", "left_semi")
    q = requests.withColumn("vector", X.embed("query"))
    return search.search(q, embedded, _indexed(s, d), v)


def hybrid_search(s, d):
    return _hits(s, d, _requests(s, d))


def hash_embeddings(s, d):
    v = X.hash_embedding(F.col("query"))
    return table(s, d, "search_requests").select("request_id", "query").distinct().select("request_id", F.posexplode(v).alias("i", "x")).select("request_id", "i", F.round("x", 6).alias("x"))


def _anchors(s, d) -> DataFrame:
    """Every active chunk."""
    return _active(s, d).select(F.col("id").alias("anchor_id"), "document_version_id", "chunk_index", "section_path")


def context_windows(s, d):
    return context.neighbours(_anchors(s, d), _active(s, d), 3).select("anchor_id", "id", "chunk_index")


def context_segments(s, d):
    """The segment around every active chunk, each chunk being the only hit of a query of its own."""
    near = context.neighbours(_anchors(s, d), _active(s, d), 3)
    return context.segments(near, ["anchor_id"]).select("document_version_id", "first_index", "last_index", "chunks", F.md5("text").alias("text_md5"))


def _cells(s, d) -> DataFrame:
    return tables_qa.table_cells(table(s, d, "chunks"), "id", "table_markdown")


def table_cells(s, d):
    return _cells(s, d)


def table_columns(s, d):
    return tables_qa.column_summary(_cells(s, d)).withColumn("total", F.round("total", 4))


def pivot_states(s, d):
    rows = table(s, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    wide = tables_qa.pivot(rows, "user_id", "event_type", "value", ["click", "error"])
    return tables_qa.unpivot(wide, ["user_id"], ["click", "error"], "event_type", "value").withColumn("value", F.round("value", 4))


def _snapshots(s, d) -> tuple[DataFrame, DataFrame]:
    """Documents as known before and as seen in the files: by even and odd ids, with some paths and contents changed."""
    t = table(s, d, "documents").filter("canonical_path is not null")
    one = t.groupBy("canonical_path").agg(F.min(F.struct("doc_id", "text")).alias("x")).select(F.col("canonical_path").alias("path"), "x.doc_id", F.length("x.text").cast("long").alias("size_bytes"), F.sha2("x.text", 256).alias("sha256"))
    known = one.filter("doc_id % 7 != 0").select("path", F.col("doc_id").cast("string").alias("document_id"), "size_bytes", F.col("doc_id").alias("mtime_ns"), "sha256", (F.col("doc_id") % 5 == 0).alias("failed"), F.when(F.col("doc_id") % 5 != 0, F.col("sha256")).alias("active_sha256"))
    moved = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    touched = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    seen = one.filter("doc_id % 17 != 0").select(moved.alias("path"), "size_bytes", touched.alias("mtime_ns"), changed.alias("sha256"))
    return known, seen


def reconcile(s, d):
    return sync.reconcile(*_snapshots(s, d))


def job_queue(s, d):
    events = reconcile(s, d).filter("event in ('add', 'update', 'move', 'delete')")
    key = sync.job_key(F.lit("kb"), F.col("event"), F.col("path"), F.lit(None).cast("string"))
    new = events.select(key.alias("job_key"), F.col("event").alias("operation"), "path")
    old = new.filter("operation in ('add', 'update')").withColumns({"state": F.when(F.col("operation") == "add", "failed").otherwise("leased"), "attempts": F.lit(1), "error": F.lit("x")})
    return sync.upsert_jobs(old, new).select("job_key", "operation", "state", "attempts", "error")


def question_leakage(s, d):
    return metrics.question_leakage(table(s, d, "eval_cases"))


def question_coverage(s, d):
    return question_leakage(s, d).select("id", "coverage")


def leakage_summary(s, d):
    return metrics.leakage_summary(question_leakage(s, d))


def ranking_metrics(s, d):
    """The BM25 ranking of all held-out questions, as deep as the deepest cut, by validated and category; a chunk is
    relevant if it matches a source of the case. A case without hits counts with nothing found."""
    cases = table(s, d, "eval_cases").groupBy(F.col("id").alias("query_id")).agg(F.coalesce(F.max("validated"), F.lit(False)).alias("validated"), F.min("category").alias("category"), F.min("relevant_sources").alias("sources"))
    versions = table(s, d, "document_versions").select(F.col("id").alias("document_version_id"), "document_id").distinct()
    chunks = table(s, d, "chunks").dropDuplicates(["id"]).select("id", "document_version_id").join(versions, "document_version_id", "left").join(_docs(s, d).select("document_id", "canonical_path"), "document_id", "left")
    hits = _bm25(s, d, max(metrics.CUTS)).join(chunks, "id", "left").join(cases.select("query_id", "sources"), "query_id")
    hits = hits.withColumn("hit", metrics.source_matches(F.col("sources"), F.col("id"), F.col("document_id"), F.col("canonical_path")))
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hit"))).alias("h"))
    relevance = F.coalesce(F.transform("h", lambda x: x["hit"]), F.array().cast("array<boolean>"))
    rows = cases.join(hits, "query_id", "left").select("validated", "category", relevance.alias("relevance"), F.coalesce(F.size("sources"), F.lit(0)).alias("total"))
    return metrics.ranking_metrics(rows, ["validated", "category"])


def document_segments(s, d):
    return evalset.segments(table(s, d, "documents")).select("doc_id", F.md5("key").alias("key_md5"))


def unique_segments(s, d):
    return evalset.unique_segments(evalset.segments(table(s, d, "documents"))).select("doc_id", F.md5("key").alias("key_md5"))


def answered_requests(s, d):
    """Answers take their own number of hits: a request's top_k is for its search only."""
    requests = _requests(s, d).drop("top_k")
    return answers.answer(requests, _hits(s, d, requests), _active(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        active_chunks, document_status, status_summary, status_histogram, latest_versions, index_consistency, normalized_documents, document_keys, unique_paragraphs, document_windows,
        packed_chunks, chunk_health, token_distribution, request_latency, bm25_search, contains_search, field_search, vector_search, vector_search_filtered, fused_ranks, hybrid_search, hash_embeddings, context_windows,
        context_segments, table_cells, table_columns, pivot_states, reconcile, job_queue, question_leakage, question_coverage, leakage_summary, ranking_metrics, document_segments, unique_segments, answered_requests,
    )
}

_LATEST = "row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1"
_DOCS = f"""
    latest AS (SELECT DISTINCT * FROM (SELECT * FROM document_versions QUALIFY {_LATEST})),
    ready AS (SELECT document_id, id AS active_version_id FROM (SELECT * FROM document_versions WHERE state = 'ready' QUALIFY {_LATEST})),
    place AS (SELECT payload.document_id AS document_id, min({{'c': payload.canonical_path, 'k': payload.knowledge_base_id}}) AS p FROM vector_records WHERE payload.document_id IS NOT NULL GROUP BY 1),
    docs AS (SELECT l.document_id, p.k AS knowledge_base_id, p.c AS canonical_path, active_version_id, l.state <> 'deleted' AS visible, l.state
             FROM latest l LEFT JOIN ready USING (document_id) LEFT JOIN place USING (document_id)),
    chunk AS (SELECT DISTINCT ON (id) * FROM chunks),
    active AS (SELECT c.*, d.document_id, d.knowledge_base_id, d.canonical_path FROM chunk c JOIN docs d ON c.document_version_id = d.active_version_id AND d.visible),
    status AS (SELECT document_id, knowledge_base_id, visible, state, coalesce(n, 0) AS chunk_count FROM docs LEFT JOIN (SELECT document_version_id, count(*) AS n FROM chunk GROUP BY 1) c ON c.document_version_id = active_version_id)"""
_NL = r"regexp_replace(%s, '[\s\p{Z}]+', ' ', 'g')"
_NORMAL = f"array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim({_NL % 'x'})), lambda x: x <> ''), chr(10))"
_WORDS = "list_filter(words, lambda x, i: list_position(words, x) = i)"
_UNIQUE = r"""
    parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
    keyed AS (SELECT doc_id, p, list_transform(p, lambda x: regexp_replace(x, '\s+', '', 'g')) AS k FROM parts),
    uniq AS (SELECT doc_id, array_to_string(list_filter(p, lambda x, i: list_position(k, k[i]) = i), chr(10) || chr(10)) AS text FROM keyed)"""
_VECTORS = """
    v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON {on} WHERE a.vec_id % 100 = 0),
    near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank, round(c, 6) AS score FROM v QUALIFY rank <= 10)"""
_NEAR = """
    near AS (SELECT a.id AS anchor_id, a.chunk_index AS anchor_index, c.id, c.document_version_id, c.chunk_index, c.text FROM active a JOIN active c
             ON c.document_version_id = a.document_version_id AND abs(c.chunk_index - a.chunk_index) <= 3 AND (coalesce(len(a.section_path), 0) = 0 OR a.section_path IS NOT DISTINCT FROM c.section_path)
             QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(c.chunk_index - a.chunk_index), c.chunk_index, c.id) <= 12)"""
_CELLS = r"""
    ids AS (SELECT id, any_value(table_markdown) AS t FROM chunks WHERE table_markdown IS NOT NULL GROUP BY id),
    line AS (SELECT id, unnest(list_transform(string_split(t, chr(10)), lambda x, i: {'n': i, 'l': trim(x)})) AS x FROM ids),
    flag AS (SELECT id, x.n, x.l, x.l LIKE '|%|' AND len(x.l) - len(replace(x.l, '|', '')) >= 3 AS is_row, regexp_matches(x.l, '^\|(\s*:?-{3,}:?\s*\|)+$') AS rule FROM line),
    heads AS (SELECT *, is_row AND NOT rule AND coalesce(lead(rule) OVER (PARTITION BY id ORDER BY n), false) AS head FROM flag),
    nos AS (SELECT *, sum(head::INT) OVER w AS table_no, sum((NOT is_row)::INT) OVER w AS gap FROM heads WINDOW w AS (PARTITION BY id ORDER BY n)),
    tab AS (SELECT *, first(gap) OVER w AS g, list_transform(string_split(trim(first(l) OVER w, '|'), '|'), lambda c: trim(c)) AS headers FROM nos WHERE table_no > 0 WINDOW w AS (PARTITION BY id, table_no ORDER BY n)),
    body AS (SELECT id, table_no, n, headers, list_transform(string_split(trim(l, '|'), '|'), lambda c: trim(c)) AS cells FROM tab WHERE is_row AND NOT head AND NOT rule AND gap = g),
    num AS (SELECT *, row_number() OVER (PARTITION BY id, table_no ORDER BY n) AS row FROM body WHERE len(cells) = len(headers)),
    cell AS (SELECT id AS key, table_no, row, i - 1 AS "column", headers[i] AS header, cells[i] AS value FROM (SELECT *, unnest(generate_series(1, len(cells))) AS i FROM num))"""
_SNAP = """
    f AS (SELECT canonical_path AS path, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents WHERE canonical_path IS NOT NULL GROUP BY 1),
    one AS (SELECT path, doc_id, length(text) AS size_bytes, sha256(text) AS sha FROM f),
    known AS (SELECT path, doc_id::VARCHAR AS document_id, size_bytes, doc_id AS mtime, sha, doc_id % 5 = 0 AS failed, CASE WHEN doc_id % 5 <> 0 THEN sha END AS active FROM one WHERE doc_id % 7 <> 0),
    seen AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'moved/' || path ELSE path END AS path, size_bytes, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END AS mtime, CASE WHEN doc_id % 11 = 0 THEN sha256(sha) ELSE sha END AS sha FROM one WHERE doc_id % 17 <> 0),
    here AS (SELECT s.path, CASE WHEN (s.size_bytes = k.size_bytes AND s.mtime = k.mtime) OR coalesce(s.sha = k.active, false) OR (s.sha = k.sha AND k.failed) THEN 'unchanged' ELSE 'update' END AS event, NULL::VARCHAR AS old_path, document_id FROM seen s JOIN known k USING (path)),
    new AS (SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM seen ANTI JOIN known USING (path)),
    gone AS (SELECT * FROM known ANTI JOIN seen USING (path)),
    old AS (SELECT active AS sha, row_number() OVER (PARTITION BY active ORDER BY path) AS n, path AS old_path, document_id FROM gone WHERE active IS NOT NULL),
    added AS (SELECT path, CASE WHEN old_path IS NULL THEN 'add' ELSE 'move' END AS event, old_path, document_id FROM new LEFT JOIN old USING (sha, n)),
    ev AS (SELECT * FROM here UNION ALL SELECT * FROM added UNION ALL SELECT path, 'delete', NULL, document_id FROM gone WHERE path NOT IN (SELECT old_path FROM added WHERE old_path IS NOT NULL))"""
_SEGMENTS = r"""
    p AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?。！？])\s+|\n+', '\1' || chr(31), 'g'), chr(31)))) AS segment FROM documents),
    k AS (SELECT doc_id, segment, regexp_replace(lower(segment), '[^\p{L}\p{N}]+', '', 'g') AS key FROM p),
    seg AS (SELECT DISTINCT doc_id, key FROM k WHERE len(key) BETWEEN 18 AND 180 AND len(key) >= 0.68 * len(segment))"""
_CASES = "c AS (SELECT id AS query_id, list_filter(regexp_extract_all(min(question), '[A-Za-z0-9_]+'), lambda x: len(x) >= 2) AS words FROM eval_cases GROUP BY 1)"

SQL = {
    "active_chunks": f"WITH {_DOCS} SELECT id, document_id, knowledge_base_id, canonical_path, chunk_index FROM active",
    "document_status": f"WITH {_DOCS} SELECT * FROM status",
    "status_summary": f"WITH {_DOCS} SELECT knowledge_base_id, count(*) AS documents, count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state NOT IN ('ready', 'failed')) AS pending FROM status WHERE visible GROUP BY 1",
    "status_histogram": f"WITH {_DOCS} SELECT coalesce(state, 'no_version') AS state, count(*) AS documents FROM status GROUP BY 1",
    "latest_versions": f"SELECT id, document_id, state FROM document_versions QUALIFY {_LATEST}",
    "index_consistency": """SELECT (SELECT count(DISTINCT id) FROM chunks WHERE id NOT IN (SELECT id FROM vector_records WHERE id IS NOT NULL)) AS chunks_without_vector,
        (SELECT count(DISTINCT id) FROM vector_records WHERE id NOT IN (SELECT id FROM chunks)) AS vectors_without_chunk,
        (SELECT count(DISTINCT id) FROM chunks WHERE document_version_id NOT IN (SELECT id FROM document_versions)) AS chunks_without_version""",
    "normalized_documents": f"SELECT doc_id, md5({_NORMAL}) AS text_md5, len(regexp_extract_all(text, '{TOKEN_RE2}')) AS tokens, sha256(text) AS sha256 FROM documents",
    "document_keys": rf"""WITH {_UNIQUE} SELECT d.doc_id, string_split(canonical_path, '/')[-1] AS file_name, lower(regexp_extract(string_split(canonical_path, '/')[-1], '[^.](\.[^.]+)$', 1)) AS suffix,
        md5(regexp_replace(lower(u.text), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS key_md5,
        lower(regexp_extract(string_split(canonical_path, '/')[-1], '[^.](\.[^.]+)$', 1)) IN ({', '.join(f"'{x}'" for x in sync.SUPPORTED)}) AS supported, canonical_path = 'corpus/contracts' OR canonical_path LIKE 'corpus/contracts/%' AS is_contract
        FROM documents d JOIN uniq u USING (doc_id)""",
    "unique_paragraphs": f"WITH {_UNIQUE} SELECT doc_id, md5(text) AS text_md5 FROM uniq",
    "document_windows": rf"""WITH a AS (SELECT doc_id, regexp_extract_all({_NORMAL}, '[\s\p{{Z}}]*(?:{TOKEN_RE2})') AS a FROM documents), w AS (SELECT doc_id, a, unnest(generate_series(0, (len(a) - 1) // 650)) AS w FROM a WHERE len(a) > 0)
        SELECT doc_id, w AS chunk_index, len(a[w * 650 + 1:(w + 1) * 650]) AS token_count, sha256(regexp_replace(array_to_string(a[w * 650 + 1:(w + 1) * 650], ''), '^\s+|\s+$', '', 'g')) AS text_hash FROM w""",
    "chunk_health": """WITH c AS (SELECT DISTINCT ON (id) * FROM chunks) SELECT count(*) AS chunks, round(count(*) FILTER (trim(coalesce(text, '')) = '') / count(*), 6) AS empty_rate,
        round((count(*) - count(DISTINCT text_hash)) / count(*), 6) AS duplicate_rate, round((count(*) - count(DISTINCT {'a': document_version_id, 'b': text_hash})) / count(*), 6) AS duplicate_rate_in_document,
        round((count(DISTINCT {'a': document_version_id, 'b': text_hash}) - count(DISTINCT text_hash)) / count(*), 6) AS duplicate_rate_across, round(count(*) FILTER (token_count < 300) / count(*), 6) AS short_rate,
        round(count(*) FILTER (token_count > 800) / count(*), 6) AS long_rate, round(count(*) FILTER (page_no IS NOT NULL OR len(section_path) > 0) / count(*), 6) AS located_rate FROM c""",
    "token_distribution": """WITH c AS (SELECT DISTINCT ON (id) token_count AS v FROM chunks), s AS (SELECT list(v ORDER BY v) AS v, count(v) AS n FROM c WHERE v IS NOT NULL)
        SELECT n, v[1] AS least, v[n // 2 + 1] AS median, v[floor((n - 1) * 0.9)::INT + 1] AS p90, v[floor((n - 1) * 0.95)::INT + 1] AS p95, v[n] AS most FROM s""",
    "request_latency": """WITH r AS (SELECT DISTINCT ON (request_id) knowledge_base_id, (epoch_us(received_at) - epoch_us(requested_at)) / 1000.0 AS v FROM search_requests)
        SELECT knowledge_base_id, count(v) AS n, round(min(v), 3) AS least, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.9), 3) AS p90, round(quantile_cont(v, 0.95), 3) AS p95, round(quantile_cont(v, 0.99), 3) AS p99, round(max(v), 3) AS most FROM r GROUP BY 1""",
    "bm25_search": rf"""WITH {_CASES}, q AS (SELECT query_id, unnest({_WORDS}[:16]) AS word FROM c), t AS (SELECT DISTINCT query_id, lower(word) AS w FROM q),
        d AS (SELECT DISTINCT ON (id) id, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS a FROM chunks), n AS (SELECT count(*) AS nd, avg(len(a)) AS avgdl FROM d),
        p AS (SELECT id, len(a) AS dl, unnest(a) AS w FROM d), tf AS (SELECT id, w, any_value(dl) AS dl, count(*) AS tf FROM p WHERE w IN (SELECT w FROM t) GROUP BY id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
        s AS (SELECT query_id, id, round(sum(greatest(ln((nd - df + 0.5) / (df + 0.5)), CASE WHEN ln((nd - df + 0.5) / (df + 0.5)) > 0 THEN 0 ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
              FROM (SELECT query_id, word, lower(word) AS w FROM q) JOIN tf USING (w) JOIN df USING (w), n GROUP BY 1, 2)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM s QUALIFY rank <= 10""",
    "contains_search": r"""WITH c AS (SELECT id AS query_id, min(question) AS question FROM eval_cases GROUP BY 1),
        q AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9_.-]*'), lambda x: len(x) >= 2))) AS w FROM c),
        k AS (SELECT DISTINCT ON (id) id, text, token_count, chunk_index FROM chunks),
        s AS (SELECT query_id, k.id, k.token_count, k.chunk_index, 20.0 * count(*) AS score FROM q JOIN k ON contains(lower(k.text), lower(w)) GROUP BY ALL)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, token_count, chunk_index, id) AS rank, score FROM s QUALIFY rank <= 10""",
    "field_search": rf"""WITH {_DOCS}, w(query_id, field) AS (VALUES (1, 'gearbox'), (2, 'Pump'), (3, '50 %'), (4, '阀门'))
        SELECT query_id, document_id, count(*) AS matched_chunks, sum((len(text) - len(replace(text, field, ''))) // len(field)) AS occurrences,
            arg_min({{'p': page_no}}, {{'c': chunk_index, 'i': id}}).p::VARCHAR AS page, arg_min({{'s': array_to_string(section_path, ' / ')}}, {{'c': chunk_index, 'i': id}}).s AS section FROM active JOIN w ON contains(lower(text), lower(field)) GROUP BY 1, 2""",
    "vector_search": f"WITH {_VECTORS.format(on='true')} SELECT query_id, id, rank, score FROM near",
    "vector_search_filtered": f"WITH {_VECTORS.format(on='a.label = b.label')} SELECT query_id, id, rank, score FROM near",
    "fused_ranks": f"""WITH {_VECTORS.format(on='true')}, l AS (SELECT query_id, id, rank, 'vector' AS source FROM near UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id), 'id' FROM near)
        SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM l GROUP BY 1, 2""",
    "hash_embeddings": r"""WITH q AS (SELECT DISTINCT request_id, query FROM search_requests), w AS (SELECT request_id, query, list_filter(string_split(trim(regexp_replace(query, '[\s\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM q),
        h AS (SELECT request_id, pos, sha256(unnest(CASE WHEN len(w) > 0 THEN w ELSE [query] END)) AS h FROM w, (SELECT 1 AS pos)),
        b AS (SELECT request_id, i, sum(('0x' || substr(h, 2 * i + 1, 2))::INT / 255.0 - 0.5) AS x FROM h, (SELECT unnest(generate_series(0, 31)) AS i) GROUP BY ALL)
        SELECT request_id, i, round(CASE WHEN sum(x * x) OVER (PARTITION BY request_id) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY request_id)) ELSE 0 END, 6) AS x FROM b""",
    "context_windows": f"WITH {_DOCS}, {_NEAR} SELECT anchor_id, id, chunk_index FROM near",
    "context_segments": f"""WITH {_DOCS}, {_NEAR}, o AS (SELECT anchor_id, document_version_id, chunk_index, min(text) AS text, min(anchor_index) AS a FROM near GROUP BY 1, 2, 3),
        r AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY anchor_id, document_version_id ORDER BY chunk_index) AS run FROM o), m AS (SELECT *, chunk_index - min(a) OVER (PARTITION BY anchor_id, document_version_id, run) AS off FROM r)
        SELECT document_version_id, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS chunks,
            md5(string_agg('【' || CASE WHEN off = 0 THEN '命中块' WHEN off < 0 THEN '前文第 ' || -off || ' 块' ELSE '后文第 ' || off || ' 块' END || '】' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5
        FROM m GROUP BY anchor_id, document_version_id, run""",
    "table_cells": f'WITH {_CELLS} SELECT key, table_no, row, "column", header, value FROM cell',
    "table_columns": rf"""WITH {_CELLS}, x AS (SELECT c.*, l.value AS label, replace(c.value, ',', '')::DOUBLE AS x FROM cell c JOIN cell l ON l.key = c.key AND l.table_no = c.table_no AND l.row = c.row AND l."column" = 0
            WHERE c."column" > 0 AND regexp_full_match(trim(replace(c.value, ',', '')), '-?\d+(\.\d+)?'))
        SELECT key, table_no, "column", header, count(*) AS n, round(sum(x), 4) AS total, max(x) AS most, arg_min(label, {{'x': -x, 'r': row}}) AS most_label, min(x) AS least, arg_min(label, {{'x': x, 'r': row}}) AS least_label FROM x GROUP BY 1, 2, 3, 4""",
    "pivot_states": "SELECT user_id, event_type, round(sum(value), 4) AS value FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2 HAVING sum(value) IS NOT NULL",
    "reconcile": f"WITH {_SNAP} SELECT * FROM ev",
    "job_queue": f"""WITH {_SNAP} SELECT sha256('kb' || chr(31) || upper(event) || chr(31) || path || chr(31)) AS job_key, event AS operation, CASE event WHEN 'update' THEN 'leased' ELSE 'queued' END AS state,
        (event IN ('add', 'update'))::INT AS attempts, CASE event WHEN 'update' THEN 'x' END AS error FROM ev WHERE event <> 'unchanged'""",
    "document_segments": f"WITH {_SEGMENTS} SELECT doc_id, md5(key) AS key_md5 FROM seg",
    "unique_segments": f"WITH {_SEGMENTS} SELECT min(doc_id) AS doc_id, md5(key) AS key_md5 FROM seg GROUP BY key HAVING count(*) = 1",
    "question_coverage": r"""WITH c AS (SELECT DISTINCT ON (id) id, regexp_replace(lower(question), '[^\p{L}\p{N}]+', '', 'g') AS q, regexp_replace(lower(array_to_string(list_transform(relevant_sources, lambda s: s.evidence_text), chr(10))), '[^\p{L}\p{N}]+', '', 'g') AS e FROM eval_cases),
        b AS (SELECT id, list_distinct(list_transform(generate_series(1, len(q) - 1), lambda i: q[i:i + 1])) AS q, list_distinct(list_transform(generate_series(1, len(e) - 1), lambda i: e[i:i + 1])) AS e FROM c)
        SELECT id, round(len(list_intersect(q, e)) / len(q), 6) AS coverage FROM b""",
}
