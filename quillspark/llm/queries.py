"""Queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.words import TOKEN_RE2, WORD_RE2
from quillspark.llm import corpus, leakage, lookalike, mixing, ocr, readability
from quillspark.sources.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.blocks_and_queries(table(spark, folder, "layout_blocks"), table(spark, folder, "search_requests"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.defects(ocr.lines_of_ocr(table(spark, folder, "ocr_text_blocks"))).withColumnRenamed("line_id", "ocr_id")


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.paragraphs(ocr.lines_of_ocr(table(spark, folder, "ocr_text_blocks")))


def p1_scanned_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.paragraphs(ocr.lines_of_blocks(table(spark, folder, "layout_blocks")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(_texts(spark, folder))


def p2_uniform(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.uniform_text(_texts(spark, folder)).distinct()


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_classes(_texts(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), leakage.item_texts(table(spark, folder, "eval_cases")))


def p6_substituted(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), leakage.item_texts(table(spark, folder, "eval_cases")), differing=1)


def p6_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), leakage.item_texts(table(spark, folder, "eval_cases")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.short_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.reached_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.prefix_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return readability.documents_of_level(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return readability.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paragraphs, p1_scanned_blocks, p2_found, p2_classes, p2_uniform, p6_found, p6_substituted, p6_passages, p7_found, p7_mix, p7_shares, p7_prefixes, p8_found, p8_levels)} | corpus.QUERIES

# The form in SQL: usual characters by rule, invisible ones dropped, look-alikes as Latin letters, composed.
_WIDE = ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_FROM = _WIDE[0] + _SPACES + "".join(lookalike.SAME) + "".join(lookalike.TO_LATIN)
_TO = _WIDE[1] + " " * len(_SPACES) + "".join(lookalike.SAME.values()) + "".join(lookalike.TO_LATIN.values())
_FORM = f"translate(regexp_replace(text, '\\p{{Cf}}+', '', 'g'), '{_FROM.replace(chr(39), chr(39) * 2)}', '{_TO.replace(chr(39), chr(39) * 2)}')"
for _n, _a in enumerate(("ff", "fi", "fl", "ffi", "ffl")):
    _FORM = f"replace({_FORM}, '{chr(0xFB00 + _n)}', '{_a}')"
_FORM = f"nfc_normalize({_FORM})"

_KEY = "replace(lower(trim(source)), '-', '_')"

# Windows of 12 words of documents and items, words broken over lines read in both ways.
_READ = rf"regexp_extract_all(lower({_FORM.replace('(text', '(x')}), '{WORD_RE2}')"
_LEAKS = rf"""
    r AS (SELECT unnest(['\1\2', '\1 \2']) AS r),
    dt AS (SELECT DISTINCT doc_id, regexp_replace(text, '([\p{{L}}\p{{N}}]+)[-‐‑–¬\x{{ad}}][^\S\n]*\n\s*([\p{{L}}\p{{N}}]+)', r, 'g') AS x FROM documents, r WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT id, unnest(list_concat([question], list_transform(coalesce(relevant_sources, []), lambda s: s.evidence_text))) AS x FROM eval_cases),
    it AS (SELECT DISTINCT id, regexp_replace(x, '([\p{{L}}\p{{N}}]+)[-‐‑–¬\x{{ad}}][^\S\n]*\n\s*([\p{{L}}\p{{N}}]+)', r, 'g') AS x FROM c, r WHERE id IS NOT NULL AND x IS NOT NULL),
    dw AS (SELECT DISTINCT doc_id, {_READ} AS w FROM dt), iw AS (SELECT DISTINCT id, {_READ} AS w FROM it),
    d AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: w[i:i + 11])) AS a FROM dw),
    i AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: w[i:i + 11])) AS b FROM iw)"""
SQL = {
    "p2_found": f"""
        WITH t AS (SELECT DISTINCT 'block-' || block_id AS key, text FROM layout_blocks WHERE text IS NOT NULL
                   UNION SELECT DISTINCT 'query-' || request_id, query FROM search_requests WHERE query IS NOT NULL),
        f AS (SELECT key, text, {_FORM} AS form FROM t)
        SELECT DISTINCT a.key AS key_a, b.key AS key_b FROM f a JOIN f b ON a.form = b.form AND a.key < b.key AND a.text <> b.text""",
    "p2_classes": f"""
        WITH t AS (SELECT DISTINCT 'block-' || block_id AS key, text FROM layout_blocks WHERE text IS NOT NULL
                   UNION SELECT DISTINCT 'query-' || request_id, query FROM search_requests WHERE query IS NOT NULL),
        f AS (SELECT key, text, {_FORM} AS form FROM t), c AS (SELECT form, min(key) AS class_key, count(DISTINCT text) AS texts FROM f GROUP BY 1)
        SELECT DISTINCT key, class_key, texts FROM f JOIN c USING (form)""",
    "p6_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, id AS case_id FROM d JOIN i ON a = b",
    # With one word replaced, the first or the last six words of a window are the same.
    "p6_substituted": f"""WITH {_LEAKS}, j AS (SELECT doc_id, id, a, b FROM d JOIN i ON a[1:6] = b[1:6] UNION ALL SELECT doc_id, id, a, b FROM d JOIN i ON a[7:12] = b[7:12])
        SELECT DISTINCT doc_id, id AS case_id FROM j WHERE len(list_filter(generate_series(1, 12), lambda k: a[k] <> b[k])) <= 1""",
    "p7_found": f"""
        WITH d AS (SELECT {_KEY} AS key, len(regexp_extract_all(text, '{TOKEN_RE2}')) AS n FROM documents),
        t AS (SELECT {_KEY} AS key, source, weight / sum(weight) OVER () AS share, max_repeats FROM mix_targets)
        SELECT source FROM t LEFT JOIN (SELECT key, sum(n) AS n FROM d GROUP BY key) s USING (key)
        WHERE coalesce(s.n, 0) * max_repeats < share * (SELECT sum(n) FROM d)""",
} | corpus.SQL
