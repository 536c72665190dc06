"""Building and auditing evaluation sets: leakage of questions, terms of texts, candidates and their quotas, gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.metrics import _nfkc, longest_common_run

# Bounds of the audit and of the gate, and of the choice of terms.
PAYLOAD, QUESTION, RUN, CONFIRMED = 0.8, 0.65, 12, 0.5
SHORTEST, LONGEST, LEAST_HAN = 8, 100, 4
RARE_MOST, WISHED, TERM_SIZES = 8, 3, (4, 3, 2)
# Words too common to ask about.
COMMON = tuple("一个 一种 一些 这个 这些 可以 进行 通过 需要 能够 相关 内容 问题 情况 主要 实现 使用 对于 以及 如果 没有 文件".split())


def plain(text: Column) -> Column:
    """Letters a-z, digits and ideographs of a text in compatible form and lower case."""
    return F.regexp_replace(F.lower(_nfkc(text)), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of a plain text; a single character is its own pair."""
    n = F.length(text)
    several = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))
    return F.when(n > 0, several).otherwise(F.array().cast("array<string>"))


def coverage(part: Column, whole: Column) -> Column:
    """Share of a plain text's pairs that another has; 0 for an empty one."""
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(pairs(part), pairs(whole))), F.size(pairs(part))), F.lit(0.0)), 6)


@F.pandas_udf(T.IntegerType())
def _run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common_run(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def leakage_audit(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per case (id, question, category, relevant_sources) with what its question gives away of the first source,
    and how the first hit of ranked (id, rank, methods array<string>, relevant) was found.

    direct (the quoted part stands in the evidence), file_named, payload_coverage, question_coverage, longest_run,
    rank1_methods, rank1_relevant, shortcut (any of them over its bound). A repeated case counts once; one without a hit has no methods.
    """
    one = cases.groupBy("id").agg(F.min("question").alias("question"), F.coalesce(F.min("category"), F.lit("unknown")).alias("category"), F.min("relevant_sources").alias("s"))
    source = F.get("s", F.lit(0))
    payload = F.trim(F.regexp_extract("question", "[“\"]([^”\"]+)[”\"]", 1))
    name = F.element_at(F.split(F.replace(source["document_path"], F.lit("\\"), F.lit("/")), "/"), -1)
    rows = one.select("id", "category", plain(F.col("question")).alias("q"), plain(payload).alias("p"), plain(F.coalesce(source["evidence_text"], F.lit(""))).alias("e"), plain(F.coalesce(name, F.lit(""))).alias("f"))
    first = ranked.filter("rank = 1").groupBy("id").agg(F.min("methods").alias("rank1_methods"), F.max("relevant").alias("rank1_relevant"))
    holds = lambda a, b: (F.length(b) > 0) & F.contains(a, b)
    rows = rows.select("id", "category", holds(F.col("e"), F.col("p")).alias("direct"), holds(F.col("q"), F.col("f")).alias("file_named"), coverage(F.col("p"), F.col("e")).alias("payload_coverage"), coverage(F.col("q"), F.col("e")).alias("question_coverage"), _run("q", "e").alias("longest_run"))
    rows = rows.join(first, "id", "left").withColumn("rank1_relevant", F.coalesce("rank1_relevant", F.lit(False)))
    return rows.withColumn("shortcut", F.col("direct") | F.col("file_named") | (F.col("payload_coverage") >= PAYLOAD) | (F.col("question_coverage") >= QUESTION) | (F.col("longest_run") >= RUN))


def audit_rates(audit: DataFrame) -> DataFrame:
    """Rates by category, and over all cases as category null: cases, direct, file_named, payload and question coverage, longest run, rank 1 relevance, shortcuts, verdict."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    out = audit.rollup("category").agg(F.count("*").alias("cases"), *(rate(c) for c in ("direct", "file_named", "payload_coverage", "question_coverage")), F.max("longest_run").alias("longest_run"), rate("rank1_relevant"), rate("shortcut"))
    return out.withColumn("verdict", F.when(F.col("shortcut") >= CONFIRMED, "LEAKAGE_CONFIRMED").otherwise("NO_MATERIAL_LEAKAGE_FOUND"))


def rank1_methods(audit: DataFrame) -> DataFrame:
    """(method, cases): by which searches the first hits were found."""
    return audit.select(F.explode("rank1_methods").alias("method")).groupBy("method").agg(F.count("*").alias("cases"))


def leakage_reasons(cases: DataFrame) -> DataFrame:
    """(id, reasons array<string>): why a question can't be used for its first source; empty if it can."""
    one = cases.groupBy("id").agg(F.min("question").alias("question"), F.min("category").alias("category"), F.min("relevant_sources").alias("s"))
    source = F.get("s", F.lit(0))
    evidence = F.coalesce(source["evidence_text"], F.lit(""))
    name = F.coalesce(plain(F.element_at(F.split(F.replace(source["document_path"], F.lit("\\"), F.lit("/")), "/"), -1)), F.lit(""))
    rows = one.select("id", "category", "question", plain(F.col("question")).alias("q"), plain(evidence).alias("e"), evidence.alias("text"), name.alias("f"))
    rows = rows.withColumn("run", _run("q", "e")).withColumn("share", coverage(F.col("q"), F.col("e")))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))
    told = F.array_sort(F.filter(F.array_intersect(numbers("question"), numbers("text")), lambda x: ~x.rlike(r"^20\d{2}$")))
    reasons = F.array(
        F.when(~F.length("question").between(SHORTEST, LONGEST), "question_length_out_of_range"),
        F.when(F.length(F.regexp_replace("question", r"[^\x{4e00}-\x{9fff}]", "")) < LEAST_HAN, "insufficient_chinese_question_text"),
        F.when((F.length("f") > 0) & F.contains("q", F.col("f")), "contains_target_filename"),
        F.when(F.col("run") >= RUN, F.concat(F.lit("longest_common_substring="), F.col("run").cast("string"))),
        F.when(F.col("share") >= QUESTION, F.concat(F.lit("bigram_coverage="), F.format_string("%.3f", "share"))),
        F.when(F.col("question").rlike("[“”\"]"), "contains_quotation"),
        F.when((F.col("category") == "numeric_parameter") & (F.size(told) > 0), F.concat(F.lit("contains_answer_number="), F.array_join(told, ","))),
    )
    return rows.select("id", F.array_compact(reasons).alias("reasons"))


def _pieces(runs: Column) -> Column:
    """The different pieces of TERM_SIZES characters of an array of texts."""
    of = lambda run, n: F.transform(F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: i <= F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(*(of(r, n) for n in TERM_SIZES)))))


def candidate_terms(text: Column) -> Column:
    """Distinct pieces of two to four ideographs of the runs of a text, none common or holding a common one of three or more."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    long = [w for w in COMMON if len(w) >= 3]
    fine = lambda x: ~x.isin(*COMMON) & (F.lit(True) if not long else ~F.greatest(*(F.contains(x, F.lit(w)) for w in long)))
    return F.filter(_pieces(runs), fine)


def term_frequencies(texts: DataFrame) -> DataFrame:
    """(term, documents) of texts (doc_id, text): in how many documents, put together without other characters, each term stands."""
    wanted = texts.select(F.explode(candidate_terms(F.col("text"))).alias("term")).distinct()
    joined = F.regexp_replace(F.lower("text"), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")
    runs = F.regexp_extract_all(joined, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    held = texts.select("doc_id", F.explode(_pieces(runs)).alias("term")).distinct()
    return held.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("documents"))


def low_overlap_terms(candidates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(id, first, second) of candidates (id, text): the two terms to ask by, neither a part of the other.

    Terms of at most RARE_MOST documents, first those of more than one, nearest to WISHED, the longer and the smaller first. Candidates without two have no row.
    """
    terms = candidates.select("id", F.explode(candidate_terms(F.col("text"))).alias("term")).distinct().join(frequencies, "term").filter(F.col("documents") <= RARE_MOST)
    order = F.struct((F.col("documents") == 1).alias("a"), F.abs(F.col("documents") - WISHED).alias("b"), (-F.length("term")).alias("c"), "term")
    first = terms.groupBy("id").agg(F.min_by("term", order).alias("first"))
    rest = terms.join(first, "id").filter(~F.contains("first", F.col("term")) & ~F.contains("term", F.col("first")))
    return rest.groupBy("id", "first").agg(F.min_by("term", order).alias("second"))


def valid_terms(first: Column, second: Column, evidence: Column) -> Column:
    """Whether two key terms can be asked by: two to six ideographs each, in the evidence, not common, neither a part of the other."""
    long = [w for w in COMMON if len(w) >= 3]
    fine = lambda x: x.rlike(r"^[\x{4e00}-\x{9fff}]{2,6}$") & F.contains(evidence, x) & ~x.isin(*COMMON) & (F.lit(True) if not long else ~F.greatest(*(F.contains(x, F.lit(w)) for w in long)))
    return fine(first) & fine(second) & ~F.contains(first, second) & ~F.contains(second, first)


def candidate_cases(chunks: DataFrame, most: int = 120) -> DataFrame:
    """The first ``most`` chunks of each base by path, then index, as cases to be validated: knowledge_base_id, id, question, expected_answer, document_id, chunk_id."""
    order = Window.partitionBy("knowledge_base_id").orderBy("canonical_path", "chunk_index", "id")
    rows = chunks.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    evidence = F.substring(F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")), 1, 180)
    question = F.concat(F.lit("Locate the source containing this excerpt: "), F.substring(evidence, 1, 60))
    return rows.select("knowledge_base_id", F.format_string("candidate-%04d", "n").alias("id"), question.alias("question"), evidence.alias("expected_answer"), "document_id", F.col("id").alias("chunk_id"))


def with_quotas(candidates: DataFrame, quotas: DataFrame, per_document: int = 16) -> DataFrame:
    """The first candidates (id, document_id, category, place) of each category up to its quota (category, quota), at most
    ``per_document`` of one document, by place; with n, from 1, and enough: whether the category's quota is met."""
    capped = candidates.withColumn("_d", F.row_number().over(Window.partitionBy("category", "document_id").orderBy("place", "id"))).filter(F.col("_d") <= per_document)
    rows = capped.join(quotas, "category").withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("place", "id"))).filter(F.col("n") <= F.col("quota"))
    return rows.withColumn("enough", F.count("*").over(Window.partitionBy("category")) >= F.col("quota")).drop("_d", "quota")


def answer_passes(answerable: Column, expected_names: Column, insufficient: Column, files: Column) -> Column:
    """Whether an answer is as expected: of an answerable question with a citation of a file with one of the names in its name, of another one without any."""
    named = F.exists(F.coalesce(expected_names, F.array().cast("array<string>")), lambda m: F.exists(files, lambda f: F.contains(f, m)))
    return F.when(answerable, ~insufficient & named).otherwise(insufficient & (F.size(files) == 0))


def overall_gate(cases: DataFrame, health: DataFrame, status: DataFrame) -> DataFrame:
    """One row: candidate and validated cases, and the conditions by which the whole evaluation fails."""
    counts = cases.groupBy("id").agg(F.max(F.coalesce("validated", F.lit(False))).alias("v")).agg(F.count("*").alias("cases"), F.count_if("v").alias("validated"))
    failed = status.filter("visible").agg(F.count_if(F.col("state") == "failed").alias("failed"))
    one = counts.join(F.broadcast(health.select("long_rate"))).join(F.broadcast(failed))
    conditions = F.array(
        F.when(F.col("validated") == 0, "no validated cases"),
        F.when(F.col("long_rate") > 0.1, "more than 10 % of the chunks exceed 800 tokens"),
        F.when(F.col("failed") > 0, "a visible document failed"),
    )
    return one.withColumn("fails", F.array_compact(conditions))


def stability(runs: DataFrame) -> DataFrame:
    """One row of runs (latency_ms, failed): completed, failure_rate, greatest latency of those that didn't fail; rates null without runs."""
    return runs.agg(F.count("*").alias("completed"), F.round(F.try_divide(F.count_if("failed"), F.count("*")), 6).alias("failure_rate"), F.round(F.max(F.when(~F.col("failed"), F.col("latency_ms"))), 2).alias("most_ms"))
