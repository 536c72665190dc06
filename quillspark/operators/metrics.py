"""Evaluation: chunk health, percentiles, ranking metrics, answer matches, leakage of questions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTS = (1, 3, 5, 10, 15)


def chunk_health(chunks: DataFrame) -> DataFrame:
    """One row of rates, rounded to 6 digits; null for an empty table."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    one = chunks.select("id", blank.alias("blank"), "text_hash", "document_version_id", "token_count", "page_no", "section_path").dropDuplicates(["id"])
    rate = lambda n: F.round(F.try_divide(n, F.count("*")), 6)
    complete = F.col("page_no").isNotNull() | (F.coalesce(F.size("section_path"), F.lit(0)) > 0)
    return one.agg(
        F.count("*").alias("chunks"),
        rate(F.count_if("blank")).alias("empty_rate"),
        rate(F.count("*") - F.count_distinct("text_hash")).alias("duplicate_rate"),
        rate(F.count("*") - F.count_distinct("document_version_id", "text_hash")).alias("duplicate_rate_in_document"),
        rate(F.count_distinct("document_version_id", "text_hash") - F.count_distinct("text_hash")).alias("duplicate_rate_across"),
        rate(F.count_if(F.col("token_count") < 300)).alias("short_rate"),
        rate(F.count_if(F.col("token_count") > 800)).alias("long_rate"),
        rate(F.count_if(complete)).alias("located_rate"),
    )


def index_percentiles(df: DataFrame, value: str) -> DataFrame:
    """n, least, median, p90, p95, most: the values at n // 2 and floor((n - 1) p), without interpolation.

    Counts by value are summed up, so the window has one row per distinct value, not per row.
    """
    from pyspark.sql import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("hi", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    at = lambda place: F.min(F.when(F.col("hi") > place, F.col("v")))
    return run.agg(F.max("n").alias("n"), F.min("v").alias("least"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor((F.col("n") - 1) * 0.9)).alias("p90"), at(F.floor((F.col("n") - 1) * 0.95)).alias("p95"), F.max("v").alias("most"))


def latency_percentiles(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """n, mean and interpolated percentiles of a value by group, rounded to 3 digits; equal values are counted first, groups without any are left out."""
    shares = ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))
    counts = df.select(*by, value.alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    return counts.groupBy(*by).agg(F.sum("_c").alias("n"), *(F.round(e, 3).alias(name) for e, name in ((F.min("_v"), "least"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c"), "mean"), *((F.percentile("_v", p, F.col("_c")), name) for p, name in shares), (F.max("_v"), "most"))))


def source_matches(sources: Column, chunk_id: Column, document_id: Column, path: Column) -> Column:
    """Whether a result is of one of a case's sources: its chunk, its document, or a path that ends with the source's. Empty fields match nothing."""
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    same = lambda want, have: F.coalesce((want != "") & (want == have), F.lit(False))
    ends = lambda want: F.coalesce((want != "") & F.endswith(slashes(path), slashes(want)), F.lit(False))
    return F.coalesce(F.exists(sources, lambda x: same(x["chunk_id"], chunk_id) | same(x["document_id"], document_id) | ends(x["document_path"])), F.lit(False))


def ranking_metrics(rows: DataFrame, by: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Means by group and cut k of hit, recall, precision, MRR and nDCG, rounded to 6 digits.

    rows: relevance array<boolean> in rank order and total, the number of relevant items. Precision divides
    by k; recall and nDCG are 0 without relevant items; recall exceeds 1 if several results are of one item.
    """
    k = F.explode(F.array(*map(F.lit, cuts)))
    df = rows.withColumn("k", k).withColumn("top", F.transform(F.slice("relevance", 1, F.col("k")), lambda x: F.coalesce(x, F.lit(False)).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    gain = total(F.transform("top", lambda x, i: x / F.log2(i + 2.0)))
    ideal = F.when(F.col("total") > 0, total(F.transform(F.sequence(F.lit(1), F.least(F.col("total").cast("int"), F.col("k"))), lambda i: 1 / F.log2(i + 1.0))))
    found, first = total("top"), F.array_position("top", 1)
    df = df.select(*by, "k", (found > 0).cast("double").alias("hit"), F.when(F.col("total") > 0, found / F.col("total")).otherwise(0.0).alias("recall"), (found / F.col("k")).alias("precision"), F.when(first > 0, 1.0 / first).otherwise(0.0).alias("mrr"), F.coalesce(gain / ideal, F.lit(0.0)).alias("ndcg"))
    return df.groupBy(*by, "k").agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "precision", "mrr", "ndcg")))


def comparable(text: str | None) -> str:
    """NFKC, lower case, letters and digits only."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "").lower())


def character_f1(a: str, b: str) -> float:
    a, b = comparable(a), comparable(b)
    if not a or not b:
        return float(a == b)
    both = sum((Counter(a) & Counter(b)).values())
    return 2 * both / (len(a) + len(b))


def longest_common_run(a: str, b: str) -> int:
    """Length of the longest common substring: rows of a table as array operations."""
    x, y = (np.array([ord(c) for c in s], np.int64) for s in (a, b))
    if not len(x) or not len(y):
        return 0
    best, run = 0, np.zeros(len(y) + 1, np.int64)
    for c in x:
        run[1:] = np.where(y == c, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


@F.pandas_udf(T.StringType())
def comparable_text(text: pd.Series) -> pd.Series:
    return text.map(comparable, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def answer_f1(answer: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([character_f1(a or "", b or "") for a, b in zip(answer, expected)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common_run(comparable(x), comparable(y)) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.BooleanType())
def _in_aliases(answer: pd.Series, expected: pd.Series, aliases: pd.Series) -> pd.Series:
    return pd.Series([comparable(a) in {comparable(x) for x in (e, *(s if s is not None else ()))} for a, e, s in zip(answer, expected, aliases)])


def exact_match(answer: Column, expected: Column, aliases: Column) -> Column:
    """Whether an answer is, as compared, the expected one or an alias."""
    return _in_aliases(answer, expected, aliases)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def numeric_match(answer: Column, expected: Column) -> Column:
    """struct<value_correct, unit_correct, both_correct> of the first numbers with their units, full-width ones included; all false where one has no number."""
    quantity = r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z%/]+)?"  # fixed value
    part = lambda c, n: F.regexp_extract(_nfkc(c), quantity, n)
    number = lambda c: F.nullif(part(c, 1), F.lit("")).cast("double")
    both = number(answer).isNotNull() & number(expected).isNotNull()
    value = F.coalesce(both & (number(answer) == number(expected)), F.lit(False))
    unit = F.coalesce(both & (F.lower(part(answer, 2)) == F.lower(part(expected, 2))), F.lit(False))
    return F.struct(value.alias("value_correct"), unit.alias("unit_correct"), (value & unit).alias("both_correct"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of the letters and digits, in lower case."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    n = F.length(plain)
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def question_leakage(cases: DataFrame, most_run: int = 12, most_coverage: float = 0.65) -> DataFrame:
    """Per case: coverage (share of the question's bigrams in its evidence), run (longest common substring),
    file_named (a source's file name in the question), leaks. A repeated case counts once."""
    one = cases.groupBy("id").agg(F.min("question").alias("question"), F.first("relevant_sources").alias("s"))
    evidence = F.concat_ws("\n", F.transform("s", lambda x: x["evidence_text"]))
    stems = F.transform("s", lambda x: F.lower(F.regexp_replace(F.element_at(F.split(x["document_path"], "/"), -1), r"\.[^.]+$", "")))
    q, e = bigrams(F.col("question")), bigrams(evidence)
    out = one.select("id", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, e)), F.size(q)), F.lit(0.0)), 6).alias("coverage"), common_run("question", evidence).alias("run"), F.exists(stems, lambda x: F.contains(F.lower("question"), x)).alias("file_named"))
    return out.withColumn("leaks", (F.col("coverage") >= most_coverage) | (F.col("run") >= most_run) | F.coalesce("file_named", F.lit(False)))


def leakage_summary(leakage: DataFrame) -> DataFrame:
    """cases, mean and greatest coverage, mean run, shortcut_rate, verdict (confirmed from a half on)."""
    out = leakage.agg(F.count("*").alias("cases"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.max("coverage").alias("most_coverage"), F.round(F.avg("run"), 6).alias("mean_run"), F.round(F.avg(F.col("leaks").cast("int")), 6).alias("shortcut_rate"))
    return out.withColumn("verdict", F.when(F.col("shortcut_rate") >= 0.5, "LEAKAGE_CONFIRMED").otherwise("NO_LEAKAGE_CONFIRMED"))
