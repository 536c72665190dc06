"""Claims of generated answers and the evidence that holds them, as tables.

An answer is taken apart into claims, claims meet the quotes of their query, and what is held is put together
again; a query has a few quotes and a few dozen claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import collapse, display_text
from quillspark.operators.review import focused

# Words that carry no content.
STOP = ("what which where when who the and for with is are was were be to of in on a an 请问 什么 如何 哪些 是否 关键 要求 关于 多少").split()
# A citation, a mark at the beginning of a list item, a number with its unit, the line of a sum.
CITATION, ITEM, QUANTITY, SUM_LINE = r"\[(\d+)\]", r"^\s*(?:[-*•]|\d+[.、])\s*", r"(?<![A-Za-z0-9])\d+(?:\.\d+)?(?:\s*[A-Za-z%/]+)?", "序号：合计"
# A claim ends behind citations, at the end of a sentence that none follows, at a full stop before a capital, or with its line.
CLAIM = r"\S.*?(?:(?:\[\d+\])++|[。！？!?](?!\[\d+\])|(?<![0-9])\.(?=\s+[A-Z\x{4e00}-\x{9fff}])|$)"
LEAST_SHARE, MOST_NEEDED, QUOTE, FALLBACK = 0.15, 3, 240, 500


def content_terms(text: Column) -> Column:
    """Distinct ASCII words of two characters or more and pairs of ideographs, without stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_.-]*"), F.lit(0)), lambda x: F.length(x) > 1)
    # Pairs overlap: a lookahead takes each place.
    pairs = F.regexp_extract_all(text, F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), F.lit(1))
    return F.array_except(F.array_distinct(F.concat(words, pairs)), F.array(*map(F.lit, STOP)))


def tight(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s\p{Z}]+", ""))


def short_quote(text: Column, most: int = QUOTE) -> Column:
    """The line of a sum, if there is one; else the text in one line, cut before ``most`` characters."""
    flat = collapse(text)
    cut = F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("...")))
    total = F.nullif(F.regexp_extract(text, f"(?m)^(.*{SUM_LINE}.*)$", 1), F.lit(""))
    return F.coalesce(total, cut)


def claims(answers: DataFrame) -> DataFrame:
    """(query_id, at, claim, bare, cited) of drafts (query_id, draft): bare without citations and list mark, cited the numbers in order."""
    rows = answers.select("query_id", F.posexplode(F.regexp_extract_all("draft", F.lit(f"(?m){CLAIM}"), F.lit(0))).alias("at", "claim")).withColumn("claim", F.trim("claim"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("claim", CITATION, ""), ITEM, ""))
    cited = F.transform(F.array_distinct(F.regexp_extract_all("claim", F.lit(CITATION), F.lit(1))), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    return rows.select("query_id", "at", "claim", bare.alias("bare"), F.array_compact(cited).alias("cited"))


def held(bare: Column, quote: Column) -> Column:
    """Whether a quote holds a claim literally, or all its quantities and enough of its terms."""
    whole, where, own = tight(bare), tight(quote), content_terms(bare)
    quantities = F.regexp_extract_all(bare, F.lit(QUANTITY), F.lit(0))
    needed = F.greatest(F.lit(1), F.least(F.lit(MOST_NEEDED), F.floor(F.size(own) * LEAST_SHARE)))
    enough = F.when(F.size(own) > 0, F.size(F.array_intersect(own, content_terms(quote))) >= needed).otherwise(F.size(quantities) > 0)
    return (whole != "") & (F.contains(where, whole) | (F.forall(quantities, lambda x: F.contains(where, tight(x))) & enough))


def verified(answers: DataFrame) -> DataFrame:
    """(query_id, text) of drafts (query_id, question, draft, quotes array<string>, scores array<double>).

    The claims that a quote holds, each with the numbers of the cited quotes that do, or without citations of the
    first that does; if none is left, or none shares a term with the question, the beginning of the quote that
    shares most. Without quotes the text is empty; a null draft has no claims.
    """
    quotes = answers.select("query_id", F.posexplode(F.arrays_zip("quotes", "scores")).alias("n", "q")).select("query_id", (F.col("n") + 1).alias("n"), F.col("q.quotes").alias("quote"), F.col("q.scores").alias("score"))
    every = quotes.groupBy("query_id").agg(F.max("n").alias("most"))
    own = claims(answers).join(every, "query_id").withColumn("cited", F.filter("cited", lambda x: x.between(1, F.col("most"))))
    pairs = own.join(quotes, "query_id").filter(((F.size("cited") == 0) | F.array_contains("cited", F.col("n"))) & held(F.col("bare"), F.col("quote")))
    kept = pairs.groupBy("query_id", "at", "claim", "cited").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    numbers = F.when(F.size("cited") > 0, F.filter("cited", lambda x: F.array_contains("ns", x))).otherwise(F.slice("ns", 1, 1))
    said = F.trim(F.regexp_replace("claim", rf"\s*{CITATION}", ""))
    lines = kept.select("query_id", "at", said.alias("said"), F.array_join(F.transform(numbers, lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "").alias("marks")).filter("said != ''")
    text = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", F.concat("said", "marks").alias("line")))).alias("l")).select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))

    asked = answers.select("query_id", "question", content_terms(F.col("question")).alias("asked"))
    scored = quotes.join(asked, "query_id").withColumn("shared", F.size(F.array_intersect("asked", content_terms(F.col("quote")))))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("n", "quote", "question"), F.struct("shared", "score", -F.col("n"))).alias("b"))
    best = best.select("query_id", "b.*")
    parts = focused(best.select(F.col("query_id").alias("key"), "question", F.col("quote").alias("text")), content_terms, 700)
    parts = parts.select(F.col("key").alias("query_id"), F.trim(display_text(F.regexp_replace("text", r"(?m)^\s*【[^】]+】\s*$", ""))).alias("part"))
    best = best.join(parts, "query_id").select("query_id", F.concat(short_quote(F.col("part"), FALLBACK), F.lit(" ["), F.col("n").cast("string"), F.lit("]")).alias("fallback"))
    out = asked.join(text, "query_id", "left").join(best, "query_id", "left")
    covers = F.col("text").isNotNull() & ((F.size("asked") <= 0) | F.arrays_overlap("asked", content_terms(F.col("text"))))
    return out.select("query_id", F.when(covers, F.col("text")).otherwise(F.coalesce("fallback", F.lit(""))).alias("text"))
