"""Review of generated answers: clean-up, numbered outlines and their completeness, the part of a quote that answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a model writes around its answer, what it says without evidence, questions for a whole list,
# questions that want a second look, endings of questions, and the least and most characters of a reviewed answer.
THOUGHT, LABEL, NO_EVIDENCE = r"(?is)<think>.*?</think>", r"^(?:修正后的最终答案|最终答案|答案)\s*[:：]\s*", "证据不足"
LIST_QUESTIONS = ("有哪些", "哪几", "包括哪些", "分别是", "列出", "所有", "全部", "基本原则", "主要原则", "主要步骤", "具体步骤", "主要方法", "基本要求")
REVIEW_QUESTIONS = ("哪些", "分别", "列出", "全部", "完整", "原则", "步骤", "条件", "区别", "总和", "合计", "为什么", "如何", "是否", "要求", "详细", "包括", "以及", "并且", "同时", "需要", "做什么")
ENDINGS = ("是什么", "有哪些", "包括哪些", "怎么做", "如何")
# How headings of each level begin, the most characters of the lower ones, and a line of a numbered outline.
HEADINGS = ((0, r"^第[一二三四五六七八九十百0-9]+[章节篇]", None), (1, r"^[一二三四五六七八九十]+、", None), (2, r"^[✎◆■]", 80), (3, r"^\d{1,2}[.．、)]", 80))
OUTLINE = r"(?m)^\s*(\d{1,2})[.．、]\s*([^\n]{2,48})$"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Z}]+", "")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(*(F.contains(text, F.lit(w)) for w in words))


def asks_for_list(question: Column) -> Column:
    return _holds(question, LIST_QUESTIONS)


def finalized(answer: Column, quotes: Column) -> Column:
    """A model's answer without its thoughts and label, citations of no quote dropped, one of the first quote added if none is left; null if nothing remains.

    ``quotes`` is the number of quotes.
    """
    said = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(answer, THOUGHT, ""), "</?think>", "")), LABEL, "")
    # Citations with a number above the quotes' go; there are few of them, so they are taken out one number at a time.
    cited = F.array_distinct(F.regexp_extract_all(said, F.lit(r"\[(\d+)\]"), F.lit(1)))
    value = lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")), F.lit(0))
    good = F.filter(cited, lambda x: value(x).between(1, quotes))
    clean = F.aggregate(cited, said, lambda t, x: F.replace(t, F.concat(F.lit("["), x, F.lit("]")), F.when(value(x).between(1, quotes), F.concat(F.lit("["), value(x).cast("string"), F.lit("]"))).otherwise("")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r"[ \t]+", " "), r" *\n *", "\n"))
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    return F.when((quotes >= 1) & (clean != ""), F.when(F.size(good) > 0, clean).otherwise(F.concat(F.rtrim(clean), F.lit(" [1]"))))


def reviewed(draft: Column, second: Column) -> Column:
    """The second answer, unless there is none or it gives up where the draft didn't."""
    return F.when(second.isNull() | (F.contains(second, F.lit(NO_EVIDENCE)) & ~F.contains(draft, F.lit(NO_EVIDENCE))), draft).otherwise(second)


def outline(text: Column) -> Column:
    """array<struct<number, title>>: the longest run of lines numbered 1, 2, 3 ...; of equally long ones the first."""
    numbers = F.regexp_extract_all(text, F.lit(OUTLINE), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(OUTLINE), F.lit(2))
    items = F.zip_with(numbers, titles, lambda a, b: F.struct(a.cast("int").alias("number"), F.trim(b).alias("title")))
    empty = F.array().cast("array<struct<number:int,title:string>>")
    longer = lambda s: F.when(F.size(s["now"]) > F.size(s["best"]), s["now"]).otherwise(s["best"])

    def step(s: Column, x: Column) -> Column:
        goes_on = (F.size(s["now"]) > 0) & (x["number"] == F.element_at(s["now"], -1)["number"] + 1) & (x["number"] != 1)
        now = F.when(x["number"] == 1, F.array(x)).when(goes_on, F.concat(s["now"], F.array(x))).otherwise(empty)
        return F.struct(longer(s).alias("best"), now.alias("now"))

    return F.coalesce(F.aggregate(items, F.struct(empty.alias("best"), empty.alias("now")), step, longer), empty)


def listed(items: Column, n: Column) -> Column:
    """The sentence that states a whole outline, citing quote n."""
    parts = F.array_join(F.transform(items, lambda x: F.concat(x["number"].cast("string"), F.lit(". "), x["title"])), "；")
    return F.concat(F.lit("依据原文，共有 "), F.size(items).cast("string"), F.lit(" 项："), parts, F.lit("。["), n.cast("string"), F.lit("]"))


def lacks(items: Column, answer: Column) -> Column:
    """Whether a title of the outline isn't in the answer, white space aside."""
    return F.exists(items, lambda x: ~F.contains(_bare(answer), _bare(x["title"])))


def completed(question: Column, answer: Column, outlines: Column) -> Column:
    """The answer, or if it lacks a title of the longest of its quotes' outlines and the question asks for a list, that whole outline."""
    numbered = F.transform(outlines, lambda x, i: F.struct(F.size(x).alias("n"), (-i).alias("place"), x.alias("items")))
    best = F.array_max(F.filter(numbered, lambda x: x["n"] > 0))
    return F.when(asks_for_list(question) & best.isNotNull() & lacks(best["items"], answer), listed(best["items"], 1 - best["place"])).otherwise(answer)


def wants_review(question: Column, complex_query: Column, outlines: Column) -> Column:
    """Whether an answer to the question is looked at twice: lists, reasons and the like, or quotes with outlines."""
    return complex_query | _holds(_bare(question), REVIEW_QUESTIONS) | F.exists(outlines, lambda x: F.size(x) >= 2) | ((F.size(outlines) >= 4) & F.contains(_bare(question), F.lit("什么")))


def wants_second(question: Column, draft: Column, quotes: Column, outlines: Column) -> Column:
    """Whether a draft seems incomplete: a title of an outline is missing, or it is far shorter than its quotes."""
    said = F.regexp_replace(draft, r"[\s\p{Z}]+|\[\d+\]", "")
    size, n = F.length(_bare(F.array_join(quotes, " "))), F.length(said)
    outlined = F.exists(outlines, lambda x: F.size(x) > 0)
    short = F.when(size < 48, n < size * 0.55).otherwise(n < F.least(F.lit(220), F.greatest(F.lit(48), F.floor(size * 0.28))))
    steps = F.contains(question, F.lit("做什么")) & F.exists(quotes, lambda q: F.contains(q, F.lit("【")))
    return steps | F.when(outlined, F.exists(outlines, lambda x: lacks(x, said))).otherwise(short)


def heading_level(line: Column) -> Column:
    """0 to 3, null for a line that is no heading."""
    bare, out = F.trim(line), None
    for level, pattern, most in HEADINGS:
        fits = bare.rlike(pattern) & (F.lit(True) if most is None else F.length(bare) <= most)
        out = F.when(fits, level) if out is None else out.when(fits, level)
    return out


def focused(texts: DataFrame, terms: Callable[[Column], Column], most: int = 2200) -> DataFrame:
    """(key, text) of a table (key, question, text): the part of each text around the line that shares most with the
    question, the first of equals. Under a heading that is what goes to the next heading of its level or above, else
    the line's paragraph and its neighbours; cut at ``most`` characters. A text without a full line stays. ``terms`` gives content terms.
    """
    core = F.regexp_replace(F.regexp_replace("question", r"[\s\p{Z}？?]", ""), f"(?:{'|'.join(ENDINGS)})$", "")
    lines = texts.select("key", terms(F.col("question")).alias("asked"), core.alias("core"), F.posexplode(F.split("text", r"\R")).alias("i", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line != ''").withColumn("level", heading_level(F.col("line")))
    bare = _bare(F.col("line"))
    points = F.size(F.array_intersect(terms(F.col("line")), F.col("asked"))) + F.when((bare != "") & F.contains("core", bare), F.length(bare) * 2.0).otherwise(0.0)
    best = lines.groupBy("key").agg(F.max_by(F.struct(F.col("i").alias("begin"), F.col("line").alias("best"), F.col("level").alias("of")), F.struct(points, -F.col("i"))).alias("b")).select("key", "b.*")
    ends = lines.join(best, "key").filter("i > begin and level <= of").groupBy("key").agg(F.min("i").alias("end"))
    rows = texts.select("key", "text").join(best, "key", "left").join(ends, "key", "left")
    split = F.split("text", r"\R")
    under = F.array_join(F.slice(split, F.col("begin") + 1, F.greatest(F.coalesce("end", F.size(split)) - F.col("begin"), F.lit(1))), "\n")
    rows = rows.withColumn("parts", F.filter(F.transform(F.split("text", r"\n\s*\n"), F.trim), lambda x: x != ""))
    rows = rows.withColumn("place", F.coalesce(F.array_position(F.transform("parts", lambda p: F.contains(p, F.col("best"))), True) - 1, F.lit(0)).cast("int"))
    near = F.array_join(F.slice("parts", F.greatest("place", F.lit(1)), F.when(F.col("place") <= 0, 2).otherwise(3)), "\n\n")
    out = F.trim(F.when(F.col("of").isNotNull(), under).otherwise(near))
    cut = F.when(F.length("out") <= most, F.col("out")).otherwise(F.concat(F.rtrim(F.substring("out", 1, most)), F.lit("...")))
    return rows.select("key", "text", "best", out.alias("out")).select("key", F.when(F.col("best").isNotNull(), cut).otherwise(F.col("text")).alias("text"))
