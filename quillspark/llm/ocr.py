"""Noise in text from scanned pages: running heads, page numbers, broken words, misread characters.

Everything is a Spark plan over recognised lines (line_id, version, page, line, text, confidence).
Words that could be misreadings of each other share a skeleton, in which each glyph is written as the
strokes it is confused with; of the forms of a skeleton the frequent one holds, if the neighbouring words
support it. Head and foot lines are found by their skeleton with digits masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

# Glyphs that are read as one another, and glyphs that are read as two.
ALIKE = ("01i|!589h6feq2", "ollllsbgbbtcgz")
STROKES = {"m": "rn", "n": "rl", "d": "cl", "u": "ll", "w": "vv"}
# Letters read for digits, hyphens at line ends, endings of a sentence.
DIGITS = ("oOlIi|sSbBzZ", "001111558822")
HYPHENS = "[-\\x{2010}\\x{2011}\\x{2013}\\x{ac}\\x{ad}]"
SCANNED = ("ocr_text", "ocr_table", "mixed", "docx_image_ocr")

# Words and abbreviations that stand before a page's number.
PAGE_WORDS = ("page", "pag", "pg", "p", "seite", "s")

EDGE, LEAST_PAGES, LEAST_SHARE, LEAST_LETTERS, SHEET = 2, 2, 0.3, 5, 1000
RATIO, RATIO_DOUBTFUL, DOUBTFUL, CLEAR = 6.0, 3.0, 0.8, 5.0
_LINE = ("line_id", "version", "page", "sheet", "line", "text", "confidence")
_WORD = r"[\p{L}\p{N}]+"
_NUMBER = r"[0-9oOlIi|sSbBzZ]+"


def skeleton(word: Column) -> Column:
    """The strokes of a word in lower case; equal for words that may be misreadings of each other."""
    out = F.translate(F.lower(word), *ALIKE)
    for glyph, strokes in STROKES.items():
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return out


def head_key(text: Column) -> Column:
    """The skeleton of a line's words, those of nothing but digits and letters read for digits masked."""
    return skeleton(F.regexp_replace(F.trim(text), rf"(?<![\p{{L}}\p{{N}}]){_NUMBER}(?![\p{{L}}\p{{N}}])", "#"))


def roman(number: Column) -> Column:
    """Lower-case Roman numeral of 1..999, else ''."""
    n, out = number.cast("int"), []
    for unit, (i, v, x) in zip((100, 10, 1), (("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x"))):
        digits = F.array(*(F.lit(d) for d in ("", i, i * 2, i * 3, i + v, v, v + i, v + i * 2, v + i * 3, i + x)))
        out.append(F.element_at(digits, F.pmod(F.floor(n / unit), F.lit(10)).cast("int") + 1))
    return F.when(n.between(1, 999), F.concat(*out)).otherwise("")


def _states_page(text: Column, page: Column) -> Column:
    """Whether a line states nothing but the page's number, also of so many, also misread or in Roman numerals."""
    line = lambda word: rf"^[^\p{{L}}\p{{N}}]*{word}\W*({_NUMBER})(?:\s*(?:/|of|von|sur|de)\s*{_NUMBER})?[^\p{{L}}\p{{N}}]*$"
    is_page = lambda number: F.translate(number, *DIGITS) == page.cast("string")
    named = line(r"([\p{L}\p{N}]+)\.?\s+")
    by_name = F.array_contains(F.transform(F.array(*map(F.lit, PAGE_WORDS)), skeleton), skeleton(F.regexp_extract(text, named, 1)))
    alone = is_page(F.regexp_extract(text, line(""), 1)) | (by_name & is_page(F.regexp_extract(text, named, 2)))
    return alone | (F.lower(F.trim(text)) == F.nullif(roman(page), F.lit("")))


def lines_of_blocks(blocks: DataFrame) -> DataFrame:
    """Lines of the scanned pages among layout blocks; line_id is "<block_id>:<line>"."""
    one = blocks.filter(F.col("source_type").isin(*SCANNED)).select("block_id", "document_version_id", "page_no", "text", "confidence").dropDuplicates(["block_id"])
    lines = one.select("*", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select(F.concat_ws(":", "block_id", "line").alias("line_id"), F.col("document_version_id").alias("version"), F.col("page_no").alias("page"), F.col("block_id").alias("sheet"), "line", F.col("t").alias("text"), "confidence")


def lines_of_ocr(ocr: DataFrame) -> DataFrame:
    """Lines of recognised text; line_id is the ocr_id."""
    return ocr.select(F.col("ocr_id").alias("line_id"), F.col("document_version_id").alias("version"), F.col("page_no").alias("page"), F.col("line_no").alias("line"), "text", "confidence")


def roles(lines: DataFrame) -> DataFrame:
    """The lines, one per line_id, with role: running_head, page_number or body; null without text.

    Of the EDGE first and last lines of a page, those are heads or feet whose masked skeleton is among
    the edge lines of at least LEAST_PAGES pages and LEAST_SHARE of the pages of the version, and page
    numbers those that state their own page, marked as such by a word, brackets or dashes, or else in a
    manner that recurs in the version, unless it has one page only.
    Lines of a null page have no head or foot and are read on in sheets of SHEET lines, those of blocks block by block.
    """
    sheet = F.col("sheet") if "sheet" in lines.columns else F.lit(0)
    sheet = F.when(F.col("page").isNull(), F.coalesce(F.col("line"), F.lit(0)) - F.coalesce(F.col("line"), F.lit(0)) % SHEET + sheet * SHEET).otherwise(0).cast("long")
    one = lines.withColumn("sheet", sheet).select(*_LINE).filter("line_id is not null").dropDuplicates(["line_id"])
    text = F.col("text").isNotNull() & (F.trim("text") != "")
    page = Window.partitionBy("version", "page", "sheet")
    full = one.filter(text)
    full = full.withColumn("top", F.row_number().over(page.orderBy("line", "line_id"))).withColumn("bottom", F.count("*").over(page) - F.col("top") + 1)
    full = full.withColumn("edge", F.when(F.col("page").isNull(), None).when(F.col("top") <= EDGE, "head").when(F.col("bottom") <= EDGE, "foot"))
    full = full.withColumn("states", F.col("edge").isNotNull() & F.coalesce(_states_page(F.col("text"), F.col("page")), F.lit(False)))
    manner = F.concat_ws(" ", "edge", F.regexp_replace(F.lower(F.trim("text")), rf"{_NUMBER}|^[ivxlc]+$", "#"))
    full = full.withColumn("key", F.when(F.col("states"), manner).when(F.col("edge").isNotNull(), head_key(F.col("text"))))

    edges = full.filter("edge is not null")
    pages = edges.groupBy("version").agg(F.count_distinct("page").alias("pages"))
    letters = F.length(F.regexp_replace("key", r"[^\p{L}]", ""))
    recurring = edges.groupBy("version", "key", "states").agg(F.count_distinct("page").alias("on")).join(pages, "version")
    recurring = recurring.filter(F.when(F.col("states"), (F.col("on") >= LEAST_PAGES) | (F.col("pages") == 1) | F.col("key").rlike(r"^\w+ (?:[ps]\w*\.? |\[|-)")).otherwise((F.col("on") >= LEAST_PAGES) & (F.col("on") >= LEAST_SHARE * F.col("pages")) & (letters >= LEAST_LETTERS)))
    flagged = edges.select("line_id", "version", "key", "states").join(recurring.select("version", "key", "states"), ["version", "key", "states"])
    flagged = flagged.select("line_id", F.when(F.col("states"), "page_number").otherwise("running_head").alias("role"))
    out = full.select(*_LINE).join(flagged, "line_id", "left").withColumn("role", F.coalesce("role", F.lit("body")))
    return out.unionByName(one.filter(~text | F.col("text").isNull()).withColumn("role", F.lit(None).cast("string")))


def _linked(lines: DataFrame) -> DataFrame:
    """Body lines with the line they go on in (next_id, next_text), on the page or at the top of the next page.

    That is the next line, or the one after it if only that begins with a small letter: notes and stray
    numbers stand between lines of the text.
    """
    body = lines.filter("role = 'body'").select(*_LINE)
    on_page = Window.partitionBy("version", "page", "sheet").orderBy("line", "line_id")
    line, small = F.struct("line_id", "text"), lambda c: F.coalesce(F.col(f"{c}.text").rlike(r"^\s*\p{Ll}"), F.lit(False))
    body = body.withColumn("next", F.lead(line).over(on_page)).withColumn("after", F.lead(line, 2).over(on_page))
    first = body.filter("page is not null").groupBy("version", "page").agg(F.min(F.struct("line", "line_id", "text")).alias("f"))
    first = first.select("version", (F.col("page") - 1).alias("page"), F.struct("f.line_id", "f.text").alias("over"))
    body = body.join(first, ["version", "page"], "left")
    body = body.withColumn("after", F.when(F.col("next").isNotNull(), F.coalesce("after", "over"))).withColumn("next", F.coalesce("next", "over"))
    body = body.withColumn("next", F.when(~small("next") & small("after"), F.col("after")).otherwise(F.col("next")))
    return body.select(*_LINE, F.col("next.line_id").alias("next_id"), F.col("next.text").alias("next_text"))


def broken(body: DataFrame) -> DataFrame:
    """Adds to linked body lines: head and tail (the parts of a word broken at the line's end, or null).

    A word ending in a hyphen goes on in the next line, unless the corpus writes the two parts with a
    hyphen within lines, more often than as one word.
    """
    body = body.withColumn("head", F.nullif(F.regexp_extract("text", rf"({_WORD}){HYPHENS}+\s*$", 1), F.lit("")))
    body = body.withColumn("tail", F.when(F.col("head").isNotNull(), F.nullif(F.regexp_extract("next_text", rf"^\s*(\p{{L}}[\p{{L}}\p{{N}}]*)", 1), F.lit(""))))
    body = body.withColumn("tail", F.when(F.col("tail").rlike(r"^\p{Ll}") | ~F.col("head").rlike(r"\p{Ll}"), F.col("tail")))
    body = body.withColumn("start", F.when(F.col("head").isNotNull(), skeleton(F.col("head")))).withColumn("whole", F.concat_ws("-", "start", skeleton(F.coalesce("tail", F.lit("")))))
    inner = body.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}-])\p{L}+-\p{L}+(?![\p{L}\p{N}-])"), F.lit(0))).alias("c"))
    inner = inner.withColumn("c", F.transform(F.split("c", "-"), skeleton)).groupBy("c").agg(F.count("*").alias("n")).filter("n > 1")
    compounds = inner.select(F.array_join("c", "-").alias("whole"), F.col("n").alias("hyphened"))
    starts = inner.groupBy(F.col("c")[0].alias("start")).agg(F.sum("n").alias("started"))
    words = body.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("w")).select(skeleton(F.col("w")).alias("w"))
    joined = body.filter("head is not null").select(F.replace("whole", F.lit("-"), F.lit("")).alias("w")).distinct()
    known = words.join(joined, "w", "left_semi").groupBy("w").agg(F.count("*").alias("known"))
    body = body.join(compounds, "whole", "left").join(starts, "start", "left").join(known.withColumnRenamed("w", "one"), F.replace("whole", F.lit("-"), F.lit("")) == F.col("one"), "left")
    belongs = F.col("text").rlike(r"[-\x{2010}\x{2011}]\s*$") & (F.coalesce("known", F.lit(0)) == 0) & (F.col("hyphened").isNotNull() | (F.col("started").isNotNull() & ~F.coalesce(F.col("tail").rlike(r"^\p{Ll}"), F.lit(False))))
    belongs = F.coalesce(belongs | (F.col("hyphened") > F.col("known")), F.lit(False))
    return body.withColumn("split", F.col("head").isNotNull() & ~belongs).drop("start", "whole", "hyphened", "started", "known", "one")


def words_of(body: DataFrame) -> DataFrame:
    """Words of the broken() lines, in order: line_id, place, word, before, after, confidence, and for words
    joined over a line end other_id and cut (letters on the first line). A tail counts with its head's line."""
    tails = body.filter("split and tail is not null").select(F.col("next_id").alias("line_id"), F.lit(True).alias("continued")).distinct()
    rows = body.join(tails, "line_id", "left")
    # Code letters ("AB-123") are names, not words; their digits are looked at.
    spoken = F.regexp_replace("text", r"(?<![\p{L}\p{N}])\p{Lu}{1,3}-(?=[\p{L}\p{N}])", "")
    rows = rows.withColumn("w", F.regexp_extract_all(spoken, F.lit(_WORD), F.lit(0)))
    rows = rows.withColumn("w", F.when(F.coalesce("continued", F.lit(False)), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))).otherwise(F.col("w")))
    whole = F.concat("head", "tail")
    rows = rows.withColumn("w", F.when(F.col("split"), F.concat(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.when(F.col("tail").isNotNull(), F.array(whole)).otherwise(F.array().cast("array<string>")))).otherwise(F.col("w")))
    # A word broken off with nothing to go on with is no word; what follows a break belongs to its head.
    rows = rows.select("line_id", "confidence", "w", F.posexplode("w").alias("place", "word"), F.when(F.col("split") & F.col("tail").isNotNull(), F.struct("next_id", F.length("head").alias("cut"))).alias("j"), F.size("w").alias("n"))
    last = F.col("place") == F.col("n") - 1
    near = lambda at: F.lower(F.get("w", at))
    return rows.select("line_id", "place", "word", near(F.col("place") - 1).alias("before"), near(F.col("place") + 1).alias("after"), "confidence", F.when(last, F.col("j.next_id")).alias("other_id"), F.when(last, F.col("j.cut")).alias("cut"))


def misread(words: DataFrame) -> DataFrame:
    """The words that hold wrong characters, with right: the form that replaces them.

    A word is misread if another form of its skeleton is RATIO times as frequent (RATIO_DOUBTFUL in lines of
    less confidence than DOUBTFUL) and at least as frequent between the same neighbours, or CLEAR times that
    frequent; so is a word with digits among its letters of which there is a form without, and a number that
    holds letters read for digits.
    """
    words = words.withColumn("low", F.lower("word"))
    digits = F.translate("word", *DIGITS)
    numeric = F.col("word").rlike(r"\d") & F.col("word").rlike(r"\p{L}") & digits.rlike(r"^\d+$")
    plain = ~F.col("word").rlike(r"^\d+$") & (F.length("word") > 1)
    inner = F.col("low").rlike(r"\d") & F.col("low").rlike(r"\p{L}.*\p{L}")  # digits among letters
    spelt = words.filter(plain & ~numeric)
    counts = spelt.groupBy("low").agg(F.count("*").alias("n")).withColumn("s", skeleton(F.col("low")))
    top = counts.groupBy("s").agg(F.max(F.struct(F.when(F.col("low").rlike(r"\d"), 0).otherwise(1).alias("letters"), "n", "low")).alias("top"))
    forms = counts.join(top.select("s", F.col("top.low").alias("rival"), F.col("top.n").alias("rival_n")), "s")
    doubted = (F.col("low") != F.col("rival")) & ((F.col("rival_n") >= RATIO_DOUBTFUL * F.col("n")) | inner)
    rivals = forms.filter(doubted).select("s", "low", "n", "rival", "rival_n")
    rivals = cut_lineage(rivals)

    # How often each form of such a skeleton stands behind and before a word: a map by form, for as many forms as the skeleton has.
    of = rivals.select("s", F.explode(F.array("low", "rival")).alias("low")).distinct()
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("near")), F.struct(F.lit(1).alias("side"), F.col("after").alias("near"))))
    beside = words.join(of, "low").select("s", "low", sides.alias("x")).select("s", "low", "x.*").filter("near is not null").groupBy("s", "side", "near", "low").agg(F.count("*").alias("m"))
    beside = beside.groupBy("s", "side", "near").agg(F.map_from_entries(F.collect_list(F.struct("low", "m"))).alias("m"))
    seen = lambda side, near, m: beside.filter(F.col("side") == side).select("s", F.col("near").alias(near), F.col("m").alias(m))
    suspects = spelt.join(rivals, "low").join(seen(0, "before", "m0"), ["s", "before"], "left").join(seen(1, "after", "m1"), ["s", "after"], "left")
    total = lambda c: sum((F.coalesce(F.try_element_at(m, F.col(c)), F.lit(0)) for m in (F.col("m0"), F.col("m1"))), F.lit(0))
    ratio = F.when(F.coalesce("confidence", F.lit(1.0)) < DOUBTFUL, RATIO_DOUBTFUL).otherwise(RATIO)
    supported = (total("rival") >= total("low")) | (F.col("rival_n") >= CLEAR * ratio * F.col("n"))
    wrong = suspects.filter(F.when(inner, F.col("rival").rlike(r"^\p{L}+$")).otherwise((F.col("rival_n") >= ratio * F.col("n")) & supported))
    shape = F.when(F.col("word").rlike(r"^\p{Lu}[^\p{Lu}]*$"), F.concat(F.upper(F.substring("rival", 1, 1)), F.expr("substring(rival, 2)"))).when(F.col("word").rlike(r"^[\p{Lu}\p{N}]{2,}$"), F.upper("rival")).otherwise(F.col("rival"))
    kept = ["line_id", "place", "word", "other_id", "cut"]
    return wrong.select(*kept, shape.alias("right")).unionByName(words.filter(numeric).select(*kept, digits.alias("right")))


def _read(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines with roles, body lines with their breaks, their words, misread words), all but the last written once."""
    all_lines = cut_lineage(roles(lines))
    body = cut_lineage(broken(_linked(all_lines)))
    words = cut_lineage(words_of(body))
    return all_lines, body, words, misread(words)


def defects(lines: DataFrame) -> DataFrame:
    """(line_id, defect), one row per defect of a line: running_head, page_number, broken_word, misread.

    A misread word that is broken over two lines counts for the line, or lines, of its wrong letters.
    Repeated ids count once, null ids and lines without text have no defects; an empty table gives none.
    """
    all_lines, body, _, wrong = _read(lines)
    edge = all_lines.filter("role in ('running_head', 'page_number')").select("line_id", F.col("role").alias("defect"))
    torn = body.filter("split").select("line_id", F.lit("broken_word").alias("defect"))
    first = F.col("cut").isNull() | (F.lower(F.substring("word", F.lit(1), F.col("cut"))) != F.lower(F.substring("right", F.lit(1), F.col("cut"))))
    rest = F.length("word") - F.col("cut")
    second = F.col("cut").isNotNull() & (F.lower(F.right("word", rest)) != F.lower(F.right("right", rest)))
    at = F.explode(F.array_compact(F.array(F.when(first, F.col("line_id")), F.when(second, F.col("other_id")))))
    return edge.unionByName(torn).unionByName(wrong.select(at.alias("line_id")).distinct().withColumn("defect", F.lit("misread")))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(version, page, paragraph, text): the pages' text, repaired and reflowed.

    Heads, feet and page numbers are left out, misread words replaced, broken words joined on the line
    where they begin. A paragraph ends at a line that ends a sentence and is shorter than 0.7 of the page's
    longest line, and at a line of three words or less after another such; pages without text give no row. The
    paragraphs of a null page are counted sheet by sheet.
    """
    _, body, words, wrong = _read(lines)
    # A misread word is the nth of its equals in the line.
    equal = words.select("line_id", "word", F.col("place").alias("at"))
    wrong = wrong.join(equal, ["line_id", "word"]).filter("at <= place").groupBy("line_id", "place", "word", "right").agg(F.count("*").alias("nth"))
    fixes = wrong.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("place", "nth", "word", "right")), asc=False).alias("fixes"))
    tails = body.filter("split and tail is not null").select(F.col("next_id").alias("line_id"), F.lit(True).alias("continued")).distinct()
    rows = body.join(tails, "line_id", "left").join(fixes, "line_id", "left")
    kept = F.when(F.coalesce("continued", F.lit(False)), F.regexp_replace("text", r"^\s*\S+", "")).otherwise(F.col("text"))
    rest = F.regexp_extract("next_text", r"^\s*(\S+)", 1)
    kept = F.when(F.col("split") & F.col("tail").isNotNull(), F.concat(F.regexp_replace(kept, rf"{HYPHENS}+\s*$", ""), rest)).otherwise(kept)
    # From the last place to the first, so that a word's number among its equals still holds when it is replaced.
    word = lambda f: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), f["word"], F.lit(r"(?![\p{L}\p{N}])"))
    nth = lambda f: F.concat(F.lit("^((?s:.*?"), word(f), F.lit("){"), f["nth"] - 1, F.lit("}(?s:.*?))"), word(f))
    fixed = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<place:int,nth:bigint,word:string,right:string>>")), kept, lambda t, f: F.regexp_replace(t, nth(f), F.concat(F.lit("$1"), f["right"])))
    rows = rows.select("version", "page", "sheet", "line", "line_id", F.trim(F.regexp_replace(fixed, r"\s+", " ")).alias("text"), F.length("text").alias("width"))
    page = Window.partitionBy("version", "page", "sheet")
    order = page.orderBy("line", "line_id")
    rows = rows.filter("text != ''").withColumn("widest", F.max("width").over(page)).withColumn("last", F.lag(F.struct("text", "width")).over(order))
    ends = F.col("last.text").rlike(r"[.!?。！？:]['\"”’)]*$") & (F.col("last.width") < 0.7 * F.col("widest"))
    short = lambda c: F.size(F.split(c, " ")) <= 3
    begins = F.coalesce(ends | (short(F.col("text")) & short(F.col("last.text"))), F.lit(False))
    rows = rows.withColumn("paragraph", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = rows.groupBy("version", "page", "sheet", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "line_id", "text"))).alias("t"))
    return parts.select("version", "page", "paragraph", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
