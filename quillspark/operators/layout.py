"""Page geometry: tables over text, reading order, headers and footers, headings, sections, image regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE, TOLERANCE, MARGIN, COVERED = 0.65, 0.04, 0.1, 0.5


def area(box: Column) -> Column:
    return F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["y1"] - box["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def outside_tables(blocks: DataFrame) -> DataFrame:
    """The blocks without those that lie by half of their area, or more, in a table of their page."""
    page = ["document_version_id", "page_no"]
    tables = blocks.filter("block_type = 'table' and bbox is not null").select(*page, F.col("bbox").alias("_t"))
    covered = blocks.filter("block_type != 'table' and bbox is not null").join(tables, page).filter(intersection(F.col("bbox"), F.col("_t")) / F.greatest(area(F.col("bbox")), F.lit(1.0)) >= COVERED)
    return blocks.join(covered.select("block_id").distinct(), "block_id", "left_anti")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds place: the order on the page. Blocks of WIDE of the page's width or more part it into bands; a band
    that falls into two columns, each of two blocks or more, is read column by column, else by line."""
    page = Window.partitionBy("document_version_id", "page_no")
    b, left, right = F.col("bbox"), F.min("bbox.x0").over(page), F.max("bbox.x1").over(page)
    df = blocks.withColumn("_w", right - left).withColumn("_mid", (right + left) / 2)
    df = df.withColumn("_wide", F.coalesce((b["x1"] - b["x0"]) >= WIDE * F.col("_w"), F.lit(True)))
    above = page.orderBy(F.coalesce(b["y0"], F.lit(0.0)), F.coalesce(b["x0"], F.lit(0.0)), "block_id")
    df = df.withColumn("_band", F.sum(F.col("_wide").cast("int")).over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow)) * 2 + (~F.col("_wide")).cast("int"))
    room = TOLERANCE * F.col("_w")
    side = F.when(F.col("_wide"), 0).when(b["x1"] <= F.col("_mid") + room, 1).when(b["x0"] >= F.col("_mid") - room, 2)
    band = Window.partitionBy("document_version_id", "page_no", "_band")
    df = df.withColumn("_side", side)
    n = lambda s: F.sum(F.when(F.col("_side") == s, 1).otherwise(0)).over(band)
    two = (n(1) >= 2) & (n(2) >= 2) & (F.sum(F.col("_side").isNull().cast("int")).over(band) == 0)
    df = df.withColumn("_column", F.when(two, F.col("_side")).otherwise(0))
    order = page.orderBy("_band", "_column", F.round(F.coalesce(b["y0"], F.lit(0.0)), 1), F.coalesce(b["x0"], F.lit(0.0)), "block_id")
    return df.withColumn("place", F.row_number().over(order)).drop("_w", "_mid", "_wide", "_band", "_side", "_column")


def recurring_key(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"\s+", ""), 1, 160)


def classify(blocks: DataFrame, page_height: float = 842.0) -> DataFrame:
    """Adds role (header, footer, page_number, list, heading, body) and level.

    Text in the top or bottom tenth that recurs on two pages or more is header or footer. The body's font size is
    the median over texts of 20 characters or more; short texts 1.16 times as large, or bold and 1.02 times, are
    headings, their level from the numbering, else from the rank of their size.
    """
    df = blocks.withColumn("_key", recurring_key(F.col("text")))
    zone = F.when(F.col("bbox.y1") <= MARGIN * page_height, "header").when(F.col("bbox.y0") >= (1 - MARGIN) * page_height, "footer")
    df = df.withColumn("_zone", zone)
    often = df.filter("_zone is not null").groupBy("document_version_id", "_zone", "_key").agg(F.count_distinct("page_no").alias("_pages"))
    size = df.filter(F.length("text") >= 20).groupBy("document_version_id").agg(F.percentile("font_size", 0.5).alias("_body"))
    df = df.join(often, ["document_version_id", "_zone", "_key"], "left").join(size, "document_version_id", "left")
    number = F.trim("text").rlike(r"^[-–—\[( ]*(?:[Pp]age |第 ?)?\d{1,4}(?: ?/ ?\d{1,4})?(?: ?页)?[-–—\]) ]*$")
    large = F.col("font_size") >= 1.16 * F.col("_body")
    bold = F.coalesce(F.col("is_bold"), F.lit(False)) & (F.col("font_size") >= 1.02 * F.col("_body"))
    role = (
        F.when(F.col("_zone").isNotNull() & number, "page_number")
        .when(F.col("_pages") >= 2, F.col("_zone"))
        .when(F.col("text").rlike(r"^\s*(?:[-*•]|\d+[.)、])\s+\S"), "list")
        .when((large | bold) & (F.length("text") <= 120), "heading")
        .otherwise("body")
    )
    df = df.withColumn("role", role)
    rank = F.least(F.dense_rank().over(Window.partitionBy("document_version_id", "role").orderBy(F.desc("font_size"))), F.lit(6))
    numbered = F.length(F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)[.\s]", 1)) > 0
    depth = F.size(F.split(F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)", 1), r"\."))
    return df.withColumn("level", F.when(F.col("role") == "heading", F.when(numbered, F.least(depth, F.lit(6))).otherwise(rank))).drop("_key", "_zone", "_pages", "_body")


def sections(blocks: DataFrame) -> DataFrame:
    """Adds section: the headings in force, by level, at each block of (document_version_id, page_no, place, level, text).

    A heading ends those of its level and deeper. Running frames of a document version; one version is one file.
    """
    upto = Window.partitionBy("document_version_id").orderBy("page_no", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("document_version_id").orderBy("page_no", "place")))
    held = [F.last(F.when(F.col("level") == k, F.struct("_n", "text")), ignorenulls=True).over(upto) for k in range(1, 7)]
    ended = [F.last(F.when(F.col("level") < k, F.col("_n")), ignorenulls=True).over(upto) for k in range(1, 7)]
    alive = [F.when(h["_n"] > F.coalesce(e, F.lit(0)), h["text"]) for h, e in zip(held, ended)]
    return df.withColumn("section", F.array_compact(F.array(*alive))).drop("_n")


def section_pages(blocks: DataFrame) -> DataFrame:
    """document_version_id, section, first_page, last_page, blocks."""
    return blocks.filter(F.size("section") > 0).groupBy("document_version_id", "section").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("blocks"))


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Unites regions that overlap by 0.8 of the smaller, larger ones first."""
    boxes = sorted(([r.x0, r.y0, r.x1, r.y1] for r in group.itertuples()), key=lambda b: -(b[2] - b[0]) * (b[3] - b[1]))
    out: list[list[float]] = []
    size = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    for b in boxes:
        for o in out:
            common = size([max(b[0], o[0]), max(b[1], o[1]), min(b[2], o[2]), min(b[3], o[3])])
            if common >= 0.8 * min(size(b), size(o)):
                o[:] = [min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3])]
                break
        else:
            out.append(list(b))
    merged = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1"])
    merged.insert(0, "page_no", group["page_no"].iloc[0])
    merged.insert(0, "document_version_id", group["document_version_id"].iloc[0])
    return merged


def image_regions(images: DataFrame) -> DataFrame:
    """Regions (document_version_id, page_no, x0, y0, x1, y1) of 8 points or more a side, united where they overlap."""
    rows = images.filter("bbox is not null").select("document_version_id", "page_no", "bbox.*").filter("x1 - x0 >= 8 and y1 - y0 >= 8")
    return rows.groupBy("document_version_id", "page_no").applyInPandas(_merge, "document_version_id string, page_no int, x0 double, y0 double, x1 double, y1 double")


def captions(images: DataFrame, blocks: DataFrame, most: float = 90.0) -> DataFrame:
    """block_id and caption of images: the nearest text of the page within ``most`` points that overlaps in x; one
    that begins like a caption goes before nearer ones."""
    text = blocks.filter("block_type != 'image' and bbox is not null and trim(text) != ''").select("document_version_id", "page_no", F.col("text").alias("caption"), F.col("bbox").alias("t"), F.col("block_id").alias("text_id"))
    both = images.filter("bbox is not null").select("block_id", "document_version_id", "page_no", "bbox").join(text, ["document_version_id", "page_no"])
    gap = F.greatest(F.col("t.y0") - F.col("bbox.y1"), F.col("bbox.y0") - F.col("t.y1"), F.lit(0.0))
    both = both.withColumn("gap", gap).filter((F.col("gap") <= most) & (F.least("t.x1", "bbox.x1") > F.greatest("t.x0", "bbox.x0")))
    score = F.when(F.col("caption").rlike(r"^\s*(?:图 ?\d|(?i:figure|fig\.) ?\d)"), 100.0).otherwise(0.0) - F.col("gap")
    return both.groupBy("block_id").agg(F.max_by("caption", F.struct(score, -F.col("text_id"))).alias("caption"))


def _ocr_tables(group: pd.DataFrame) -> pd.DataFrame:
    """Cells of a page to rows and columns, by the tolerances of row and column."""
    from statistics import median

    from quillspark.sources.parsers import markdown_table

    cells = sorted(group.itertuples(), key=lambda c: ((c.y0 + c.y1) / 2, c.x0))
    height, width = median(c.y1 - c.y0 for c in cells), median(c.x1 - c.x0 for c in cells)
    rows: list[list] = []
    for c in cells:
        middle = (c.y0 + c.y1) / 2
        if rows and abs(middle - sum((x.y0 + x.y1) / 2 for x in rows[-1]) / len(rows[-1])) <= max(5.0, 0.75 * height):
            rows[-1].append(c)
        else:
            rows.append([c])
    tolerance = min(36.0, max(12.0, 0.9 * width))
    starts: list[list[float]] = []
    for x in sorted(c.x0 for r in rows for c in r):
        if starts and x - starts[-1][-1] <= tolerance:
            starts[-1].append(x)
        else:
            starts.append([x])
    columns = [sum(s) / len(s) for s in starts if len(s) >= max(2, (3 * len(rows) + 4) // 5)]
    table = None
    if len(columns) >= 2:
        grid = [[""] * len(columns) for _ in rows]
        for i, r in enumerate(rows):
            for c in sorted(r, key=lambda c: c.x0):
                k = min(range(len(columns)), key=lambda k: abs(columns[k] - c.x0))
                grid[i][k] = f"{grid[i][k]} {c.text}".strip()
        if sum(sum(map(bool, r)) > 1 for r in grid) >= max(2, (3 * len(grid) + 3) // 4):
            table = markdown_table(grid)
    return pd.DataFrame({"document_version_id": [group["document_version_id"].iloc[0]], "page_no": [group["page_no"].iloc[0]], "cells": [len(cells)], "table_markdown": [table]})


def ocr_tables(cells: DataFrame) -> DataFrame:
    """document_version_id, page_no, cells, table_markdown (null if the cells form no table) of recognised cells."""
    rows = cells.filter("bbox is not null and trim(text) != ''").select("document_version_id", "page_no", "text", "bbox.*")
    return rows.groupBy("document_version_id", "page_no").applyInPandas(_ocr_tables, "document_version_id string, page_no int, cells int, table_markdown string")


def new_ocr(ocr: DataFrame, native: DataFrame) -> DataFrame:
    """Recognised blocks whose text isn't on the page already, equal ones at one place once."""
    key = ["document_version_id", "page_no", "_key"]
    seen = native.withColumn("_key", recurring_key(F.col("text"))).select(*key).distinct()
    at = F.transform(F.array(*(F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1"))), lambda x: F.round(x, 1))
    return ocr.withColumn("_key", recurring_key(F.col("text"))).join(seen, key, "left_anti").withColumn("_at", at).dropDuplicates([*key, "_at"]).drop("_key", "_at")


def preview(chunks: DataFrame, focus: DataFrame) -> DataFrame:
    """(id, html) of chunks in focus with one neighbour on either side, escaped and marked."""
    from quillspark.functions.text import html_escape
    from quillspark.operators.context import neighbours

    near = neighbours(focus.select(F.col("id").alias("anchor_id"), "document_version_id", "chunk_index", F.array().cast("array<string>").alias("section_path")), chunks, 1)
    part = F.concat(F.when(F.col("id") == F.col("anchor_id"), "<mark>").otherwise("<p>"), html_escape(F.col("text")), F.when(F.col("id") == F.col("anchor_id"), "</mark>").otherwise("</p>"))
    out = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("h")))).alias("p"))
    return out.select(F.col("anchor_id").alias("id"), F.array_join(F.transform("p", lambda x: x["h"]), "\n").alias("html"))
