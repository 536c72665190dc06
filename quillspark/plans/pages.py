"""Queries of parsing, page layout and event streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import layout
from quillspark.sources import parsers
from quillspark.sources.tables import table
from quillspark.streaming import feed


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_blocks").dropDuplicates(["block_id"])


def blocks_outside_tables(s, d):
    return layout.outside_tables(_blocks(s, d)).select("block_id")


def reading_order(s, d):
    return layout.reading_order(_blocks(s, d)).select("block_id", "place")


def block_roles(s, d):
    return layout.classify(_blocks(s, d)).select("block_id", "role", "level")


def _sectioned(s, d) -> DataFrame:
    return layout.sections(layout.reading_order(layout.classify(_blocks(s, d))))


def block_sections(s, d):
    return _sectioned(s, d).select("block_id", F.array_join("section", " / ").alias("section"))


def section_pages(s, d):
    return layout.section_pages(_sectioned(s, d))


def image_regions(s, d):
    return layout.image_regions(_blocks(s, d).filter("block_type = 'image'"))


def image_captions(s, d):
    b = _blocks(s, d)
    return layout.captions(b.filter("block_type = 'image'"), b)


def ocr_tables(s, d):
    return layout.ocr_tables(table(s, d, "ocr_text_blocks").dropDuplicates(["ocr_id"]))


def new_ocr_lines(s, d):
    native = _blocks(s, d).filter("source_type = 'native_text'")
    return layout.new_ocr(table(s, d, "ocr_text_blocks").dropDuplicates(["ocr_id"]), native).groupBy("document_version_id").agg(F.count("*").alias("lines"))


def chunk_previews(s, d):
    c = table(s, d, "chunks").dropDuplicates(["id"])
    return layout.preview(c, c.select("id", "document_version_id", "chunk_index"))


def parsed_documents(s, d):
    """The documents as Markdown files, parsed to blocks."""
    files = table(s, d, "documents").select(F.concat("doc_id", F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("content"))
    return parsers.parse_files(files).select("path", "block_no", "block_type", "heading_level", F.md5("text").alias("text_md5"), F.array_join("section_path", " / ").alias("section"))


def event_windows(s, d):
    return feed.event_windows(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(s, d):
    return feed.user_sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (blocks_outside_tables, reading_order, block_roles, block_sections, section_pages, image_regions, image_captions, ocr_tables, new_ocr_lines, chunk_previews, parsed_documents, event_windows, user_sessions)
}

_B = "b AS (SELECT DISTINCT ON (block_id) * FROM layout_blocks)"
_AREA = "greatest({0}.x1 - {0}.x0, 0) * greatest({0}.y1 - {0}.y0, 0)"
_COMMON = "greatest(least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0), 0) * greatest(least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0), 0)"
_KEY = r"left(regexp_replace(regexp_replace(lower({0}), '\d+', '#', 'g'), '\s+', '', 'g'), 160)"
SQL = {
    "blocks_outside_tables": f"""WITH {_B}, t AS (SELECT document_version_id, page_no, bbox AS t FROM b WHERE block_type = 'table' AND bbox IS NOT NULL),
        c AS (SELECT block_id FROM b JOIN t USING (document_version_id, page_no) WHERE block_type <> 'table' AND bbox IS NOT NULL AND ({_COMMON.format('bbox', 't')}) / greatest({_AREA.format('bbox')}, 1) >= 0.5)
        SELECT block_id FROM b WHERE block_id NOT IN (SELECT block_id FROM c)""",
    "reading_order": f"""WITH {_B}, w AS (SELECT *, max(bbox.x1) OVER p - min(bbox.x0) OVER p AS w, (max(bbox.x1) OVER p + min(bbox.x0) OVER p) / 2 AS mid, coalesce(bbox.y0, 0) AS y, coalesce(bbox.x0, 0) AS x FROM b WINDOW p AS (PARTITION BY document_version_id, page_no)),
        v AS (SELECT *, coalesce(bbox.x1 - bbox.x0 >= 0.65 * w, true) AS wide FROM w),
        n AS (SELECT *, sum(wide::INT) OVER (PARTITION BY document_version_id, page_no ORDER BY y, x, block_id) * 2 + (NOT wide)::INT AS band, CASE WHEN wide THEN 0 WHEN bbox.x1 <= mid + 0.04 * w THEN 1 WHEN bbox.x0 >= mid - 0.04 * w THEN 2 END AS side FROM v),
        c AS (SELECT *, CASE WHEN count(*) FILTER (side = 1) OVER q >= 2 AND count(*) FILTER (side = 2) OVER q >= 2 AND count(*) FILTER (side IS NULL) OVER q = 0 THEN side ELSE 0 END AS col FROM n WINDOW q AS (PARTITION BY document_version_id, page_no, band))
        SELECT block_id, row_number() OVER (PARTITION BY document_version_id, page_no ORDER BY band, col, round(y, 1), x, block_id) AS place FROM c""",
    "image_captions": f"""WITH {_B}, t AS (SELECT document_version_id, page_no, text AS caption, bbox AS t, block_id AS text_id FROM b WHERE block_type <> 'image' AND bbox IS NOT NULL AND trim(text) <> ''),
        p AS (SELECT b.block_id, t.caption, text_id, greatest(t.y0 - bbox.y1, bbox.y0 - t.y1, 0) AS gap, CASE WHEN regexp_matches(t.caption, '^\\s*(图 ?\\d|(?i:figure|fig\\.) ?\\d)') THEN 100 ELSE 0 END AS bonus
              FROM b JOIN t USING (document_version_id, page_no) WHERE block_type = 'image' AND bbox IS NOT NULL AND least(t.x1, bbox.x1) > greatest(t.x0, bbox.x0))
        SELECT block_id, arg_max(caption, {{'s': bonus - gap, 'i': -text_id}}) AS caption FROM p WHERE gap <= 90 GROUP BY 1""",
    "new_ocr_lines": f"""WITH {_B}, n AS (SELECT DISTINCT document_version_id, page_no, {_KEY.format('text')} AS k FROM b WHERE source_type = 'native_text'), o AS (SELECT DISTINCT ON (ocr_id) *, {_KEY.format('text')} AS k FROM ocr_text_blocks),
        u AS (SELECT DISTINCT o.document_version_id, o.page_no, o.k, round(bbox.x0, 1) AS a, round(bbox.y0, 1) AS b, round(bbox.x1, 1) AS c, round(bbox.y1, 1) AS d FROM o ANTI JOIN n ON n.document_version_id = o.document_version_id AND n.page_no = o.page_no AND n.k = o.k)
        SELECT document_version_id, count(*) AS lines FROM u GROUP BY 1""",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "user_sessions": """WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
        n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
}
