"""Neighbouring chunks of hits, and the runs they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(anchors: DataFrame, chunks: DataFrame, radius: int, most: int = 12) -> DataFrame:
    """Chunks of the anchor's version within the radius, and, if the anchor has a section, of that section.

    anchors: anchor_id, document_version_id, chunk_index, section_path. Result: anchor_id, anchor_index, id,
    document_version_id, chunk_index, text, at most max(most, 2 radius + 1) by distance, then index. The band is
    an equi-join on (version, index), the anchor's indexes being listed, so a hot version spreads over its indexes.
    """
    a = anchors.select("anchor_id", "document_version_id", F.col("chunk_index").alias("anchor_index"), F.col("section_path").alias("section"))
    a = a.withColumn("chunk_index", F.explode(F.sequence(F.col("anchor_index") - radius, F.col("anchor_index") + radius)))
    c = chunks.select("id", "document_version_id", "chunk_index", "section_path", "text")
    near = a.join(c, ["document_version_id", "chunk_index"]).filter((F.coalesce(F.size("section"), F.lit(0)) <= 0) | F.col("section").eqNullSafe(F.col("section_path")))
    order = Window.partitionBy("anchor_id").orderBy(F.abs(F.col("chunk_index") - F.col("anchor_index")), "chunk_index", "id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(most, 2 * radius + 1))
    return near.select("anchor_id", "anchor_index", "id", "document_version_id", "chunk_index", "text")


def label(offset: Column) -> Column:
    """Where a chunk stands relative to the hit."""
    before, after = F.concat(F.lit("前文第 "), -offset, F.lit(" 块")), F.concat(F.lit("后文第 "), offset, F.lit(" 块"))
    return F.when(offset == 0, "命中块").when(offset < 0, before).otherwise(after)


def segments(near: DataFrame, query: list[str] | None = None) -> DataFrame:
    """Runs of consecutive chunks over all anchors of a version: document_version_id, first_index, last_index,
    chunks, text (each chunk once, labelled by its distance to the first anchor of the run)."""
    keys = [*(query or []), "document_version_id"]
    one = near.groupBy(*keys, "chunk_index").agg(F.min("text").alias("text"), F.min("anchor_index").alias("anchor_index"))
    run = F.col("chunk_index") - F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_index"))
    one = one.withColumn("run", run).withColumn("anchor", F.min("anchor_index").over(Window.partitionBy(*keys, "run")))
    part = F.concat(F.lit("【"), label(F.col("chunk_index") - F.col("anchor")), F.lit("】\n"), "text")
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("part"))))
    out = one.groupBy(*keys, "run").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("chunks"), rows.alias("rows"))
    return out.select(*keys, "first_index", "last_index", "chunks", F.array_join(F.transform("rows", lambda x: x["part"]), "\n\n").alias("text"))
