"""Material for evaluation questions: segments, and those that one document only holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, USEFUL = 18, 180, 0.68


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, segment, key) of a table (doc_id, text): sentences and lines whose letters and digits, the key,
    number LEAST to MOST and make up USEFUL of the segment. Null texts give none; repeated segments of a document count once."""
    parts = F.explode(F.split("text", r"(?<=[.!?。！？])\s+|\n+"))
    df = documents.select("doc_id", parts.alias("segment")).withColumn("segment", F.trim("segment"))
    df = df.withColumn("key", F.regexp_replace(F.lower("segment"), r"[^\p{L}\p{N}]+", "")).filter(F.length("key").between(LEAST, MOST) & (F.length("key") >= USEFUL * F.length("segment")))
    return df.groupBy("doc_id", "key").agg(F.min("segment").alias("segment")).select("doc_id", "segment", "key")


def unique_segments(found: DataFrame) -> DataFrame:
    """Segments whose key is in exactly one document."""
    one = found.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("segment").alias("segment"))
    return one.filter("n = 1").select("doc_id", "segment", "key")
