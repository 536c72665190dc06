"""Versions, visibility and access: what every read goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of every document: by created_at, then id, both falling. Repeated rows count once."""
    newest = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    return versions.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def documents(versions: DataFrame, records: DataFrame) -> DataFrame:
    """(document_id, knowledge_base_id, canonical_path, active_version_id, visible): the newest ready version is
    active, and a document whose newest version is deleted isn't visible. Base and path come from vector payloads and
    are null for a document without one."""
    ready = latest_versions(versions.filter("state = 'ready'")).select("document_id", F.col("id").alias("active_version_id"))
    state = latest_versions(versions).select("document_id", (F.col("state") != "deleted").alias("visible"))
    place = records.select("payload.document_id", "payload.knowledge_base_id", "payload.canonical_path").filter("document_id is not null")
    place = place.groupBy("document_id").agg(F.min(F.struct("canonical_path", "knowledge_base_id")).alias("p"))
    return state.join(ready, "document_id", "left").join(place, "document_id", "left").select("document_id", "p.knowledge_base_id", "p.canonical_path", "active_version_id", "visible")


def active_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of active versions of visible documents, one row per id, with document_id, knowledge_base_id, canonical_path."""
    shown = docs.filter("visible and active_version_id is not null").select("document_id", "knowledge_base_id", "canonical_path", F.col("active_version_id").alias("document_version_id"))
    return chunks.join(shown, "document_version_id").dropDuplicates(["id"])


def allowed(document_id: Column, allow: Column) -> Column:
    """Access: a null list allows every document, an empty one none."""
    return allow.isNull() | F.coalesce(F.array_contains(allow, document_id), F.lit(False))


def document_status(docs: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, state of the newest version, chunks of the active version (0 if none)."""
    n = chunks.dropDuplicates(["id"]).groupBy("document_version_id").agg(F.count("*").alias("n"))
    out = docs.join(latest_versions(versions).select("document_id", "state"), "document_id", "left")
    out = out.join(n, out["active_version_id"] == n["document_version_id"], "left")
    return out.select("document_id", "knowledge_base_id", "visible", "state", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def status_summary(status: DataFrame) -> DataFrame:
    """By knowledge base, over visible documents: documents, ready, failed, pending (any other state or none)."""
    state = F.coalesce("state", F.lit("no_version"))
    return (
        status.filter("visible")
        .groupBy("knowledge_base_id")
        .agg(F.count("*").alias("documents"), F.count_if(state == "ready").alias("ready"), F.count_if(state == "failed").alias("failed"), F.count_if(~state.isin("ready", "failed")).alias("pending"))
    )


def status_histogram(status: DataFrame) -> DataFrame:
    return status.groupBy(F.coalesce("state", F.lit("no_version")).alias("state")).agg(F.count("*").alias("documents"))


def under_path(path: Column, root: str) -> Column:
    """Whether a path is root or below it, ASCII case aside."""
    low, top = F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), root.rstrip("/").lower()
    return (low == top) | F.startswith(low, F.lit(top + "/"))


def index_consistency(chunks: DataFrame, records: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of counts that are all 0 in a sound index: chunks without vector, vectors without chunk, chunks without version."""
    c, v = chunks.select("id", "document_version_id").dropDuplicates(["id"]), records.select("id").distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        n(c.join(v, "id", "left_anti"), "chunks_without_vector"),
        n(v.join(c, "id", "left_anti"), "vectors_without_chunk"),
        n(c.join(versions.select(F.col("id").alias("document_version_id")), "document_version_id", "left_anti"), "chunks_without_version"),
    ]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))


def delete_knowledge_base(tables: dict[str, DataFrame], knowledge_base_id: str) -> dict[str, DataFrame]:
    """The tables without a knowledge base: its documents, their versions, chunks and vectors."""
    gone = tables["documents"].filter(F.col("knowledge_base_id") == knowledge_base_id).select("document_id")
    versions = tables["versions"].join(gone, "document_id", "left_semi").select(F.col("id").alias("document_version_id")).distinct()
    return {
        "documents": tables["documents"].join(gone, "document_id", "left_anti"),
        "versions": tables["versions"].join(gone, "document_id", "left_anti"),
        "chunks": tables["chunks"].join(versions, "document_version_id", "left_anti"),
        "vectors": tables["vectors"].filter(~F.coalesce(F.col("payload.knowledge_base_id") == knowledge_base_id, F.lit(False))),
    }
