"""Structured Streaming twins: new files, idempotent jobs, event windows, state of a path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, root: str, per_batch: int = 16) -> DataFrame:
    """A stream of files that appear below root, as read_files gives them."""
    from quillspark.operators.sync import supported

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_batch)).load(root)
    return files.filter(supported(F.col("path"))).select("path", F.col("length").alias("size_bytes"), "modificationTime", F.sha2("content", 256).alias("sha256"), "content")


def unique_jobs(jobs: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream of jobs (job_key, created_at) with each key once within the lateness."""
    return jobs.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["job_key"])


def event_windows(events: DataFrame, length: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type; works on batches as well."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    size, sha = state.get if state.exists else (None, None)
    out = []
    for batch in batches:
        for row in batch.sort_values("seen_at").itertuples():
            event = "add" if sha is None else "unchanged" if (size, sha) == (row.size_bytes, row.sha256) else "update"
            size, sha = row.size_bytes, row.sha256
            out.append((key[0], event, row.sha256))
    state.update((size, sha))
    yield pd.DataFrame(out, columns=["path", "event", "sha256"])


def path_changes(observations: DataFrame) -> DataFrame:
    """A stream of observations (path, seen_at, size_bytes, sha256) to events (path, event, sha256) by the path's last state."""
    return observations.groupBy("path").applyInPandasWithState(_changes, "path string, event string, sha256 string", "size_bytes long, sha256 string", "append", "NoTimeout")
