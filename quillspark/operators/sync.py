"""Change detection between snapshots, and the job queue it feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUPPORTED = (".txt", ".md", ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xlsm", ".xls", ".zip", ".tar", ".gz", ".rar", ".7z")  # fixed values


def supported(path: Column) -> Column:
    """Whether a file is taken up: known suffix, no lock or resource file."""
    from quillspark.functions.text import file_name, suffix

    return suffix(path).isin(*SUPPORTED) & ~F.startswith(file_name(path), F.lit("~$")) & ~F.startswith(file_name(path), F.lit("._"))


def reconcile(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Events (path, event, old_path, document_id) that lead from the known documents to the files seen.

    known: path, document_id, size_bytes, mtime_ns, sha256, failed (the newest version failed), active_sha256;
    seen: path, size_bytes, mtime_ns, sha256. A file of known size and time is unchanged, so is one whose
    content is the active one or the latest, failed one; other known files are updates. A new path whose content
    is active under a path no longer seen is a move (the smallest such path); other new paths are adds. Known
    paths neither seen nor moved are deletes.
    """
    k = known.select(F.col("path"), "document_id", F.col("size_bytes").alias("k_size"), F.col("mtime_ns").alias("k_time"), F.col("sha256").alias("k_sha"), "failed", "active_sha256")
    both = seen.join(k, "path", "full_outer")
    here = both.filter(F.col("sha256").isNotNull() & F.col("document_id").isNotNull())
    same = ((F.col("size_bytes") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_time"))) | F.coalesce(F.col("sha256") == F.col("active_sha256"), F.lit(False)) | ((F.col("sha256") == F.col("k_sha")) & F.col("failed"))
    changed = here.select("path", F.when(same, "unchanged").otherwise("update").alias("event"), F.lit(None).cast("string").alias("old_path"), "document_id")
    new, gone = both.filter(F.col("document_id").isNull()), both.filter(F.col("sha256").isNull())
    # Of equal contents, the n-th new path takes the n-th path that is gone.
    order = lambda sha: Window.partitionBy(sha).orderBy("path")
    old = gone.filter("active_sha256 is not null").select(F.col("active_sha256").alias("sha256"), F.row_number().over(order("active_sha256")).alias("n"), F.col("path").alias("old_path"), "document_id")
    added = new.select("path", "sha256", F.row_number().over(order("sha256")).alias("n")).join(old, ["sha256", "n"], "left")
    added = added.select("path", F.when(F.col("old_path").isNotNull(), "move").otherwise("add").alias("event"), "old_path", "document_id")
    moved = added.filter("event = 'move'").select(F.col("old_path").alias("path"))
    deleted = gone.join(moved, "path", "left_anti").select("path", F.lit("delete").alias("event"), F.lit(None).cast("string").alias("old_path"), "document_id")
    return changed.unionByName(added).unionByName(deleted)


def job_key(knowledge_base_id: Column, operation: Column, path: Column, sha256: Column) -> Column:
    """The key that makes a job idempotent."""
    return F.sha2(F.concat_ws("\u001f", knowledge_base_id, F.upper(operation), path, F.coalesce(sha256, F.lit(""))), 256)


def forced_job_key(key: Column, token: Column) -> Column:
    """The key of a job that is queued whatever is known of it; the token is new each time."""
    return F.sha2(F.concat_ws("\u001f", key, token), 256)


def upsert_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with the new ones queued; of a known key only a failed job is queued again, its error cleared."""
    known = jobs.join(new.select("job_key").distinct().withColumn("_again", F.lit(True)), "job_key", "left")
    again = F.coalesce("_again", F.lit(False)) & (F.col("state") == "failed")
    known = known.withColumn("error", F.when(~again, F.col("error"))).withColumn("state", F.when(again, "queued").otherwise(F.col("state"))).drop("_again")
    fresh = new.dropDuplicates(["job_key"]).join(jobs.select("job_key"), "job_key", "left_anti")
    fresh = fresh.withColumn("state", F.lit("queued")).withColumn("attempts", F.lit(0)).withColumn("error", F.lit(None).cast("string"))
    return known.unionByName(fresh, allowMissingColumns=True)


def lease_jobs(jobs: DataFrame, owner: str, most: int = 16) -> DataFrame:
    """Jobs with the ``most`` oldest queued ones leased to the owner."""
    taken = jobs.filter("state = 'queued'").orderBy("created_at", "job_key").limit(most).select("job_key", F.lit(True).alias("_taken"))
    out = jobs.join(taken, "job_key", "left")
    is_taken = F.coalesce("_taken", F.lit(False))
    return out.withColumns({"state": F.when(is_taken, "leased").otherwise(F.col("state")), "attempts": F.col("attempts") + is_taken.cast("int"), "lease_owner": F.when(is_taken, F.lit(owner)).otherwise(F.col("lease_owner"))}).drop("_taken")


def release_jobs(jobs: DataFrame) -> DataFrame:
    """Every leased job queued again, as after a crash."""
    leased = F.col("state") == "leased"
    return jobs.withColumns({"lease_owner": F.when(~leased, F.col("lease_owner")), "state": F.when(leased, "queued").otherwise(F.col("state"))})


def runnable_jobs(jobs: DataFrame, knowledge_base_id: str | None = None) -> DataFrame:
    """Queued jobs, of one base if given, with place: their order by created_at, then key, base by base."""
    queued = jobs.filter("state = 'queued'")
    queued = queued if knowledge_base_id is None else queued.filter(F.col("knowledge_base_id") == knowledge_base_id)
    return queued.withColumn("place", F.row_number().over(Window.partitionBy("knowledge_base_id").orderBy("created_at", "job_key")))


def finish_jobs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with their results (job_key, error): succeeded without an error, failed with one, their lease given back.

    Only queued and leased jobs can finish; a result for another one changes nothing and sets refused. Of several results of a job an error wins.
    """
    one = results.groupBy("job_key").agg(F.max("error").alias("_error"), F.lit(True).alias("_done"))
    out = jobs.join(one, "job_key", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    ends = F.col("_done") & F.col("state").isin("queued", "leased")
    out = out.withColumn("refused", F.col("_done") & ~ends)
    changed = {
        "error": F.when(ends, F.col("_error")).otherwise(F.col("error")),
        "lease_owner": F.when(~ends, F.col("lease_owner")),
        "state": F.when(ends, F.when(F.col("_error").isNull(), "succeeded").otherwise("failed")).otherwise(F.col("state")),
    }
    return out.withColumns(changed).drop("_error", "_done")


def reindex_jobs(documents: DataFrame, versions: DataFrame, only_failed: bool = False) -> DataFrame:
    """A job for each visible document (document_id, knowledge_base_id, canonical_path, active_version_id, visible) that has a
    version: job_key, document_id, operation, path, sha256, version_id, again (its failed version is pending again).

    The active version counts, else the newest. A document with an active version is indexed anew under a
    forced key, another is added. ``only_failed`` takes the documents whose newest version failed.
    """
    from quillspark.operators.catalog import latest_versions

    newest = latest_versions(versions).select("document_id", F.col("id").alias("n_id"), F.col("sha256").alias("n_sha"), F.col("state").alias("n_state"))
    active = versions.select(F.col("id").alias("active_version_id"), F.col("sha256").alias("a_sha"), F.col("state").alias("a_state")).dropDuplicates(["active_version_id"])
    rows = documents.filter("visible").join(newest, "document_id").join(active, "active_version_id", "left")
    rows = rows.filter("n_state = 'failed'") if only_failed else rows
    has = F.col("a_sha").isNotNull()
    sha, operation = F.when(has, F.col("a_sha")).otherwise(F.col("n_sha")), F.when(has, "reindex").otherwise("add")
    version, state = F.when(has, F.col("active_version_id")).otherwise(F.col("n_id")), F.when(has, F.col("a_state")).otherwise(F.col("n_state"))
    key = job_key(F.col("knowledge_base_id"), operation, F.col("canonical_path"), sha)
    return rows.select(F.when(has, forced_job_key(key, version)).otherwise(key).alias("job_key"), "document_id", operation.alias("operation"), F.col("canonical_path").alias("path"), sha.alias("sha256"), version.alias("version_id"), (state == "failed").alias("again"))


def move_documents(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """Documents with the paths of moves (document_id, path); of several moves of a document the greatest path."""
    to = moves.groupBy("document_id").agg(F.max("path").alias("_to"))
    return documents.join(to, "document_id", "left").withColumn("canonical_path", F.coalesce("_to", "canonical_path")).drop("_to")


def refresh_fingerprints(versions: DataFrame, seen: DataFrame) -> DataFrame:
    """Versions with the size and time of files seen (id, size_bytes, mtime_ns) whose content is the same."""
    now = seen.groupBy("id").agg(F.max(F.struct("mtime_ns", "size_bytes")).alias("_s"))
    out = versions.join(now, "id", "left")
    return out.withColumns({c: F.coalesce(f"_s.{c}", c) for c in ("size_bytes", "mtime_ns")}).drop("_s")


def store_parsed(versions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Versions with what parsing found (id, parser_version, layout_version, document_type, document_structure_tree); null fields there clear."""
    fields = ("parser_version", "layout_version", "document_type", "document_structure_tree")
    new = parsed.groupBy("id").agg(F.max(F.struct(*fields)).alias("_p"))
    out = versions.join(new, "id", "left")
    return out.withColumns({c: F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(c)) for c in fields}).drop("_p")


def stable_files(observations: DataFrame) -> DataFrame:
    """Observations (path, seen_at, size_bytes, mtime_ns) with stable: nothing changed since the one before."""
    before = Window.partitionBy("path").orderBy("seen_at")
    same = (F.lag("size_bytes").over(before) == F.col("size_bytes")) & (F.lag("mtime_ns").over(before) == F.col("mtime_ns"))
    return observations.withColumn("stable", F.coalesce(same, F.lit(False)))


def keep_latest(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace: of all rows of a key, that of the latest change."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return table.unionByName(changes).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
