"""Versioned artifact library and deliverable harvesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.display import file_suffix

VERSIONS_KEPT = 20
DELIVERABLE_MAX_BYTES = 20 * 1024 * 1024
FALLBACK_FILES = 8
# Fixed list: file types worth keeping from a task that declared no files.
HARVEST_SUFFIXES = [
    ".md", ".txt", ".avif", ".gif", ".jpeg", ".jpg", ".png", ".svg", ".webp",
    ".html", ".htm", ".json", ".csv", ".pdf", ".mp4", ".webm", ".mov",
]

VERSION_TYPE = (
    "struct<run_id: string, path: string, report_path: string, finished_at: string, "
    "outcome: string, tasks_pass: int, tasks_fail: int>"
)
ENTRY_TYPE = (
    "struct<live_path: string, state: string, identity: string, current_run_id: string, "
    f"updated_at: string, versions: array<{VERSION_TYPE}>>"
)
LIBRARY_TYPE = f"artifacts map<string, {ENTRY_TYPE}>"


def library_entries(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row per run name of library documents; garbage reads as empty."""
    parsed = documents.where(F.try_parse_json(body).isNotNull()).select(
        F.from_json(body, LIBRARY_TYPE).alias("l")
    )
    return parsed.select(F.explode("l.artifacts").alias("run_name", "e")).select("run_name", "e.*")


def library_versions(entries: DataFrame) -> DataFrame:
    """Kept versions with their place in the entry."""
    return entries.select("run_name", F.posexplode("versions").alias("pos", "v")).select(
        "run_name", "pos", "v.*"
    )


def latest_entries(updates: DataFrame) -> DataFrame:
    """Current entry per run name: the last writer wins, ties by run id."""
    fields = [c for c in updates.columns if c != "run_name"]
    return updates.groupBy("run_name").agg(
        F.max_by(F.struct(*fields), F.struct("updated_at", "run_id")).alias("e")
    ).select("run_name", "e.*")


def deduped_versions(versions: DataFrame) -> DataFrame:
    """One version per (run_name, run_id); a newer record replaces an older one."""
    fields = [c for c in versions.columns if c not in ("run_name", "run_id")]
    return versions.groupBy("run_name", "run_id").agg(
        F.max_by(F.struct(*fields), F.col("finished_at")).alias("v")
    ).select("run_name", "run_id", "v.*")


def kept_versions(versions: DataFrame, keep: int = VERSIONS_KEPT) -> DataFrame:
    """Newest ``keep`` versions per run name.

    The rank filter lets Spark prune each task's rows to ``keep`` per name before
    the shuffle, so a dominant name stays small.
    """
    newest = Window.partitionBy("run_name").orderBy(F.desc("finished_at"), F.desc("run_id"))
    return (
        deduped_versions(versions)
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= keep)
    )


def pruned_versions(versions: DataFrame, keep: int = VERSIONS_KEPT) -> DataFrame:
    """Versions older than the kept ones.

    Compared with the oldest kept version of their name instead of ranking the
    whole history of a name in one task.
    """
    cutoff = kept_versions(versions, keep).groupBy("run_name").agg(
        F.min(F.struct("finished_at", "run_id")).alias("_cut"), F.count("*").alias("_n")
    ).where(F.col("_n") == keep)
    older = F.struct("finished_at", "run_id") < F.col("_cut")
    return (
        deduped_versions(versions)
        .join(cutoff.repartition("run_name"), "run_name")
        .where(older)
        .drop("_cut", "_n")
    )


def reconcile(entries: DataFrame, active: DataFrame, now: str) -> DataFrame:
    """Live entries whose run is gone become ``died``, stamped ``now``."""
    live = active.select(F.col("run_id").alias("_r")).distinct()
    joined = entries.join(live, F.col("current_run_id") == F.col("_r"), "left")
    gone = (F.col("state") == "live") & (
        (F.coalesce("current_run_id", F.lit("")) == "") | F.col("_r").isNull()
    )
    flagged = joined.withColumn("changed", gone)
    return flagged.withColumns(
        {
            "state": F.when(F.col("changed"), "died").otherwise(F.col("state")),
            "updated_at": F.when(F.col("changed"), F.lit(now)).otherwise(F.col("updated_at")),
        }
    ).drop("_r")


def any_changed(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(F.coalesce(F.bool_or("changed"), F.lit(False)).alias("changed"))


def entry_order() -> list[Column]:
    return [F.desc("updated_at"), F.col("run_name")]


def sorted_entries(entries: DataFrame) -> DataFrame:
    return entries.orderBy(*entry_order())


def deliverable_totals(tasks: DataFrame) -> DataFrame:
    """Per run: delivered files and bytes, and the pass/fail tally of its version."""
    files = F.coalesce("deliverables", F.array())
    return tasks.groupBy("run_id").agg(
        F.sum(F.size(files)).alias("files"),
        F.sum(
            F.aggregate(files, F.lit(0).cast("bigint"), lambda total, d: total + d["bytes"])
        ).alias("bytes"),
        F.count_if(F.col("status") == "passed").alias("tasks_pass"),
        F.count_if(F.col("status").isin("failed", "timeout")).alias("tasks_fail"),
    )


def harvest(tasks: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """Deliverables of passed tasks.

    A task with an expected list delivers the listed files that exist.  Without
    one, a plain task directory gives its first few visible files of a known type
    by name; a worktree gives none.  Files above the size limit stay in the
    result as ``oversized`` (after the cap, so they do use up a place).
    """
    key = ["run_id", "task_key"]
    listed = expected.select(*key).distinct().withColumn("_listed", F.lit(True))
    plain = tasks.join(listed, key, "left").where(F.col("_listed").isNull() & ~F.col("worktrees"))
    visible = files.where(
        ~F.col("name").startswith(".") & file_suffix(F.col("name")).isin(*HARVEST_SUFFIXES)
    ).join(plain.select(*key).repartition(*key), key, "left_semi")
    by_name = Window.partitionBy(*key).orderBy("name")
    fallback = (
        visible.withColumn("_rank", F.row_number().over(by_name))
        .where(F.col("_rank") <= FALLBACK_FILES)
        .select(*key, "name", "bytes")
    )
    declared = expected.join(files, [*key, "name"]).join(tasks.select(*key), key, "left_semi")
    return declared.select(*key, "name", "bytes").unionByName(fallback).withColumn(
        "oversized", F.col("bytes") > DELIVERABLE_MAX_BYTES
    )


def harvest_cuts(tasks: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """How many files the cap left out, per task it was applied to."""
    key = ["run_id", "task_key"]
    listed = expected.select(*key).distinct()
    plain = tasks.where(~F.col("worktrees")).join(listed, key, "left_anti")
    visible = files.where(
        ~F.col("name").startswith(".") & file_suffix(F.col("name")).isin(*HARVEST_SUFFIXES)
    ).join(plain.select(*key), key, "left_semi")
    totals = visible.groupBy(*key).agg(F.count("*").alias("found"))
    return totals.where(F.col("found") > FALLBACK_FILES).withColumn("kept", F.lit(FALLBACK_FILES))
