"""Run states: roll-ups, outcomes, orphans, indexes and plain-language summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import clock, status

RECENT_RUNS = 12


def parse_run_states(documents: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Rows from one-document JSON texts; malformed ones and those without run_id drop out."""
    parsed = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    others = [c for c in documents.columns if c != body]
    # Behind the explode no filter is pushed before the parsing, which would parse again.
    return (
        documents.select(*others, F.explode_outer(F.array(parsed)).alias("_s"))
        .where(F.coalesce(F.col("_s.run_id"), F.lit("")) != "")
        .select(*others, "_s.*")
    )


def tasks_of(states: DataFrame) -> DataFrame:
    """One row per task of a nested run state, with its position."""
    return states.select("run_id", F.posexplode("tasks").alias("pos", "t")).select(
        "run_id", "pos", F.col("t.key").alias("task_key"), F.expr("t.*")
    ).drop("key")


def run_counts(tasks: DataFrame) -> DataFrame:
    """Tally of display buckets per run."""
    kind = status.status_kind(F.col("status"), F.col("attempt"))
    kinds = tasks.select("run_id", kind.alias("kind"))
    names = {"pass": "passed", "fail": "failed"}
    return kinds.groupBy("run_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("kind") == k).alias(names.get(k, k)) for k in status.KINDS],
    )


def with_counts(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with their tallies; a run without tasks has zeros."""
    counts = run_counts(tasks)
    tallies = [c for c in counts.columns if c != "run_id"]
    joined = runs.join(counts, "run_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in tallies})


def flag_orphans(runs: DataFrame, active: DataFrame | None) -> DataFrame:
    """``died``: not done and not active.  Without a readable active table nothing is flagged."""
    if active is None:
        return runs.withColumn("died", F.lit(False))
    live = active.select("run_id").distinct().withColumn("_active", F.lit(True))
    died = ~F.col("done") & F.col("_active").isNull()
    return runs.join(live, "run_id", "left").withColumn("died", died).drop("_active")


def outcomes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("outcome", status.run_outcome(F.col("done"), F.col("failed")))


def all_passed(results: DataFrame) -> DataFrame:
    """A run passes only when every task's verdict is PASS."""
    return results.groupBy("run_id").agg(
        F.bool_and(F.col("verdict") == "PASS").alias("all_passed"), F.count("*").alias("tasks")
    )


def recent_runs(
    runs: DataFrame, active: DataFrame | None, modified: str, limit: int = RECENT_RUNS
) -> DataFrame:
    """Newest states by file time; equal times go by run id."""
    named = runs.where(F.coalesce(F.col("run_id"), F.lit("")) != "")
    newest = named.orderBy(F.desc(modified), "run_id").limit(limit)
    return flag_orphans(newest, active)


def runs_index(runs: DataFrame, tasks: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Every run, newest first, with state, tallies, elapsed time and page names."""
    rows = flag_orphans(with_counts(runs, tasks), active)
    state = status.run_state(F.col("done"), F.col("failed"), F.col("died"))
    seconds = clock.elapsed_seconds(F.col("started_at"), F.col("updated_at"))
    return rows.select(
        "run_id", "run_name", "identity", state.alias("state"), "passed", "failed",
        clock.duration_text(seconds).alias("elapsed"), "updated_at",
        F.concat("run_id", F.lit(".html")).alias("live_page"),
        F.when(F.col("done"), F.concat("run_id", F.lit("-report.html"))).alias("report_page"),
    ).orderBy(F.desc("updated_at"), "run_id")


def effective_engine(
    tasks: DataFrame, engines: DataFrame, default_engine: str
) -> DataFrame:
    """Engine and model a task really runs with; unknown engines are flagged."""
    dim = engines.select(
        F.col("engine").alias("_e"), F.col("default_model").alias("_m")
    ).dropDuplicates(["_e"])
    named = tasks.withColumn(
        "effective_engine", F.coalesce(F.nullif("engine", F.lit("")), F.lit(default_engine))
    )
    return named.join(dim, F.col("effective_engine") == F.col("_e"), "left").select(
        *tasks.columns, "effective_engine",
        F.coalesce(F.nullif("model", F.lit("")), "_m", F.lit("")).alias("effective_model"),
        F.col("_e").isNull().alias("unknown_engine"),
    )


def verify_floor(expected: DataFrame, listing: DataFrame, checks: DataFrame) -> DataFrame:
    """A task passes when its expected files exist, are not empty, and its check passes.

    ``missing`` keeps the files that failed the floor; a check below it does not count.
    The expected list is short per task, so the collected array is too.
    """
    sizes = listing.select("path", "length").groupBy("path").agg(F.max("length").alias("_len"))
    bad = expected.join(sizes, "path", "left").where(F.coalesce("_len", F.lit(0)) <= 0)
    missing = bad.groupBy("task_key").agg(
        F.array_sort(F.collect_set("path")).alias("missing")
    )
    joined = checks.join(missing, "task_key", "left")
    met = F.col("missing").isNull()
    return joined.select(
        "task_key", met.alias("floor_met"),
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        (met & F.col("check_pass")).alias("passed"),
    )


def task_state(events: DataFrame) -> DataFrame:
    """Current row of every task from its status commands.

    The start is the first ``set_status`` and sticks; attempt comes from the last
    ``set_status``; the end, tokens and proof from the last ``set_result``; status
    from the last command of either kind.  ``max_by`` skips rows whose ordering
    is NULL, so each field looks only at its own kind of command.
    """
    started = F.when(F.col("op") == "set_status", F.col("seq"))
    ended = F.when(F.col("op") == "set_result", F.col("seq"))
    return events.groupBy("run_id", "task_key").agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("attempt", started).alias("attempt"),
        F.min_by("ts", started).alias("started_at"),
        F.max_by("ts", ended).alias("ended_at"),
        F.max("seq").alias("last_seq"),
    )


def task_notes(tasks: DataFrame) -> DataFrame:
    """What to show for a task that delivered nothing, and its proof when settled."""
    kind = status.status_kind(F.col("status"), F.col("attempt"))
    return tasks.withColumn("kind", kind).select(
        "run_id", "task_key", "kind",
        status.kind_text(F.col("kind")).alias("label"),
        status.empty_work_note(F.col("kind")).alias("note"),
        status.how_checked(F.col("kind"), F.col("verified")).alias("how_checked"),
        status.proof(F.col("kind"), F.col("check_tail")).alias("proof"),
        status.proof_label(F.col("kind"), F.col("check_tail")).alias("proof_label"),
    )


# --- plain-language summaries; the wording is the status page's fixed text ---


def _phrase(count: str, words: str) -> Column:
    n = F.col(count)
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {words}")))


def _task_word(n: Column) -> Column:
    return F.when(n == 1, "task").otherwise("tasks")


def _plain_list(parts: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(parts, F.lit(-1))
    return (
        F.when(n == 0, "").when(n == 1, last)
        .when(n == 2, F.concat(head, F.lit(" and "), last))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )


def progress_legend() -> Column:
    parts = F.array_compact(
        F.array(
            _phrase("passed", "finished"), _phrase("working", "working"),
            _phrase("retry", "sent back"), _phrase("failed", "failed"),
            _phrase("waiting", "waiting"),
        )
    )
    return F.when(F.size(parts) == 0, "No tasks").otherwise(F.array_join(parts, " · "))


def outcome_text(state: Column) -> Column:
    passed, failed = F.col("passed").cast("string"), F.col("failed").cast("string")
    return (
        F.when(state == "died", F.concat(F.lit("died · "), passed, F.lit(" passed")))
        .when(state == "live", F.concat(passed, F.lit(" passed so far")))
        .when(
            F.col("failed") > 0,
            F.concat(passed, F.lit(" passed · "), failed, F.lit(" failed")),
        )
        .otherwise(F.concat(F.lit("all "), passed, F.lit(" passed")))
    )


def live_briefing(subject: str) -> Column:
    waiting = F.when(F.col("waiting") == 1, F.lit("1 is waiting")).when(
        F.col("waiting") > 1, F.concat(F.col("waiting").cast("string"), F.lit(" are waiting"))
    )
    parts = F.array_compact(
        F.array(
            _phrase("passed", "finished and checked"), _phrase("working", "working"),
            _phrase("retry", "sent back"), waiting, _phrase("failed", "failed"),
        )
    )
    ago = clock.ago_text(clock.elapsed_seconds(F.col("started_at"), F.col("updated_at")))
    total = F.col("total")
    return F.when(
        total == 0, F.concat(F.lit(f"{subject} has no tasks. Started "), ago, F.lit(" ago."))
    ).otherwise(
        F.concat(
            F.lit(f"{subject} is working on "), total.cast("string"), F.lit(" "), _task_word(total),
            F.lit(" — "), _plain_list(parts), F.lit(", started "), ago, F.lit(" ago."),
        )
    )


def final_briefing(subject: str) -> Column:
    total = F.col("total")
    took = clock.duration_text(clock.elapsed_seconds(F.col("started_at"), F.col("updated_at")))
    first = F.concat(
        F.lit(f"{subject} finished "), total.cast("string"), F.lit(" "), _task_word(total),
        F.lit(" in "), took, F.lit("."),
    )
    return F.when(
        F.col("failed") == 0,
        F.concat(first, F.lit(" All "), total.cast("string"), F.lit(" finished and checked.")),
    ).otherwise(
        F.concat(
            first, F.lit(" "), F.col("passed").cast("string"), F.lit(" finished and checked, "),
            F.col("failed").cast("string"), F.lit(" failed after retry."),
        )
    )


def briefings(runs: DataFrame, tasks: DataFrame, active: DataFrame | None, subject: str) -> DataFrame:
    """Heading, legend and one-line outcome of every run."""
    rows = flag_orphans(with_counts(runs, tasks), active)
    state = status.run_state(F.col("done"), F.col("failed"), F.col("died"))
    heading = F.when(F.col("done"), final_briefing(subject)).otherwise(live_briefing(subject))
    return rows.select(
        "run_id", heading.alias("heading"), progress_legend().alias("legend"),
        outcome_text(state).alias("outcome_line"),
    )
