"""Streaming queries: a stored table is replayed in order, the result read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import sessions
from attestry.registry.base import ORACLES, Inputs, query
from attestry.registry.ingest import ATTEMPT, MODELLED, REASON, ROWS
from attestry.registry.scoreboard import MODELS, rounded
from attestry.sources import storage
from attestry.streaming import alerts, imports, runtime, tasks

import attestry.registry.runs  # noqa: F401  (batch twins of these queries)
import attestry.registry.texts  # noqa: F401


def replay(v: Inputs, view: str, run, order: str = "seq") -> None:
    runtime.replay(v(view), storage.scratch_path(v.spark, view), order, run)


def out(v: Inputs, name: str) -> str:
    return storage.scratch_path(v.spark, name)


@query("stream_attempts", f"with {ROWS}, {MODELLED} select {ATTEMPT} from m where {REASON} is null", ("attempts_jsonl", "run_tasks"))
def _(v):
    root = out(v, "stream-attempts")
    tasks_of = v("run_tasks")
    replay(v, "attempts_jsonl", lambda s, cp: imports.stream_attempts(s, root, tasks_of, checkpoint=cp), "line_no")
    return runtime.read_batches(v.spark, f"{root}/attempts").drop("batch")


@query("stream_task_state", ORACLES["first_start_sticky"])
def _(v):
    root = out(v, "stream-task-state")
    replay(v, "status_events", lambda s, cp: tasks.stream_task_state(s, root, checkpoint=cp))
    return tasks.current_task_state(v.spark, root)


@query("stream_output_tail", ORACLES["output_tail_batch"])
def _(v):
    root = out(v, "stream-output-tail")
    replay(v, "output_chunks", lambda s, cp: tasks.stream_output_tail(s, root, cap=2_000, block=64, checkpoint=cp))
    return tasks.current_tails(v.spark, root, limit=300, cap=2_000, block=64)


BURST = """with e as (select *, row_number() over (partition by session_id order by seq) as n from session_edits),
 f as (select session_id, min(seq) as s from e where trim(file_path) <> '' group by session_id, file_path),
 g as (select session_id, s, row_number() over (partition by session_id order by s) as k from f),
 r as (select e.session_id, greatest(e.seq, g.s) as start from e join g on g.session_id = e.session_id and g.k = 3 where e.n = 8)
 select e.session_id, min(e.seq) as seq from e join r using (session_id) where not e.live and e.seq >= r.start group by e.session_id"""


@query("edit_burst_batch", BURST, ("session_edits",))
def _(v):
    return sessions.burst_alerts(v("session_edits"))


@query("stream_edit_burst", BURST, ("session_edits",))
def _(v):
    root = out(v, "stream-edit-burst")
    replay(v, "session_edits", lambda s, cp: alerts.stream_rows(alerts.edit_bursts(s), root, "edit-burst", checkpoint=cp))
    return runtime.read_batches(v.spark, root).select("session_id", "seq")


@query("stream_command_alerts", "select session_id from (" + ORACLES["command_alerts"] + ")")
def _(v):
    root = out(v, "stream-command-alerts")
    replay(
        v, "session_commands",
        lambda s, cp: alerts.stream_rows(alerts.command_alerts(s, "conductor"), root, "command-alerts", checkpoint=cp),
    )
    return runtime.read_batches(v.spark, root).select("session_id")


def snapshots(v: Inputs):
    """Outcome snapshots per run in event order, seconds since the epoch."""
    return v("status_events").select(
        "run_id", "seq", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"),
        F.when(F.col("status") == "running", "live").when(F.col("status") == "passed", "pass")
        .otherwise("fail").alias("outcome"),
    )


# The throttle depends on the last row let through, so SQL walks the rows recursively.
@query("stream_library_live", """with recursive s as (select run_id, seq, epoch(cast(ts as timestamp)) as tm,
  case status when 'running' then 'live' when 'passed' then 'pass' else 'fail' end as outcome, row_number() over (partition by run_id order by ts, seq) as n from status_events),
 w as (select run_id, seq, n, outcome, tm as last, outcome as shown, true as kept from s where n = 1
  union all select s.run_id, s.seq, s.n, s.outcome, case when s.outcome <> w.shown or s.tm - w.last >= 600 then s.tm else w.last end,
   case when s.outcome <> w.shown or s.tm - w.last >= 600 then s.outcome else w.shown end, s.outcome <> w.shown or s.tm - w.last >= 600
  from w join s on s.run_id = w.run_id and s.n = w.n + 1)
 select run_id, seq, outcome from w where kept""", ("status_events",))
def _(v):
    root = out(v, "stream-library-live")
    runtime.replay(
        snapshots(v), out(v, "snapshots"), "seq",
        lambda s, cp: alerts.stream_rows(alerts.library_updates(s, seconds=600), root, "library-live", checkpoint=cp),
    )
    return runtime.read_batches(v.spark, root).select("run_id", "seq", "outcome")


TIMEOUT_MS = 6 * 3600 * 1000


@query("stream_dead_runs", f"""with h as (select run_id, max(epoch_ms(cast(ts as timestamp))) as last_seen_ms, bool_or(status = 'passed' and attempt = 2 and seq % 11 = 0) as done from status_events group by run_id),
 w as (select max(epoch_ms(cast(ts as timestamp))) as m from status_events)
 select run_id, last_seen_ms from h, w where not done and last_seen_ms + {TIMEOUT_MS} <= m""", ("status_events",))
def _(v):
    """Runs silent for six hours of event time that never finished."""
    beats = v("status_events").select(
        "run_id", "seq", F.col("ts").cast("timestamp").alias("at"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        ((F.col("status") == "passed") & (F.col("attempt") == 2) & (F.col("seq") % 11 == 0)).alias("done"),
    )
    root = out(v, "stream-dead-runs")
    runtime.replay(
        beats, out(v, "beats"), "seq",
        lambda s, cp: alerts.stream_rows(alerts.dead_runs(s.drop("seq"), TIMEOUT_MS), root, "dead-runs", checkpoint=cp),
    )
    return runtime.read_batches(v.spark, root).select("run_id", "last_seen_ms")


@query("stream_scoreboard", MODELS + "select * from scored", ("attempts", "catalog_models"))
def _(v):
    root = out(v, "stream-scoreboard")
    prices = v("catalog_models")
    replay(v, "attempts", lambda s, cp: imports.stream_scoreboard(s, root, prices, buckets=8, checkpoint=cp), "id")
    board = imports.current_scoreboard(v.spark, root)
    return rounded(board, "first_rate", "pass_rate", "median_duration_s", "cost")


@query("stream_catalog", "select ts, kind, model_id from (" + ORACLES["catalog_diff"] + """) union all
 select '2026-07-12T00:00:00Z', 'added', concat('vendor/part-', cast(p_partkey as varchar)) from part where p_brand <> 'Brand#7'""")
def _(v):
    """Both payloads arrive in parts: three slices, the middle one with rows of both."""
    def parts(view, fetched_at, n):
        rows = v(view)
        place = F.pmod(F.xxhash64("id"), F.lit(100)) + 100 * n
        return rows.withColumns({
            "fetched_at": F.lit(fetched_at), "position": F.xxhash64("id"), "total": F.lit(rows.count()), "n": place,
        })

    root = out(v, "stream-catalog")
    runtime.replay(
        parts("catalog_old", "2026-07-12T00:00:00Z", 0).unionByName(parts("catalog_new", "2026-07-13T00:00:00Z", 1)),
        out(v, "payloads"), "n", lambda s, cp: imports.stream_catalog(s.drop("n"), root, checkpoint=cp), slices=3,
    )
    return imports.catalog_events(v.spark, root).select("ts", "kind", "model_id")
