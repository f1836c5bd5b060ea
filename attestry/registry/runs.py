"""Run-state, library and display queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import session
from attestry.functions import clock, display, status
from attestry.operators import library, ranks, runs
from attestry.registry.base import Inputs, query
from attestry.schemas import RUN_STATE
from attestry.sources import documents, storage

RUNS = ("runs", "run_tasks", "active_runs")
SUBJECT = "The crew"
ROWS_A_SLICE = 5_000_000
SLICES = 8  # each reads the tables anew
DOCS_A_FILE = 100_000

KIND = """case when status = 'passed' then 'pass' when status = 'running' then case when attempt > 1 then 'retry' else 'working' end
 when status in ('failed', 'timeout') then 'fail' else 'waiting' end"""
COUNTED = f"""
k as (select run_id, {KIND} as kind from run_tasks),
cnt as (select run_id, count(*) as total, count(*) filter (where kind = 'pass') as passed, count(*) filter (where kind = 'working') as working,
  count(*) filter (where kind = 'retry') as retry, count(*) filter (where kind = 'fail') as failed, count(*) filter (where kind = 'waiting') as waiting from k group by run_id),
rc as (select r.*, coalesce(total, 0) as total, coalesce(passed, 0) as passed, coalesce(working, 0) as working,
  coalesce(retry, 0) as retry, coalesce(failed, 0) as failed, coalesce(waiting, 0) as waiting,
  not r.done and r.run_id not in (select run_id from active_runs) as died,
  greatest(date_diff('second', cast(started_at as timestamp), cast(updated_at as timestamp)), 0) as secs
  from runs r left join cnt using (run_id))
"""
DURATION = "case when {s} < 60 then concat(cast({s} as bigint), 's') else concat(cast({s} // 60 as bigint), 'm ', lpad(cast({s} % 60 as varchar), 2, '0'), 's') end"


def nested_states(v: Inputs, at: int = 0, slices: int = 1):
    """Run states as nested rows, the way their documents hold them; those of one slice of run ids."""

    def sliced(view: str):
        rows = v(view)
        return rows if slices == 1 else rows.where(F.pmod(F.xxhash64("run_id"), F.lit(slices)) == at)

    task = F.struct(
        "pos", F.col("task_key").alias("key"), "model", "status", "attempt", "tokens", "verified",
        "started_at", "ended_at", "check_tail",
    )

    def delivered(t: Column) -> Column:
        report = F.struct(
            t["key"].alias("task_key"), F.lit("report.md").alias("name"),
            F.concat(F.lit("/out/"), "run_id").alias("path"), t["tokens"].alias("bytes"),
        )
        return t.withField("deliverables", F.when(t["status"] == "passed", F.array(report)))

    # Deliverables follow from their task: made behind the shuffle, they take no place in it.
    tasks = sliced("run_tasks").groupBy("run_id").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    tasks = tasks.withColumn("tasks", F.transform("tasks", delivered))
    return sliced("runs").join(tasks, "run_id", "left")


def state_documents(v: Inputs, at: int = 0, slices: int = 1):
    """One JSON text per run; pending runs of priority 5 are cut off mid-document."""
    states = nested_states(v, at, slices)
    body = F.to_json(F.struct(*states.columns))
    broken = ~F.col("done") & (F.col("identity") == "5-LOW")
    return states.select(
        F.col("updated_at").alias("modified"),
        F.when(broken, F.expr("left('{\"run_id\":\"cut', 12)")).otherwise(body).alias("body"),
    )


def filed(v: Inputs, docs, name: str) -> str:
    """Documents written to files, one a line; returns their folder."""
    path = storage.scratch_path(v.spark, name)
    docs.select("body").write.text(path)
    return path


def filed_states(v: Inputs) -> str:
    """Run states written to files, one a line, a slice of the runs at a time; returns their folder.

    The shuffles that nest the states are several times the tables, so those of one
    slice go before the next one runs.  A compressed file is read by one task: none is long.
    """
    path = storage.scratch_path(v.spark, "run-states")
    rows = v.table("orders").count() + v.table("lineitem").count()
    slices = max(1, min(SLICES, -(-rows // ROWS_A_SLICE)))
    with session.shuffles_removed(v.spark):
        for at in range(slices):
            docs = state_documents(v, at, slices).select("body")
            docs.write.mode("append").options(
                compression="gzip", maxRecordsPerFile=DOCS_A_FILE, **{"zlib.compress.level": "BEST_SPEED"}
            ).text(path)
    return path


@query("scan_run_states", """select r.run_id, r.run_name, r.done, coalesce(n.n, 0) as tasks from runs r
 left join (select run_id, count(*) as n from run_tasks group by run_id) n using (run_id)
 where r.done or r.identity <> '5-LOW'""", ("runs", "run_tasks"))
def _(v):
    states = documents.read_run_states(v.spark, filed_states(v), one_per_line=True)
    # A sort reads its input twice, the first time for its ranges: what it sorts is parsed before.
    sized = session.cut_lineage(states.select(
        "run_id", "run_name", "done", "updated_at",
        F.greatest(F.size(F.coalesce("tasks", F.array())), F.lit(0)).cast("bigint").alias("tasks"),
    ))
    return sized.orderBy(F.desc("updated_at"), "run_id").drop("updated_at")


ACTIVE_BODY = """case when o_orderstatus = 'P' then '{oops' else concat('{"run-', cast(o_orderkey as string), '":{"pid":', cast(o_custkey as string),
 ',"run_name":"job","workdir":"/w"},"twin-', cast(o_orderkey as string), '":{"pid":1,"identity":"', o_orderpriority, '","extra":[1]}}') end"""


@query("scan_active_runs", """select 'run-' || o_orderkey as run_id, cast(o_custkey as int) as pid, 'job' as run_name, null as identity from orders where o_orderstatus <> 'P'
 union all select 'twin-' || o_orderkey, 1, null, o_orderpriority from orders where o_orderstatus <> 'P'""")
def _(v):
    docs = v.table("orders").select(F.expr(ACTIVE_BODY).alias("body"))
    found = documents.read_active_runs(v.spark, filed(v, docs, "active-runs"), one_per_line=True)
    return found.select("run_id", "pid", "run_name", "identity")


LIBRARY_BODY = """case when o_orderpriority = '5-LOW' then '[garbage' else concat('{"artifacts":{"job-', cast(o_orderkey as string),
 '":{"live_path":"/l","state":"live","current_run_id":"r', cast(o_custkey as string), '","versions":[{"run_id":"a","outcome":"pass","tasks_pass":2},',
 '{"run_id":"b","report_path":null,"outcome":"', case when o_orderstatus = 'F' then 'fail' else 'pass' end, '","tasks_fail":', cast(o_custkey % 9 as string), '}]}}}') end"""


@query("scan_library", """select 'job-' || o_orderkey as run_name, 'live' as state, 'r' || o_custkey as current_run_id, p as pos,
 case when p = 0 then 'a' else 'b' end as run_id, case when p = 1 and o_orderstatus = 'F' then 'fail' else 'pass' end as outcome,
 case when p = 0 then 2 end as tasks_pass, case when p = 1 then cast(o_custkey % 9 as int) end as tasks_fail
 from orders, (select cast(unnest([0, 1]) as int) as p) where o_orderpriority <> '5-LOW'""")
def _(v):
    docs = v.table("orders").select(F.expr(LIBRARY_BODY).alias("body"))
    found = documents.read_library(v.spark, filed(v, docs, "library"), one_per_line=True)
    # Entries meet their versions by name: what both sides read is parsed before, once.
    entries = session.cut_lineage(found.select("run_name", "state", "current_run_id", "versions"))
    versions = library.library_versions(entries)
    return entries.select("run_name", "state", "current_run_id").join(versions, "run_name").select(
        "run_name", "state", "current_run_id", "pos", "run_id", "outcome", "tasks_pass", "tasks_fail"
    )


@query("status_kind", f"select run_id, task_key, {KIND} as kind from run_tasks", ("run_tasks",))
def _(v):
    return v("run_tasks").select(
        "run_id", "task_key", status.status_kind(F.col("status"), F.col("attempt")).alias("kind")
    )


VERDICT = "case when timed_out then 'TIMEOUT' when spawn_error then 'ERROR' when check_pass then 'PASS' else 'FAIL' end"


@query("attempt_verdict", f"""with v as (select *, {VERDICT} as verdict from outcomes)
 select id, verdict, case verdict when 'PASS' then 'passed' when 'TIMEOUT' then 'timeout' else 'failed' end as status,
 case verdict when 'PASS' then 'PASS' when 'TIMEOUT' then 'TIMEOUT' else 'FAIL' end as back from v""", ("outcomes",))
def _(v):
    verdict = status.attempt_verdict(F.col("timed_out"), F.col("spawn_error"), F.col("check_pass"))
    rows = v("outcomes").withColumn("verdict", verdict)
    rows = rows.withColumn("status", status.verdict_status(F.col("verdict")))
    return rows.select("id", "verdict", "status", status.status_verdict(F.col("status")).alias("back"))


@query("verify_floor", """with c as (select distinct run_id || '/' || task_key as task_key, true as check_pass from harvest_tasks),
 m as (select e.run_id || '/' || e.task_key as task_key, string_agg(e.name, ',' order by e.name) as missing, count(*) as n from expected_files e
  left join task_files f using (run_id, task_key, name) where coalesce(f.bytes, 0) <= 0 group by 1)
 select c.task_key, m.n is null as floor_met, coalesce(m.missing, '') as missing, m.n is null and check_pass as passed from c left join m using (task_key)""",
       ("harvest_tasks", "expected_files", "task_files"))
def _(v):
    task = F.concat("run_id", F.lit("/"), "task_key")
    full = F.concat(task, F.lit("/"), "name")
    expected = v("expected_files").select(task.alias("task_key"), full.alias("path"))
    listing = v("task_files").select(full.alias("path"), F.col("bytes").alias("length"))
    checks = v("harvest_tasks").select(task.alias("task_key"), F.lit(True).alias("check_pass"))
    names = F.transform("missing", lambda p: F.substring_index(p, "/", -1))
    return runs.verify_floor(expected, listing, checks).withColumn(
        "missing", F.array_join(names, ",")
    )


@query("task_engine_default", """with e as (select trim(engine) as engine, max(trim(default_model_key)) as dm from registry_engines where trim(engine) <> '' group by 1),
 t as (select id, case when id % 4 = 0 then '' else engine end as engine, case when id % 3 = 0 then '' else trim(model) end as model from attempts)
 select t.id, coalesce(nullif(t.engine, ''), 'codex') as effective_engine, coalesce(nullif(t.model, ''), e.dm, '') as effective_model,
 e.engine is null as unknown_engine from t left join e on e.engine = coalesce(nullif(t.engine, ''), 'codex')""", ("attempts", "registry_engines"))
def _(v):
    engines = v("registry_engines").select(
        F.trim("engine").alias("engine"), F.trim("default_model_key").alias("default_model")
    ).where("engine <> ''")
    tasks = v("attempts").select(
        "id", F.expr("case when id % 4 = 0 then '' else engine end").alias("engine"),
        F.expr("case when id % 3 = 0 then '' else trim(model) end").alias("model"),
    )
    return runs.effective_engine(tasks, engines, "codex").drop("engine", "model")


@query("run_counts", f"with {COUNTED} select * from cnt", RUNS)
def _(v):
    return runs.run_counts(v("run_tasks"))


@query("run_outcome", f"with {COUNTED} select run_id, case when not done then 'live' when failed > 0 then 'fail' else 'pass' end as outcome from rc", RUNS)
def _(v):
    return runs.outcomes(runs.with_counts(v("runs"), v("run_tasks"))).select("run_id", "outcome")


@query("all_passed", f"""select run_id, bool_and({VERDICT} = 'PASS') as all_passed, count(*) as tasks,
 count(*) filter (where case when tokens < 0 then '-' else cast(tokens as varchar) end = '-') as unknown_tokens from outcomes group by run_id""", ("outcomes",))
def _(v):
    verdict = status.attempt_verdict(F.col("timed_out"), F.col("spawn_error"), F.col("check_pass"))
    rows = v("outcomes").withColumn("verdict", verdict)
    unknown = rows.groupBy("run_id").agg(
        F.count_if(status.known_tokens(F.col("tokens")) == "-").alias("unknown_tokens")
    )
    return runs.all_passed(rows).join(unknown, "run_id")


@query("deliverable_totals", """select run_id, cast(count(*) filter (where status = 'passed') as bigint) as files,
 cast(coalesce(sum(case when status = 'passed' then tokens end), 0) as bigint) as bytes,
 count(*) filter (where status = 'passed') as tasks_pass, count(*) filter (where status in ('failed', 'timeout')) as tasks_fail from run_tasks group by run_id""", ("runs", "run_tasks"))
def _(v):
    states = nested_states(v).where(F.col("tasks").isNotNull())
    return library.deliverable_totals(runs.tasks_of(states.withColumn(
        "tasks", F.transform("tasks", lambda t: t.dropFields("pos"))
    )))


@query("first_start_sticky", """select run_id, task_key, arg_max(status, seq) as status,
 arg_max(attempt, seq) filter (op = 'set_status') as attempt, arg_min(ts, seq) filter (op = 'set_status') as started_at,
 arg_max(ts, seq) filter (op = 'set_result') as ended_at, max(seq) as last_seq from status_events group by run_id, task_key""", ("status_events",))
def _(v):
    return runs.task_state(v("status_events"))


@query("orphan_runs", f"with {COUNTED} select run_id, died from rc", RUNS)
def _(v):
    return runs.flag_orphans(v("runs"), v("active_runs")).select("run_id", "died")


@query("recent_runs", f"with {COUNTED} select run_id, updated_at, died from rc order by updated_at desc, run_id limit 12", RUNS)
def _(v):
    return runs.recent_runs(v("runs"), v("active_runs"), "updated_at").select(
        "run_id", "updated_at", "died"
    )


@query("runs_index", f"""with {COUNTED} select run_id, run_name, identity, case when died then 'died' when not done then 'live' when failed > 0 then 'fail' else 'pass' end as state,
 passed, failed, {DURATION.format(s='secs')} as elapsed, updated_at, run_id || '.html' as live_page, case when done then run_id || '-report.html' end as report_page from rc""", RUNS)
def _(v):
    return runs.runs_index(v("runs"), v("run_tasks"), v("active_runs"))


@query("elapsed_seconds", """select run_id, task_key, cast(case when ended_at <> '' then date_diff('second', cast(started_at as timestamp), cast(ended_at as timestamp))
 else greatest(date_diff('second', cast(started_at as timestamp), timestamp '1998-06-01 00:00:00'), 0) end as double) as seconds from run_tasks""", ("run_tasks",))
def _(v):
    seconds = clock.task_elapsed(
        F.col("started_at"), F.col("ended_at"), F.lit("1998-06-01T00:00:00Z")
    )
    return v("run_tasks").select("run_id", "task_key", seconds.alias("seconds"))


@query("format_duration", f"select event_id, {DURATION.format(s='s')} as text from (select event_id, cast(floor(value + 0.5) as bigint) as s from events)")
def _(v):
    return v.table("events").select("event_id", clock.duration_text(F.col("value")).alias("text"))


def _unit(n: str, word: str) -> str:
    return f"concat({n}, ' {word}', case when {n} = 1 then '' else 's' end)"


AGO = f"""case when s < 60 then {_unit('s', 'second')} when s < 3600 then concat({_unit('s // 60', 'minute')}, case when s % 60 = 0 then '' else concat(' ', {_unit('s % 60', 'second')}) end)
 else concat({_unit('s // 3600', 'hour')}, case when s // 60 % 60 = 0 then '' else concat(' ', {_unit('s // 60 % 60', 'minute')}) end) end"""


@query("format_ago", f"select o_orderkey, {AGO} as text from (select o_orderkey, cast(floor(o_totalprice / 37) as bigint) as s from orders)")
def _(v):
    return v.table("orders").select(
        "o_orderkey", clock.ago_text(F.col("o_totalprice") / 37).alias("text")
    )


def _part(n: str, words: str) -> str:
    return f"case when {n} > 0 then concat({n}, ' {words}') end"


PARTS = (
    f"list_filter([{_part('passed', 'finished and checked')}, {_part('working', 'working')}, {_part('retry', 'sent back')}, "
    f"case when waiting = 1 then '1 is waiting' when waiting > 1 then concat(waiting, ' are waiting') end, {_part('failed', 'failed')}], lambda x: x is not null)"
)
LEGEND = (
    f"list_filter([{_part('passed', 'finished')}, {_part('working', 'working')}, {_part('retry', 'sent back')}, "
    f"{_part('failed', 'failed')}, {_part('waiting', 'waiting')}], lambda x: x is not null)"
)


@query("briefing_text", f"""with {COUNTED}, b as (select *, {PARTS} as parts, {LEGEND} as legend_parts, secs as s from rc)
 select run_id, case when done then concat('{SUBJECT} finished ', total, case when total = 1 then ' task' else ' tasks' end, ' in ', {DURATION.format(s='s')}, '.',
   case when failed = 0 then concat(' All ', total, ' finished and checked.') else concat(' ', passed, ' finished and checked, ', failed, ' failed after retry.') end)
  when total = 0 then concat('{SUBJECT} has no tasks. Started ', {AGO}, ' ago.')
  else concat('{SUBJECT} is working on ', total, case when total = 1 then ' task' else ' tasks' end, ' — ',
   case len(parts) when 1 then parts[1] when 2 then concat(parts[1], ' and ', parts[2])
    else concat(array_to_string(parts[:-2], ', '), ', and ', parts[-1]) end, ', started ', {AGO}, ' ago.') end as heading,
 case when len(legend_parts) = 0 then 'No tasks' else array_to_string(legend_parts, ' · ') end as legend,
 case when died then concat('died · ', passed, ' passed') when not done then concat(passed, ' passed so far')
  when failed > 0 then concat(passed, ' passed · ', failed, ' failed') else concat('all ', passed, ' passed') end as outcome_line from b""", RUNS)
def _(v):
    return runs.briefings(v("runs"), v("run_tasks"), v("active_runs"), SUBJECT)


@query("task_work_note", f"""with n as (select run_id, task_key, {KIND} as kind, nullif(trim(verified), '') as verified, nullif(trim(check_tail), '') as tail from run_tasks)
 select run_id, task_key, kind,
 case kind when 'pass' then 'finished & checked' when 'working' then 'working' when 'retry' then 'sent back — redoing' when 'fail' then 'failed' else 'waiting' end as label,
 case kind when 'pass' then 'Finished and checked — this worker filed nothing to the shelf.' when 'fail' then 'Failed its check — nothing was delivered.'
  when 'working' then 'Nothing delivered yet — still on it.' when 'retry' then 'Nothing delivered yet — still on it.' else 'Waiting its turn.' end as note,
 case when kind in ('pass', 'fail') and verified is not null then concat(case when kind = 'fail' then 'What the check demanded' else 'How it was checked' end, ': ', verified) end as how_checked,
 case when kind in ('pass', 'fail') then tail end as proof,
 case when kind in ('pass', 'fail') and tail is not null then case when kind = 'fail' then 'See why it failed' else 'See the proof' end end as proof_label from n""", ("run_tasks",))
def _(v):
    return runs.task_notes(v("run_tasks"))


LATEST = """latest as (select run_name, arg_max(current_run_id, (updated_at, run_id)) as current_run_id,
  arg_max(state, (updated_at, run_id)) as state, max(updated_at) as updated_at from library_updates group by run_name)"""


@query("library_latest", f"with {LATEST} select * from latest", ("library_updates",))
def _(v):
    return library.latest_entries(v("library_updates")).select(
        "run_name", "current_run_id", "state", "updated_at"
    )


@query("library_sorted", f"with {LATEST} select run_name, updated_at, row_number() over (order by updated_at desc, run_name) as rank from latest", ("library_updates",))
def _(v):
    entries = library.latest_entries(v("library_updates"))
    return ranks.ranked(entries, library.entry_order()).select("run_name", "updated_at", "rank")


NOW = "2002-01-01T00:00:00Z"


@query("reconcile_library", f"""select run_id as run_name, current_run_id, case when gone then 'died' else state end as state,
 case when gone then '{NOW}' else updated_at end as updated_at, gone as changed
 from (select *, state = 'live' and current_run_id not in (select run_id from active_runs) as gone from library_updates)""", ("library_updates", "active_runs"))
def _(v):
    """Every run stands for an entry of its own, so both live and dead ones occur."""
    entries = v("library_updates").select(
        F.col("run_id").alias("run_name"), "current_run_id", "state", "updated_at"
    )
    return library.reconcile(entries, v("active_runs"), NOW)


@query("reconcile_changed", "select bool_or(state = 'live' and current_run_id not in (select run_id from active_runs)) as changed from library_updates", ("library_updates", "active_runs"))
def _(v):
    entries = v("library_updates").select(
        F.col("run_id").alias("run_name"), "current_run_id", "state", "updated_at"
    )
    return library.any_changed(library.reconcile(entries, v("active_runs"), NOW))


VERSIONS = """ver as (select run_name, run_id, updated_at as finished_at, state as outcome,
  row_number() over (partition by run_name order by updated_at desc, run_id desc) as rank from library_updates)"""


def versions(v: Inputs):
    return v("library_updates").select(
        "run_name", "run_id", F.col("updated_at").alias("finished_at"), F.col("state").alias("outcome")
    )


@query("library_versions_top20", f"with {VERSIONS} select run_name, run_id, finished_at, outcome, cast(rank as int) as rank from ver where rank <= 20", ("library_updates",))
def _(v):
    return library.kept_versions(versions(v))


@query("library_versions_pruned", f"with {VERSIONS} select run_name, run_id, finished_at, outcome from ver where rank > 20", ("library_updates",))
def _(v):
    return library.pruned_versions(versions(v))


HARVEST = ("harvest_tasks", "expected_files", "task_files")
SUFFIXES = ", ".join(f"'{s}'" for s in library.HARVEST_SUFFIXES)
VISIBLE = f"""vis as (select f.*, row_number() over (partition by run_id, task_key order by name) as rn, count(*) over (partition by run_id, task_key) as found
  from task_files f join harvest_tasks t using (run_id, task_key)
  where not t.worktrees and not starts_with(name, '.') and lower(regexp_extract(name, '\\.[^./]*$')) in ({SUFFIXES})
  and (run_id, task_key) not in (select (run_id, task_key) from expected_files))"""


@query("deliverable_top8", f"""with {VISIBLE} select run_id, task_key, name, bytes, bytes > 20971520 as oversized from vis where rn <= 8
 union all select run_id, task_key, name, bytes, bytes > 20971520 from expected_files join task_files using (run_id, task_key, name)""", HARVEST)
def _(v):
    return library.harvest(v("harvest_tasks"), v("expected_files"), v("task_files"))


@query("deliverable_cuts", f"with {VISIBLE} select distinct run_id, task_key, found, 8 as kept from vis where found > 8", HARVEST)
def _(v):
    return library.harvest_cuts(v("harvest_tasks"), v("expected_files"), v("task_files"))


@query("safe_name", """select page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') as name,
 coalesce(nullif(regexp_replace(regexp_replace(concat('._', url), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown-session') as session from pages""")
def _(v):
    return v.table("pages").select(
        "page_id", display.safe_name(F.col("url")).alias("name"),
        display.safe_session(F.concat(F.lit("._"), "url")).alias("session"),
    )


STEM = "nullif(trim(translate(regexp_replace(name, '\\.[^.]*$', ''), '_-', '  ')), '')"
EXT = "lower(regexp_extract(name, '(\\.[^./]*)$', 1))"
FILE_KIND = f"""case when {EXT} in ('.html', '.htm') then 'web page' when {EXT} in ('.avif', '.gif', '.jpeg', '.jpg', '.png', '.svg', '.webp') then 'image'
 when {EXT} in ('.md', '.txt', '.log') then 'document' else 'download' end"""
NAMED = """named as (select l_orderkey, l_linenumber, l_partkey, case l_partkey % 11 when 0 then 'report.html' when 1 then 'worker.log' when 2 then '.png'
  when 3 then 'Report.MD' else concat('my_FINAL-out_', l_returnflag, case l_partkey % 7 when 0 then '.md' when 1 then '.PNG' when 2 then '.htm' when 3 then '' else '.bin' end) end as name from lineitem)"""


@query("deliverable_class", f"""with {NAMED} select l_orderkey, l_linenumber, l_partkey, name, {FILE_KIND} as kind,
 concat(coalesce(upper(left({STEM}, 1)) || substr({STEM}, 2), 'Work'), ' — ', {FILE_KIND}) as label,
 case when lower(name) = 'worker.log' then 'Work log' when lower(name) in ('report.md', 'report.html') then 'What this worker produced'
  else coalesce(upper(left({STEM}, 1)) || lower(substr({STEM}, 2)), 'Worker output') end as title from named""")
def _(v):
    name = F.expr(NAMED[NAMED.index("case"): NAMED.rindex(" as name")])
    n = F.col("name")
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("name")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "name", display.deliverable_kind(n).alias("kind"),
        display.deliverable_label(n).alias("label"), display.deliverable_title(n).alias("title"),
    )


@query("report_links", """select run_id, task_key, case when bool_or(name = 'out.md') then 'out.md' when bool_or(name = 'report.html') then 'report.html' end as report
 from (select run_id, task_key, case when name like '%.MD' then 'report.md' when name like '%.html' then 'report.html' else name end as name from task_files)
 group by run_id, task_key""".replace("'out.md'", "'report.md'"), ("task_files",))
def _(v):
    """The report a task links to: Markdown before HTML, whatever else it wrote."""
    name = F.when(F.col("name").endswith(".MD"), "report.md").when(
        F.col("name").endswith(".html"), "report.html"
    )
    found = v("task_files").withColumn("name", name).groupBy("run_id", "task_key").agg(
        F.collect_set("name").alias("names")
    )
    return found.select("run_id", "task_key", display.report_name(F.col("names")).alias("report"))
