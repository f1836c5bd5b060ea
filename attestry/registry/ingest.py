"""Log import and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import ingest
from attestry.plans import attempt_import
from attestry.registry.base import Inputs, query
from attestry.sources import storage

LOG = ("attempts_jsonl",)

J = "json_extract_string(j, '$.{}')"


def _text(*names: str) -> str:
    parts = ", ".join(f"nullif(trim({J.format(n)}), '')" for n in names)
    return f"coalesce({parts}, '')"


# Parsed rows; the check engine's JSON functions play the part of the parser.
ROWS = f"""
raw as (select line_no, trim(line) as line from attempts_jsonl where trim(line) <> ''),
p as (select line_no, case when json_valid(line) then case when json_type(line::json) = 'OBJECT' then line::json end end as j from raw),
c as (select line_no as id, j is not null as parsed, {_text('run_id')} as run_id, {_text('run_name')} as run_name,
  {_text('task_key')} as task_key, {_text('engine', 'worker_engine')} as engine, {_text('model')} as model,
  {_text('task_type')} as task_type, upper({_text('verdict')}) as verdict,
  case when lower(trim({J.format('retry')})) = 'true' then 1 when lower(trim({J.format('retry')})) = 'false' then 0
   when try_cast({J.format('retry')} as double) is not null then greatest(cast(trunc(try_cast({J.format('retry')} as double)) as int), 0)
   when contains({J.format('notes')}, 'retry=true') then 1 else 0 end as retry,
  coalesce(try_cast({J.format('duration_s')} as double), try_cast({J.format('duration_ms')} as double) / 1000, 0.0) as duration_s,
  coalesce(cast(trunc(try_cast({J.format('tokens')} as double)) as bigint), cast(trunc(try_cast({J.format('worker_tokens')} as double)) as bigint), -1) as tokens,
  {_text('check_output', 'notes')} as check_output, {_text('identity', 'orchestrator')} as identity,
  {_text('created_at', 'logged_at')} as created_at from p)
"""
MODELLED = """
rm as (select run_id, task_key, coalesce(arg_min(model, pos), '') as run_model from run_tasks group by run_id, task_key),
m as (select c.* replace (coalesce(nullif(c.model, ''), rm.run_model, '') as model)
  from c left join rm on rm.run_id = c.run_id and rm.task_key = c.task_key)
"""
TYPED = """
pre as (select d.run_id, arg_max(t.v, length(t.k)) as v from (select distinct run_id from c where run_id <> '') d
  join task_type_map t on t.k like 'name:_%' and starts_with(d.run_id, substr(t.k, 6)) group by d.run_id),
t as (select c.* replace (coalesce(nullif(c.task_type, ''),
   case when c.run_id <> '' then coalesce(nullif(t1.v, ''), nullif(t2.v, ''), pre.v) end, '') as task_type)
  from c left join task_type_map t1 on c.task_key <> '' and t1.k = c.run_id || ':' || c.task_key
  left join task_type_map t2 on t2.k = c.run_id left join pre on pre.run_id = c.run_id)
"""
REASON = """case when not parsed then 'bad_json' when run_id = '' then 'no_run_id'
 when task_key = '' then 'no_task_key' when verdict = '' then 'no_verdict' end"""
ATTEMPT = ", ".join(ingest.ATTEMPT)


def rows(v: Inputs):
    return ingest.coalesce_attempts(ingest.parse_lines(v("attempts_jsonl")))


@query("scan_attempts_jsonl", f"with {ROWS} select count(*) as lines, count(*) filter (where parsed) as good, count(*) filter (where not parsed) as bad from c", LOG)
def _(v):
    parsed = ingest.parse_lines(v("attempts_jsonl"))
    return parsed.agg(
        F.count("*").alias("lines"), F.count_if(F.col("_j").isNotNull()).alias("good"),
        F.count_if(F.col("_j").isNull()).alias("bad"),
    )


@query("attempt_coalesce", f"with {ROWS} select id, run_id, run_name, task_key, engine, model, task_type, verdict, check_output, identity, created_at from c", LOG)
def _(v):
    return rows(v).drop("parsed", "retry", "duration_s", "tokens")


@query("retry_value", f"with {ROWS} select id, retry from c", LOG)
def _(v):
    return rows(v).select("id", "retry")


@query("duration_value", f"with {ROWS} select id, duration_s from c", LOG)
def _(v):
    return rows(v).select("id", "duration_s")


@query("tokens_value", f"with {ROWS} select id, tokens from c", LOG)
def _(v):
    return rows(v).select("id", "tokens")


@query("backfill_model", f"with {ROWS}, {MODELLED} select id, run_id, task_key, model from m", (*LOG, "run_tasks"))
def _(v):
    return ingest.backfill_model(rows(v), v("run_tasks")).select("id", "run_id", "task_key", "model")


@query("backfill_task_type", f"with {ROWS}, {TYPED} select id, run_id, task_key, task_type from t", (*LOG, "task_type_map"))
def _(v):
    return ingest.backfill_task_type(rows(v), v("task_type_map")).select(
        "id", "run_id", "task_key", "task_type"
    )


@query("import_valid", f"with {ROWS} select id, {REASON} as reject_reason from c where {REASON} is not null", LOG)
def _(v):
    return ingest.rejected(ingest.classify(rows(v)))


@query("import_counts", f"with {ROWS} select count(*) filter (where {REASON} is null) as imported, count(*) filter (where {REASON} is not null) as skipped from c", LOG)
def _(v):
    return ingest.import_counts(attempt_import.classified_rows(v("attempts_jsonl")))


@query("append_attempts", f"with {ROWS}, {MODELLED} select {ATTEMPT} from m where {REASON} is null", (*LOG, "run_tasks"))
def _(v):
    path = storage.scratch_path(v.spark, "attempts")
    attempt_import.run_import(v("attempts_jsonl"), path, run_tasks=v("run_tasks"))
    return storage.read_attempts(v.spark, path)


@query("export_attempts_jsonl", "select id, run_id, task_key, engine, trim(model) as model, upper(verdict) as verdict, tokens, created_at from attempts", ("attempts",))
def _(v):
    """Written as JSON lines, then read back through the importer."""
    path = storage.scratch_path(v.spark, "export")
    storage.export_jsonl(v("attempts"), path)
    back = v.spark.read.text(path).withColumnRenamed("value", "line")
    parsed = ingest.parse_lines(back, extra=("id",)).withColumn(
        "line_no", F.col("_j.id").cast("bigint")
    )
    return ingest.coalesce_attempts(parsed).select(
        "id", "run_id", "task_key", "engine", "model", "verdict", "tokens", "created_at"
    )
