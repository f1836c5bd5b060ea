"""Scoreboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import median, ranks, scoreboard
from attestry.registry.base import Inputs, query

ATTEMPTS = ("attempts",)

LABELLED = """
inst as (select run_id, task_key, min(id) first_id, max(id) final_id, count(*) n
         from attempts group by run_id, task_key),
labeled as (
  select i.run_id, i.task_key, i.n as attempts_in_task, i.final_id,
    coalesce(nullif(trim(f.model), ''), trim(f.engine)) as model, f.engine,
    coalesce(nullif(trim(f.task_type), ''), '(untyped)') as task_type,
    upper(f.verdict) as final_verdict, f.duration_s as final_duration_s,
    f.created_at as final_created_at, upper(s.verdict) as first_verdict
  from inst i join attempts f on f.id = i.final_id join attempts s on s.id = i.first_id)
"""


def _rollup(keys: str) -> str:
    return f"""
tok as (select {keys}, median(a.tokens) as median_tokens
        from labeled s join (select run_id, task_key, tokens from attempts) a using (run_id, task_key)
        where a.tokens >= 0 group by {keys}),
latest as (select {keys}, engine from (
   select {keys}, engine, row_number() over (partition by {keys} order by final_created_at desc, final_id desc) rn
   from labeled) where rn = 1),
roll as (select {keys}, count(*) as tasks, cast(sum(attempts_in_task) as bigint) as attempts,
   cast(sum(attempts_in_task) - count(*) as bigint) as retries,
   count(*) filter (where final_verdict = 'PASS') as passed, count(*) filter (where final_verdict <> 'PASS') as failed,
   avg(case when first_verdict = 'PASS' then 1.0 else 0.0 end) as first_rate,
   avg(case when final_verdict = 'PASS' then 1.0 else 0.0 end) as pass_rate,
   median(final_duration_s) as median_duration_s, max(final_created_at) as last_seen
   from labeled group by {keys})
"""


MODELS = f"""with {LABELLED}, {_rollup('model')},
scored as (select r.model, l.engine, case when tasks >= 3 then 'proven' else 'probation' end as tier,
 tasks, attempts, retries, passed, failed, round(first_rate, 6) as first_rate, round(pass_rate, 6) as pass_rate,
 round(median_duration_s, 6) as median_duration_s, cast(t.median_tokens as double) as median_tokens, last_seen,
 round(case when t.median_tokens is null or c.id is null or c.variable_pricing then null
      when c.free then 0.0
      else t.median_tokens * (coalesce(c.prompt_per_m, 0) + coalesce(c.completion_per_m, 0)) / 2 / 1000000 end, 6) as cost
 from roll r left join tok t using (model) left join latest l using (model)
 left join catalog_models c on c.id = case when r.model ilike 'openrouter/%' then substr(r.model, 12) else r.model end)
"""

GROUPS = f"""with {LABELLED}, {_rollup('model, task_type')},
grouped as (select r.model, r.task_type, l.engine, tasks, attempts, passed, failed,
 round(first_rate, 6) as first_rate, round(pass_rate, 6) as pass_rate,
 round(median_duration_s, 6) as median_duration_s, cast(t.median_tokens as double) as median_tokens, last_seen
 from roll r left join tok t using (model, task_type) left join latest l using (model, task_type))
"""


def rounded(df, *columns):
    """Averages and medians differ in the last bits between engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def models(v: Inputs):
    df = scoreboard.scoreboard_models(v("attempts"), v("catalog_models"))
    return rounded(df, "first_rate", "pass_rate", "median_duration_s", "cost")


def groups(v: Inputs):
    df = scoreboard.scoreboard_groups(v("attempts"))
    return rounded(df, "first_rate", "pass_rate", "median_duration_s")


@query("scan_attempts", "select * from attempts order by id", ATTEMPTS)
def _(v):
    return v("attempts").orderBy("id")


@query("count_attempts", "select count(*) as n from attempts", ATTEMPTS)
def _(v):
    return v("attempts").agg(F.count("*").alias("n"))


FILTER = scoreboard.ScoreFilter(engine="opencode", task_type="click", since="2024-01-05")


@query("score_filter", f"""with codex as (select * from attempts where engine = 'opencode'),
 {LABELLED.replace('from attempts', 'from codex').replace('join attempts', 'join codex')}
 select run_id, task_key, model, task_type, final_verdict from labeled
 where task_type = 'click' and final_created_at >= '2024-01-05'""", ATTEMPTS)
def _(v):
    return scoreboard.selected_instances(v("attempts"), FILTER).select(
        "run_id", "task_key", "model", "task_type", "final_verdict"
    )


@query("attempt_label", """select id, run_id, task_key,
 coalesce(nullif(trim(model), ''), trim(engine)) as model, engine,
 coalesce(nullif(trim(task_type), ''), '(untyped)') as task_type, upper(verdict) as verdict from attempts""", ATTEMPTS)
def _(v):
    return scoreboard.labelled_attempts(v("attempts"))


@query("task_instances", """select run_id, task_key, min(id) as first_id, max(id) as final_id, count(*) as n
 from attempts group by run_id, task_key""", ATTEMPTS)
def _(v):
    return scoreboard.task_instances(v("attempts"))


@query("instance_first_final", f"with {LABELLED} select * from labeled", ATTEMPTS)
def _(v):
    return scoreboard.first_final(v("attempts"))


@query("tokens_to_labels", f"""with {LABELLED}
 select run_id, task_key, a.tokens, s.model, s.task_type
 from labeled s join attempts a using (run_id, task_key) where a.tokens >= 0""", ATTEMPTS)
def _(v):
    attempts = v("attempts")
    return scoreboard.labelled_tokens(scoreboard.first_final(attempts), attempts)


@query("median", """select coalesce(nullif(trim(model), ''), trim(engine)) as model,
 cast(median(tokens) as double) as median_tokens from attempts where tokens >= 0 group by 1""", ATTEMPTS)
def _(v):
    labelled = v("attempts").where("tokens >= 0").withColumn("model", scoreboard.label_column())
    return median.exact_median(labelled, ["model"], F.col("tokens"), "median_tokens")


@query("median_select", """select coalesce(nullif(trim(model), ''), trim(engine)) as model,
 round(median(duration_s), 6) as median_duration_s from attempts group by 1""", ATTEMPTS)
def _(v):
    labelled = v("attempts").withColumn("model", scoreboard.label_column())
    return rounded(
        median.exact_median(labelled, ["model"], F.col("duration_s"), "median_duration_s"),
        "median_duration_s",
    )


@query("latest_engine", f"""with {LABELLED}, {_rollup('model')} select model, engine from latest""", ATTEMPTS)
def _(v):
    return scoreboard.latest_engine(scoreboard.first_final(v("attempts")), ["model"])


@query("score_dims", f"""with {LABELLED}, {_rollup('model')}
 select model, tasks, engine, cast(median_tokens as double) as median_tokens
 from roll left join latest using (model) left join tok using (model)""", ATTEMPTS)
def _(v):
    return scoreboard.score_dims(v("attempts"))


@query("cost_lookup", MODELS + "select model, median_tokens, cost from scored", ("attempts", "catalog_models"))
def _(v):
    dims = scoreboard.score_dims(v("attempts")).select("model", "median_tokens")
    return rounded(scoreboard.with_cost(dims, v("catalog_models")), "cost")


@query("scoreboard_models", MODELS + "select * from scored", ("attempts", "catalog_models"))
def _(v):
    return models(v)


@query("scoreboard_groups", GROUPS + "select * from grouped", ATTEMPTS)
def _(v):
    return groups(v)


@query("scoreboard_rank", MODELS + """select model, tier, first_rate, pass_rate, cost, row_number() over (
 order by case tier when 'proven' then 0 when 'probation' then 1 else 3 end, first_rate desc, pass_rate desc,
 coalesce(cost, case when median_tokens is null then 0.0 else 'infinity'::double end), model) as rank from scored""",
       ("attempts", "catalog_models"))
def _(v):
    return ranks.ranked(models(v), scoreboard.model_order()).select(
        "model", "tier", "first_rate", "pass_rate", "cost", "rank"
    )


@query("groups_rank", GROUPS + """select model, task_type, pass_rate, first_rate, cast(row_number() over (
 partition by task_type order by pass_rate desc, first_rate desc, model) as int) as position from grouped""", ATTEMPTS)
def _(v):
    return scoreboard.group_positions(groups(v)).select(
        "model", "task_type", "pass_rate", "first_rate", "position"
    )


UNTESTED = """, untested as (select id from catalog_models c where not exists (
 select 1 from scored s where s.model = c.id))"""


@query("tiers", MODELS + UNTESTED + """select model, tier, tasks, first_rate, pass_rate from scored
 union all select id, 'untested', null, null, null from untested""", ("attempts", "catalog_models"))
def _(v):
    board = models(v)
    untested = v("catalog_models").join(board.select(F.col("model").alias("id")), "id", "left_anti")
    return scoreboard.tiers(board, untested)


@query("nest_task_types", GROUPS + """select model, cast(sum(tasks) as bigint) as tasks,
 string_agg(task_type || ':' || cast(tasks as varchar), ',' order by tasks desc, task_type) as task_types
 from grouped group by model""", ATTEMPTS)
def _(v):
    detail = groups(v)
    heads = detail.groupBy("model").agg(F.sum("tasks").alias("tasks"))
    nested = scoreboard.nest_task_types(detail, heads)
    shown = F.transform(
        "task_types", lambda t: F.concat_ws(":", t["task_type"], t["tasks"].cast("string"))
    )
    return nested.select("model", "tasks", F.array_join(shown, ",").alias("task_types"))
