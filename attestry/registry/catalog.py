"""Catalog, identity and exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import display
from attestry.operators import catalog, identity, ranks, scoreboard
from attestry.plans import catalog_refresh
from attestry.registry.base import Inputs, query
from attestry.registry.scoreboard import GROUPS, LABELLED, MODELS, groups, models, rounded
from attestry.sources import storage

NEW = ("catalog_new",)
BOTH = ("catalog_old", "catalog_new")
PRICES = ("prompt_per_m", "completion_per_m")
TS = "2026-07-13T00:00:00Z"


def prices(df):
    return rounded(df, *PRICES)


NORMALISED = """
f as (select part_no, trim(coalesce(json_extract_string(raw, '$.id'), '')) as id,
  nullif(trim(json_extract_string(raw, '$.name')), '') as nm,
  case json_type(raw, '$.context_length') when 'VARCHAR' then
         case when regexp_matches(trim(json_extract_string(raw, '$.context_length')), '^[+-]?[0-9]+$')
              then try_cast(trim(json_extract_string(raw, '$.context_length')) as bigint) end
       when 'NULL' then null
       else cast(trunc(try_cast(json_extract_string(raw, '$.context_length') as double)) as bigint) end as ctx,
  trim(coalesce(json_extract_string(raw, '$.architecture.modality'), '')) as modality,
  try_cast(nullif(trim(json_extract_string(raw, '$.pricing.prompt')), '') as double) as p,
  try_cast(nullif(trim(json_extract_string(raw, '$.pricing.completion')), '') as double) as c from catalog_raw),
g as (select *, p is null or c is null as unk, p is null or c is null or p < 0 or c < 0 as var from f where id <> ''),
norm as (select part_no, id, coalesce(nm, id) as name, cast(coalesce(ctx, 0) as int) as context_length, modality,
  case when not var then round(p * 1e6, 6) end as prompt_per_m, case when not var then round(c * 1e6, 6) end as completion_per_m,
  var as variable_pricing, unk as pricing_unknown,
  (id like '%:free' or (not var and p = 0 and c = 0)) as free from g)
"""
NORM_COLUMNS = ", ".join(catalog.SNAPSHOT)


@query("catalog_normalise", f"with {NORMALISED} select {NORM_COLUMNS} from norm", ("catalog_raw",))
def _(v):
    return prices(catalog.normalise(v.dealt("catalog_raw"))).select(*catalog.SNAPSHOT)


@query("scan_catalog_any_shape", f"""with {NORMALISED}
 select {NORM_COLUMNS} from norm where part_no % 3 = 0
 union all select {NORM_COLUMNS.replace('prompt_per_m', 'round(prompt_per_m, 6) as prompt_per_m').replace('completion_per_m', 'round(completion_per_m, 6) as completion_per_m')}
 from catalog_models where cast(substr(id, 13) as bigint) % 3 <> 0""", ("catalog_raw", "catalog_models"))
def _(v):
    """Three documents shapes, one document per part: raw payload, snapshot, bare list."""
    number = F.substring("id", 13, 20).cast("bigint")
    raw = v("catalog_raw").where("part_no % 3 = 0").select(
        F.concat(F.lit('{"data":['), "raw", F.lit(',"junk"]}')).alias("body")
    )
    rows = v("catalog_models").withColumn("_n", number).where("_n % 3 <> 0")
    item = F.to_json(F.struct(*catalog.SNAPSHOT))
    snapshots = rows.select(
        F.when(F.col("_n") % 3 == 1, F.concat(F.lit('{"models":['), item, F.lit(']}')))
        .otherwise(F.concat(F.lit("["), item, F.lit(',{"name":"no id"}]'))).alias("body")
    )
    return prices(catalog.models_from_documents(raw.unionByName(snapshots))).select(*catalog.SNAPSHOT)


SNAP = "select " + NORM_COLUMNS.replace(
    "prompt_per_m, completion_per_m", "round(prompt_per_m, 6) as prompt_per_m, round(completion_per_m, 6) as completion_per_m"
)


@query("scan_catalog", f"{SNAP} from catalog_models", ("catalog_models",))
def _(v):
    return prices(catalog.sorted_catalog(v("catalog_models")))


@query("catalog_snapshot_write", f"{SNAP}, '{TS}' as fetched_at from catalog_new", NEW)
def _(v):
    root = storage.scratch_path(v.spark, "catalog")
    storage.write_snapshot(v("catalog_new"), root, TS)
    return prices(storage.latest_snapshot(v.spark, root))


@query("catalog_free", f"{SNAP} from catalog_models where free", ("catalog_models",))
def _(v):
    return prices(catalog.sorted_catalog(v("catalog_models"), free_only=True))


@query("catalog_stale", """with s as (select max(updated_at) as newest from runs)
 select newest, coalesce(date_diff('second', cast(newest as timestamp), timestamp '2001-08-02 00:00:00') > 86400, true) as stale from s""",
       ("runs",))
def _(v):
    stamped = v("runs").select(F.col("updated_at").alias("fetched_at"))
    return catalog.stale(stamped, F.lit("2001-08-02T00:00:00Z"))


@query("catalog_sort", """select id, variable_pricing, round(prompt_per_m, 6) as prompt_per_m, row_number() over (
 order by variable_pricing, case when variable_pricing then 'infinity'::double else coalesce(prompt_per_m, 0) + coalesce(completion_per_m, 0) end, id) as rank from catalog_models""", ("catalog_models",))
def _(v):
    placed = ranks.ranked(v("catalog_models"), catalog.catalog_order())
    return rounded(placed.select("id", "variable_pricing", "prompt_per_m", "rank"), "prompt_per_m")


@query("catalog_key_diff", """select coalesce(o.id, n.id) as id,
 case when o.id is null then 'added' when n.id is null then 'removed' else 'common' end as side
 from catalog_old o full outer join catalog_new n on o.id = n.id""", BOTH)
def _(v):
    return catalog.key_diff(v("catalog_old"), v("catalog_new"))


EVENTS = f"""
p as (select coalesce(o.id, n.id) as model_id, o.id is null as is_new, n.id is null as is_gone, o.name as o_name, n.name as n_name,
  coalesce(o.prompt_per_m, 0) as op, coalesce(n.prompt_per_m, 0) as np, coalesce(o.completion_per_m, 0) as oc,
  coalesce(n.completion_per_m, 0) as nc, o.variable_pricing as ov, n.variable_pricing as nv, o.free as ofr, n.free as nfr,
  coalesce(n.context_length, o.context_length) as context_length, coalesce(n.modality, o.modality) as modality,
  coalesce(n.pricing_unknown, o.pricing_unknown) as pricing_unknown
  from catalog_old o full outer join catalog_new n on o.id = n.id),
ev as (
  select 'added' as kind, * from p where is_new
  union all select 'removed', * from p where is_gone
  union all select 'pricing_variable', * from p where not is_new and not is_gone and nv and not ov
  union all select 'pricing_fixed', * from p where not is_new and not is_gone and not nv and ov
  union all select 'price_change', * from p where not is_new and not is_gone and not nv and not ov and (op <> np or oc <> nc)
  union all select 'went_free', * from p where not is_new and not is_gone and not nv and nfr and (ov or not ofr)
  union all select 'went_paid', * from p where not is_new and not is_gone and not nv and not ov and ofr and not nfr)
"""


def events(v: Inputs):
    return catalog.diff(v("catalog_old"), v("catalog_new"), F.lit(TS))


@query("catalog_diff", f"with {EVENTS} select '{TS}' as ts, kind, model_id from ev", BOTH)
def _(v):
    return catalog.ordered_events(events(v)).select("ts", "kind", "model_id")


@query("event_payload", f"""with {EVENTS} select kind, model_id,
 case when is_new then n_name when is_gone then o_name else coalesce(nullif(n_name, ''), o_name) end as name,
 case when is_new then round(np, 6) when is_gone then round(op, 6) end as prompt_per_m,
 case when is_new then nfr when is_gone then ofr end as free,
 case when is_new or is_gone then context_length end as context_length,
 case when is_new or is_gone then modality end as modality,
 case when not is_new and not is_gone then round(op, 6) end as old_prompt_per_m,
 case when not is_new and not is_gone then round(np, 6) end as new_prompt_per_m,
 case when not is_new and not is_gone then round(oc, 6) end as old_completion_per_m,
 case when not is_new and not is_gone then round(nc, 6) end as new_completion_per_m,
 case when not is_new and not is_gone then ofr end as old_free,
 case when not is_new and not is_gone then nfr end as new_free from ev""", BOTH)
def _(v):
    p = events(v).select("kind", "model_id", "payload.*").drop(
        "completion_per_m", "variable_pricing", "pricing_unknown"
    )
    return rounded(
        p, "prompt_per_m", "old_prompt_per_m", "new_prompt_per_m",
        "old_completion_per_m", "new_completion_per_m",
    )


STORED = f"""with {EVENTS} select '{TS}' as ts, kind, model_id,
 round(case when is_new or is_gone then null else np end, 6) as new_prompt_per_m from ev"""


def _stored(df):
    price = F.get_json_object("payload", "$.new_prompt_per_m").cast("double")
    return df.select("ts", "kind", "model_id", F.round(price, 6).alias("new_prompt_per_m"))


@query("catalog_events_append", STORED, BOTH)
def _(v):
    root = storage.scratch_path(v.spark, "events")
    storage.append_events(events(v), root, TS)
    return _stored(storage.read_events(v.spark, root))


@query("catalog_events_recent", f"""with {EVENTS} select '{TS}' as ts, kind, model_id from ev
 order by case when is_new then 0 when is_gone then 1 else 2 end desc, model_id desc,
 case kind when 'price_change' then 0 when 'pricing_fixed' then 0 else 1 end desc limit 20""", BOTH)
def _(v):
    return catalog.recent_events(events(v), 20).select("ts", "kind", "model_id")


@query("catalog_refresh", STORED, BOTH)
def _(v):
    root = storage.scratch_path(v.spark, "refresh")
    catalog_refresh.refresh(v("catalog_old"), root, "2026-07-12T00:00:00Z")
    return _stored(catalog_refresh.refresh(v("catalog_new"), root, TS))


@query("event_text", f"""with {EVENTS} select model_id, kind, concat('{TS} ', model_id, ' ', kind,
 case when kind = 'added' and nfr then ' FREE'
  when kind = 'price_change' then concat(': in ', regexp_replace(cast(round(op, 6) as varchar), '\\.0$', ''), '->',
   regexp_replace(cast(round(np, 6) as varchar), '\\.0$', ''), ', out ', regexp_replace(cast(round(oc, 6) as varchar), '\\.0$', ''), '->',
   regexp_replace(cast(round(nc, 6) as varchar), '\\.0$', '')) else '' end) as line from ev""", BOTH)
def _(v):
    rounding = {
        f"{w}_{f}_per_m": F.round(F.col(f"payload.{w}_{f}_per_m"), 6)
        for w in ("old", "new") for f in ("prompt", "completion")
    }
    tidy = events(v).withColumn(
        "payload", F.col("payload").withField("name", F.col("payload.name"))
    )
    for name, col in rounding.items():
        tidy = tidy.withColumn("payload", F.col("payload").withField(name, col))
    return tidy.select(
        "model_id", "kind",
        display.event_text(F.col("ts"), F.col("model_id"), F.col("kind"), F.col("payload")).alias("line"),
    )


REGISTRY = ("registry_engines", "registry_models")
DIMS = """
em as (select trim(engine) as engine, coalesce(nullif(trim(harness), ''), trim(engine)) as harness,
  coalesce(nullif(trim(access), ''), 'unknown') as access, nullif(trim(default_model_key), '') as dk
  from registry_engines where trim(engine) <> ''),
mi as (select trim(engine) as engine, trim(model_key) as model_key,
  coalesce(nullif(trim(display), ''), trim(model_key)) as display, confidence, source from registry_models)
"""
RESOLVED = """
res as (select l.engine, l.model,
 case when mi.display is not null then mi.display when trim(l.engine) = 'opencode' and l.model like 'openrouter/%' then substr(l.model, 12)
  when em.engine is not null and coalesce(nullif(trim(l.model), ''), em.dk) is not null then coalesce(nullif(trim(l.model), ''), em.dk)
  else coalesce(nullif(trim(l.engine), ''), 'unknown') end as model_display,
 case when mi.display is not null then em.harness when trim(l.engine) = 'opencode' and l.model like 'openrouter/%' then coalesce(em.harness, 'OpenCode')
  when em.engine is not null and coalesce(nullif(trim(l.model), ''), em.dk) is not null then em.harness
  else coalesce(nullif(trim(l.engine), ''), 'unknown') end as harness,
 case when mi.display is not null then em.access when trim(l.engine) = 'opencode' and l.model like 'openrouter/%' then coalesce(em.access, 'OpenRouter API')
  when em.engine is not null and coalesce(nullif(trim(l.model), ''), em.dk) is not null then em.access else 'unknown' end as access,
 case when mi.display is not null then mi.confidence when trim(l.engine) = 'opencode' and l.model like 'openrouter/%' then 'fallback'
  when em.engine is not null and coalesce(nullif(trim(l.model), ''), em.dk) is not null then 'fallback' else 'unknown' end as confidence,
 case when mi.display is not null then mi.source when trim(l.engine) = 'opencode' and l.model like 'openrouter/%' then 'unlisted OpenRouter slug'
  when em.engine is not null and coalesce(nullif(trim(l.model), ''), em.dk) is not null then 'engine default model key' else '' end as source
 from lab l left join em on em.engine = trim(l.engine)
 left join mi on mi.engine = trim(l.engine) and mi.model_key = coalesce(nullif(trim(l.model), ''), em.dk))
"""


@query("scan_registry", f"with {DIMS} select em.engine, harness, access, dk as default_model_key, model_key, display from em left join mi using (engine)", REGISTRY)
def _(v):
    return identity.registry_engines(v("registry_engines")).join(
        identity.registry_models(v("registry_models")).drop("confidence", "source"), "engine", "left"
    )


@query("resolve_identity", f"with {DIMS}, lab as (select distinct engine, model from attempts), {RESOLVED} select * from res",
       ("attempts", *REGISTRY))
def _(v):
    labels = v("attempts").select("engine", "model").distinct()
    return identity.resolve(labels, v("registry_engines"), v("registry_models"))


TESTED = f"with {LABELLED}, tested as (select distinct model from labeled)"
WITH_CATALOG = ("attempts", "catalog_models")


def tested(v: Inputs):
    return scoreboard.first_final(v("attempts")).select("model").distinct()


@query("untested_models", TESTED + f"{SNAP.replace('select ', ' select ')} from catalog_models where id not in (select model from tested)", WITH_CATALOG)
def _(v):
    return prices(catalog.untested(v("catalog_models"), tested(v)))


CANDIDATE = "context_length >= 32000 and (contains(modality, 'text->text') or modality in ('text', ''))"


@query("explore_filter", f"select id, context_length, modality from catalog_models where {CANDIDATE}", ("catalog_models",))
def _(v):
    return catalog.explorable(v("catalog_models")).select("id", "context_length", "modality")


@query("explore_queue", TESTED + f""" select id, context_length, free from catalog_models
 where {CANDIDATE} and id not in (select model from tested)""", WITH_CATALOG)
def _(v):
    return catalog.explore_queue(v("catalog_models"), tested(v)).select("id", "context_length", "free")


@query("tier_union", GROUPS + f""", tested as (select distinct model from grouped)
 select model, task_type, case when tasks >= 3 then 'proven' else 'probation' end as tier, tasks, null as context_length from grouped
 union all select id, null, 'untested', null, context_length from catalog_models
 where {CANDIDATE} and id not in (select model from tested)""", WITH_CATALOG)
def _(v):
    detail = groups(v)
    local = detail.select(
        "model", "task_type", scoreboard.tier_column().alias("tier"), "tasks"
    )
    waiting = catalog.explore_queue(v("catalog_models"), detail.select("model"))
    return local.unionByName(
        waiting.select(F.col("id").alias("model"), F.lit("untested").alias("tier"), "context_length"),
        allowMissingColumns=True,
    )


@query("short_cost", """select o_orderkey, case when o_orderpriority = '5-LOW' then 'in plan' when c = 0 then 'free'
 when c < 0.1 and c * 100 < 1 then '<1¢' when c < 0.1 then concat('~', cast(cast(round(c * 100) as int) as varchar), '¢')
 else printf('$%.2f', c) end as cost_text from (select *, case when o_orderstatus = 'P' then 0.0
 when o_orderpriority = '1-URGENT' then o_totalprice / 9999991 else o_totalprice / 99991 end as c from orders)""")
def _(v):
    amount = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double"))
        .when(F.col("o_orderstatus") == "P", F.lit(0.0))
        .when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 9999991)
        .otherwise(F.col("o_totalprice") / 99991)
    )
    return v.table("orders").select("o_orderkey", display.short_cost(amount).alias("cost_text"))


@query("price_format", """select p_partkey, case when p_size % 5 = 0 then 'var' else regexp_replace(printf('%.4g', x), '^$', '') end as price
 from (select *, p_retailprice / (case p_size % 4 when 0 then 79901.0 when 1 then 799.0 when 2 then 0.0301 else 99999001.0 end) as x from part)""")
def _(v):
    divisor = F.expr(
        "case p_size % 4 when 0 then 79901.0D when 1 then 799.0D when 2 then 0.0301D else 99999001.0D end"
    )
    return v.table("part").select(
        "p_partkey",
        display.price_text(F.col("p_retailprice") / divisor, F.col("p_size") % 5 == 0).alias("price"),
    )


@query("score_format", GROUPS + f""", {DIMS.strip()}, lab as (select distinct engine, model from grouped), {RESOLVED.strip()}
 select g.model, g.task_type, case when r.model_display = g.model then g.model else concat(r.model_display, ' (', g.model, ')') end as display,
 coalesce(nullif(r.harness, ''), 'unknown') as harness,
 cast(floor(g.median_duration_s * 1000 + 0.5) as bigint) as duration_ms, cast(floor(g.median_tokens) as bigint) as tokens
 from grouped g join res r on r.engine = g.engine and r.model = g.model""", ("attempts", *REGISTRY))
def _(v):
    shown = identity.resolve(groups(v), v("registry_engines"), v("registry_models"))
    return shown.select(
        "model", "task_type",
        display.display_name(F.col("model_display"), F.col("model")).alias("display"),
        display.harness_or_unknown(F.col("harness")).alias("harness"),
        display.milliseconds(F.col("median_duration_s")).alias("duration_ms"),
        display.whole_tokens(F.col("median_tokens")).alias("tokens"),
    )


@query("report_json", GROUPS + f""" select 'rollup' as part, model, cast(sum(tasks) as bigint) as tasks,
 string_agg(task_type, ',' order by tasks desc, task_type) as task_types from grouped group by model
 union all select 'groups', model, cast(tasks as bigint), task_type from grouped""", ("attempts",))
def _(v):
    """The scoreboard's one document, ``{rollup, groups}``, written and read back."""
    detail = groups(v)
    heads = detail.groupBy("model").agg(F.sum("tasks").alias("tasks"))
    path = storage.scratch_path(v.spark, "report")
    nested = scoreboard.nest_task_types(detail, heads).orderBy(F.desc("tasks"), "model")
    storage.write_report({"rollup": nested, "groups": detail}, path)
    report = storage.read_report(
        v.spark, path,
        "rollup array<struct<model: string, tasks: bigint, task_types: array<struct<task_type: string>>>>, "
        "groups array<struct<model: string, tasks: bigint, task_type: string>>",
    )
    rollup = report.select(F.inline("rollup")).select(
        F.lit("rollup").alias("part"), "model", "tasks", F.array_join(F.col("task_types.task_type"), ",").alias("task_types")
    )
    rows = report.select(F.inline("groups")).select(
        F.lit("groups").alias("part"), "model", "tasks", F.col("task_type").alias("task_types")
    )
    return rollup.unionByName(rows)
