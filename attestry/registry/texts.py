"""Notes, data-quality, log and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import display
from attestry.operators import logs, notes, quality, scoreboard, sessions
from attestry.registry.base import Inputs, query
from attestry.registry.scoreboard import LABELLED
from attestry.sources import records, storage

NOTES = ("notes_md",)

# Line by line, with running counts: a different route from the operator's splits.
PARSED = r"""
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from notes_md),
h as (select *, regexp_matches(line, '^##\s+.') as is_head from l),
s as (select *, sum(case when is_head then 1 else 0 end) over (partition by doc_id order by n) - 1 as sec from h),
b as (select *, not is_head and starts_with(line, '- ') as is_bullet,
  not is_head and (starts_with(line, '  ') or regexp_matches(line, '^\s*$')) and not starts_with(line, '- ') as is_more from s where sec >= 0),
g as (select *, sum(case when is_bullet or not is_more then 1 else 0 end) over (partition by doc_id, sec order by n) as grp from b),
bl as (select doc_id, sec, grp, bool_or(is_bullet) as is_bullet,
  regexp_replace(string_agg(regexp_replace(case when is_bullet then substr(line, 3) else line end, '^\s+|\s+$', '', 'g'), chr(10) order by n), '^\s+|\s+$', '', 'g') as bullet
  from g where not is_head group by doc_id, sec, grp),
dated as (select doc_id, sec, bullet, row_number() over (partition by doc_id, sec order by grp) - 1 as bullet_idx from bl
  where is_bullet and regexp_matches(bullet, '\b\d{4}-\d{2}-\d{2}\b')),
heads as (select doc_id, sec, regexp_replace(regexp_extract(line, '^##\s+(.+)$', 1), '\s+$', '') as heading from s where is_head),
notes as (select d.doc_id, cast(d.sec as int) as sec_idx, h.heading, cast(d.bullet_idx as int) as bullet_idx, d.bullet from dated d join heads h using (doc_id, sec))
"""
CLEAN = r"""
flat as (select *, regexp_replace(bullet, '\s+', ' ', 'g') as f from notes),
parts as (select *, regexp_matches(f, '^-?\s*(\d{4}-\d{2}-\d{2})\s+') as dated,
  regexp_extract(f, '^-?\s*(\d{4}-\d{2}-\d{2})\s+', 1) as iso, regexp_extract(f, '^-?\s*\d{4}-\d{2}-\d{2}\s+(?:[-–—]+\s*)?(.*)$', 1) as rest from flat),
clean as (select doc_id, sec_idx, bullet_idx, regexp_extract(bullet, '\b\d{4}-\d{2}-\d{2}\b') as date_key,
  case when not dated then '' when cast(iso[6:7] as int) between 1 and 12
    then concat(['January','February','March','April','May','June','July','August','September','October','November','December'][cast(iso[6:7] as int)], ' ', regexp_replace(iso[9:10], '^0', ''))
    else iso end as date,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(case when dated then rest else bullet end, '`([^`]*)`', '\1', 'g'),
   '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_]{1,3}([^*_]+)[*_]{1,3}', '\1', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as body from parts)
"""
MATCHED = f"""{LABELLED}, models as (select distinct model from labeled),
nh as (select doc_id, sec, heading, lower(regexp_replace(heading, '\\s+', ' ', 'g')) as nh from heads),
m as (select model, doc_id, sec, heading, nh = lower(model) as exact, strlen(nh) as size from models, nh where contains(nh, lower(model))
  and regexp_matches(nh, concat('(^|[^A-Za-z0-9._/:-])', regexp_escape(lower(model)), '($|[^A-Za-z0-9._/:-])'))),
best as (select model, doc_id, sec, heading from (select *, row_number() over (partition by model order by exact desc, size desc, doc_id, sec) as rn from m) where rn = 1)
"""


def parsed(v: Inputs):
    return notes.sections(v("notes_md"))


def models(v: Inputs):
    return scoreboard.first_final(v("attempts")).select("model").distinct()


@query("scan_notes", f"with {PARSED} select doc_id, cast(sec as int) as sec_idx, heading from heads", NOTES)
def _(v):
    return parsed(v).select("doc_id", "sec_idx", "heading")


@query("notes_parse", f"with {PARSED} select doc_id, sec_idx, heading, bullet_idx, bullet from notes", NOTES)
def _(v):
    return notes.bullets(parsed(v))


@query("notes_clean", f"with {PARSED}, {CLEAN} select doc_id, sec_idx, bullet_idx, date, body from clean", NOTES)
def _(v):
    return notes.cleaned(notes.bullets(parsed(v))).select(
        "doc_id", "sec_idx", "bullet_idx", "date", "body"
    )


@query("notes_for_model", f"with {PARSED}, {MATCHED} select model, doc_id, cast(sec as int) as sec_idx, heading from best", ("notes_md", "attempts"))
def _(v):
    return notes.matched_sections(models(v), parsed(v))


@query("notes_newest", f"""with {PARSED}, {CLEAN}, {MATCHED},
 r as (select model, row_number() over (partition by model order by date_key desc, bullet_idx) as rank, date, body
  from best join clean on clean.doc_id = best.doc_id and clean.sec_idx = best.sec where body <> '')
 select model, cast(rank as int) as rank, date, body from r where rank <= 5""", ("notes_md", "attempts"))
def _(v):
    return notes.newest_notes(models(v), parsed(v))


DQ = ("dq_records",)
RULES = [
    "count>=100", "count!=0", "unique:id", "nonempty:priority", "amount>=1,000", "amount<900000",
    "status!=P", "any:status==F", "any:priority==7-NONE", "priority==None", "missing==None",
]
NUM = "try_cast(replace(amount, ',', '') as double)"


@query("dq_check", f"""with t as (select count(*) as n,
  count(case when trim(id) <> '' then id end) - count(distinct case when trim(id) <> '' then id end) as dup,
  count(*) filter (where priority is null or trim(priority) = '') as noprio, count(*) filter (where trim(id) = '') as noid,
  count(*) filter (where not coalesce({NUM} >= 1000, false)) as a1, count(*) filter (where not coalesce({NUM} < 900000, false)) as a2,
  count(*) filter (where status = 'P') as s1, count(*) filter (where status = 'F') as s2, count(*) filter (where trim(coalesce(priority, 'None')) <> 'None') as p1 from dq_records)
 select 'min_rows:10' as rule, n >= 10 as ok, 0 as bad from t
 union all select 'schema:id', true, 0 union all select 'schema:colour', false, 1
 union all select 'required:id', noid = 0, noid from t
 union all select 'count>=100', n >= 100, case when n >= 100 then 0 else 1 end from t union all select 'count!=0', n <> 0, case when n <> 0 then 0 else 1 end from t
 union all select 'unique:id', dup = 0, dup from t union all select 'nonempty:priority', noprio = 0, noprio from t
 union all select 'amount>=1,000', false, n from t union all select 'amount<900000', a2 = 0, a2 from t
 union all select 'status!=P', s1 = 0, s1 from t union all select 'any:status==F', s2 > 0, case when s2 > 0 then 0 else n end from t
 union all select 'any:priority==7-NONE', false, n from t union all select 'priority==None', p1 = 0, p1 from t
 union all select 'missing==None', true, 0""", DQ)
def _(v):
    """Every rule of a check, in one aggregate.  A bound with a comma is no number."""
    return quality.check_records(
        v("dq_records"), [quality.invariant(r) for r in RULES],
        required=["id"], schema_fields=["id", "colour"], min_rows=10,
    )


def _one(v: Inputs, *rules: str):
    return quality.check_records(v("dq_records"), [quality.invariant(r) for r in rules])


@query("dq_count", """select 'count' || op || '5000' as rule, ok, case when ok then 0 else 1 end as bad from (select count(*) as n from dq_records),
 lateral (values ('==', n = 5000), ('!=', n <> 5000), ('>=', n >= 5000), ('<=', n <= 5000), ('>', n > 5000), ('<', n < 5000)) as o(op, ok)""", DQ)
def _(v):
    return _one(v, *[f"count{op}5000" for op in ("==", "!=", ">=", "<=", ">", "<")])


@query("dq_unique", "select id as value, count(*) as n from dq_records where trim(id) <> '' group by id having count(*) > 1", DQ)
def _(v):
    return quality.duplicates(v("dq_records"), "id")


@query("dq_nonempty", """select 'id' as field, count(*) filter (where trim(coalesce(id, '')) = '') as empty from dq_records union all select 'amount', count(*) filter (where trim(coalesce(amount, '')) = '') from dq_records
 union all select 'priority', count(*) filter (where trim(coalesce(priority, '')) = '') from dq_records""", DQ)
def _(v):
    return quality.empty_counts(v("dq_records"), ["id", "amount", "priority"])


@query("dq_predicate", f"""select 'amount>=100000' as rule, count(*) filter (where not coalesce({NUM} >= 100000, false)) = 0 as ok, count(*) filter (where not coalesce({NUM} >= 100000, false)) as bad from dq_records
 union all select 'status==F', bool_and(status = 'F'), count(*) filter (where status <> 'F') from dq_records
 union all select 'any:amount>499000', coalesce(bool_or({NUM} > 499000), false), case when bool_or({NUM} > 499000) then 0 else count(*) end from dq_records""", DQ)
def _(v):
    return _one(v, "amount>=100000", "status==F", "any:amount>499000")


@query("dq_typed", """with t as (select o_orderpriority = '1-URGENT' as flag, o_orderkey * 1e7 as n, o_orderkey / 1e6 as s from orders)
 select 'any:flag==True' as rule, bool_or(flag) as ok, case when bool_or(flag) then 0 else count(*) end as bad from t
 union all select 'flag!=False', bool_and(flag), count(*) filter (where not flag) from t
 union all select 'any:n==10000000.0', bool_or(n = 1e7), case when bool_or(n = 1e7) then 0 else count(*) end from t
 union all select 'n!=20000000.0', not bool_or(n = 2e7), count(*) filter (where n = 2e7) from t
 union all select 'any:s==1e-06', bool_or(s = 1e-6), case when bool_or(s = 1e-6) then 0 else count(*) end from t
 union all select 'any:s==1E-06', false, count(*) from t""")
def _(v):
    """Booleans and floating numbers compare as the checks print them."""
    key = F.col("o_orderkey").cast("double")
    records = v.dealt_table("orders").select(
        (F.col("o_orderpriority") == "1-URGENT").alias("flag"), (key * 1e7).alias("n"), (key / 1e6).alias("s")
    )
    rules = ["any:flag==True", "flag!=False", "any:n==10000000.0", "n!=20000000.0", "any:s==1e-06", "any:s==1E-06"]
    return quality.check_records(records, [quality.invariant(r) for r in rules])


@query("dq_schema", """with k as (select distinct unnest(json_keys(case when json_valid(line) then line::json end)) as field from attempts_jsonl)
 select field from (values ('run_id'), ('colour'), ('notes'), ('verdict'), ('size')) as w(field) where field not in (select field from k)""", ("attempts_jsonl",))
def _(v):
    return quality.missing_fields(
        v("attempts_jsonl"), ["run_id", "colour", "notes", "verdict", "size"]
    )


@query("dq_rejects", "select count(*) as rejects from attempts_jsonl where trim(line) <> ''", ("attempts_jsonl",))
def _(v):
    return quality.reject_count(v("attempts_jsonl"))


@query("dq_rejects_file", """select form, count(*) as rejects from attempts_jsonl, (values ('csv'), ('jsonl')) as t(form) where trim(line) <> '' group by form
 union all select 'missing', 0""", ("attempts_jsonl",))
def _(v):
    """Reject files in both forms, written and counted; a file that is not there holds none."""
    lines = v("attempts_jsonl").where("trim(line) <> ''").select("line")
    counts = []
    for form in ("csv", "jsonl"):
        path = f"{storage.scratch_path(v.spark, 'rejects')}.{form}"
        if form == "csv":
            lines.write.option("header", "true").option("escape", '"').csv(path)
        else:
            lines.write.text(path)
        counts.append(records.reject_counts(v.spark, path).select(F.lit(form).alias("form"), "rejects"))
    missing = records.reject_counts(v.spark, f"{storage.scratch_path(v.spark, 'rejects')}.csv", require_file=True)
    counts.append(missing.select(F.lit("missing").alias("form"), "rejects"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("dq_log_counts", """select doc_id, case when coalesce(text, '') = '' then 'missing or empty log' else 'no row counts' end as finding from documents
 where coalesce(text, '') = '' or (not contains(lower(text), 'row count') and not contains(lower(text), 'rows'))""")
def _(v):
    return quality.log_findings(v.table("documents").select("doc_id", "text"))


REPORT_SECTIONS = ", ".join(f"('{s}')" for s in quality.REPORT_SECTIONS)


@query("dq_report_agree", f"""with n as (select (select count(*) from dq_records) as rows_, (select count(*) from attempts_jsonl where trim(line) <> '') as bad)
 select report_id, concat('missing section ', s) as finding from validation_reports, (values {REPORT_SECTIONS}) as t(s) where not contains(lower(text), s)
 union all select report_id, 'row count not stated' from validation_reports, n where not contains(text, cast(rows_ as varchar))
 union all select report_id, 'reject count not stated' from validation_reports, n where not contains(text, cast(bad as varchar))""",
       ("validation_reports", "dq_records", "attempts_jsonl"))
def _(v):
    return quality.report_agreement(
        v("validation_reports"), v("dq_records"), quality.reject_count(v("attempts_jsonl"))
    )


@query("scan_records_any_format", """select f as form, trim(id) as id, amount, status from dq_records, (values ('csv'), ('json'), ('jsonl')) as t(f)""", DQ)
def _(v):
    """The records written in each format and read back."""
    rows = v("dq_records").select(F.trim("id").alias("id"), "amount", "status")
    out = None
    for form in ("csv", "json", "jsonl"):
        path = storage.scratch_path(v.spark, f"records-{form}")
        if form == "csv":
            rows.write.option("header", "true").option("emptyValue", "").csv(path)
        elif form == "jsonl":
            rows.write.json(path)
        else:
            rows.select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]"))).write.text(path)
        back = records.read_records(
            v.spark, path, "jsonl" if form == "json" else form,
            None if form == "csv" else "id string, amount string, status string",
        ).select(F.lit(form).alias("form"), F.coalesce("id", F.lit("")).alias("id"), "amount", "status")
        out = back if out is None else out.unionByName(back)
    return out


@query("bad_lines", """select line_no, case when json_valid(line) then 'ARRAY' else 'not JSON' end as found from attempts_jsonl
 where trim(line) <> '' and coalesce(json_type(case when json_valid(line) then line::json end), '') <> 'OBJECT'""", ("attempts_jsonl",))
def _(v):
    return records.bad_lines(v("attempts_jsonl")).select(
        "line_no", F.regexp_replace("found", "<.*", "").alias("found")
    )


SCRAPED = r"""coalesce(try_cast(replace(list_last(regexp_extract_all(tail, {p}, 1)), ',', '') as bigint), -1)"""
CODEX = r"tokens\s+used\s*:?\s*([0-9][0-9,]*)"
OPENCODE = r'"tokens":\{"total":([0-9]+)'


@query("token_scrape", f"""select id, engine, case engine when 'codex' then {SCRAPED.format(p=f"'{CODEX}'")}
 when 'opencode' then {SCRAPED.format(p=f"'{OPENCODE}'")} else -1 end as tokens from worker_logs""", ("worker_logs",))
def _(v):
    patterns = {"codex": CODEX, "opencode": OPENCODE, "grok": "([broken"}
    return logs.scrape_by_engine(v("worker_logs"), patterns).select("id", "engine", "tokens")


@query("tail_regex_per_engine", f"""select id, engine, case engine when 'codex' then {SCRAPED.format(p=f"'{CODEX}'")}
 when 'opencode' then {SCRAPED.format(p=f"'{OPENCODE}'")} else -1 end as tokens from worker_logs""", ("worker_logs",))
def _(v):
    return logs.scrape_by_table(v("worker_logs"), v("engine_patterns")).select("id", "engine", "tokens")


@query("tail_bytes", """select doc_id, octet_length(encode(text)) as size, octet_length(encode(text)) > 6000 as truncated,
 md5(encode(text)[greatest(octet_length(encode(text)) - 5999, 1):]) as tail_md5 from documents""")
def _(v):
    text = F.col("text")
    return logs.tail_rows(v.table("documents"), "text", logs.CONTEXT_BYTES).select(
        "doc_id", "size", "truncated", F.md5(logs.tail_binary(text, logs.CONTEXT_BYTES)).alias("tail_md5")
    )


@query("retry_spec", """select id, run_id, task_key, concat('Do ', task_key, chr(10), chr(10), '--- Previous attempt failed. Check output:', chr(10), check_output) as retry_spec
 from attempts where retry = 0 and verdict <> 'PASS'""", ("attempts",))
def _(v):
    attempts = v("attempts")
    specs = attempts.select("run_id", "task_key").distinct().withColumn(
        "spec", F.concat(F.lit("Do "), "task_key")
    )
    return logs.retry_specs(attempts, specs)


@query("output_tail_batch", """with r as (select *, sum(length(chunk)) over (partition by run_id, task_key order by seq desc) as s,
  row_number() over (partition by run_id, task_key order by seq desc) as rn from output_chunks)
 select run_id, task_key, right(string_agg(chunk, '' order by seq), 300) as tail from r where s <= 2000 or rn = 1 group by run_id, task_key""", ("output_chunks",))
def _(v):
    return logs.output_tails(v("output_chunks"), limit=300, cap=2_000, block=64)


@query("cmd_needs_routing", f"""select seq, command from session_commands where trim(command) <> ''
 and not regexp_matches(trim(command), '^(\\S*/)?conductor(\\.py)?(\\s|$)') and not regexp_matches(trim(command), '^\\S+\\s+(\\S*/)?conductor\\.py(\\s|$)')
 and (regexp_matches(command, '{sessions.PROVIDER}') or regexp_matches(command, '{sessions.HARNESS}'))""", ("session_commands",))
def _(v):
    return v("session_commands").where(
        sessions.needs_routing(F.col("command"), "conductor")
    ).select("seq", "command")


@query("command_alerts", f"""select session_id, min(seq) as seq, arg_min(command, seq) as command from session_commands where not live and trim(command) <> ''
 and not regexp_matches(trim(command), '^(\\S*/)?conductor(\\.py)?(\\s|$)') and not regexp_matches(trim(command), '^\\S+\\s+(\\S*/)?conductor\\.py(\\s|$)')
 and (regexp_matches(command, '{sessions.PROVIDER}') or regexp_matches(command, '{sessions.HARNESS}')) group by session_id""", ("session_commands",))
def _(v):
    return sessions.routing_alerts(v("session_commands"), "conductor")


@query("marker_key", "select seq, sha256(encode(session_id) || '\\x00'::blob || encode('pre-bash')) as marker from session_commands", ("session_commands",))
def _(v):
    return v("session_commands").select(
        "seq", display.marker_key(F.col("session_id"), F.lit("pre-bash")).alias("marker")
    )


@query("distinct_files_union", """select session_id, count(*) as edits, count(distinct case when trim(file_path) <> '' then file_path end) as files from session_edits group by session_id""", ("session_edits",))
def _(v):
    return sessions.session_files(v("session_edits"))
