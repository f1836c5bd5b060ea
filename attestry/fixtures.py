"""Views of the driver tables in the shapes the operators expect.

Each view is one SQL text used twice: by Spark over the Parquet files and, as a
CTE, by the check SQL.  ``Dialect`` holds the few spellings that differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    # How Spark names a table; None is the check engine, with tables registered as views.
    source: Callable[[str], str] | None = None

    def t(self, table: str) -> str:
        return table if self.source is None else self.source(table)

    def iso(self, expr: str) -> str:
        if self.source is None:
            return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"
        # Text of a zone-less timestamp, so the session's time zone plays no part.
        return f"concat(replace(substr(cast({expr} as string), 1, 19), ' ', 'T'), 'Z')"

    def json_k(self, expr: str) -> str:
        if self.source is None:
            return f"cast(json_extract_string({expr}, '$.k') as bigint)"
        return f"cast(get_json_object({expr}, '$.k') as bigint)"


RUN = "concat('run-', cast(cast(floor(event_id / 40) as bigint) as string))"
TASK = "concat('task-', cast(event_id % 25 as string))"
ENGINE = "case user_id % 3 when 0 then 'codex' when 1 then 'grok' else 'opencode' end"

VIEWS: dict[str, Callable[[Dialect], str]] = {}


def _view(name: str):
    def register(fn: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        VIEWS[name] = fn
        return fn

    return register


@_view("attempts")
def _attempts(d: Dialect) -> str:
    return f"""select event_id as id, {RUN} as run_id,
 concat('job-', cast(user_id % 30 as string)) as run_name, {TASK} as task_key, {ENGINE} as engine,
 case when user_id % 10 = 9 then ' '
      when user_id % 3 = 2 then concat('openrouter/vendor/part-', cast(user_id % 8 as string))
      else concat('vendor/part-', cast(user_id % 8 as string)) end as model,
 case when user_id % 7 = 0 then '' else event_type end as task_type,
 case event_type when 'error' then 'FAIL' when 'signup' then 'timeout' else 'PASS' end as verdict,
 cast(event_id % 2 as int) as retry, value as duration_s,
 case when event_id % 9 = 0 then cast(-1 as bigint) else {d.json_k('props')} * 1000 end as tokens,
 concat(event_type, ' check of ', props) as check_output, 'orchestrator' as identity,
 {d.iso('ts')} as created_at
from {d.t('events')}"""


@_view("catalog_models")
def _catalog_models(d: Dialect) -> str:
    return f"""select concat('vendor/part-', cast(p_partkey as string)) as id, p_name as name,
 cast(p_size * 2000 as int) as context_length,
 case p_partkey % 3 when 0 then 'text->text' when 1 then 'text+image->text' else '' end as modality,
 case when p_size % 5 = 0 then cast(null as double) else p_retailprice / 1000 end as prompt_per_m,
 case when p_size % 5 = 0 then cast(null as double) else p_retailprice / 500 end as completion_per_m,
 p_size % 5 = 0 as variable_pricing, p_size % 10 = 0 as pricing_unknown, p_size % 4 = 0 as free
from {d.t('part')}"""


def _snapshot(d: Dialect, keep: str, price: str, variable: str, free: str) -> str:
    return f"""select concat('vendor/part-', cast(p_partkey as string)) as id, p_name as name,
 cast(p_size * 2000 as int) as context_length,
 case p_partkey % 3 when 0 then 'text->text' when 1 then 'text+image->text' else '' end as modality,
 case when {variable} then cast(null as double) else {price} end as prompt_per_m,
 case when {variable} then cast(null as double) else {price} * 2 end as completion_per_m,
 {variable} as variable_pricing, {variable} as pricing_unknown, {free} as free
from {d.t('part')} where {keep}"""


@_view("catalog_old")
def _catalog_old(d: Dialect) -> str:
    return _snapshot(
        d, "p_brand <> 'Brand#7'", "p_retailprice / 1000", "p_size % 10 = 0", "p_size % 4 = 0"
    )


@_view("catalog_new")
def _catalog_new(d: Dialect) -> str:
    return _snapshot(
        d, "p_brand <> 'Brand#9'",
        "(case when p_partkey % 7 = 0 then p_retailprice / 800 else p_retailprice / 1000 end)",
        "(p_size + p_partkey % 2) % 10 = 0", "(p_size + p_partkey % 3) % 4 = 0",
    )


@_view("registry_engines")
def _registry_engines(d: Dialect) -> str:
    return f"""select case r_regionkey when 0 then 'codex' when 1 then ' opencode ' when 2 then 'local'
  when 3 then ' ' else 'spare' end as engine,
 case r_regionkey when 0 then 'Codex CLI' when 1 then 'OpenCode' else ' ' end as harness,
 case r_regionkey when 0 then 'OAuth plan' when 1 then 'Router API' else '' end as access,
 case r_regionkey when 0 then 'vendor/part-1' else '' end as default_model_key
from {d.t('region')}"""


@_view("registry_models")
def _registry_models(d: Dialect) -> str:
    return f"""select case when p_partkey % 2 = 0 then 'codex' else 'opencode' end as engine,
 case when p_partkey % 2 = 0 then '' else 'openrouter/' end
   || 'vendor/part-' || cast(p_partkey as string) as model_key,
 case when p_size % 3 = 0 then ' ' else p_name end as display,
 'verified' as confidence, p_brand as source
from {d.t('part')} where p_size > 5"""


@_view("runs")
def _runs(d: Dialect) -> str:
    return f"""select concat('run-', cast(o_orderkey as string)) as run_id,
 concat('job-', cast(o_custkey % 30 as string)) as run_name, o_orderpriority as identity,
 o_orderstatus <> 'P' as done, {d.iso('o_orderdate')} as started_at,
 {d.iso("(o_orderdate + interval 1 minute * cast(o_orderkey % 200 as int) + interval 1 second * cast(o_custkey % 60 as int))")} as updated_at
from {d.t('orders')}"""


@_view("active_runs")
def _active_runs(d: Dialect) -> str:
    return f"""select concat('run-', cast(o_orderkey as string)) as run_id
from {d.t('orders')} where o_orderpriority in ('1-URGENT', '2-HIGH')"""


@_view("run_tasks")
def _run_tasks(d: Dialect) -> str:
    return f"""select concat('run-', cast(l_orderkey as string)) as run_id,
 concat('task-', cast(l_linenumber as string)) as task_key, cast(l_linenumber as int) as pos,
 case max(l_returnflag) when 'R' then 'failed' when 'A' then 'passed'
   else case when max(l_linestatus) = 'O' then 'running' else
     case when max(l_partkey) % 3 = 0 then 'timeout' else 'queued' end end end as status,
 1 + cast(max(l_partkey) % 2 as int) as attempt, cast(sum(l_quantity) as bigint) as tokens,
 case when max(l_suppkey) % 4 = 0 then ' ' else concat(' row count ', cast(count(*) as string), ' ') end as verified,
 case when max(l_suppkey) % 5 = 0 then '' else concat('line ', cast(max(l_partkey) as string)) end as check_tail,
 case when max(l_suppkey) % 6 = 0 then '' else concat('vendor/part-', cast(max(l_partkey) % 8 as string)) end as model,
 {d.iso('min(l_shipdate)')} as started_at,
 case when max(l_returnflag) = 'N' then '' else {d.iso('(max(l_shipdate) + interval 45 second)')} end as ended_at
from {d.t('lineitem')} group by l_orderkey, l_linenumber"""


@_view("catalog_raw")
def _catalog_raw(d: Dialect) -> str:
    return f"""select cast(p_partkey as bigint) as part_no, concat('{{"id":"',
 case when p_size = 50 then '  ' else concat('vendor/part-', cast(p_partkey as string)) end,
 case when p_partkey % 17 = 0 and p_size <> 50 then ':free' else '' end, '",',
 case when p_partkey % 6 = 0 then '"name":" "' else concat('"name":" ', p_name, '"') end,
 ',"context_length":', case p_partkey % 5 when 0 then cast(p_size * 1000 as string)
   when 1 then concat(cast(p_size * 1000 as string), '.75') when 2 then concat('" ', cast(p_size * 1000 as string), '"')
   when 3 then '"12.5"' else 'null' end,
 ',"pricing":{{', case p_partkey % 9 when 0 then '"prompt":""' when 1 then '"prompt":"n/a"' when 2 then '"other":1'
   when 3 then '"prompt":"-1"' when 4 then '"prompt":0' when 5 then '"prompt":"0"'
   else concat('"prompt":"0.', lpad(cast(p_partkey % 1000 as string), 7, '0'), '"') end,
 ',"completion":', case p_partkey % 7 when 0 then 'null' when 1 then '"0"' when 2 then '0'
   else concat('"0.', lpad(cast(p_size as string), 6, '0'), '"') end,
 '}},"architecture":{{"modality":"', case p_partkey % 3 when 0 then 'text->text' when 1 then ' text ' else '' end,
 '"}}}}') as raw from {d.t('part')}"""


@_view("attempts_jsonl")
def _attempts_jsonl(d: Dialect) -> str:
    iso = d.iso("ts")
    return f"""select event_id as line_no, case
 when event_id % 50 = 7 then '{{not json' when event_id % 50 = 8 then '   ' when event_id % 50 = 9 then '[1, 2]'
 when event_id % 50 = 12 then '{{"run_id":"r","task_key":"t","verdict":"PASS"}}{{"run_id":"s"}}'
 when event_id % 2 = 0 then concat('{{"run_id":"', {RUN}, '","task_key":"', case when event_id % 70 = 6 then '' else {TASK} end,
  '","run_name":"job","engine":" codex ","model":"', case when event_id % 6 = 0 then ' ' else concat('m', cast(user_id % 8 as string)) end,
  '","task_type":"', case when event_id % 8 = 0 then 'code' else '' end, '","verdict":"pass","retry":',
  case event_id % 10 when 0 then 'true' when 2 then '"2"' when 4 then '"maybe"' when 6 then '2.9' else '-1' end,
  ',"duration_s":', case when event_id % 4 = 0 then concat('"', cast(event_id % 90 as string), '.5"') else cast(event_id % 90 as string) end,
  ',"tokens":', cast(event_id % 1000 as string), '.9,"check_output":"done","created_at":"', {iso}, '"}}')
 else concat('{{"run_id":"', case when event_id % 25 = 10 or event_id % 30 = 11 then ' ' else {RUN} end, '","task_key":"', {TASK},
  '","worker_engine":"grok","verdict":"', case when event_id % 40 = 13 then '' else 'FAIL' end, '","retry":',
  case event_id % 6 when 1 then '"True"' when 3 then 'null' else '"n/a"' end,
  ',"duration_ms":', cast(event_id * 10 as string), ',"worker_tokens":', case when event_id % 3 = 0 then '"77"' else 'null' end,
  ',"notes":"', case when event_id % 4 = 1 then 'x retry=true' else 'plain' end, '","orchestrator":"me","logged_at":"', {iso}, '"}}')
 end as line from {d.t('events')}"""


@_view("task_type_map")
def _task_type_map(d: Dialect) -> str:
    return f"""select concat('run-', cast(o_orderkey as string)) as k,
  case when o_orderstatus = 'P' then '' else 'whole-run' end as v from {d.t('orders')} where o_orderpriority = '5-LOW'
 union all select concat('run-', cast(o_orderkey as string), ':task-3'), o_orderstatus from {d.t('orders')} where o_orderpriority = '1-URGENT'
 union all select concat('name:run-', cast(n_nationkey as string)), case when n_regionkey = 2 then '' else n_name end from {d.t('nation')}
 union all select 'name:', 'never' from {d.t('region')} where r_regionkey = 0"""


@_view("status_events")
def _status_events(d: Dialect) -> str:
    return f"""select event_id as seq, {RUN} as run_id, {TASK} as task_key,
 case when event_type in ('view', 'click') then 'set_status' else 'set_result' end as op,
 case event_type when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'passed'
  when 'error' then 'failed' else 'timeout' end as status,
 cast(1 + event_id % 2 as int) as attempt, {d.iso('ts')} as ts from {d.t('events')}"""


@_view("task_files")
def _task_files(d: Dialect) -> str:
    return f"""select concat('run-', cast(l_suppkey as string)) as run_id, concat('task-', cast(l_linenumber as string)) as task_key,
 concat(case when l_suppkey % 7 = 0 and l_partkey % 5 = 0 then '.' else '' end, 'out-', cast(l_partkey as string), case l_partkey % 8 when 0 then '.MD' when 1 then '.log' when 2 then '.csv'
  when 3 then '.png' when 4 then '.exe' when 5 then '' when 6 then '.html' else '.txt' end) as name,
 max(cast(floor(l_extendedprice * 300) as bigint)) as bytes from {d.t('lineitem')} group by 1, 2, 3"""


@_view("harvest_tasks")
def _harvest_tasks(d: Dialect) -> str:
    return f"""select concat('run-', cast(l_suppkey as string)) as run_id, concat('task-', cast(l_linenumber as string)) as task_key,
 l_suppkey % 10 = 0 as worktrees from {d.t('lineitem')} group by l_suppkey, l_linenumber"""


@_view("expected_files")
def _expected_files(d: Dialect) -> str:
    return f"""select concat('run-', cast(l_suppkey as string)) as run_id, concat('task-', cast(l_linenumber as string)) as task_key,
 concat('out-', cast(l_partkey as string), case l_partkey % 8 when 0 then '.MD' when 3 then '.png' else '.txt' end) as name
 from {d.t('lineitem')} where l_suppkey % 3 = 0 group by 1, 2, 3"""


@_view("outcomes")
def _outcomes(d: Dialect) -> str:
    return f"""select event_id as id, {RUN} as run_id, {TASK} as task_key, event_type = 'signup' as timed_out,
 user_id % 11 = 0 as spawn_error, value > 20 as check_pass, case when event_id % 9 = 0 then -1 else event_id end as tokens from {d.t('events')}"""


@_view("library_updates")
def _library_updates(d: Dialect) -> str:
    return f"""select r.run_name, r.run_id, r.identity, r.updated_at, r.run_id as current_run_id,
 case when not r.done then 'live' when coalesce(f.bad, 0) > 0 then 'fail' else 'pass' end as state
 from ({VIEWS['runs'](d)}) r left join (select run_id, count(*) as bad from ({VIEWS['run_tasks'](d)}) t
  where status in ('failed', 'timeout') group by run_id) f on f.run_id = r.run_id"""


@_view("notes_md")
def _notes_md(d: Dialect) -> str:
    return f"""select doc_id, concat('# Notes', chr(10), '- 2026-01-01 outside any section', chr(10),
 '## Vendor/part-', cast(doc_id % 8 as string), case doc_id % 5 when 0 then '' when 1 then ' (router lane)' when 2 then '-xl extra'
   when 3 then concat('   in  ', source) else concat(', ', lang) end, chr(10), text, chr(10),
 '- 2026-07-0', cast(1 + doc_id % 9 as string), ' — **Solid** on `', source, '` [link](http://x.y/z)', chr(10), '  more _detail_ ', lang, chr(10), chr(10),
 'break', chr(10), '  dropped', chr(10), '- undated ', lang, chr(10), '##   Second   heading ', lang, chr(10),
 '- seen 2026-13-05 odd', chr(10), '- 2026-13-05 odd month', chr(10), '- 2026-06-1', cast(doc_id % 10 as string), ' -', chr(10)) as text from {d.t('documents')}"""


@_view("dq_records")
def _dq_records(d: Dialect) -> str:
    return f"""select case when o_orderkey % 97 = 0 then ' ' else cast(o_orderkey - o_orderkey % 31 % 2 as string) end as id,
 case when o_orderkey % 50 = 0 then 'n/a' when o_orderkey % 7 = 0 then concat('1,', cast(o_custkey % 900 + 100 as string)) else cast(o_totalprice as string) end as amount,
 o_orderstatus as status, case when o_orderpriority = '5-LOW' then cast(null as string) else concat(' ', o_orderpriority, ' ') end as priority from {d.t('orders')}"""


@_view("validation_reports")
def _validation_reports(d: Dialect) -> str:
    return f"""select doc_id as report_id, concat('## Verdict', chr(10), text, chr(10), '## Row counts', chr(10),
 case when doc_id % 3 = 0 then 'unknown' else cast((select count(*) from {d.t('orders')}) as string) end, chr(10),
 case when doc_id % 4 = 0 then '## Schema' else '' end, chr(10), '## Empty value scan', chr(10), '## Spot Invariants', chr(10), '## Rejects', chr(10),
 case when doc_id % 5 = 0 then 'none' else cast((select count(*) from {d.t('events')}) as string) end, chr(10), '## Assumptions') as text from {d.t('documents')}"""


@_view("worker_logs")
def _worker_logs(d: Dialect) -> str:
    return f"""select event_id as id, {RUN} as run_id, {TASK} as task_key, {ENGINE} as engine,
 concat('step one', chr(10), 'tokens used 10', chr(10), case when event_id % 9 = 0 then 'no report' when user_id % 3 = 2
   then concat('{{"tokens":{{"total":', cast(event_id as string), '}}}}') else
   concat('Tokens', chr(10), 'used: ', chr(10), 'tokens used: ', cast(cast(floor(value) as bigint) as string), ',', lpad(cast(event_id % 1000 as string), 3, '0')) end) as tail
from {d.t('events')}"""


@_view("engine_patterns")
def _engine_patterns(d: Dialect) -> str:
    return f"""select case r_regionkey when 0 then 'codex' when 1 then 'opencode' when 2 then 'grok' else r_name end as engine,
 case r_regionkey when 0 then 'tokens\\\\s+used\\\\s*:?\\\\s*(?P<token_count>[0-9][0-9,]*)(?#total)' when 1 then '"tokens":\\\\{{"total":([0-9]+)' else '' end as token_regex,
 case when r_regionkey < 2 then 1 else 0 end as token_group from {d.t('region')}"""


@_view("output_chunks")
def _output_chunks(d: Dialect) -> str:
    return f"""select event_id as seq, concat('run-', cast(user_id % 9 as string)) as run_id, {TASK} as task_key,
 concat(repeat(event_type, 1 + cast(event_id % 40 as int)), cast(event_id as string), chr(10)) as chunk from {d.t('events')}"""


@_view("session_edits")
def _session_edits(d: Dialect) -> str:
    return f"""select event_id as seq, concat('sess-', cast(user_id as string), '-', cast(day(ts) % 8 as string)) as session_id,
 case when event_id % 13 = 0 then ' ' else concat('src/', event_type, '/f', cast(event_id % 4 as string), '.py') end as file_path,
 day(ts) % 5 = 0 as live, ts from {d.t('events')} where event_type <> 'error'"""


@_view("session_commands")
def _session_commands(d: Dialect) -> str:
    return f"""select event_id as seq, concat('sess-', cast(user_id as string)) as session_id, case event_id % 9
 when 0 then 'python3 tools/eval_runner.py --n 3' when 1 then 'curl https://API.openai.com/v1/chat/completions'
 when 2 then 'ls -la' when 3 then 'git status' when 4 then 'conductor run eval api.openai.com' when 5 then ' python3 lib/conductor.py openrouter.ai'
 when 6 then '   ' when 7 then 'grep conductor api.anthropic.com' else 'node bench/smoke.mjs' end as command,
 day(ts) % 5 = 0 as live, ts from {d.t('events')}"""


def _nl(*parts: str) -> str:
    return "concat(" + ", chr(10), ".join(parts) + ")"


@_view("cited_reports")
def _cited_reports(d: Dialect) -> str:
    return f"""select page_id as report_id, cast(floor(page_id / 5) as bigint) as group_id, {_nl(
        "'## Target'", "concat('See ', url, '. Also (', replace(url, 'http', 'HTTP'), '),')",
        "concat('and http://Extra.example.com//a//bcdefghij/', cast(page_id % 7 as string), '/x/?q=', cast(page_id % 3 as string), '#frag;')",
        "concat('plus \"https://short.example.com/a', cast(page_id % 4 as string), '\" fetched on time')",
        "case when page_id % 6 = 0 then '' else '## Source Log' end", "'12% of 3,400 users, 5.5 ms, a1 x2'", "html",
        "case when page_id % 8 = 0 then 'none' else '## Angle findings: pricing' end", "'## Extracted Numbers'")} as text from {d.t('pages')}"""


@_view("allowlist")
def _allowlist(d: Dialect) -> str:
    return f"""select url from {d.t('pages')} where url like 'https:%'
 union all select concat('http://', r_name, '.example.com/a/bcdefghij') from {d.t('region')}
 union all select concat('http://extra.example.com/a/bcdefghij/', cast(r_regionkey as string), case when r_regionkey > 2 then '?q=1' else '' end) from {d.t('region')}
 union all select concat('https://short.example.com/a', cast(n_nationkey as string)) from {d.t('nation')}"""


@_view("synthesis_reports")
def _synthesis_reports(d: Dialect) -> str:
    return f"""select page_id as report_id, cast(floor(page_id / 5) as bigint) as group_id,
 concat('We compare ', case when page_id % 3 = 0 then replace(url, 'example', 'elsewhere') else url end, ', and [x](http://new.example.com/',
  cast(page_id % 11 as string), ').', chr(10), html) as text from {d.t('pages')}"""


@_view("review_reports")
def _review_reports(d: Dialect) -> str:
    return f"""select doc_id, {_nl(
        "case when doc_id % 13 = 0 then 'Review' else '# Review Report' end", "'## Summary'", "text",
        "case when doc_id % 4 = 0 then case when doc_id % 8 = 0 then '## Findings' else concat('## Findings', chr(10), 'No findings') end else concat('## Findings', chr(10), '### Finding: ', source, chr(10), 'Priority: P', cast(doc_id % 5 as string), chr(10), 'Confidence: ', case doc_id % 3 when 0 then 'high' when 1 then 'LOW' else 'unsure' end, chr(10), 'Evidence: ', case when doc_id % 2 = 0 then 'src/a.py:12' else 'somewhere' end, chr(10), case when doc_id % 5 = 0 then '' else 'Impact: big' end, chr(10), '### finding: second', chr(10), 'evidence: x', chr(10), 'Fix: y', chr(10), 'priority:  p2') end",
        "case when doc_id % 7 = 0 then '' else '## Clean' end", "lang", "'## Assumptions'",
        "case when doc_id % 9 = 0 then 'I  patched the code' else 'none' end")} as text from {d.t('documents')}"""


@_view("strict_reviews")
def _strict_reviews(d: Dialect) -> str:
    return f"""select doc_id, {_nl(
        "case when doc_id % 5 = 0 then 'Intro' else '## Summary of work' end", "text",
        "case when doc_id % 4 = 0 then case when doc_id % 8 = 0 then 'no findings' else 'all good' end else concat('Finding: one', chr(10), 'Evidence: ', case when doc_id % 2 = 0 then 'short' else 'src/a.py line 12 shows the loop' end, chr(10), 'Impact: big', chr(10), 'Fix: y', chr(10), 'Priority: P', cast(doc_id % 5 as string), chr(10), 'Confidence: ', case doc_id % 3 when 0 then 'high' else 'sure' end, chr(10), 'finding : two', chr(10), 'Priority: P1') end",
        "case when doc_id % 9 = 0 then 'We committed the change' else 'end' end")} as text from {d.t('documents')}"""


@_view("contract_docs")
def _contract_docs(d: Dialect) -> str:
    from attestry.operators.contracts import CONTRACTS

    cases = []
    for i, c in enumerate(CONTRACTS):
        parts = [f"case when doc_id % 11 = 3 then 'Untitled' else '# {c.title}' end", "text"]
        parts += [
            f"case when (doc_id + {n}) % 9 = 0 then 'gap' else '## {h} ' end"
            for n, h in enumerate(c.headings)
        ]
        parts += [
            f"case when (doc_id + {n}) % 10 = 0 then 'gap' else '{p.upper() if n % 2 else p}' end"
            for n, p in enumerate(c.phrases)
        ]
        parts += [
            "case when doc_id % 6 = 0 then 'no verdict' else 'verdict: mixed' end",
            "case when doc_id % 5 = 0 then '' else 'see https://example.com/x accessed: 2026-07-01' end",
            "concat('model ', source)",
        ]
        cases.append(f"when {i} then {_nl(*parts)}")
    names = " ".join(f"when {i} then '{c.name}'" for i, c in enumerate(CONTRACTS))
    n = len(CONTRACTS)
    return f"""select doc_id, case doc_id % {n} {names} end as doc_type,
 case when doc_id % 37 = 36 then '' else case doc_id % {n} {' '.join(cases)} end end as text,
 case when doc_id % 12 = 0 then 'absent-model' else source end as expected_model from {d.t('documents')}"""


@_view("doc_files")
def _doc_files(d: Dialect) -> str:
    return f"""select doc_id, {_nl(
        "'preamble'", "'# Over-View!'", "text", "case when doc_id % 6 = 0 then '##### other' else '## API symbols' end",
        "concat('Use `', source, '()` and `', lang, '.run` or `http://x.y` or ` `')", "'### api  SYMBOLS:'", "concat('also `fn_', cast(doc_id % 40 as string), '`')",
        "'## Usage'", "case when doc_id % 5 = 0 then 'few words' else concat('Run it. ', text) end",
        "case when doc_id % 4 = 0 then 'none' else concat('```Python title', chr(10), 'print(1)', chr(10), '```') end",
        "'# over view'", "'tail `late`'")} as text from {d.t('documents')}"""


@_view("transcripts")
def _transcripts(d: Dialect) -> str:
    return f"""select concat(cast(conv_id as string), ':', cast(turn as string)) as tid,
 case conv_id % 4 when 0 then 'model' when 1 then 'api' when 2 then 'postmortem' else 'generic' end as mode, {_nl(
        "case when turn % 3 = 0 then 'PROMPT: hi' else 'start' end",
        "case when turn % 5 = 4 then 'nothing' else concat(case when role = 'user' then 'Response:  ' else 'MODEL response: ' end, text) end",
        "case when turn % 2 = 0 then 'OBSERVED BEHAVIOR: fine' else '## Next' end", "case when conv_id % 3 = 0 then 'Verdict: ok' else 'bye' end",
        "case when conv_id % 5 = 0 then 'Failure Observed: x  Evidence: y  Next check: z' else '' end")} as transcript,
 case turn % 4 when 0 then 'HTTP_STATUS: 200' when 1 then 'status code: 404' when 2 then 'an Error came' else 'quiet' end as output from {d.t('conversations')}"""


@_view("site_pages")
def _site_pages(d: Dialect) -> str:
    return f"""select page_id, concat(html, case when page_id % 3 = 0 then '' else '<img src="data:image/png;base64,AA"><img src="DATA:image/webp;base64,BB">' end,
 case when page_id % 4 = 0 then '<a HREF = "https://cdn.example.com/x">' else '' end, case when page_id % 5 = 0 then '' else '<form>' end,
 case when page_id % 7 = 0 then '' else 'Draft prices for Acme Lamp' end, case when page_id % 6 = 0 then '<svg>acme</svg>' else '' end,
 case when page_id % 8 = 0 then 'Working Title' else '#AA11bb' end, case when page_id % 9 = 0 then '' else 'Money back guarantee' end) as html from {d.t('pages')}"""


@_view("copy_docs")
def _copy_docs(d: Dialect) -> str:
    names = ", chr(10), ".join(f"'- Name {i}: Lamp{i}'" for i in range(1, 8))
    return f"""select doc_id, source, lang, {_nl(
        names, "case when doc_id % 2 = 0 then '**NAME** — Lamp8' else 'Nam: no' end", "concat('Pitch A: ', case when doc_id % 3 = 0 then replace(text, chr(10), ' ') else 'short pitch' end)",
        "'Pitch b - second'", "case when doc_id % 5 = 0 then '' else 'pitch C: third' end", "'Tagline one: light'", "'Tagline two — glow'", "case when doc_id % 7 = 0 then 'x' else 'TAGLINE: shine' end",
        "case when doc_id % 4 = 0 then 'none' else '> My pick: A' end", "'## 1. Direction North'", "'#112233 #aabbcc #445566 #778899 Headline Font: x Body type: y Why this'", "'## Direction two'", "'#112233 body font'",
        "case when doc_id % 6 = 0 then 'text' else '# 3) direction' end", "text", "'## Typography'", "concat('<svg width=1>', case when doc_id % 3 = 0 then 'Acme' else 'none' end, '</svg> price list')",
        "'# Product 1'", "'Title: Lamp'", "' * bullet one'", "'- bullet two'", "'- bullet three'", "'## 2) PRODUCT'", "concat('Title - ', replace(text, chr(10), ' '))", "'- only'",
        "case when doc_id % 3 = 1 then '## product' else 'end' end", "case when doc_id % 10 = 0 then 'sure' else 'prices TBD' end", "case when doc_id % 9 = 0 then '' else '# About us' end")} as text from {d.t('documents')}"""


@_view("persona_docs")
def _persona_docs(d: Dialect) -> str:
    return f"""select doc_id, source as scenario, lang as model, {_nl(
        "text", "concat('Verdict: ', case doc_id % 4 when 0 then 'Buy now' when 1 then 'maybe' when 2 then 'PASS, sorry' else 'hmm' end)", "concat('* PITCH — ', case when doc_id % 5 = 0 then 'Z' else 'b' end)",
        "'name: Ann'", "case when doc_id % 3 = 0 then 'would pay: nothing' else 'Would Pay: $12 a month' end", "'Where - online'", "case when doc_id % 7 = 0 then '' else 'Top objection: price' end")} as text from {d.t('documents')}"""


@_view("test_files")
def _test_files(d: Dialect) -> str:
    return f"""select doc_id, {_nl("'# comment'", "'  // other'", "text", "'assert x == 1'", "case when doc_id % 3 = 0 then '' else '  expect(y).toBe(2); assert z' end", "' * star'")} as text,
 concat(case doc_id % 5 when 0 then 'Tests: 3 failed, ' when 1 then 'Ran 14 tests in 2s' when 2 then 'collected 8 items' when 3 then concat(cast(doc_id as string), ' passing') else 'nothing' end,
  case when doc_id % 5 = 0 then concat(cast(doc_id as string), ' passed, 9 total') else '' end, case when doc_id % 10 = 3 then concat(chr(10), '77 passed in 3s') else '' end) as output from {d.t('documents')}"""


@_view("manifest_tasks")
def _manifest_tasks(d: Dialect) -> str:
    return f"""select concat('m-', cast(cast(floor(event_id / 10) as bigint) as string)) as manifest_id, cast(event_id % 10 as int) as pos,
 case when event_id % 23 = 0 then '' when event_id % 29 = 0 then '../x' when event_id % 31 = 0 then './logs/a' when event_id % 37 = 0 then '../w/ok' else concat('k', cast(event_id % 9 as string)) end as task_key,
 case event_id % 7 when 0 then 'Read /tmp/brief.md and do what it says' when 1 then ''
  when 2 then concat(repeat('Describe the output in detail. ', 5), 'Then run git commit.')
  when 3 then concat(repeat('Describe the output in detail. ', 5), 'Do not run git commit. Never: `git commit`')
  when 4 then concat(repeat('Describe it. ', 60), 'See /etc/hosts') when 5 then concat(repeat('Explain more. ', 9), 'open the file at ~/notes/a.md')
  else concat(repeat('Describe the output in detail. ', 5), 'no git commit', repeat(' really', 9), ' but do not, after all of that long talk about everything, git commit') end as spec,
 case event_id % 6 when 0 then 'true' when 1 then 'test -s out.txt' when 2 then 'echo ok && echo done'
  when 3 then 'diff -q a b || echo differs' when 4 then '' else 'python3 check.py --file out.txt' end as check_cmd,
 case event_id % 5 when 0 then cast(null as string) when 1 then '/shared/out.txt' when 2 then 'out.txt' when 3 then '~/x.md'
  else concat('/shared/', cast(event_id % 3 as string), '.md') end as expect_file,
 cast(floor(event_id / 10) as bigint) % 2 = 0 as worktrees, event_id % 4 = 0 as full_access, {ENGINE} as engine from {d.t('events')}"""


@_view("manifests")
def _manifests(d: Dialect) -> str:
    return f"""select concat('m-', cast(o_orderkey as string)) as manifest_id, case when o_orderkey % 7 = 0 then '' else 'run' end as run_name,
 case when o_orderkey % 9 = 0 then '' else '/w' end as workdir, cast(o_orderkey % 5 - 1 as int) as max_parallel, o_orderkey % 2 = 0 as worktrees,
 case when o_orderkey % 3 = 0 then '' else '/repo' end as repo from {d.t('orders')}"""


@_view("owned_paths")
def _owned_paths(d: Dialect) -> str:
    return f"""select distinct concat('sess-', cast(user_id as string), '-', cast(day(ts) % 8 as string)) as task_id,
 case user_id % 6 when 0 then '*' when 1 then 'src/click' when 2 then './src/view/f1.py' when 3 then ' src/purchase/ ' when 4 then 'src' else 'src/click/f1.py/deep.txt' end as path from {d.t('events')}"""


@_view("source_files")
def _source_files(d: Dialect) -> str:
    return f"""select doc_id, concat(case doc_id % 9 when 0 then 'lib/node_modules/' when 1 then 'build/' else 'lib/' end, cast(doc_id as string), '.py') as path,
 concat('def ', source, '() ', text, ' fn_', cast(doc_id % 23 as string), case when doc_id % 9 < 2 then ' hidden_fn late' else '' end) as content from {d.t('documents')}"""
