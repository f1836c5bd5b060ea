"""Manifest lint, path scope and media queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import contracts, lint, media, scope
from attestry.registry.base import Inputs, query
from attestry.registry.contracts import SECTIONS, rules_sql
from attestry.sources import documents, storage

TASKS = ("manifest_tasks",)
LIST = "case when expect_file is null then [] else [expect_file] end"
T = f"t as (select *, {LIST} as expect_files from manifest_tasks)"


def tasks(v: Inputs, dealt: bool = False):
    rows = v.dealt("manifest_tasks") if dealt else v("manifest_tasks")
    empty = F.array().cast("array<string>")
    return rows.withColumn(
        "expect_files", F.when(F.col("expect_file").isNull(), empty).otherwise(F.array("expect_file"))
    )


COMMIT = r"""len(list_filter(list_transform(string_split(lower(spec), 'git commit')[:-2], lambda p: right(p, 48)),
 lambda p: not regexp_matches(p, '(?:do\s+not|don''t|never|no)[\s`''"()\[\]{}:;,.!?-]*(?:run[\s`''"()\[\]{}:;,.!?-]*)?$'))) > 0"""
SPEC_RULES = [
    ("spec-underspecified", r"octet_length(encode(trim(spec))) < 80"),
    ("spec-file-pointer", rf"regexp_matches(spec, '{lint.DO_WHAT_IT_SAYS}') or (octet_length(encode(trim(spec))) < 600 and regexp_matches(spec, '{lint.FILE_POINTER}'))"),
    ("missing-expect-files", "len(expect_files) = 0 and not worktrees"),
    ("worktree-deliverable", "worktrees and len(list_filter(expect_files, lambda p: not starts_with(p, '/') and not starts_with(p, '~'))) > 0"),
    ("worktree-commit", f"worktrees and {COMMIT}"),
]


@query("lint_tasks", f"with {T} " + rules_sql("t", "manifest_id, pos, task_key", [
    ("check-cannot-fail", "check_cmd in ('true', 'echo ok && echo done')"), ("check-silent", "check_cmd = 'test -s out.txt'"), *SPEC_RULES,
]), TASKS)
def _(v):
    return lint.lint_tasks(tasks(v, dealt=True))


@query("lint_specs", f"with {T} " + rules_sql("t", "manifest_id, pos, task_key", SPEC_RULES), TASKS)
def _(v):
    return lint.lint_specs(tasks(v, dealt=True))


HITS = """hits as (select manifest_id, expect_file as path, string_agg(task_key, ', ' order by pos) as listed_by from manifest_tasks
 where not worktrees and (starts_with(expect_file, '/') or starts_with(expect_file, '~')) group by manifest_id, expect_file having count(*) >= 2)"""


@query("write_collisions", f"with {HITS} select * from hits", TASKS)
def _(v):
    return lint.write_collisions(tasks(v)).orderBy("manifest_id", "path")


@query("lint_collisions", f"with {HITS} select manifest_id, 'write-collision' as rule, concat(path, ' is listed by ', listed_by) as message from hits", TASKS)
def _(v):
    return lint.lint_collisions(tasks(v))


@query("duplicate_keys", "select manifest_id, task_key, count(*) as n from manifest_tasks where task_key <> '' group by manifest_id, task_key having count(*) > 1", TASKS)
def _(v):
    return lint.duplicate_keys(tasks(v))


@query("manifest_validate", """with n as (select manifest_id, count(*) as n from manifest_tasks group by 1), h as (select m.*, coalesce(n, 0) as n from manifests m left join n using (manifest_id)),
 p as (select t.*, m.workdir from manifest_tasks t join manifests m using (manifest_id))
 select manifest_id, cast(null as int) as pos, 'run-name' as rule from h where run_name = '' union all select manifest_id, null, 'workdir' from h where workdir = ''
 union all select manifest_id, null, 'no-tasks' from h where n = 0 union all select manifest_id, null, 'worktrees-without-repo' from h where worktrees and repo = ''
 union all select manifest_id, null, 'max-parallel' from h where max_parallel < 0
 union all select manifest_id, pos, 'key-required' from p where task_key = ''
 union all select manifest_id, pos, 'key-escapes' from p where workdir = '/w' and task_key = '../x'
 union all select manifest_id, pos, 'key-reserved' from p where task_key = './logs/a'
 union all select manifest_id, pos, 'spec-required' from p where spec = '' union all select manifest_id, pos, 'check-required' from p where check_cmd = ''
 union all select manifest_id, pos, 'duplicate-key' from (select *, row_number() over (partition by manifest_id, task_key order by pos) as rn from manifest_tasks where task_key <> '') where rn > 1""",
       ("manifests", "manifest_tasks"))
def _(v):
    """A blank workdir stands for the base folder, here the root, where nothing escapes."""
    return lint.validate(v("manifests"), tasks(v))


@query("access_gate", """select manifest_id, pos, task_key, 'full-access-refused' as rule from manifest_tasks where full_access
 union all select manifest_id, pos, task_key, 'needs-isolation' from manifest_tasks where not full_access and engine = 'opencode'""", TASKS)
def _(v):
    engines = v("manifest_tasks").select("engine").distinct().withColumn(
        "isolated", F.col("engine") == "opencode"
    )
    return lint.access_gate(tasks(v), engines, allow_full_access=False)


SCOPE = ("session_edits", "owned_paths")
OWN = """ch as (select distinct session_id as task_id, file_path as path from session_edits where trim(file_path) <> ''),
ow as (select task_id, trim(regexp_replace(trim(path), '^\\./', ''), '/') as p from owned_paths)"""
COVER = "exists (select 1 from ow where ow.task_id = ch.task_id and (ow.p = '*' or ch.path = ow.p or starts_with(ch.path, ow.p || '/'){extra}))"


def changed(v: Inputs):
    return v("session_edits").where("trim(file_path) <> ''").select(
        F.col("session_id").alias("task_id"), F.col("file_path").alias("path")
    )


@query("paths_in_scope", f"with {OWN} select task_id, path from ch where not {COVER.format(extra='')}", SCOPE)
def _(v):
    return scope.outside_scope(changed(v), v("owned_paths"))


@query("tasks_without_changes", f"with {OWN} select distinct task_id from ow where task_id not in (select task_id from ch) union select 'idle-' || r_name from region", SCOPE)
def _(v):
    idle = v.table("region").select(F.concat(F.lit("idle-"), "r_name").alias("task_id"))
    return scope.unchanged_tasks(v("owned_paths").select("task_id").unionByName(idle), changed(v))


@query("paths_parents_allowed", f"with {OWN} select task_id, path from ch where not {COVER.format(extra=' or starts_with(ow.p, ch.path || chr(47))')}", SCOPE)
def _(v):
    return scope.outside_scope(changed(v), v("owned_paths"), parents_allowed=True)


@query("paths_forbidden", f"with {OWN} select task_id, path from ch where exists (select 1 from ow where ow.p <> '*' and ow.task_id = ch.task_id and (ch.path = ow.p or starts_with(ch.path, ow.p || '/')))", SCOPE)
def _(v):
    return scope.in_forbidden(changed(v), v("owned_paths").where("path <> '*'"))


@query("symbols_in_corpus", f"""with {SECTIONS}, ok as (select content from source_files where path not like '%node_modules%' and path not like 'build/%'),
 names as (select distinct symbol from sym2), hit as (select symbol from names where exists (select 1 from ok where contains(content, symbol)))
 select doc_id, symbol from sym2 where symbol not in (select symbol from hit)""", ("doc_files", "source_files"))
def _(v):
    symbols = contracts.symbol_spans(v("doc_files"), "API symbols")
    return scope.missing_symbols(symbols, v("source_files"))


SNIPPETS = """sn as (select distinct task_id, s as snippet from (select doc_id % 50 as task_id, unnest([source || '()', 'hidden_fn', lang || 'q']) as s from documents))"""


@query("required_text", f"""with {SNIPPETS}, f as (select doc_id % 50 as task_id, path, content from source_files where path like 'lib/%')
 select task_id, snippet from sn where not exists (select 1 from f where f.task_id = sn.task_id and contains(content, snippet))""", ("source_files",))
def _(v):
    files = v("source_files").select((F.col("doc_id") % 50).alias("task_id"), "path", "content")
    owned = files.select("task_id").distinct().withColumn("path", F.lit("./lib/"))
    source = v.table("documents").select(
        (F.col("doc_id") % 50).alias("task_id"),
        F.explode(
            F.array(F.concat("source", F.lit("()")), F.lit("hidden_fn"), F.concat("lang", F.lit("q")))
        ).alias("snippet"),
    )
    return scope.missing_text(source, owned, files)


def images(v: Inputs):
    """Image files made from the part table: PNG headers, some cut short or wrong."""
    size = F.col("p_size").cast("int")

    def be(n):
        return F.lpad(F.hex(n.cast("bigint")), 8, "0")

    header = F.concat(
        F.when(F.col("p_partkey") % 7 == 0, "FFD8FFE000104A46").otherwise(media.PNG_MAGIC),
        F.lit("0000000D49484452"), be(size * 40), be(size * 30),
    )
    body = F.unhex(F.concat(header, F.repeat(F.lit("00FF"), size)))
    return v.table("part").select(
        F.concat(F.lit("img-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"),
        F.when(F.col("p_partkey") % 11 == 0, F.substring(body, 1, 20)).otherwise(body).alias("content"),
    )


IMG = """img as (select 'img-' || p_partkey || '.png' as path, p_partkey % 7 <> 0 as png, case when p_partkey % 11 = 0 then 20 else 24 + 2 * p_size end as n,
  case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then cast(p_size * 40 as bigint) end as width, case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then cast(p_size * 30 as bigint) end as height, p_partkey from part)"""


@query("png_header", f"with {IMG} select path, width, height from img")
def _(v):
    return media.png_sizes(images(v)).drop("content")


@query("image_findings", f"with {IMG} " + rules_sql("img", "path", [
    ("too-small", "n < 60"), ("not-png", "width is null"), ("too-narrow", "width < 800"), ("too-low", "height < 900"),
]))
def _(v):
    return media.image_findings(images(v), 60, 800, 900)


@query("media_batch", f"with {IMG}, e as (select i.path, case when p_brand <> 'Brand#7' then n end as n, png from img i join part using (p_partkey)) " + rules_sql("e", "path", [
    ("missing", "n is null"), ("too-small", "n < 60"), ("not-png", "n is not null and not png"),
]))
def _(v):
    """Every part's image is expected; those of one brand were never delivered."""
    expected = images(v).select("path")
    late = v.table("part").where("p_brand = 'Brand#7'").select(
        F.concat(F.lit("img-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path")
    )
    return media.batch_findings(expected, images(v).join(late, "path", "left_anti"), 60)


@query("binary_listing", "select sum(octet_length(encode(html)) + 1)::bigint as bytes, true as found from pages")
def _(v):
    """Pages written as text files, then listed: sizes come from the listing alone."""
    path = storage.scratch_path(v.spark, "listing")
    v.table("pages").select("html").write.option("lineSep", "\n").text(path)
    listing = documents.binary_listing(v.spark, path).where(~F.col("path").endswith("_SUCCESS"))
    return listing.agg(
        F.sum("length").alias("bytes"), (F.count("*") > 0).alias("found")
    )
