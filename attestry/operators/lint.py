"""Manifest linting and validation over tables of manifests and tasks.

Task rows carry ``manifest_id, pos, task_key, spec, check_cmd, expect_files,
worktrees``; findings are ``(manifest_id, pos, task_key, rule)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import clean_segments, is_absolute
from attestry.functions.shell import with_judgements
from attestry.operators.contracts import findings, violations
from attestry.operators.logs import tail_text

SHORT_SPEC_BYTES = 80
POINTER_SPEC_BYTES = 600
NEGATION_BYTES = 48
COMMIT = "git commit"
# Fixed patterns: a spec that only points at a file, and a negation in front of a command.
DO_WHAT_IT_SAYS = r"(?i)do (exactly )?what (it|the file|that file) says"
FILE_POINTER = r"(?i)\b(read|open|follow|see)\b[^\n.]{0,100}?/[\w~][\w./~-]*"
NEGATED = (
    r"(?:do\s+not|don't|never|no)[\s`'\"()\[\]{}:;,.!?-]*(?:run[\s`'\"()\[\]{}:;,.!?-]*)?\z"
)


def instructs_commit(spec: Column) -> Column:
    """Some mention of the command is not negated right before it."""
    low = F.lower(spec)
    parts = F.split(low, COMMIT)
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    unnegated = F.exists(before, lambda p: ~tail_text(p, NEGATION_BYTES).rlike(NEGATED))
    return F.when(low.contains(COMMIT), unnegated).otherwise(low.contains(COMMIT))


def is_file_pointer(spec: Column) -> Column:
    text = F.regexp_replace(spec, r"^\s+|\s+$", "")
    return text.rlike(DO_WHAT_IT_SAYS) | (
        (F.octet_length(text) < POINTER_SPEC_BYTES) & text.rlike(FILE_POINTER)
    )


def spec_rules() -> list[tuple[str, Column]]:
    spec = F.coalesce("spec", F.lit(""))
    files = F.coalesce("expect_files", F.array().cast("array<string>"))
    relative = F.exists(files, lambda p: p.rlike(r"\S") & ~is_absolute(p))
    return [
        (
            "spec-underspecified",
            F.octet_length(F.regexp_replace(spec, r"^\s+|\s+$", "")) < SHORT_SPEC_BYTES,
        ),
        ("spec-file-pointer", is_file_pointer(spec)),
        ("missing-expect-files", (F.size(files) == 0) & ~F.col("worktrees")),
        ("worktree-deliverable", F.col("worktrees") & relative),
        ("worktree-commit", F.when(F.col("worktrees"), instructs_commit(spec))),
    ]


def lint_tasks(tasks: DataFrame) -> DataFrame:
    """All task rules in one projection, over a command that is brought into its plain form once."""
    judged = with_judgements(tasks, "check_cmd", "_check")
    rules = [
        ("check-cannot-fail", F.col("_check.cannot_fail")),
        ("check-silent", F.col("_check.silent")),
        *spec_rules(),
    ]
    return findings(judged, ["manifest_id", "pos", "task_key"], rules)


def lint_specs(tasks: DataFrame) -> DataFrame:
    """The rules that need no command parsing; stays in the JVM."""
    return findings(tasks, ["manifest_id", "pos", "task_key"], spec_rules())


def write_collisions(tasks: DataFrame) -> DataFrame:
    """Absolute paths listed more than once in a manifest without worktrees.

    The tasks are listed in manifest order; a task that lists a path twice counts
    twice.
    """
    paths = tasks.where(~F.col("worktrees")).select(
        "manifest_id", "pos", "task_key", F.posexplode("expect_files").alias("_n", "path")
    )
    entry = F.struct("pos", "_n", "task_key")
    return (
        paths.where(is_absolute(F.col("path")))
        .groupBy("manifest_id", "path")
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("_t"))
        .where(F.col("n") >= 2)
        .select(
            "manifest_id", "path",
            F.array_join(F.transform("_t", lambda t: t["task_key"]), ", ").alias("listed_by"),
        )
    )


def lint_collisions(tasks: DataFrame) -> DataFrame:
    """Collisions as manifest-level findings."""
    return write_collisions(tasks).select(
        "manifest_id", F.lit("write-collision").alias("rule"),
        F.concat("path", F.lit(" is listed by "), "listed_by").alias("message"),
    )


def duplicate_keys(tasks: DataFrame) -> DataFrame:
    return (
        tasks.where(F.coalesce("task_key", F.lit("")) != "")
        .groupBy("manifest_id", "task_key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )


def validate(manifests: DataFrame, tasks: DataFrame, base_dir: str = "/") -> DataFrame:
    """Every problem of every manifest: (manifest_id, pos, rule); pos is NULL for the header."""
    counts = tasks.groupBy("manifest_id").agg(F.count("*").alias("_tasks"))

    def blank(name: str) -> Column:
        return F.coalesce(name, F.lit("")) == ""

    head = findings(
        manifests.join(counts, "manifest_id", "left"), ["manifest_id"],
        [
            ("run-name", blank("run_name")), ("workdir", blank("workdir")),
            ("no-tasks", F.coalesce("_tasks", F.lit(0)) == 0),
            ("worktrees-without-repo", F.col("worktrees") & blank("repo")),
            ("max-parallel", F.coalesce("max_parallel", F.lit(0)) < 0),
        ],
    ).select("manifest_id", F.lit(None).cast("int").alias("pos"), "rule")
    homes = manifests.select("manifest_id", F.coalesce("workdir", F.lit("")).alias("_workdir"))
    root = clean_segments(
        F.when(F.col("_workdir").startswith("/"), F.col("_workdir")).otherwise(
            F.concat(F.lit(base_dir + "/"), "_workdir")
        )
    )
    # Of the long texts only whether they are blank meets the manifests.
    told = tasks.select(
        "manifest_id", "pos", "task_key", blank("spec").alias("_no_spec"), blank("check_cmd").alias("_no_check")
    )
    placed = told.join(homes, "manifest_id").withColumns({"_root": root})
    placed = placed.withColumn(
        "_full", clean_segments(F.concat_ws("/", F.array_join("_root", "/"), "task_key"))
    )
    depth = F.size("_root")
    inside = F.slice("_full", F.lit(1), depth) == F.col("_root")
    keyed = ~blank("task_key")
    reserved = inside & (F.get("_full", depth) == "logs")
    rows = findings(
        placed, ["manifest_id", "pos"],
        [
            ("key-required", blank("task_key")),
            ("key-escapes", keyed & ~inside),
            ("key-reserved", keyed & F.coalesce(reserved, F.lit(False))),
            ("spec-required", F.col("_no_spec")), ("check-required", F.col("_no_check")),
        ],
    )
    # Every repeat after the first of a key, as the manifest lists them.
    firsts = tasks.where(keyed).groupBy("manifest_id", "task_key").agg(F.min("pos").alias("_first"))
    repeats = tasks.join(firsts.repartition("manifest_id", "task_key"), ["manifest_id", "task_key"]).where(
        F.col("pos") > F.col("_first")
    )
    again = repeats.select("manifest_id", "pos", F.lit("duplicate-key").alias("rule"))
    return head.unionByName(rows).unionByName(again)


def access_gate(tasks: DataFrame, engines: DataFrame, allow_full_access: bool) -> DataFrame:
    """Tasks the policy refuses, and tasks that must run isolated."""
    dim = engines.select("engine", F.col("isolated").alias("_isolated"))
    joined = tasks.join(dim, "engine", "left")
    refused = F.col("full_access") & F.lit(not allow_full_access)
    isolated = ~F.col("full_access") & F.coalesce("_isolated", F.lit(False))
    found = violations([("full-access-refused", refused), ("needs-isolation", isolated)])
    return joined.select("manifest_id", "pos", "task_key", F.explode(found).alias("rule"))
