"""Importing attempt logs: two dialects of JSON lines, backfills, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.values import first_nonblank, number, trimmed, truncated

ATTEMPT = [
    "id", "run_id", "run_name", "task_key", "engine", "model", "task_type", "verdict", "retry",
    "duration_s", "tokens", "check_output", "identity", "created_at",
]
UNKNOWN_TOKENS = -1
RETRY_NOTE = "retry=true"
PREFIX_MARK = "name:"


# Every field either dialect uses.  All are read as text: booleans and numbers
# arrive as their JSON spelling, so the two ways of writing them read the same.
FIELDS = [
    "run_id", "run_name", "task_key", "engine", "worker_engine", "model", "task_type", "verdict",
    "retry", "duration_s", "duration_ms", "tokens", "worker_tokens", "check_output", "notes",
    "identity", "orchestrator", "created_at", "logged_at",
]
BROKEN = "_broken"
JSON_OPTIONS = {
    "columnNameOfCorruptRecord": BROKEN, "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}

JSON_LIST_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_lines(lines: DataFrame, line: str = "line", extra: tuple[str, ...] = ()) -> DataFrame:
    """Non-blank lines with their fields in the struct ``_j``; NULL when not a JSON object."""
    schema = ", ".join(f"{name} string" for name in [*FIELDS, *extra, BROKEN])
    text = trimmed(F.col(line))
    rows = lines.withColumn("_t", text).where(F.col("_t") != "")
    parsed = rows.withColumn("_p", F.from_json("_t", schema, JSON_OPTIONS))
    # The parser stops behind the first object; where another may follow, the line is
    # read once more as a list, which must have one member.
    several = F.col("_t").rlike(r"\}\s*,?\s*\{")
    members = F.size(F.from_json(F.concat(F.lit("["), "_t", F.lit("]")), "array<struct<run_id:string>>", JSON_LIST_OPTIONS))
    whole = (
        F.col(f"_p.{BROKEN}").isNull() & F.col("_t").startswith("{") & F.col("_t").endswith("}")
        & F.when(several, F.coalesce(members == 1, F.lit(False))).otherwise(True)
    )
    return parsed.withColumn("_j", F.when(whole, F.col("_p"))).drop("_p", "_t")


def _raw(name: str) -> Column:
    return F.col(f"_j.{name}")


def field(*names: str) -> Column:
    """First non-blank of several alternative keys, as trimmed text, else blank."""
    return F.coalesce(first_nonblank(*[_raw(name) for name in names]), F.lit(""))


def retry_value() -> Column:
    """Retry count from a boolean, a number, their text forms, or the notes marker."""
    text, count = F.lower(trimmed(_raw("retry"))), F.col("_retry")
    marked = F.coalesce(_raw("notes").contains(RETRY_NOTE), F.lit(False))
    return (
        F.when(text == "true", F.lit(1))
        .when(text == "false", F.lit(0))
        .when(count > 0, count.try_cast("int"))
        .when(count.isNotNull(), F.lit(0))
        .when(marked, F.lit(1))
        .otherwise(F.lit(0))
    )


def duration_value() -> Column:
    return F.coalesce(
        number(_raw("duration_s")), number(_raw("duration_ms")) / F.lit(1000.0), F.lit(0.0)
    )


def tokens_value() -> Column:
    return F.coalesce(
        truncated(number(_raw("tokens"))), truncated(number(_raw("worker_tokens"))),
        F.lit(UNKNOWN_TOKENS).cast("bigint"),
    )


def coalesce_attempts(parsed: DataFrame, id_column: str = "line_no") -> DataFrame:
    """Native and legacy field names folded into attempt columns (before backfill)."""
    # A column of its own, because the retry ladder looks at it several times.
    return parsed.withColumn("_retry", number(_raw("retry"))).select(
        F.col(id_column).alias("id"), F.col("_j").isNotNull().alias("parsed"),
        field("run_id").alias("run_id"), field("run_name").alias("run_name"),
        field("task_key").alias("task_key"), field("engine", "worker_engine").alias("engine"),
        field("model").alias("model"), field("task_type").alias("task_type"),
        F.upper(field("verdict")).alias("verdict"), retry_value().alias("retry"),
        duration_value().alias("duration_s"), tokens_value().alias("tokens"),
        field("check_output", "notes").alias("check_output"),
        field("identity", "orchestrator").alias("identity"),
        field("created_at", "logged_at").alias("created_at"),
    )


def task_models(run_tasks: DataFrame) -> DataFrame:
    """Model of the first task with a key, per run; ``pos`` is the task's place."""
    return run_tasks.groupBy("run_id", "task_key").agg(
        F.coalesce(F.min_by("model", "pos"), F.lit("")).alias("_run_model")
    )


def backfill_model(rows: DataFrame, run_tasks: DataFrame) -> DataFrame:
    """Blank models take the run state's task model; a matched blank stays blank."""
    known = task_models(run_tasks).where("run_id <> '' and task_key <> ''")
    # Its own exchange lets adaptive execution split a hot task's log rows.
    joined = rows.join(known.repartition("run_id", "task_key"), ["run_id", "task_key"], "left")
    model = F.coalesce(F.nullif("model", F.lit("")), "_run_model", F.lit(""))
    return joined.withColumn("model", model).select(*rows.columns)


def backfill_task_type(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Blank task types from a map: ``run:task``, then ``run``, then the longest prefix.

    Blank values fall through the first two tiers; in the third the longest
    prefix wins even when its value is blank, which leaves the type blank.  Of a
    key that is listed twice the greatest value counts.  The prefix tier runs on
    distinct run ids and turns the prefix test into an equi join on those beginnings
    of the run id that are as long as some key of the map.
    """
    entries = mapping.select("k", F.coalesce("v", F.lit("")).alias("v"))
    exact = entries.where(F.col("v") != "")
    # The need is an aggregate, not a filter: a filter would be pushed below the
    # parsing of the lines and parse them a second time.
    blank = (F.col("task_type") == "") & (F.col("run_id") != "")
    runs = rows.groupBy("run_id").agg(F.bool_or(blank).alias("_need")).where("_need").select("run_id")
    own = F.array(F.struct(F.lit(True).alias("whole"), F.col("run_id").alias("k")))
    named = entries.where(F.startswith("k", F.lit(PREFIX_MARK)))
    sizes = named.agg(F.collect_set(F.char_length("k") - len(PREFIX_MARK))).scalar()
    starts = F.transform(
        F.filter("sizes", lambda n: (n >= 1) & (n <= F.char_length("run_id"))),
        lambda n: F.struct(
            F.lit(False).alias("whole"),
            F.concat(F.lit(PREFIX_MARK), F.substring("run_id", F.lit(1), n)).alias("k"),
        ),
    )
    found = runs.withColumn("sizes", sizes).select("run_id", F.inline(F.concat(own, starts))).join(entries, "k")
    prefix_size = F.when(~F.col("whole"), F.char_length("k"))
    per_run = found.groupBy("run_id").agg(
        F.max(F.when(F.col("whole"), F.nullif("v", F.lit("")))).alias("_t2"),
        F.max_by("v", F.when(~F.col("whole"), F.struct(prefix_size.alias("size"), "v"))).alias("_t3"),
    ).select("run_id", F.coalesce("_t2", "_t3").alias("_by_run"))
    per_task = exact.groupBy(F.col("k").alias("_pair")).agg(F.max("v").alias("_t1"))
    pair = F.when(
        (F.col("run_id") != "") & (F.col("task_key") != ""),
        F.concat("run_id", F.lit(":"), "task_key"),
    )
    joined = (
        rows.withColumn("_pair", F.coalesce(pair, F.concat(F.lit("\0"), F.col("id").cast("string"))))
        .join(per_task, "_pair", "left")
        .join(per_run.repartition("run_id"), "run_id", "left")
    )
    filled = F.coalesce(F.nullif("task_type", F.lit("")), "_t1", "_by_run", F.lit(""))
    return joined.withColumn("task_type", filled).select(*rows.columns)


def reject_reason() -> Column:
    return (
        F.when(~F.col("parsed"), "bad_json")
        .when(F.col("run_id") == "", "no_run_id")
        .when(F.col("task_key") == "", "no_task_key")
        .when(F.col("verdict") == "", "no_verdict")
    )


def classify(rows: DataFrame) -> DataFrame:
    """Adds ``reject_reason``; NULL marks a row that can be imported."""
    return rows.withColumn("reject_reason", reject_reason())


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNull()).select(*ATTEMPT)


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNotNull()).select("id", "reject_reason")


def import_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("imported"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"),
    )
