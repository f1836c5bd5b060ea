"""Scoreboards over the attempt log.

Grains: an *attempt* is one row; an *instance* is a (run_id, task_key) pair,
whose first and final attempts are the lowest and highest ``id``.  The engine
filter applies to attempts before instances form, the other filters to the
final attempt afterwards, and the two medians live at different grains
(durations of final attempts, tokens of every attempt), so none of these steps
may be merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.median import exact_median
from attestry.session import cut_lineage

INSTANCE = ["run_id", "task_key"]
UNTYPED = "(untyped)"
PROVEN_TASKS = 3
ROUTER_PREFIX = "openrouter/"
TOKENS_PER_PRICE_UNIT = 1_000_000


@dataclass(frozen=True)
class ScoreFilter:
    """Empty fields are off.  ``since`` compares with the RFC3339 text."""

    task_type: str = ""
    model: str = ""
    engine: str = ""
    since: str = ""


def _nonblank(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def label_column() -> Column:
    return F.coalesce(_nonblank("model"), F.trim(F.col("engine")))


def task_type_column() -> Column:
    return F.coalesce(_nonblank("task_type"), F.lit(UNTYPED))


def labelled_attempts(attempts: DataFrame) -> DataFrame:
    """Each attempt with its own model label, task type and upper-cased verdict."""
    return attempts.select(
        "id", "run_id", "task_key",
        label_column().alias("model"), "engine", task_type_column().alias("task_type"),
        F.upper("verdict").alias("verdict"),
    )


def engine_attempts(attempts: DataFrame, f: ScoreFilter) -> DataFrame:
    return attempts.where(F.col("engine") == f.engine) if f.engine else attempts


def task_instances(attempts: DataFrame) -> DataFrame:
    """First id, final id and attempt count of every instance."""
    return attempts.groupBy(*INSTANCE).agg(
        F.min("id").alias("first_id"), F.max("id").alias("final_id"), F.count("*").alias("n")
    )


def first_final(attempts: DataFrame) -> DataFrame:
    """Labelled instances in one aggregate: one shuffle in place of two self joins.

    ``min_by``/``max_by`` combine on the map side, so a hot instance is reduced
    before it is shuffled.
    """
    final = F.struct(
        label_column().alias("model"), F.col("engine").alias("engine"),
        task_type_column().alias("task_type"), F.upper("verdict").alias("verdict"),
        F.col("duration_s").alias("duration_s"), F.col("created_at").alias("created_at"),
    )
    picked = attempts.groupBy(*INSTANCE).agg(
        F.count("*").alias("attempts_in_task"),
        F.max("id").alias("final_id"),
        F.max_by(final, F.col("id")).alias("f"),
        F.min_by(F.upper("verdict"), F.col("id")).alias("first_verdict"),
    )
    return picked.select(
        *INSTANCE, "attempts_in_task", "final_id", "f.model", "f.engine", "f.task_type",
        F.col("f.verdict").alias("final_verdict"), F.col("f.duration_s").alias("final_duration_s"),
        F.col("f.created_at").alias("final_created_at"), "first_verdict",
    )


def selected_instances(attempts: DataFrame, f: ScoreFilter = ScoreFilter()) -> DataFrame:
    """Instances after both filter stages."""
    out = first_final(engine_attempts(attempts, f))
    if f.model:
        out = out.where(F.col("model") == f.model)
    if f.task_type:
        out = out.where(F.col("task_type") == f.task_type)
    if f.since:
        out = out.where(F.col("final_created_at") >= f.since)
    return out


def labelled_tokens(
    instances: DataFrame, attempts: DataFrame, f: ScoreFilter = ScoreFilter()
) -> DataFrame:
    """Known token counts of all attempts, under their instance's final label.

    The narrow instance side gets an exchange of its own: that is the shape in
    which adaptive execution can split a hot instance's attempts.
    """
    labels = instances.select(*INSTANCE, "model", "task_type").repartition(*INSTANCE)
    known = (
        engine_attempts(attempts, f)
        .where(F.col("tokens") >= 0)
        .select(*INSTANCE, "tokens")
    )
    return known.join(labels, INSTANCE)


def token_medians(
    instances: DataFrame, attempts: DataFrame, keys: list[str], f: ScoreFilter = ScoreFilter()
) -> DataFrame:
    tokens = labelled_tokens(instances, attempts, f)
    return exact_median(tokens, keys, F.col("tokens"), "median_tokens")


def latest_engine(instances: DataFrame, keys: list[str]) -> DataFrame:
    """Engine of the most recent final attempt; equal times go to the later id."""
    return instances.groupBy(*keys).agg(_latest_engine().alias("engine"))


def _latest_engine() -> Column:
    return F.max_by("engine", F.struct("final_created_at", "final_id"))


def _rate(condition: Column) -> Column:
    return F.avg(F.when(condition, F.lit(1).cast("double")).otherwise(F.lit(0).cast("double")))


def _rollup(instances: DataFrame, keys: list[str]) -> DataFrame:
    passed = F.col("final_verdict") == "PASS"
    totals = [
        _latest_engine().alias("engine"),
        F.count("*").alias("tasks"),
        F.sum("attempts_in_task").alias("attempts"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        _rate(F.col("first_verdict") == "PASS").alias("first_rate"),
        _rate(passed).alias("pass_rate"),
        F.max("final_created_at").alias("last_seen"),
    ]
    durations = exact_median(instances, keys, F.col("final_duration_s"), "median_duration_s")
    return _beside(instances.groupBy(*keys).agg(*totals), durations, keys)


def _beside(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` in which a null key meets a null key."""
    named = more.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, same, "left").drop(*[f"_{k}" for k in keys])


def catalog_key(label: Column) -> Column:
    """Catalog id of a label: the router prefix is dropped whatever its case."""
    return F.when(
        F.ilike(label, F.lit(ROUTER_PREFIX + "%")),
        F.substr(label, F.lit(len(ROUTER_PREFIX) + 1)),
    ).otherwise(label)


def with_cost(rollup: DataFrame, catalog: DataFrame) -> DataFrame:
    """Estimated cost per task; unknown before free, free before priced."""
    prices = catalog.select(
        F.col("id").alias("_catalog_id"), "prompt_per_m", "completion_per_m",
        "variable_pricing", "free",
    )
    keyed = rollup.withColumn("_catalog_id", catalog_key(F.col("model")))
    mean_price = (
        F.coalesce("prompt_per_m", F.lit(0.0)) + F.coalesce("completion_per_m", F.lit(0.0))
    ) / F.lit(2.0)
    # One catalog row per id is the snapshot's contract (see catalog.snapshot_rows).
    joined = keyed.join(prices.withColumn("_listed", F.lit(True)), "_catalog_id", "left")
    cost = (
        F.when(
            F.col("median_tokens").isNull() | F.col("_listed").isNull() | F.col("variable_pricing"),
            F.lit(None).cast("double"),
        )
        .when(F.col("free"), F.lit(0.0))
        .otherwise(F.col("median_tokens") * mean_price / F.lit(float(TOKENS_PER_PRICE_UNIT)))
    )
    return joined.withColumn("cost", cost).drop(
        "_catalog_id", "prompt_per_m", "completion_per_m", "variable_pricing", "free", "_listed"
    )


def tier_column(min_tasks: int = PROVEN_TASKS, min_first_rate: float = 0.0) -> Column:
    proven = (F.col("tasks") >= min_tasks) & (F.col("first_rate") >= F.lit(min_first_rate))
    return F.when(proven, "proven").otherwise("probation")


def scoreboard_models(
    attempts: DataFrame,
    catalog: DataFrame | None = None,
    f: ScoreFilter = ScoreFilter(),
    min_tasks: int = PROVEN_TASKS,
    min_first_rate: float = 0.0,
) -> DataFrame:
    """Per-model roll-up, ranked."""
    instances = selected_instances(attempts, f)
    rollup = _with_medians(instances, attempts, ["model"], f)
    return finished_models(rollup, catalog, min_tasks, min_first_rate)


def finished_models(
    rollup: DataFrame, catalog: DataFrame | None = None, min_tasks: int = PROVEN_TASKS, min_first_rate: float = 0.0
) -> DataFrame:
    """A model roll-up with tier, retries and cost, ranked."""
    rollup = rollup.withColumn("tier", tier_column(min_tasks, min_first_rate)).withColumn(
        "retries", F.col("attempts") - F.col("tasks")
    )
    if catalog is None:
        rollup = rollup.withColumn("cost", F.lit(None).cast("double"))
    else:
        rollup = with_cost(rollup, catalog)
    return rank_models(rollup).select(
        "model", "engine", "tier", "tasks", "attempts", "retries", "passed", "failed",
        "first_rate", "pass_rate", "median_duration_s", "median_tokens", "last_seen", "cost",
    )


def scoreboard_groups(attempts: DataFrame, f: ScoreFilter = ScoreFilter()) -> DataFrame:
    """Per-(model, task type) roll-up, ranked."""
    instances = selected_instances(attempts, f)
    rollup = _with_medians(instances, attempts, ["model", "task_type"], f)
    return rank_groups(rollup).select(
        "model", "task_type", "engine", "tasks", "attempts", "passed", "failed",
        "first_rate", "pass_rate", "median_duration_s", "median_tokens", "last_seen",
    )


def _with_medians(
    instances: DataFrame, attempts: DataFrame, keys: list[str], f: ScoreFilter
) -> DataFrame:
    instances = cut_lineage(instances)  # read by the roll-up and by both medians
    tokens = token_medians(instances, attempts, keys, f)
    return _beside(_rollup(instances, keys), tokens, keys)


def score_dims(attempts: DataFrame, f: ScoreFilter = ScoreFilter()) -> DataFrame:
    """Task count, token median and latest engine per model."""
    instances = selected_instances(attempts, f)
    counts = instances.groupBy("model").agg(
        F.count("*").alias("tasks"), _latest_engine().alias("engine")
    )
    return _beside(counts, token_medians(instances, attempts, ["model"], f), ["model"])


def rank_models(rollup: DataFrame) -> DataFrame:
    """Proven first, then rates, then cheapest; an unpriced model sorts as free
    only when its tokens are unknown."""
    return rollup.orderBy(*model_order())


def model_order() -> list[Column]:
    price = F.coalesce(
        "cost", F.when(F.col("median_tokens").isNull(), F.lit(0.0)).otherwise(F.lit(float("inf")))
    )
    return [
        F.when(F.col("tier") == "proven", 0).when(F.col("tier") == "probation", 1).otherwise(3),
        F.desc("first_rate"), F.desc("pass_rate"), price, F.col("model"),
    ]


def rank_groups(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy("task_type", F.desc("pass_rate"), F.desc("first_rate"), "model")


def group_positions(rollup: DataFrame) -> DataFrame:
    """Position of each model inside its task type, in display order."""
    order = Window.partitionBy("task_type").orderBy(
        F.desc("pass_rate"), F.desc("first_rate"), "model"
    )
    return rollup.withColumn("position", F.row_number().over(order))


def tiers(
    rollup: DataFrame, untested: DataFrame, min_tasks: int = PROVEN_TASKS,
    min_first_rate: float = 0.0,
) -> DataFrame:
    """Local tiers together with catalog models nobody has tried."""
    local = rollup.select(
        "model", tier_column(min_tasks, min_first_rate).alias("tier"),
        "tasks", "first_rate", "pass_rate",
    )
    waiting = untested.select(F.col("id").alias("model"), F.lit("untested").alias("tier"))
    return local.unionByName(waiting, allowMissingColumns=True)


def nest_task_types(groups: DataFrame, models: DataFrame) -> DataFrame:
    """Model roll-up with its task types nested, biggest first.

    Task types per model are a handful of labels, so the nested list is small;
    the sort key is built into the struct so no lambda comparator is needed.
    """
    entry = F.struct(
        (-F.col("tasks")).alias("_order"), "task_type", "tasks", "attempts", "passed", "failed",
        "first_rate", "pass_rate", "last_seen",
    )
    nested = groups.groupBy("model").agg(F.array_sort(F.collect_list(entry)).alias("_types"))
    fields = F.transform("_types", lambda t: t.dropFields("_order")).alias("task_types")
    return models.join(nested.select("model", fields), "model", "left")
