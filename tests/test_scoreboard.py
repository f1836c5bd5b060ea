"""Scoreboard and median semantics on literal rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from attestry.operators import median, ranks, scoreboard

ATTEMPTS = (
    "id bigint, run_id string, task_key string, engine string, model string, task_type string, "
    "verdict string, retry int, duration_s double, tokens bigint, created_at string"
)
SEED = [
    (1, "r1", "t1", "codex", "M", "code", "PASS", 0, 10.0, 100, "2026-07-10T00:00:01Z"),
    (2, "r1", "t2", "codex", "M", "code", "FAIL", 0, 5.0, 50, "2026-07-10T00:00:02Z"),
    (3, "r1", "t2", "codex", "M", "code", "PASS", 1, 8.0, 60, "2026-07-10T00:00:03Z"),
    (4, "r1", "t3", "codex", "M", "docs", "PASS", 0, 20.0, 200, "2026-07-10T00:00:04Z"),
    (5, "r2", "u1", "grok", "N", "code", "FAIL", 0, 3.0, 30, "2026-07-10T00:00:05Z"),
]
CATALOG = (
    "id string, prompt_per_m double, completion_per_m double, variable_pricing boolean, free boolean"
)


@pytest.fixture()
def attempts(spark):
    return spark.createDataFrame(SEED, ATTEMPTS)


def test_model_rows(spark, attempts):
    catalog = spark.createDataFrame([("M", 2.0, 4.0, False, False)], CATALOG)
    rows = scoreboard.scoreboard_models(attempts, catalog).collect()
    assert [r.model for r in rows] == ["M", "N"]
    m, n = rows
    assert (m.tier, m.tasks, m.attempts, m.retries, m.passed, m.failed) == ("proven", 3, 4, 1, 3, 0)
    assert m.first_rate == pytest.approx(2 / 3) and m.pass_rate == 1.0 and m.engine == "codex"
    # Durations of final attempts, tokens of every attempt: 80, not 100.
    assert m.median_duration_s == 10 and m.median_tokens == 80
    assert m.cost == pytest.approx(0.00024)
    assert n.tier == "probation" and n.pass_rate == 0 and n.cost is None


def test_filters_apply_at_their_own_stage(attempts):
    only = scoreboard.scoreboard_models(attempts, None, scoreboard.ScoreFilter(engine="grok"))
    assert [r.model for r in only.collect()] == ["N"]
    docs = scoreboard.scoreboard_models(attempts, None, scoreboard.ScoreFilter(task_type="docs"))
    assert [(r.model, r.tasks) for r in docs.collect()] == [("M", 1)]


def test_router_prefix_is_stripped_for_the_price(spark):
    row = (1, "r", "t", "opencode", "OpenRouter/z-ai/glm", "x", "PASS", 0, 1.0, 1000, "2026-07-10T00:00:00Z")
    attempts = spark.createDataFrame([row], ATTEMPTS)
    catalog = spark.createDataFrame([("z-ai/glm", 2.0, 2.0, False, False)], CATALOG)
    assert scoreboard.scoreboard_models(attempts, catalog).first().cost == pytest.approx(0.002)


@pytest.mark.parametrize(
    "price,expected",
    [((None, None, True, True), None), ((1.0, 1.0, False, True), 0.0), ((None, 4.0, False, False), 80 * 2 / 1e6)],
)
def test_cost_ladder(spark, attempts, price, expected):
    catalog = spark.createDataFrame([("M", *price)], CATALOG)
    cost = scoreboard.scoreboard_models(attempts, catalog).first().cost
    assert cost == (None if expected is None else pytest.approx(expected))


def test_documented_tier_rule_is_a_parameter(attempts):
    strict = scoreboard.scoreboard_models(attempts, None, min_first_rate=0.67)
    assert strict.where("model = 'M'").first().tier == "probation"


@pytest.mark.parametrize(
    "values,expected", [([1, 5, 3], 3), ([10, 20, 40, 30], 25), ([7], 7), ([], None), ([None, 2], 2)]
)
def test_median_cases(spark, values, expected):
    df = spark.createDataFrame([("k", None if v is None else float(v)) for v in values], "k string, v double")
    rows = median.exact_median(df, ["k"], F.col("v"), "m").collect()
    assert [r.m for r in rows] == ([] if expected is None else [expected])


@pytest.mark.parametrize("parts", [1, 2, 3, 8])
def test_median_with_a_dominant_group(spark, parts):
    """One group holds most rows, one has a null key, one holds NaN."""
    rng = random.Random(parts)
    rows = [("hot", rng.choice([rng.gauss(0, 50), float(rng.randint(-3, 3))])) for _ in range(20_000)]
    rows += [(f"k{i % 7}", rng.random()) for i in range(400)] + [("flat", 2.5)] * 1_000
    rows += [(None, 4.0), (None, 8.0)]
    want = {k: statistics.median(v for g, v in rows if g == k) for k in {r[0] for r in rows}}
    nan = float("nan")
    rows += [("n3", 5.0), ("n3", nan), ("n3", 2.0), ("n2", nan), ("n2", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    got = {r.k: r.m for r in median.exact_median(df, ["k"], F.col("v"), "m").collect()}
    assert got.pop("n3") == 5.0 and got.pop("n2") != 0 and got == pytest.approx(want)


def test_median_bins_follow_the_order_of_values(spark):
    rng = random.Random(5)
    inf = float("inf")
    values = sorted({rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-1070, 1000) for _ in range(4_000)}
                    | {rng.gauss(300, 1) for _ in range(4_000)} | {0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, inf, -inf})
    df = spark.createDataFrame([(v,) for v in values + [float("nan")]], "v double")
    bins = [r.b for r in df.select(median.bin_of(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins) and len(set(bins)) > 1_000


def test_medians_run_nothing_while_planned(spark):
    """Infinite values, and no stage before the result is asked for."""
    inf = float("inf")
    df = spark.createDataFrame([("a", inf), ("a", -inf), ("a", 3.0), ("b", -inf), ("b", -2.0), ("b", -8.0)], "k string, v double")
    spark.sparkContext.setJobGroup("median-plan", "")
    planned = median.exact_median(df, ["k"], F.col("v"), "m")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("median-plan")
    assert {r.k: r.m for r in planned.collect()} == {"a": 3.0, "b": -8.0}


def test_global_median(spark):
    df = spark.range(1001).withColumn("v", F.col("id") * 2)
    assert median.exact_median(df, [], F.col("v"), "m").first().m == 1000


def test_ranks_are_those_of_one_order(spark):
    df = spark.range(5_000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(700))).repartition(7)
    got = ranks.ranked(df, [F.desc("v"), F.col("id")]).collect()
    order = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r["rank"] for r in order] == list(range(1, 5_001))


def test_instances_take_one_shuffle(spark, attempts):
    plan = scoreboard.first_final(attempts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
