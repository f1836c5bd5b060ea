"""State of the streamed scoreboard: instances, and counted values per model.

Every table is kept in buckets.  A batch reads the newest version of the buckets it
touches and writes their next version; what it does not touch is neither read nor
written.  A model's values are counted multisets that change by signed counts, so its
medians follow from few distinct values and never from the log.  A replayed batch reads
the versions before it and writes its own again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attestry.operators import scoreboard
from attestry.operators.median import counted_median
from attestry.operators.scoreboard import INSTANCE
from attestry.streaming import runtime

FINAL = "struct<model: string, engine: string, verdict: string, duration_s: double, created_at: string>"
SCHEMAS = {
    "instances": f"run_id string, task_key string, attempts long, final_id long, final {FINAL}, first_id long, first_verdict string, bucket int",
    "tokens": "run_id string, task_key string, tokens double, c long, bucket int",
    "models": (
        "model string, kind string, value double, at string, id long, engine string, "
        "c long, attempts long, passed long, first long, bucket int"
    ),
}
VALUE = ["model", "kind", "value", "at", "id", "engine"]
SUMS = ["c", "attempts", "passed", "first"]


class BoardState:
    """The tables below ``root``; ``buckets`` may not change once a table is written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root, buckets

    def bucket(self, *keys: str):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def versions(self, table: str, wanted: list[int], before: int) -> list[str]:
        """Folders of the newest versions of the wanted buckets; one small row a bucket and batch is read."""
        try:
            ledger = self.spark.read.schema("kept string, bucket int, batch long").parquet(f"{self.root}/ledger")
        except AnalysisException:
            return []
        newest = (
            ledger.where((F.col("kept") == table) & (F.col("batch") < before) & F.col("bucket").isin(wanted))
            .groupBy("bucket").agg(F.max("batch").alias("batch"))
        )
        return [f"{self.root}/{table}/batch={r.batch}/part={r.bucket}" for r in newest.collect()]

    def read(self, table: str, wanted: list[int], before: int) -> DataFrame:
        paths = self.versions(table, wanted, before)
        schema = SCHEMAS[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, table: str, rows: DataFrame, wanted: list[int], batch_id: int) -> DataFrame:
        """The next version of the wanted buckets, which are listed last."""
        path = f"{self.root}/{table}/batch={batch_id}"
        rows.withColumn("part", F.col("bucket")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        left = self.spark.read.parquet(path).select("bucket").distinct()
        left.select(F.lit(table).alias("kept"), "bucket", F.lit(batch_id).cast("long").alias("batch")).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/ledger/of={table}-{batch_id}")
        return self.spark.read.schema(SCHEMAS[table]).parquet(path)


def _touched(rows: DataFrame) -> list[int]:
    """Bucket numbers: never more than there are buckets."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


def _merged(old: DataFrame, batch: DataFrame, state: BoardState) -> DataFrame:
    """Instances of the touched buckets with the batch's attempts taken in."""
    final = F.struct(
        scoreboard.label_column().alias("model"), F.col("engine"), F.upper("verdict").alias("verdict"),
        F.col("duration_s").cast("double").alias("duration_s"), F.col("created_at"),
    )
    fresh = batch.select(
        *INSTANCE, F.lit(1).cast("long").alias("attempts"), F.col("id").cast("long").alias("final_id"), final.alias("final"),
        F.col("id").cast("long").alias("first_id"), F.upper("verdict").alias("first_verdict"), state.bucket(*INSTANCE),
    )
    return fresh.unionByName(old).groupBy(*INSTANCE, "bucket").agg(
        F.sum("attempts").alias("attempts"), F.max_by("final", "final_id").alias("final"), F.max("final_id").alias("final_id"),
        F.min_by("first_verdict", "first_id").alias("first_verdict"), F.min("first_id").alias("first_id"),
    )


def _signed(instances: DataFrame, tokens: DataFrame, sign: int) -> DataFrame:
    """What instances add to their models, or take away."""
    none = {k: F.lit(None).cast(t) for k, t in (("value", "double"), ("at", "string"), ("id", "long"), ("engine", "string"))}
    zero = F.lit(0).cast("long")

    def facts(rows: DataFrame, kind: str, **given) -> DataFrame:
        columns = {**none, "c": F.lit(sign).cast("long"), "attempts": zero, "passed": zero, "first": zero, **given}
        return rows.select(F.col("final.model").alias("model"), F.lit(kind).alias("kind"), *[v.alias(k) for k, v in columns.items()])

    passed, first = (F.when(F.col(c) == "PASS", sign).otherwise(0).cast("long") for c in ("final.verdict", "first_verdict"))
    counted = tokens.join(instances.select(*INSTANCE, "final"), INSTANCE)
    return (
        facts(instances, "sum", attempts=sign * F.col("attempts"), passed=passed, first=first)
        .unionByName(facts(instances, "final", at=F.col("final.created_at"), id=F.col("final_id"), engine=F.col("final.engine")))
        .unionByName(facts(instances.where("final.duration_s is not null"), "duration", value=F.col("final.duration_s")))
        .unionByName(facts(counted, "tokens", value=F.col("tokens"), c=sign * F.col("c")))
    )


def rollup(models: DataFrame) -> DataFrame:
    """The model roll-up from counted values."""
    total = models.where("kind = 'sum'").select(
        "model", F.col("c").alias("tasks"), "attempts", "passed", (F.col("c") - F.col("passed")).alias("failed"),
        (F.col("first") / F.col("c")).alias("first_rate"), (F.col("passed") / F.col("c")).alias("pass_rate"),
    )
    seen = models.where("kind = 'final'").groupBy("model").agg(
        F.max_by("engine", F.struct("at", "id")).alias("engine"), F.max("at").alias("last_seen")
    )
    board = scoreboard._beside(total, seen, ["model"])
    for kind, out in (("duration", "median_duration_s"), ("tokens", "median_tokens")):
        counted = models.where(F.col("kind") == kind).select("model", F.col("value").alias("_v"), F.col("c").alias("_c"))
        board = scoreboard._beside(board, counted_median(counted, ["model"], out), ["model"])
    return board


def take_in(batch: DataFrame, batch_id: int, root: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Bring the state up to date; returns the touched models and their counted values."""
    spark = batch.sparkSession
    state = BoardState(spark, root, buckets)
    keyed = batch.select("*", state.bucket(*INSTANCE))
    wanted = _touched(keyed)
    old, old_tokens = state.read("instances", wanted, batch_id), state.read("tokens", wanted, batch_id)
    now = state.write("instances", _merged(old, batch, state), wanted, batch_id)
    fresh = keyed.where("tokens >= 0").select(*INSTANCE, F.col("tokens").cast("double").alias("tokens"), F.lit(1).cast("long").alias("c"), "bucket")
    tokens_now = state.write(
        "tokens", fresh.unionByName(old_tokens).groupBy(*INSTANCE, "tokens", "bucket").agg(F.sum("c").alias("c")), wanted, batch_id
    )
    keys = keyed.select(*INSTANCE).distinct()
    changes = f"{root}/changes"
    runtime.write_batch(
        _signed(now.join(keys, INSTANCE, "left_semi"), tokens_now, 1)
        .unionByName(_signed(old.join(keys, INSTANCE, "left_semi"), old_tokens, -1))
        .groupBy(*VALUE).agg(*[F.sum(c).alias(c) for c in SUMS]).select("*", state.bucket("model")),
        changes, batch_id,
    )
    signed = spark.read.schema(SCHEMAS["models"]).parquet(f"{changes}/batch={batch_id}")
    theirs = _touched(signed)
    counted = (
        signed.unionByName(state.read("models", theirs, batch_id)).groupBy(*VALUE, "bucket")
        .agg(*[F.sum(c).alias(c) for c in SUMS]).where("c <> 0")
    )
    models = signed.select("model").distinct()
    kept = state.write("models", counted, theirs, batch_id)
    return models, kept.join(models.select(F.col("model").alias("_m")), F.col("model").eqNullSafe(F.col("_m")), "left_semi")
