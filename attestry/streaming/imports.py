"""Streaming log import, scoreboard upkeep and catalog refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.operators import ingest, scoreboard
from attestry.plans.attempt_import import classified_rows
from attestry.plans.catalog_refresh import refresh
from attestry.sources import storage
from attestry.streaming import board_state, runtime

BUCKETS = 64  # of the scoreboard's stored state


def stream_attempts(
    lines: DataFrame, root: str, run_tasks: DataFrame | None = None,
    mapping: DataFrame | None = None, **options,
) -> StreamingQuery:
    """Continuous import: accepted rows and rejects, one folder each per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = classified_rows(batch, run_tasks, mapping).persist()
        try:
            runtime.write_batch(ingest.accepted(rows), f"{root}/attempts", batch_id)
            runtime.write_batch(ingest.rejected(rows), f"{root}/rejects", batch_id)
        finally:
            rows.unpersist()

    writer = lines.writeStream.foreachBatch(write)
    return runtime.start(writer, lines.sparkSession, "attempts", **options)


def stream_scoreboard(
    attempts: DataFrame, root: str, catalog: DataFrame | None = None, buckets: int = BUCKETS, **options
) -> StreamingQuery:
    """Keep the model scoreboard current.

    Instances and each model's counted values are stored state (see ``board_state``): a
    batch reads and writes the buckets it touches and gives new rows for the models whose
    instances changed.  A model left without instances gets a row with no tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        models, counted = board_state.take_in(batch, batch_id, root, buckets)
        board = scoreboard.finished_models(board_state.rollup(counted), catalog)
        gone = models.join(board.select("model"), "model", "left_anti").withColumn("tasks", F.lit(0).cast("bigint"))
        runtime.write_batch(board.unionByName(gone, allowMissingColumns=True), f"{root}/board", batch_id)

    writer = attempts.writeStream.foreachBatch(write)
    return runtime.start(writer, attempts.sparkSession, "scoreboard", **options)


def current_scoreboard(spark: SparkSession, root: str) -> DataFrame:
    board = runtime.latest_rows(runtime.read_batches(spark, f"{root}/board"), ["model"])
    return scoreboard.rank_models(board.where(F.col("tasks") > 0))


def stream_catalog(payloads: DataFrame, root: str, **options) -> StreamingQuery:
    """Refresh the catalog once for every payload that has arrived in full.

    ``payloads`` holds normalised model rows with their payload's ``fetched_at``, their
    ``position`` in it and its ``total`` of rows.  A payload may come in any number of
    files and batches, and a batch may hold parts of many.  Parts are kept by payload;
    one is complete when ``total`` different positions have come.  Rows that come again
    change nothing.  Complete payloads of a batch are refreshed oldest first; one without
    a total waits for ever.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = F.concat(F.lit("at-"), F.replace("fetched_at", F.lit(":"), F.lit(".")))
        parts = f"{root}/parts/batch={batch_id}"
        batch.withColumn("payload", key).write.mode("overwrite").partitionBy("payload").parquet(parts)
        touched = spark.read.schema(batch.schema).parquet(parts).select("fetched_at").distinct()
        # A batch holds few payloads: each is a whole catalog.
        for fetched_at in [r[0] for r in touched.orderBy("fetched_at").toLocalIterator()]:
            rows = spark.read.schema(batch.schema).parquet(f"{root}/parts/batch=*/payload={storage.payload_key(fetched_at)}")
            come, total = rows.agg(F.count_distinct("position"), F.max("total")).first()
            if come == total:
                refresh(rows, root, fetched_at, F.col("position"))

    writer = payloads.writeStream.foreachBatch(write)
    return runtime.start(writer, payloads.sparkSession, "catalog", **options)


def catalog_events(spark: SparkSession, root: str) -> DataFrame:
    return storage.read_events(spark, root)
