"""Task state and output tails kept from streams.

Both keep mergeable parts: a batch is combined in the JVM and written as a folder of its
own, and every few batches all folders are merged into one base, where tasks that have
been idle for too long go.  A read meets one base and a bounded number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.operators import logs
from attestry.streaming import runtime

TASK = ["run_id", "task_key"]
MERGE_EVERY = 32  # batches
KEEP_SECONDS = 30 * 24 * 3600  # of idle tasks


def _keep(
    rows: DataFrame, root: str, name: str, part: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame],
    every: int, keep_seconds: int, options: dict,
) -> StreamingQuery:
    """Write each batch's part; merge the folders every ``every`` batches, idle tasks left out."""
    spark = rows.sparkSession

    def merged(kept: DataFrame) -> DataFrame:
        newest = kept.groupBy(*TASK).agg(F.max("written_at").alias("_newest"))
        idle = newest.where(F.timestamp_diff("SECOND", F.col("_newest"), F.current_timestamp()) >= keep_seconds)
        return merge(kept.join(idle.select(*TASK), TASK, "left_anti"))

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = part(batch).withColumn("written_at", F.current_timestamp())
        runtime.write_batch(stamped, root, batch_id)
        if batch_id % every == every - 1:
            runtime.compact(spark, root, batch_id, merged)

    return runtime.start(rows.writeStream.foreachBatch(write), spark, name, **options)


def _partial_state(events: DataFrame) -> DataFrame:
    """What a set of status commands says about each task, in a form that merges in any order."""
    seq = F.col("seq")
    begun = (F.col("op") == "set_status") & seq.isNotNull()
    ended = (F.col("op") == "set_result") & seq.isNotNull()
    return events.groupBy(*TASK).agg(
        F.max(F.when(seq.isNotNull(), F.struct("seq", "status"))).alias("last"),
        F.max(F.when(begun, F.struct("seq", "attempt"))).alias("begun"),
        F.min(F.when(begun, F.struct("seq", "ts"))).alias("first"),
        F.max(F.when(ended, F.struct("seq", "ts"))).alias("ended"),
    )


def _merged_state(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*TASK).agg(
        F.max("last").alias("last"), F.max("begun").alias("begun"), F.min("first").alias("first"),
        F.max("ended").alias("ended"), F.max("written_at").alias("written_at"),
    )


def stream_task_state(
    events: DataFrame, root: str, every: int = MERGE_EVERY, keep_seconds: int = KEEP_SECONDS, **options
) -> StreamingQuery:
    """Status commands to current task rows, equal to ``runs.task_state`` in any arrival order.

    A chatty task is combined on the map side within its batch; nothing is kept in Spark's
    own state.  Tasks without a command for ``keep_seconds`` go at the next merge.
    """
    return _keep(events, root, "task-state", _partial_state, _merged_state, every, keep_seconds, options)


def current_task_state(spark: SparkSession, root: str) -> DataFrame:
    return _merged_state(runtime.read_compacted(spark, root)).select(
        *TASK, "last.status", "begun.attempt", F.col("first.ts").alias("started_at"),
        F.col("ended.ts").alias("ended_at"), F.col("last.seq").alias("last_seq"),
    )


def retained_chunks(chunks: DataFrame, cap: int, block: int) -> DataFrame:
    """Chunks that can still be retained: newest first up to ``cap`` bytes, one at least.

    Blocks of sequence numbers are weighed first, so only those near the end are ordered.
    """
    sized = chunks.withColumns(
        {"_n": F.octet_length("chunk"), "_block": F.floor(F.col("seq") / block).cast("bigint")}
    )
    weights = sized.groupBy(*TASK, "_block").agg(F.sum("_n").alias("_w"))
    newer = Window.partitionBy(*TASK).orderBy(F.desc("_block")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    near = weights.withColumn("_after", F.coalesce(F.sum("_w").over(newer), F.lit(0))).where(
        F.col("_after") <= cap
    )
    order = Window.partitionBy(*TASK).orderBy(F.desc("seq"))
    close = sized.join(near.select(*TASK, "_block"), [*TASK, "_block"], "left_semi").withColumns(
        {"_sum": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_rank": F.row_number().over(order)}
    )
    return close.where((F.col("_sum") <= cap) | (F.col("_rank") == 1)).select(*chunks.columns)


def stream_output_tail(
    chunks: DataFrame, root: str, cap: int = logs.RETAINED_BYTES, block: int = 65_536,
    every: int = MERGE_EVERY, keep_seconds: int = KEEP_SECONDS, **options,
) -> StreamingQuery:
    """Keep what each batch can add to a task's tail; older output is dropped at once.

    Every finally retained chunk is retained within its own batch and within every merge
    too, so trimming them loses nothing.  A task holds at most ``cap`` bytes, or its newest
    chunk, in the base and in each batch since.
    """

    def trimmed(rows: DataFrame) -> DataFrame:
        return retained_chunks(rows, cap, block)

    return _keep(chunks, root, "output-tail", trimmed, trimmed, every, keep_seconds, options)


def current_tails(
    spark: SparkSession, root: str, limit: int, cap: int = logs.RETAINED_BYTES, block: int = 65_536
) -> DataFrame:
    return logs.output_tails(runtime.read_compacted(spark, root).drop("written_at"), limit, cap, block)
