"""Shared plumbing of the streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from attestry.session import stream_checkpoint

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives off the heap; required by the arbitrary-state operators."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start(
    writer: DataStreamWriter, spark: SparkSession, name: str, checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start a writer with a checkpoint in the shared folder."""
    location = checkpoint or stream_checkpoint(spark, f"{name}-{uuid.uuid4().hex}")
    writer = writer.option("checkpointLocation", location)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(query: StreamingQuery) -> None:
    """Wait for an available-now query and surface its failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def write_batch(rows: DataFrame, root: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten on replay, so a retry never duplicates."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(f"{root}/batch=*")


def compacted_upto(spark: SparkSession, root: str) -> int:
    """The last batch below ``root`` that is merged into a base; -1 while there is none."""
    try:
        listed = spark.read.schema("upto long").parquet(f"{root}/compacted/*")
    except AnalysisException:
        return -1
    return listed.agg(F.coalesce(F.max("upto"), F.lit(-1).cast("long"))).first()[0]


def read_compacted(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest base and the batches behind it, without column ``batch``.

    ``before`` leaves out that batch and later ones.
    """
    upto = compacted_upto(spark, root)
    rest = read_batches(spark, root).where(F.col("batch") > upto)
    if before is not None:
        rest = rest.where(F.col("batch") < before)
    rest = rest.drop("batch")
    return rest if upto < 0 else rest.unionByName(spark.read.schema(rest.schema).parquet(f"{root}/base/upto={upto}"))


def compact(spark: SparkSession, root: str, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge everything before ``batch_id`` into one base and remove what the last base replaced.

    Earlier batches are committed and never written again, so a replay of ``batch_id``
    finds its base listed and does nothing.  A base is listed only once it is whole.
    The base before it and the batches since then stay until the next time, for readers
    that have begun.
    """
    last, upto = compacted_upto(spark, root), batch_id - 1
    if upto <= last:
        return
    merge(read_compacted(spark, root, before=batch_id)).write.mode("overwrite").parquet(f"{root}/base/upto={upto}")
    listed = spark.range(1).select(F.lit(upto).cast("long").alias("upto"))
    listed.write.mode("overwrite").parquet(f"{root}/compacted/of={upto}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, name, newest in (("", "batch=", last), ("/base", "upto=", last - 1)):
        for found in files.globStatus(path(f"{root}{kind}/{name}*")) or []:
            if int(found.getPath().getName().removeprefix(name)) <= newest:
                files.delete(found.getPath(), True)


def latest_rows(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of every key over the batches written so far."""
    fields = [c for c in batches.columns if c not in keys and c != "batch"]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col("batch")).alias("r")).select(
        *keys, "r.*"
    )


def replay(
    df: DataFrame, path: str, order: str, run: Callable[[DataFrame, str], StreamingQuery],
    slices: int = 2,
) -> None:
    """Feed a stored table to a streaming job as a source that grows in ``order``.

    Each slice is appended as ordinary parallel files and the job, started by
    ``run(stream, checkpoint)``, is run until it has caught up; the next slice
    resumes it from the same checkpoint, as a scheduled job would.
    """
    spark = df.sparkSession
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) // slices + 1
    place = F.floor((F.col(order) - low) / width)
    checkpoint = stream_checkpoint(spark, uuid.uuid4().hex)
    for n in range(slices):
        df.where(place == n).write.mode("append").parquet(path)
        finish(run(spark.readStream.schema(df.schema).parquet(path), checkpoint))
