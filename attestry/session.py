"""Session construction and the shared-folder lookup for lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app_name: str = "attestry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` is left to spark-submit unless given.  Shuffle partition counts
    are only a starting point: adaptive execution coalesces small ones and
    splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder stands in only for a ``local`` master, where the driver and
    its tasks share one machine, and goes when the process ends.  Elsewhere a
    missing setting is an error: executors would each write to their own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(
                f"spark.checkpoint.dir must name a folder shared by all executors of {context.master}"
            )
        named = tempfile.mkdtemp(prefix="attestry-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """A fresh checkpoint location for one streaming query below the shared folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, readable by every executor."""
    return f"{ensure_checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, columns pruned.

    Later stages survive executor loss.  Runs now: its readers would each compute the
    plan.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
