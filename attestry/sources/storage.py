"""Tables the jobs write and read back: attempts, catalog snapshots, change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attestry.operators.catalog import snapshot_rows
from attestry.session import scratch_path


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Append to the fact table, partitioned by the day of ``created_at``.

    Rows are clustered by day first, so each day gets few files; adaptive
    execution splits a day that is too large for one task.
    """
    (
        attempts.withColumn("dt", F.substring("created_at", 1, 10))
        .hint("rebalance", "dt")
        .write.mode("append").partitionBy("dt").parquet(path)
    )


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("dt")


def export_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line, null fields kept so every line has every key."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_snapshot(models: DataFrame, root: str, fetched_at: str) -> None:
    """Write one catalog snapshot to its own folder, then list it; earlier ones stay readable.

    The list holds one row a snapshot.  What is not listed was not finished.
    """
    snapshot_rows(models.drop("fetched_at")).write.mode("overwrite").parquet(_snapshot_path(root, fetched_at))
    models.sparkSession.createDataFrame([(fetched_at,)], "fetched_at string").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/published/payload={payload_key(fetched_at)}"
    )


def payload_key(fetched_at: str) -> str:
    """A payload's folder name; the prefix keeps Spark from reading it as a time."""
    return "at-" + fetched_at.replace(":", ".")


def _snapshot_path(root: str, fetched_at: str) -> str:
    return f"{root}/snapshots/payload={payload_key(fetched_at)}"


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """The times of all finished snapshots; None before the first one."""
    try:
        return spark.read.parquet(f"{root}/published").select("fetched_at")
    except AnalysisException:
        return None


def time_beside(spark: SparkSession, root: str, fetched_at: str | None = None, after: bool = False) -> str | None:
    """The newest snapshot's time, the newest before ``fetched_at``, or the first one after it."""
    times = published(spark, root)
    if times is None:
        return None
    at = F.col("fetched_at")
    if fetched_at is not None:
        times = times.where(at > fetched_at if after else at < fetched_at)
    return times.agg(F.min(at) if after else F.max(at)).first()[0]


def read_snapshot(spark: SparkSession, root: str, fetched_at: str | None) -> DataFrame | None:
    """One snapshot with its time, from its own folder."""
    if fetched_at is None:
        return None
    return spark.read.parquet(_snapshot_path(root, fetched_at)).withColumn("fetched_at", F.lit(fetched_at))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest snapshot; only the list of snapshots and its folder are read."""
    return read_snapshot(spark, root, time_beside(spark, root))


def append_events(events: DataFrame, root: str, fetched_at: str) -> None:
    """Store the change events of one payload, details as JSON text.

    Each payload has a folder of its own, so a repeated refresh replaces its events.
    """
    events.withColumn("payload", F.to_json("payload")).write.mode("overwrite").parquet(
        f"{root}/events/of={payload_key(fetched_at)}"
    )


def read_events(spark: SparkSession, root: str, fetched_at: str | None = None) -> DataFrame:
    """All events, or those of one payload from its folder alone."""
    if fetched_at is not None:
        return spark.read.parquet(f"{root}/events/of={payload_key(fetched_at)}")
    return spark.read.parquet(f"{root}/events").drop("of")


def write_report(lists: dict[str, DataFrame], path: str) -> None:
    """One JSON document, ``{"name": [rows], ...}``, with every list in its rows' order.

    The lists are results, already ranked.  A document is one file, so one task writes
    it, but row by row: no list is ever held.
    """
    columns = ["part", "at", "line"]
    text: DataFrame | None = None
    for part, (name, rows) in enumerate(lists.items()):
        spark = rows.sparkSession
        head = ("{" if part == 0 else "],") + f'"{name}":['
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
        ranked = rows.select(body.alias("line")).withColumn("at", F.monotonically_increasing_id())
        place = F.row_number().over(Window.orderBy("at"))
        numbered = ranked.select(
            F.lit(part).alias("part"), place.alias("at"),
            F.concat(F.when(place > 1, ",").otherwise(""), "line").alias("line"),
        )
        opened = spark.createDataFrame([(part, 0, head)], "part int, at int, line string").unionByName(numbered)
        text = opened if text is None else text.unionByName(opened)
    end = text.sparkSession.createDataFrame([(len(lists), 0, "]}")], "part int, at int, line string")
    text.unionByName(end).select(columns).repartition(1).sortWithinPartitions("part", "at").select("line").write.mode(
        "overwrite"
    ).text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one document of a report as a row with a column per list."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select("r.*")
