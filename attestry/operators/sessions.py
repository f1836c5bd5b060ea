"""Session events: commands that should be routed, and bursts of edits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BURST_EDITS = 8
BURST_FILES = 3
# Fixed patterns: model provider endpoints and evaluation-harness scripts.
PROVIDER = (
    r"(?i)(api\.anthropic\.com|api\.openai\.com|openrouter\.ai|generativelanguage\.googleapis"
    r"|/v1/chat/completions|/v1/messages)"
)
HARNESS = (
    r"(?i)\b(?:node|python3?|bun|deno)\s+\S*(?:simulat|probe|smoke|harness|persona|grader|eval)"
    r"\S*\.(?:mjs|js|ts|py)\b"
)


def invokes(command: Column, tool: str) -> Column:
    """The command runs ``tool``: as first word, or as a script given to an interpreter."""
    name = re.escape(tool)
    return command.rlike(rf"^\s*(?:(?:\S*/)?{name}(?:\.py)?|\S+\s+(?:\S*/)?{name}\.py)(?=\s|\z)")


def needs_routing(command: Column, tool: str) -> Column:
    present = F.coalesce(command, F.lit("")).rlike(r"\S")
    return present & ~invokes(command, tool) & (command.rlike(PROVIDER) | command.rlike(HARNESS))


def routing_alerts(commands: DataFrame, tool: str) -> DataFrame:
    """First command of each session that should be routed while nothing is live.

    ``commands.live`` tells whether runs were active at that moment.  Suppressed
    commands are dropped before the once-per-session choice, so they do not use
    up the session's alert.
    """
    hits = commands.where(needs_routing(F.col("command"), tool) & ~F.col("live"))
    return hits.groupBy("session_id").agg(
        F.min("seq").alias("seq"), F.min_by("command", "seq").alias("command")
    )


def session_files(edits: DataFrame) -> DataFrame:
    """Edits and distinct files of each session; blank paths count as edits only."""
    path = F.when(F.col("file_path").rlike(r"\S"), F.col("file_path"))
    return edits.groupBy("session_id").agg(
        F.count("*").alias("edits"), F.count_distinct(path).alias("files")
    )


def burst_sessions(edits: DataFrame) -> DataFrame:
    return session_files(edits).where(
        (F.col("edits") >= BURST_EDITS) & (F.col("files") >= BURST_FILES)
    )


def burst_alerts(edits: DataFrame) -> DataFrame:
    """The edit at which each session's burst alert fires (batch form of the stream).

    It is the first edit with nothing live at or after both the eighth edit and the
    first sight of the third file.  Both places come from rank filters that Spark
    applies before the shuffle.
    """
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    eighth = (
        edits.select("session_id", "seq").withColumn("_r", F.row_number().over(by_seq))
        .where(F.col("_r") <= BURST_EDITS)
        .groupBy("session_id").agg(F.max("seq").alias("_at8"), F.count("*").alias("_n"))
        .where(F.col("_n") == BURST_EDITS)
    )
    third = (
        edits.where(F.col("file_path").rlike(r"\S"))
        .groupBy("session_id", "file_path").agg(F.min("seq").alias("seq"))
        .withColumn("_r", F.row_number().over(by_seq))
        .where(F.col("_r") <= BURST_FILES)
        .groupBy("session_id").agg(F.max("seq").alias("_at3"), F.count("*").alias("_k"))
        .where(F.col("_k") == BURST_FILES)
    )
    ready = eighth.join(third, "session_id").select(
        "session_id", F.greatest("_at8", "_at3").alias("_from")
    )
    return (
        edits.where(~F.col("live"))
        .join(ready.repartition("session_id"), "session_id")
        .where(F.col("seq") >= F.col("_from"))
        .groupBy("session_id").agg(F.min("seq").alias("seq"))
    )
