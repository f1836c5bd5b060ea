"""Worker logs: bounded tails, token scraping and retry specs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.patterns import java_pattern
from attestry.functions.values import integer

CONTEXT_BYTES = 6_000
SCRAPE_BYTES = 64 * 1024
RETAINED_BYTES = 256 * 1024
UNKNOWN = -1
RETRY_SEPARATOR = "\n\n--- Previous attempt failed. Check output:\n"
TASK = ["run_id", "task_key"]


def tail_binary(text: Column, n: int) -> Column:
    return F.substring(text.cast("binary"), -n, n)


def tail_text(text: Column, n: int) -> Column:
    """Last ``n`` bytes as text; a character cut in half becomes the replacement character."""
    return F.make_valid_utf8(tail_binary(text, n).cast("string"))


def tail_rows(logs: DataFrame, text: str, n: int) -> DataFrame:
    """Tail, full size in bytes and whether anything was cut."""
    size = F.octet_length(text)
    return logs.withColumns(
        {"tail": tail_text(F.col(text), n), "size": size, "truncated": size > n}
    )


def token_count(matches: Column) -> Column:
    last = F.try_element_at(matches, F.lit(-1))
    digits = F.replace(F.trim(last), F.lit(","), F.lit(""))
    return F.coalesce(integer(digits), F.lit(UNKNOWN).cast("bigint"))


def scrape_tokens(text: Column, pattern: str) -> Column:
    """Last report in the text: last group of the last match, else the whole match.

    The pattern is engine configuration, so it is validated here and compiled once
    per task; a blank or invalid one gives the unknown count.
    """
    usable = usable_pattern(pattern, None)
    if usable is None:
        return F.lit(UNKNOWN).cast("bigint")
    return token_count(F.regexp_extract_all(text, F.lit(usable), F.lit(re.compile(pattern).groups)))


def usable_pattern(pattern: str | None, group: int | None) -> str | None:
    """``pattern`` as Spark writes it; None if it cannot be run.

    A pattern without the wanted ``group`` is as unusable as one that does not parse.
    """
    written = java_pattern(pattern) if pattern else None
    if written is None or (group is not None and not 0 <= group <= re.compile(pattern).groups):
        return None
    return written


def scrape_by_engine(
    logs: DataFrame, patterns: dict[str, str], text: str = "tail", scrape_bytes: int = SCRAPE_BYTES
) -> DataFrame:
    """Token counts with the pattern of each row's engine, read from the log's last bytes."""
    window = tail_text(F.col(text), scrape_bytes)
    tokens = F.lit(UNKNOWN).cast("bigint")
    for engine, pattern in patterns.items():
        tokens = F.when(F.col("engine") == engine, scrape_tokens(window, pattern)).otherwise(tokens)
    return logs.withColumn("tokens", tokens)


def scrape_by_table(
    logs: DataFrame, engines: DataFrame, text: str = "tail", scrape_bytes: int = SCRAPE_BYTES
) -> DataFrame:
    """As above with patterns in a table: ``engine``, ``token_regex``, ``token_group``."""
    window = tail_text(F.col(text), scrape_bytes)
    # One row per engine: the patterns are checked there, not per log.
    usable = F.udf(usable_pattern, "string")(F.col("token_regex"), F.col("token_group"))
    checked = engines.select("engine", usable.alias("token_regex"), "token_group")
    joined = logs.join(checked, "engine", "left")
    matches = F.when(
        F.coalesce("token_regex", F.lit("")) != "",
        F.regexp_extract_all(window, F.col("token_regex"), F.col("token_group")),
    )
    return joined.withColumn("tokens", token_count(matches)).drop("token_regex", "token_group")


def retry_specs(
    attempts: DataFrame, specs: DataFrame, verdict: str = "verdict", context_bytes: int = CONTEXT_BYTES
) -> DataFrame:
    """Spec of the second attempt: the task's spec plus the end of the first check's output."""
    first = attempts.where((F.col("retry") == 0) & (F.col(verdict) != "PASS"))
    context = tail_text(F.col("check_output"), context_bytes)
    return first.join(specs, TASK).select(
        "id", *TASK, F.concat("spec", F.lit(RETRY_SEPARATOR), context).alias("retry_spec")
    )


def output_tails(
    chunks: DataFrame, limit: int, cap: int = RETAINED_BYTES, block: int = 65_536, segment: int = 64
) -> DataFrame:
    """Last ``limit`` bytes of each task's ordered chunks, within what a ``cap`` retains.

    Retained are the newest chunks whose total is at most ``cap``, or the newest
    one alone.  Sizes are summed at two levels, by ``segment`` sequence numbers and by
    ``block``, combined on the map side; only segments that reach the tail are ordered,
    so a task with a huge output never meets in one place.  Of a chunk no more than
    ``limit`` characters travel, which bounds what is ordered by bytes: the tail and one
    segment of such ends.
    """
    sized = chunks.select(
        *TASK, "seq", F.octet_length("chunk").alias("_n"),
        F.floor(F.col("seq") / block).cast("bigint").alias("_block"),
        F.floor(F.col("seq") / segment).cast("bigint").alias("_segment"),
        F.when(F.char_length("chunk") <= limit, F.col("chunk")).otherwise(F.right("chunk", F.lit(limit))).alias("_end"),
    )
    reach = min(limit, cap)

    def near(weights: DataFrame, level: str) -> DataFrame:
        """The newest parts of a level, down to the one in which the tail begins."""
        newer = Window.partitionBy(*TASK).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, -1)
        return weights.withColumn("_after", F.coalesce(F.sum("_w").over(newer), F.lit(0))).where(
            F.col("_after") < reach
        ).select(*TASK, level)

    blocks = near(sized.groupBy(*TASK, "_block").agg(F.sum("_n").alias("_w")), "_block")
    segments = near(
        sized.join(blocks, [*TASK, "_block"], "left_semi").groupBy(*TASK, "_segment").agg(F.sum("_n").alias("_w")), "_segment"
    )
    kept = sized.join(segments, [*TASK, "_segment"], "left_semi")
    order = Window.partitionBy(*TASK).orderBy(F.desc("seq"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept.withColumns({"_sum": F.sum("_n").over(upto), "_rank": F.row_number().over(order)})
    tail = placed.where(
        ((F.col("_sum") <= cap) | (F.col("_rank") == 1)) & (F.col("_sum") - F.col("_n") < limit)
    )
    filled = F.when(F.col("_n") > 0, F.struct("seq", "_end"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(filled)), lambda c: c["_end"]), "")
    return tail.groupBy(*TASK).agg(tail_text(joined, limit).alias("tail"))
