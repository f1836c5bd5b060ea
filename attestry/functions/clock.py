"""Durations between RFC3339 texts and their words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: RFC3339 with a zone; anything else counts as unparseable.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def instant(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end; 0 when either does not parse or time runs backwards."""
    micros = F.unix_micros(instant(end)) - F.unix_micros(instant(start))
    return F.greatest(F.coalesce(micros / F.lit(1e6), F.lit(0.0)), F.lit(0.0))


def task_elapsed(started: Column, ended: Column, now: Column) -> Column:
    """A running task is measured up to the snapshot's own time."""
    return elapsed_seconds(started, F.coalesce(F.nullif(ended, F.lit("")), now))


def duration_text(seconds: Column) -> Column:
    """``9s`` below a minute, else ``1m 03s``; halves round up."""
    whole = F.floor(seconds + F.lit(0.5)).cast("bigint")
    minutes, rest = F.floor(whole / 60).cast("bigint"), whole % 60
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(
        F.format_string("%dm %02ds", minutes, rest)
    )


def ago_text(seconds: Column) -> Column:
    """Words with the two largest units, never finer than seconds."""
    total = F.greatest(F.floor(seconds).cast("bigint"), F.lit(0).cast("bigint"))
    minutes, seconds_left = F.floor(total / 60).cast("bigint"), total % 60
    hours, minutes_left = F.floor(minutes / 60).cast("bigint"), minutes % 60

    def unit(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    def pair(big: Column, big_word: str, small: Column, small_word: str) -> Column:
        return F.when(small == 0, unit(big, big_word)).otherwise(
            F.concat(unit(big, big_word), F.lit(" "), unit(small, small_word))
        )

    return (
        F.when(total < 60, unit(total, "second"))
        .when(minutes < 60, pair(minutes, "minute", seconds_left, "second"))
        .otherwise(pair(hours, "hour", minutes_left, "minute"))
    )
