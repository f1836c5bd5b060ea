"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Sources share the target total by weight; no source gets more than ``max_epochs``
times its own size, and what it cannot take is shared again by weight.  A document
is taken a whole number of times, and a seeded part of the source once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import ROW, packed

# Fixed values of the contract: weights by source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"

# Slices of a source's seeded order; a slice, not a source, is what one task orders.
SLICE_DIGITS = 3  # hexadecimal digits: 4096 slices


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` to targets.

    In order of cap over weight the clamped sources come first, so one ordered pass
    finds the level at which clamping stops.  The windows run over one row per
    source, never over documents, and one task holds them: fit for sources, not for hosts.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    ).cast("long")
    capped = sources.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ordered = (
        capped.withColumn("total", F.sum("source_size").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    clamped = ordered.withColumn(
        "clamped",
        F.col("cap").cast("double") * F.col("weight_left")
        <= F.col("weight").cast("double") * (F.col("total") - F.col("caps_before")),
    )
    level = clamped.withColumn(
        "rest", F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every)
    ).withColumn("open_weight", F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(every))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("rest")).cast("double") / F.col("open_weight")
    )
    return level.select("source", "source_size", "weight", target.alias("target"))


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows with ``doc_id``, ``source`` and ``size`` to how often each is taken.

    Gives row (the input row), doc_id, source, size, source_size, target and copies.
    ``copies`` is the whole part of target over source size, plus one for the rows
    that come first in the source's seeded order until the fractional part is
    filled to within half a document.  The order is cut into slices of the seed
    hash: running sums start from the slice totals, so a source with a third of
    all rows is ordered by thousands of tasks and the result is that of one order.

    A null source is a source, last in order.  A document without words is never
    short of its source's whole copies.  Rows that repeat are separate rows; equal
    places in the order go by id, null last, then size.  Empty tables give no rows.  The
    input row travels as one struct, so its column names cannot clash; texts need not
    be in it.
    """
    rows = packed(sized, F.col("doc_id"), F.col("source"), F.col("size").cast("long").alias("size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.withColumn("mix_key", key).withColumn("mix_slice", F.substring("mix_key", 1, SLICE_DIGITS))
    slices = placed.groupBy("source", "mix_slice").agg(F.sum("size").alias("slice_size"))
    in_order = Window.partitionBy("source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    started = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(in_order), F.lit(0)))
    goals = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    left, right = started.alias("a"), goals.alias("b")
    plan = left.join(right, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("plan_source"), F.col("a.mix_slice").alias("plan_slice"),
        "slice_start", "source_size", "target",
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    running = Window.partitionBy("source", "mix_slice").orderBy(
        "mix_key", F.col("doc_id").asc_nulls_last(), "size"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("slice_start") + F.sum("size").over(running) - F.col("size") / F.lit(2.0)
    once_more = middle <= F.col("target") - F.col("whole") * F.col("source_size")
    return (
        placed.join(
            plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("mix_slice") == F.col("plan_slice"))
        )
        .withColumn("whole", whole.cast("long"))
        .withColumn("once_more", once_more & (F.col("target") > F.col("whole") * F.col("source_size")))
        .withColumn("copies", F.col("whole") + F.col("once_more").cast("long"))
        .select(ROW, "doc_id", "source", "size", "source_size", "target", "copies")
    )
