"""Exact grouped medians that stay bounded when one group dominates.

One strategy at every size.  Values are counted per group first, combined on the map
side.  Every value belongs to a bin of its size, 1,024 of them from one power of two to
the next, so a group with very many values spreads over many bins.  Counts per group and
bin tell in which bin the two middle ranks fall, and only those bins' distinct values are
ordered.  A bin follows from the value alone, so nothing is stored or computed beforehand.

Null group keys are a group of their own, and NaN is greater than every number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1_024  # of an octave: a bin is 0.07 % wide
LEAST, BEYOND = 2_000_000, 9_000_000  # above any bin of a finite double, and of the infinite


def exact_median(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """One row per group with the exact median of the non-null ``value``s.

    Groups without a value are absent.
    """
    counted = (
        df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    )
    return counted_median(counted, keys, out)


def bin_of(value: Column) -> Column:
    """A number that never falls where the value grows.

    Spark's logarithm is the strict one, equal on every machine.
    """
    size = F.abs(value)
    # The smallest double is 2^-1074; an infinite one must not meet the cast.
    octave = F.floor(F.log2(F.when(size < float("inf"), size)) * BINS) + LEAST
    signed = F.coalesce(octave, F.lit(BEYOND)) * F.when(value < 0, -1).otherwise(1)
    return F.when(F.isnan(value), BEYOND + 1).when(value == 0, 0).otherwise(signed).cast("int")


def counted_median(counted: DataFrame, keys: list[str], out: str) -> DataFrame:
    """As above from values that are counted already: ``keys``, ``_v`` and its count ``_c``."""
    laid = counted.withColumn("_bin", bin_of(F.col("_v")))
    per_bin = laid.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_in"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    so_far = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_bin.withColumn("_n", F.sum("_in").over(group)).withColumn(
        "_before", F.sum("_in").over(so_far) - F.col("_in")
    )
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    middle = placed.where((F.col("_before") < high) & (F.col("_before") + F.col("_in") >= low)).select(
        F.col("_bin").alias("_at"), "_n", "_before", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    )
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
        F.col("_bin") == F.col("_at"),
    )
    running = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ordered = laid.join(middle, same).withColumn("_upto", F.col("_before") + F.sum("_c").over(running))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col("_v")))

    return ordered.groupBy(*keys).agg(((at(low) + at(high)) / F.lit(2.0)).alias(out))
