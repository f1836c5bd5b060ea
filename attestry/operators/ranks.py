"""Positions in a total order, without one task ever holding the whole order.

Rows are range-partitioned and sorted; what lies in the partitions before is added
to the place inside a partition.  The partitioned rows are cut off from their plan
once, so both readers see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import cut_lineage

RANGES = 1_024  # ranges of a block: sums inside a block run on, those of blocks are few


def sliced(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ranges of ``order`` with the range's number as ``_slice``."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Every row with its 1-based place in ``order``; ties get places in any order."""
    rows = sliced(df, order)
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("_rows"))
    # One row per range, as many as there are partitions; summed in blocks of ranges.
    blocks = sizes.withColumn("_block", F.floor(F.col("_slice") / RANGES))
    before = Window.partitionBy("_block").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    every = blocks.groupBy("_block").agg(F.sum("_rows").alias("_rows")).agg(
        F.sort_array(F.collect_list(F.struct("_block", "_rows"))).alias("_all")
    )
    block_starts = every.select(F.explode(F.transform("_all", lambda x, i: F.struct(
        x["_block"].alias("_block"),
        F.aggregate(F.slice("_all", F.lit(1), i), F.lit(0).cast("long"), lambda n, y: n + y["_rows"]).alias("_block_start"),
    ))).alias("r")).select("r.*")
    starts = blocks.withColumn("_in_block", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(block_starts, "_block").select(
        "_slice", (F.col("_block_start") + F.col("_in_block")).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return rows.join(starts, "_slice").withColumn(out, (F.col("_start") + inside).cast("long")).drop("_slice", "_start")
