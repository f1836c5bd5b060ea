"""Exact deduplication through an extendible-hash index in the shared folder.

1. Every document is normalised, hashed and written once to the index files.  Within
   one Arrow batch equal texts are found at once: the best of them leads, the others
   point to it, so a text that a third of all rows share enters the index once per
   batch and not once per row.
2. The directory grows by doubling: while a bucket holds more leads than a bucket
   may, the bucket is split by one more bit of the hash.
3. Owner tasks take whole buckets, which are ranges of the hash, in hash order.
   Entries of one hash form a chain and are told apart by comparing their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from attestry.llm.common import BLANK_BYTES, ROW, packed, shared

# Rows a bucket holds before it is split, and bits a directory may use.  The directory
# has at most 2**MAX_DEPTH slots of 12 bytes; buckets that are overfull at that depth
# stay one sorted range of an owner task, so results do not depend on either value.
BUCKET_ROWS = 512
MAX_DEPTH = 14


def normal(text: bytes) -> bytes:
    return text.translate(None, BLANK_BYTES)


def key_of(body: bytes) -> int:
    """Hash the index is built on, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def index_batches(batches: Iterable[pa.RecordBatch], key=key_of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        chars = pc.utf8_length(text).to_pylist()
        ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
        bodies = [normal(t) for t in pc.cast(text, pa.binary()).to_pylist()]
        best: dict[bytes, tuple] = {}
        for place in zip(((-n, i is None, i or 0, r) for n, i, r in zip(chars, ids, rids)), bodies):
            if place[1] not in best or place[0] < best[place[1]]:
                best[place[1]] = place[0]
        held: dict[bytes, int] = {}
        for body in bodies:
            held[body] = held.get(body, 0) + 1
        lead = [best[b][3] for b in bodies]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(ROW), batch.column("rid"), batch.column("doc_id"), pa.array(chars, pa.int64()),
                pa.array([key(b) for b in bodies], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
                pa.array(lead, pa.int64()),
                pa.array([held[b] if r == first else None for b, r, first in zip(bodies, rids, lead)], pa.int64()),
            ],
            [ROW, "rid", "doc_id", "chars", "key", "text_sha256", "lead", "held"],
        )


def chain_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in hash order to ``(lead, same_as)``: the first entry with the same bytes."""
    current, chain = None, []
    for batch in batches:
        same = []
        for key, rid, text in zip(
            batch.column("key").to_pylist(), batch.column("rid").to_pylist(),
            pc.cast(batch.column("text"), pa.binary()).to_pylist(),
        ):
            body = normal(text)
            if key != current:
                current, chain = key, []
            first = next((r for b, r in chain if b == body), None)
            if first is None:
                first = rid
                chain.append((body, rid))
            same.append(first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("chars"), batch.column("held"),
             pa.array(same, pa.int64())],
            ["lead", "doc_id", "chars", "held", "same_as"],
        )


def directory(loads: np.ndarray, capacity: int) -> list[int]:
    """Slots of an extendible-hash directory: the bucket of every hash prefix.

    ``loads`` holds the entries per prefix of the longest allowed length (a power of
    two of them).  One bucket at first; as long as a bucket as deep as the directory
    is overfull the directory doubles and such buckets split.
    """
    deepest = len(loads).bit_length() - 1
    totals = np.concatenate([[0], np.cumsum(loads)])

    def load(prefix: int, depth: int) -> int:
        width = 1 << (deepest - depth)
        return int(totals[(prefix + 1) * width] - totals[prefix * width])

    depth, slots, local = 0, [0], {0: (0, 0)}  # bucket -> its prefix and depth
    while depth < deepest:
        full = [b for b, (prefix, d) in local.items() if d == depth and load(prefix, d) > capacity]
        if not full:
            break
        depth += 1
        slots = [b for b in slots for _ in range(2)]
        for b in full:
            prefix, new = local[b][0] * 2, len(local)
            local[b], local[new] = (prefix, depth), (prefix + 1, depth)
            slots[prefix + 1] = new
    return slots


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH, key=key_of) -> DataFrame:
    """One row per document row: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks.  The row with the most
    code points, then the smallest doc_id, stays; null ids come last, and of rows
    that agree in both the first one in the table stays.  A null text counts as
    empty, and all empty texts are one group.  Rows repeated with one doc_id are
    separate rows of one group.  Empty tables give no rows.  The input row travels
    as one struct, so its column names cannot clash.
    """
    spark = docs.sparkSession
    rows = packed(
        docs, F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    schema = StructType([
        rows.schema[ROW], StructField("rid", LongType()), StructField("doc_id", LongType()),
        StructField("chars", LongType()), StructField("key", LongType()),
        StructField("text_sha256", StringType()), StructField("lead", LongType()), StructField("held", LongType()),
    ])
    index = shared(rows.mapInArrow(lambda batches: index_batches(batches, key), schema), "exact-index")
    leads = index.where(F.col("held").isNotNull())

    # One count per prefix, 2**max_depth at most, reaches the driver.
    prefix = F.shiftrightunsigned(F.col("key"), 64 - max_depth).cast("int") if max_depth else F.lit(0)
    loads = np.zeros(1 << max_depth, np.int64)
    for slot, n in leads.groupBy(prefix.alias("p")).count().collect():
        loads[slot] = n
    slots = directory(loads, bucket_rows)
    depth = len(slots).bit_length() - 1
    table = spark.createDataFrame(
        list(enumerate(slots)), StructType([StructField("slot", IntegerType()), StructField("bucket", IntegerType())])
    )
    slot = F.shiftrightunsigned(F.col("key"), 64 - depth).cast("int") if depth else F.lit(0)
    owned = (
        leads.select("rid", "doc_id", "chars", "held", "key", F.coalesce(F.col(f"{ROW}.{text}").cast("string"), F.lit("")).alias("text"), slot.alias("slot"))
        .join(F.broadcast(table), "slot")
        .repartition("bucket").sortWithinPartitions("bucket", "key", "rid")
        .select("rid", "doc_id", "chars", "held", "key", "text")
    )
    chained = shared(
        owned.mapInArrow(chain_batches, "lead long, doc_id long, chars long, held long, same_as long"), "exact-chains"
    )
    groups = chained.groupBy("same_as").agg(
        F.sum("held").alias("group_size"),
        F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "lead")).alias("best"),
    )
    placed = chained.select("lead", "same_as").join(groups, "same_as").select(
        "lead", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.lead").alias("keep_rid")
    )
    return index.join(placed, "lead").select(
        ROW, "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )
