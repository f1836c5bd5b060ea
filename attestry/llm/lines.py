"""Dropping lines that an earlier document already holds.

1. Every document is written once to the shared folder with the hashes of its lines.
2. Hashes, never lines, are dealt to pages: a page owns the hashes with its leading bits
   and fills two Bloom filters, one for hashes seen once and one for hashes seen again.
   A batch sends each of its hashes once, so a line that every document holds is cheap.
3. The filters of hashes seen again, a few bits a line and at most ``max_pages`` pages,
   are what tasks hold to tell suspected repeats.  Only suspects' lines are shuffled:
   equal keys meet, and the smallest document that holds a key is found.
4. Only documents with a suspect are shuffled, to meet their decisions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from attestry.llm.common import BLANK_BYTES, ROW, packed, shared

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# Hashes a page is laid out for, and pages at most: 1 KB each is what a task holds, 64 MB
# in all.  Fuller pages let more lines pass as suspects; the result does not change.
PAGE_LINES = 4096
MAX_PAGES = 1 << 16
PAGE_BITS = 16  # a page's filter of hashes seen once has 2**16 bits
AGAIN_SHIFT = 3  # that of hashes seen again is folded to 2**13


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK_BYTES).translate(LOWER)


def long_enough(key: bytes, chars: int) -> bool:
    """Whether a key in UTF-8 has at least ``chars`` code points."""
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "replace")) >= chars)


def keys_of(text: bytes, chars: int) -> dict[bytes, int]:
    """Keys that may be dropped, numbered by their first line."""
    keys: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        key = line_key(line)
        if key not in keys and long_enough(key, chars):
            keys[key] = len(keys)
    return keys


def hashed_batches(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [
            [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys_of(text, chars)]
            for text in pc.cast(batch.column("text"), pa.binary()).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("rid"), batch.column("doc_id"), pa.array(hashes, pa.list_(pa.int64()))],
            [ROW, "rid", "doc_id", "hashes"],
        )


def dealt_batches(batches: Iterable[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """Each hash of a batch once, with its page and whether two of its documents hold it."""
    for batch in batches:
        flat = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        distinct, counts = np.unique(flat, return_counts=True)
        page = (distinct >> np.uint64(48) >> np.uint64(shift)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(page), pa.array(distinct.view(np.int64)), pa.array(counts > 1)], ["page", "hash", "again"]
        )


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Three places in a page's filter for each hash, from the bits that do not name the page."""
    low = np.uint64((1 << PAGE_BITS) - 1)
    return np.stack([((hashes >> np.uint64(s)) & low).astype(np.int64) for s in (0, 16, 32)], axis=1)


class Page:
    """The two filters of one page."""

    def __init__(self):
        self.once = np.zeros(1 << PAGE_BITS, bool)
        self.again = np.zeros(1 << (PAGE_BITS - AGAIN_SHIFT), bool)

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        distinct, first, counts = np.unique(hashes[order], return_index=True, return_counts=True)
        repeated = np.logical_or.reduceat(again[order], first) | (counts > 1)
        places = bits_of(distinct)
        repeated |= self.once[places].all(axis=1)
        self.once[places.ravel()] = True
        self.again[places[repeated].ravel() >> AGAIN_SHIFT] = True


def page_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes in page order to the packed filters of hashes seen again."""
    number, page = None, None

    def done():
        if page is not None and page.again.any():
            bits = np.packbits(page.again).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([bits], pa.binary())], ["page", "bits"])

    for batch in batches:
        pages = batch.column("page").to_numpy(zero_copy_only=False)
        hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
        again = batch.column("again").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(pages)) + 1
        for start, end in zip([0, *edges], [*edges, len(pages)]):
            if end > start:
                if pages[start] != number:
                    yield from done()
                    number, page = int(pages[start]), Page()
                page.add(hashes[start:end], again[start:end])
    yield from done()


class Again:
    """The filters of all pages, as tasks hold them."""

    def __init__(self, pages: dict[int, bytes], shift: int):
        self.shift, self.slots = shift, np.full(1 << (16 - shift), -1, np.int32)
        width = 1 << (PAGE_BITS - AGAIN_SHIFT - 3)
        self.bits = np.zeros((len(pages), width), np.uint8)
        for slot, (page, bits) in enumerate(pages.items()):
            self.slots[page], self.bits[slot] = slot, np.frombuffer(bits, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.view(np.uint64)
        slot = self.slots[(hashes >> np.uint64(48) >> np.uint64(self.shift)).astype(np.int64)]
        if not len(self.bits):
            return np.zeros(len(hashes), bool)
        places = bits_of(hashes) >> AGAIN_SHIFT
        cells = self.bits[slot[:, None], places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1
        return (slot >= 0) & cells.all(axis=1)

    def any_of(self, lists: pa.Array) -> np.ndarray:
        """Whether a list of hashes holds a suspect, for each list."""
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        hits = self.holds(lists.flatten().to_numpy(zero_copy_only=False))
        sums = np.concatenate([[0], np.cumsum(hits)])
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths] > 0


def suspect_batches(batches: Iterable[pa.RecordBatch], filters: Again, chars: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Suspected keys of a batch with its documents that hold them."""
    for batch in batches:
        held: dict[bytes, list[tuple]] = {}
        batch = batch.filter(pa.array(filters.any_of(batch.column("hashes"))))
        for rid, doc, text, hashes in zip(
            batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(),
            pc.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("hashes"),
        ):
            hits = filters.holds(hashes.values.to_numpy(zero_copy_only=False))
            for (key, number), hit in zip(keys_of(text, chars).items(), hits):
                if hit:
                    held.setdefault(key, []).append(({"last": doc is None, "doc_id": doc}, rid, number))
        if held:
            order = lambda who: (who["last"], who["doc_id"] or 0)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "key": key, "low": min((w for w, _, _ in rows), key=order), "high": max((w for w, _, _ in rows), key=order),
                        "holders": [{"who": w, "rid": r, "number": n} for w, r, n in rows],
                    }
                    for key, rows in held.items()
                ],
                schema=schema,
            )


def kept_batches(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, dropped, kept = [], [], []
        for text, numbers in zip(pc.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("numbers").to_pylist()):
            lines = text.split(b"\n")
            gone = set(numbers or ())
            out = {key for key, number in keys_of(text, chars).items() if number in gone} if gone else ()
            rest = [line for line in lines if line_key(line) not in out] if gone else lines
            counts.append(len(lines))
            dropped.append(len(lines) - len(rest))
            kept.append(b"\n".join(rest))
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()),
             pc.cast(pa.array(kept, pa.binary()), pa.string())],
            [ROW, "n_lines", "n_dropped", "kept_text"],
        )


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10,
                        page_lines: int = PAGE_LINES, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per document row: row, n_lines, n_dropped, kept_text.

    A line's key is the line without blanks at both ends, A-Z lower-cased.  A key of at
    least ``min_chars`` code points that two documents hold loses its lines in all but the
    document with the smallest id; there all its lines stay.  Null ids are one document
    that comes last; rows with one id are one document.  A null or empty text is one empty
    line.  The first document keeps even a text of nothing but repeats; others may end up
    empty.  Long texts travel whole; what a task holds besides a batch is the filters,
    ``max_pages`` KB at most (a power of two up to 2**16).  Empty tables give no rows.  The
    input row travels as one struct, so its column names cannot clash.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = packed(docs, F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"))
    stored = shared(
        rows.mapInArrow(
            lambda batches: hashed_batches(batches, min_chars),
            StructType([rows.schema[ROW], StructField("rid", LongType()), StructField("doc_id", LongType()),
                        StructField("hashes", ArrayType(LongType()))]),
        ),
        "line-hashes",
    )
    lines = stored.agg(F.sum(F.size("hashes"))).first()[0] or 0
    pages = min(max_pages, 1 << max(0, (lines // page_lines).bit_length()))
    shift = 16 - (pages.bit_length() - 1)
    filters = (
        stored.select("hashes")
        .mapInArrow(lambda batches: dealt_batches(batches, shift), "page int, hash long, again boolean")
        .repartition("page").sortWithinPartitions("page")
        .mapInArrow(page_batches, "page int, bits binary")
    )
    # At most ``max_pages`` KB.
    held = spark.sparkContext.broadcast(Again({page: bytes(bits) for page, bits in filters.toLocalIterator()}, shift))

    body = F.coalesce(F.col(f"{ROW}.`{text}`").cast("string"), F.lit(""))
    who = StructType([StructField("last", BooleanType()), StructField("doc_id", LongType())])
    schema = StructType([
        StructField("key", StringType()), StructField("low", who), StructField("high", who),
        StructField("holders", ArrayType(StructType([
            StructField("who", who), StructField("rid", LongType()), StructField("number", LongType())]))),
    ])
    arrow_who = pa.struct([("last", pa.bool_()), ("doc_id", pa.int64())])
    arrow = pa.schema([
        ("key", pa.string()), ("low", arrow_who), ("high", arrow_who),
        ("holders", pa.list_(pa.struct([("who", arrow_who), ("rid", pa.int64()), ("number", pa.int64())]))),
    ])
    suspects = shared(
        stored.select("rid", "doc_id", body.alias("text"), "hashes")
        .mapInArrow(lambda batches: suspect_batches(batches, held.value, min_chars, arrow), schema),
        "line-suspects",
    )
    confirmed = suspects.groupBy("key").agg(F.min("low").alias("first"), F.max("high").alias("end")).where("first < end")
    drops = (
        suspects.select("key", "holders").join(confirmed.select("key", "first"), "key")
        .select("first", F.explode("holders").alias("h")).where("h.who > first")
        .groupBy("h.rid").agg(F.collect_list("h.number").alias("numbers"))
    )

    @F.pandas_udf("boolean")
    def suspected(hashes):
        import pandas as pd

        return pd.Series(held.value.any_of(pa.array(hashes, pa.list_(pa.int64()))))

    flagged = stored.select(ROW, "rid", body.alias("text"), suspected("hashes").alias("flag"))
    clean = flagged.where(~F.col("flag")).select(
        ROW, (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"),
    )
    touched = flagged.where("flag").join(drops, "rid", "left").select(ROW, "text", "numbers")
    return clean.unionByName(
        touched.mapInArrow(
            lambda batches: kept_batches(batches, min_chars),
            StructType([rows.schema[ROW], StructField("n_lines", LongType()), StructField("n_dropped", LongType()),
                        StructField("kept_text", StringType())]),
        )
    )
