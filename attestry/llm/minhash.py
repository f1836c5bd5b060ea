"""Near-duplicate components: MinHash bands, sequential Bayesian pruning, exact checks.

1. One pass over the texts gives each document its set of five-word shingles as a
   fingerprint, its size and a MinHash signature.  Documents with equal sets become
   one class before anything is compared.
2. Classes that agree in a band are candidates.  They are not paired all with all:
   each is compared with the first class of a bucket, links join components, and only
   members of different components remain to be compared, block by block at the end.
3. A candidate pair is compared signature batch by signature batch and dropped once
   the posterior probability that it reaches the threshold falls below
   ``MISS``.  What survives is verified on the full shingle sets of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from attestry.llm.common import ROW, packed, shared

# Fixed values of the contract.
SHINGLE_WORDS = 5
PERCENT = 75

# A pair at the threshold shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
BATCH = 32
MISS = 1e-6
BLOCK = 512  # members of one bucket that one task compares with as many others
REMEMBERED = 500_000  # words a Python worker keeps hashes of

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MULTIPLIERS = np.random.default_rng(20240607).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE_WORDS)
    g = h[: n - width + 1] + np.uint64(width)
    for k in range(1, width):
        g = (g ^ (g >> np.uint64(32))) * STEP + h[k : n - width + 1 + k]
    g = (g ^ (g >> np.uint64(31))) * LAST
    g ^= g >> np.uint64(29)
    return np.unique(g)


def signature(found: np.ndarray) -> bytes:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[None, at : at + 1024] * MULTIPLIERS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def _binary(column: pa.Array) -> list[bytes]:
    return pc.cast(column, pa.binary()).to_pylist()


def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, signatures = [], [], []
        for text in _binary(batch.column("text")):
            found = shingles(text)
            sizes.append(len(found))
            prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("rid"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
             pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())],
            [ROW, "rid", "doc_id", "n_shingles", "print", "signature"],
        )


def signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        matrix = signature_matrix(batch.column("signature")).astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * LAST, matrix.shape[:2]).copy()
        for row in range(BAND_ROWS):
            key = (key ^ (key >> np.uint64(32)) ^ matrix[:, :, row]) * STEP
        key ^= key >> np.uint64(31)
        class_ids = np.repeat(batch.column("class_id").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(batch))), pa.array(class_ids)],
            ["band", "number", "class_id"],
        )


@lru_cache
def least_matches(compared: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest agreements of ``compared`` hashes that keep a pair in the race.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m of n
    agreements; the chance that it reaches t is that of at most m successes in n + 1
    trials of chance t.
    """
    t, n, reach = percent / 100, compared + 1, 0.0
    for m in range(compared + 1):
        reach += comb(n, m) * t**m * (1 - t) ** (n - m)
        if reach >= miss:
            return m
    return compared


def plausible(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices stay in the race after every batch."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for at in range(0, HASHES, BATCH):
        part = slice(at, at + BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(at + BATCH)]
    keep = np.zeros(len(left), bool)
    keep[alive] = True
    return keep


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= PERCENT * (len(left) + len(right) - both)


def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that stay in the race and whose full shingle sets are similar enough."""
    first, found = None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = plausible(signature_matrix(batch.column("signature_a")), signature_matrix(batch.column("signature_b")))
        batch = batch.filter(pa.array(keep))
        linked = []
        for a, left, right in zip(batch.column("a").to_pylist(), _binary(batch.column("text_a")), _binary(batch.column("text_b"))):
            if a != first:
                first, found = a, shingles(left)
            linked.append(similar(found, shingles(right)))
        yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])


def compare_block(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between members of a pair of blocks of one bucket, enough to join all they join.

    A pair is looked at in the first band it agrees in and nowhere else, and only
    while its components are apart: links found on the way join them.
    """
    i, j, number = int(frame["i"].iat[0]), int(frame["j"].iat[0]), int(frame["number"].iat[0])
    ids, parts, block = frame["class_id"].to_numpy(), frame["component"].to_numpy(), frame["block"].to_numpy()
    matrix = np.frombuffer(b"".join(frame["signature"]), "<u4").reshape(-1, HASHES)
    texts, sets = frame["text"].tolist(), {}
    joined: dict[int, int] = {}

    def root(part: int) -> int:
        while part in joined:
            part = joined[part]
        return part

    def set_of(row: int) -> np.ndarray:
        if row not in sets:
            sets[row] = shingles(texts[row].encode())
        return sets[row]

    right = np.flatnonzero(block == j)
    out = []
    for row in np.flatnonzero(block == i).tolist():
        others = right[(parts[right] != parts[row]) & ((ids[right] > ids[row]) if i == j else True)]
        agree = (matrix[others].reshape(-1, BANDS, BAND_ROWS) == matrix[row].reshape(1, BANDS, BAND_ROWS)).all(axis=2)
        others = others[agree.argmax(axis=1) == number] if len(others) else others
        one = np.broadcast_to(matrix[row], (len(others), HASHES))
        for other in others[plausible(one, matrix[others])].tolist():
            mine, theirs = root(int(parts[row])), root(int(parts[other]))
            if mine != theirs and similar(set_of(row), set_of(other)):
                joined[mine] = theirs
                out.append((min(ids[row], ids[other]), max(ids[row], ids[other])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """``(class_id, component)`` of every linked class: the smallest id reachable.

    Every round takes the least label among a node and its neighbours and then the
    label of that label, so long chains shrink as fast as stars.
    """
    both = shared(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links",
    )
    labels = shared(
        both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), "labels"
    )
    while True:
        around = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(around, "u").select("u", "label", F.least("label", "near").alias("low"))
        target = labels.select(F.col("u").alias("low"), F.col("label").alias("jump"))
        moved = shared(
            lower.join(target, "low").select("u", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("label")).alias("moved")),
            "labels",
        )
        labels = moved.select("u", "label")
        if moved.where("moved").isEmpty():
            return labels.select(F.col("u").alias("class_id"), F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: row, doc_id, n_shingles, component_id, kept, stays.

    A null text counts as empty; a text without words has no shingles, is linked with
    nothing and is its own component.  ``kept`` says that the document's id is the
    component's smallest; ``stays`` marks exactly one row per component also where
    ids repeat or are null (nulls last).  If all ids of a component are null, so is
    its ``component_id``.  Rows with equal sets are one class, however many they are.
    The input row travels as one struct, so its column names cannot clash.
    """
    rows = packed(
        docs, F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    schema = StructType([
        rows.schema[ROW], StructField("rid", LongType()), StructField("doc_id", LongType()),
        StructField("n_shingles", LongType()), StructField("print", BinaryType()), StructField("signature", BinaryType()),
    ])
    signed = shared(rows.mapInArrow(sign, schema), "near-signed")
    worded = signed.where(F.col("print").isNotNull())
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    classes = shared(
        worded.groupBy("print").agg(F.min(first).alias("first"), F.first("signature").alias("signature"))
        .select("print", "first", F.col("first.rid").alias("class_id"), "signature"),
        "near-classes",
    )
    bands = classes.select("class_id", "signature").mapInArrow(band, "band long, number int, class_id long")
    buckets = bands.groupBy("band").agg(F.min("class_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = shared(bands.join(buckets, "band"), "near-members")

    # Signature and text of the classes that met another in a bucket; nothing else of
    # the texts is read again.
    met = members.select(F.col("class_id").alias("rid")).distinct()
    bodies = shared(
        signed.select("rid", "signature", F.coalesce(F.col(f"{ROW}.{text}").cast("string"), F.lit("")).alias("text"))
        .join(met, "rid").withColumnRenamed("rid", "class_id"),
        "near-bodies",
    )

    def linked(pairs: DataFrame) -> DataFrame:
        for side in "ba":
            pairs = pairs.join(bodies.select(*[F.col(c).alias(f"{n}{side}") for c, n in (("class_id", ""), ("signature", "signature_"), ("text", "text_"))]), side)
        return shared(pairs.mapInArrow(verify, "a long, b long"), "near-links")

    def label(rows: DataFrame, parts: DataFrame) -> DataFrame:
        return rows.join(parts, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))

    # Each class against the first leader among its buckets.
    star = members.where("class_id != leader")
    links = linked(star.groupBy(F.col("class_id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"))
    parts = components(links)
    # Against the leaders of all its buckets, where that still joins components.
    placed = label(star.select("class_id", "leader").distinct(), parts)
    leading = parts.select(F.col("class_id").alias("leader"), F.col("component").alias("theirs"))
    cross = placed.join(leading, "leader", "left").where(F.col("component") != F.coalesce("theirs", "leader"))
    more = linked(cross.select(F.col("leader").alias("a"), F.col("class_id").alias("b")))
    if not more.isEmpty():
        links = links.unionByName(more)
        parts = components(links)
    # What is left: members of one bucket in different components, compared by blocks.
    grouped = label(members.select("band", "number", "class_id", "n"), parts)
    split = grouped.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("class_id"), blocks).cast("int")
    replicated = (
        grouped.join(split.select("band"), "band")
        .select("band", "number", "class_id", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("band", "number", "class_id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(bodies, "class_id")
    )
    last = shared(replicated.groupBy("band", "i", "j").applyInPandas(compare_block, "a long, b long"), "near-links")
    if not last.isEmpty():
        parts = components(links.unionByName(last))

    named = label(classes.select("print", "class_id", "first"), parts)
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    places = named.select("print", "component").join(heads, "component").select(
        F.col("print").alias("of"), F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("head_rid")
    )
    found = worded.join(places, F.col("print") == F.col("of")).select(
        ROW, "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("rid") == F.col("head_rid")).alias("stays"),
    )
    alone = signed.where(F.col("print").isNull()).select(
        ROW, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays")
    )
    return found.unionByName(alone)
