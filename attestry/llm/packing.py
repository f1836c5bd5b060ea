"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Documents become token pieces in one pass; only lengths travel further.  Pieces are
dealt to shards of bounded size.  Within a shard each piece goes where the squared
counts of open bins per residual gap become smallest.  Bins that stay open are
opened up again and their pieces packed together with those of other shards, round
by round, until one shard holds what is left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import shared

# Fixed values of the contract.
CAPACITY = 4096
END_ID = 1

# Pieces a shard packs, and the gap up to which a bin counts as full.
SHARD_PIECES = 4096
SLACK = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Texts made of these characters only are cut into pre-tokens here and each pre-token
# is encoded once.  For them the cut below is the tokenizer's own: its normaliser
# only lowers case, and neither a special token nor a rare letter can occur.
PLAIN = re.compile(r"[\t-\r\x20-;=-~À-ÖØ-öø-ÿ]*")
# Fixed value: the pre-tokens of the vocabulary, written for those characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
REMEMBERED = 400_000  # pre-tokens kept per Python worker


@lru_cache(1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokens(dict):
    """Pre-token to its ids as little-endian bytes, filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        self.whole = tokenizer(path)
        self.model = self.whole.model
        # The byte alphabet, taken from the tokenizer itself.
        self.letters = {
            c: self.whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100)))
        }
        self.letters = str.maketrans(self.letters)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        spelled = piece if piece.isascii() else piece.translate(self.letters)
        ids = np.array([token.id for token in self.model.tokenize(spelled)], "<u4").tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, PRE_TOKEN.findall(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(1)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def cut(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    known, width, end = pre_tokens(path), 4 * capacity, int(end_id).to_bytes(4, "little")
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = known.encode(text or "") + end
            for piece, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first, and the gap each bin is left with.

    ``open_bins[g]`` lists the bins with gap g and ``count[g]`` their number.  A piece
    of length s moves a bin from g to g - s; that changes the sum of squares by
    2 (count[g-s] - count[g]) + 2, or by 1 - 2 count[g] when it fills the bin, and a
    new bin changes it by 2 count[capacity-s] + 1.  The smaller gap wins ties.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    gaps: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        here = count[s:capacity]
        change = 2 * (count[: capacity - s] - here) + 2
        if len(change):
            change[0] -= 1
        change[here == 0] = np.iinfo(np.int64).max
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= new:
            gap = s + best
            at = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = at, capacity - gap
        gaps[at] = gap - s
        if gap > s:
            open_bins[gap - s].append(at)
            count[gap - s] += 1
    return bins, offsets, np.array(gaps, np.int64)


def pack_shard(frames: Iterable[pd.DataFrame], capacity: int, turn: int) -> Iterator[pd.DataFrame]:
    """One partition is one shard; it holds lengths and ids of a bounded number of pieces."""
    held = [frame for frame in frames if len(frame)]
    if not held:
        return
    shard = pd.concat(held, ignore_index=True)
    bins, offsets, gaps = sum_of_squares(shard["length"].to_numpy(), capacity)
    place = (turn << 56) + (TaskContext.get().partitionId() << 24)
    yield shard.assign(sequence_id=place + bins, offset=offsets, gap=gaps[bins])


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES,
         slack: int = SLACK) -> DataFrame:
    """One row per piece with its sequence and its place there.

    A document is its token ids and ``end_id``; one longer than ``capacity`` is cut,
    and its full pieces fill a sequence each.  A null or empty text is one ``end_id``.
    Repeated rows are packed as separate documents, null ids stay null, an empty
    table gives no rows.  Only the two named columns are read.  Every round is
    written to the shared folder, so a lost executor never changes a placing.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    left = shared(source.mapInArrow(lambda b: cut(b, tokenizer_path, capacity, end_id), PIECES), "pack-pieces")
    schema, done, turn = f"{PIECES}, sequence_id long, offset long, gap long", None, 0
    remaining = left.count()
    while True:
        shards = max(1, -(-remaining // shard_pieces))
        packed = shared(
            left.repartition(shards).mapInPandas(lambda f, turn=turn: pack_shard(f, capacity, turn), schema),
            f"pack-{turn}",
        )
        kept = packed if shards == 1 else packed.where(F.col("gap") <= slack)
        rest = 0 if shards == 1 else packed.where(F.col("gap") > slack).count()
        if rest > 0.9 * remaining:  # another deal would hardly fill more
            kept, rest = packed, 0
        done = kept if done is None else done.unionByName(kept)
        if not rest:
            return done.drop("gap")
        left = packed.where(F.col("gap") > slack).drop("sequence_id", "offset", "gap")
        remaining, turn = rest, turn + 1
