"""Language identification by interpolated Kneser-Ney character models.

Character 4-grams of all labelled texts are counted by Spark; every lower order of a
Kneser-Ney model follows from the distinct grams of the order above.  Each language has
a model of its own, in sorted arrays of gram hashes that one task writes to the shared
folder; executors fetch the files from there, and no gram passes through the driver.
The language with the lowest cross-entropy per character wins; an entropy that labelled
texts of that length do not reach is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from attestry.llm.common import packed, shared

ORDER = 4
START, SPACE = 1, 32
ALPHABET = 1 << 16
UNKNOWN = "und"  # fixed value of the contract

REACHED = 0.99  # share of the labelled texts of a length that lie below its limit
MARGIN = 0.3
BINS = 4_096  # of one unit of entropy, only to find a rank
SURE_CHARS = 30  # characters after which more text adds no confidence
GROUP_CHARS = 1 << 20  # characters folded at a time
WINDOW = 1 << 20
HELD_GRAMS = 1 << 21
ROW_GRAMS = 1 << 20  # grams of an array in one row of a file


@lru_cache(1)
def folding() -> np.ndarray:
    """Code point to letter code: lower-case letters and marks, all else a space."""
    table = np.full(0x110000, SPACE, np.uint16)
    for point in range(0x323B0):
        c = chr(point)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = ord(c.lower()[0])
            table[point] = low if 64 < low < ALPHABET else (low % (ALPHABET - 256)) + 256
    table[START] = START
    return table


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter; marks are not, though they take part in grams."""
    table = np.zeros(0x110000, bool)
    for point in range(0x323B0):
        table[point] = chr(point).isalpha()
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams, the text each belongs to, and whether its last character is a letter.

    Every text begins with start marks, so no gram reaches into the text before it.
    """
    mark = chr(START) * (ORDER - 1)
    clean = [t.replace(chr(START), " ") if chr(START) in t else t for t in texts]
    lengths = np.array([len(t) + len(mark) for t in clean], np.int64)
    points = np.frombuffer((mark + mark.join(clean)).encode("utf-32-le", "replace"), "<u4")
    codes = folding()[points]
    before = np.concatenate([[SPACE], codes[:-1]])
    keep = (codes != SPACE) | ((before != SPACE) & (before != START))
    owner = np.repeat(np.arange(len(texts)), lengths)[keep]
    codes = codes[keep].astype(np.uint64)
    packed = codes.copy()
    for back in range(1, ORDER):
        packed[back:] |= codes[:-back] << np.uint64(16 * back)
    said = codes != START
    return packed[said], owner[said], letters()[points[keep]][said]


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about a million characters and the place of the first."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= GROUP_CHARS:
            yield first, held
            first, held, size = at + 1, [], 0
    if held:
        yield first, held


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, text)`` to gram counts, summed over as much of a partition as is held."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
            )
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for first, some in groups(texts):
            names, which = np.unique(np.array(langs[first : first + len(some)], dtype=object), return_inverse=True)
            packed, owner, _ = grams(some)
            of = which[owner]
            for k, lang in enumerate(names):
                keys, n = np.unique(packed[of == k], return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                size += len(keys)
        if size > HELD_GRAMS:
            for lang, parts in held.items():
                held[lang] = [merged(parts)]
            size = sum(len(k) for parts in held.values() for k, _ in parts)
            if size > HELD_GRAMS // 2:
                yield from flush()
                size = 0
    yield from flush()


def mixed(keys: np.ndarray) -> np.ndarray:
    h = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class HashArray:
    """Values found by the hash of a packed gram; hashes are sorted."""

    hashes: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = mixed(keys)
        order = np.argsort(hashes)
        return HashArray(hashes[order], values[order].astype(np.float32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is missing."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def tail(keys: np.ndarray, width: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * width)) - 1)


@dataclass
class Smoothed:
    """One order of one language: counts discounted, and the weight left per context."""

    keys: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray) -> Smoothed:
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = once / (once + 2 * twice) if once else 0.5
        contexts, where = np.unique(keys >> np.uint64(16), return_inverse=True)
        total = np.bincount(where, weights=counts)
        kinds = np.bincount(where)
        return Smoothed(keys, np.maximum(counts - discount, 0) / total[where], contexts, discount * kinds / total)


@dataclass
class Language:
    """The model of one language."""

    probs: list[HashArray]  # by order, 1 first: log probabilities
    backoff: list[HashArray]  # by context length, 0 first: log weights

    @staticmethod
    def fit(keys: np.ndarray, counts: np.ndarray) -> Language:
        """From its distinct 4-grams and their counts."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        orders: list[Smoothed] = []
        for width in range(ORDER, 0, -1):
            orders.insert(0, Smoothed.of(keys, counts))
            keys, counts = np.unique(tail(keys, width - 1), return_counts=True)
        probs, backoff = [], []
        below, below_keys = np.array([1 / ALPHABET]), np.zeros(1, np.uint64)
        for width, s in enumerate(orders, 1):
            # Every shorter gram of a gram is there, and so is its context.
            base = below[np.searchsorted(below_keys, tail(s.keys, width - 1))]
            p = s.share + s.left[np.searchsorted(s.contexts, s.keys >> np.uint64(16))] * base
            probs.append(HashArray.of(s.keys, np.log(p)))
            backoff.append(HashArray.of(s.contexts, np.log(s.left)))
            below, below_keys = p, s.keys
        return Language(probs, backoff)

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character."""
        out = np.zeros(len(keys))
        rest = np.arange(len(keys))
        for width in range(ORDER, 0, -1):
            short = tail(keys[rest], width)
            at = self.probs[width - 1].find(mixed(short))
            hit = at >= 0
            out[rest[hit]] += self.probs[width - 1].values[at[hit]]
            rest, short = rest[~hit], short[~hit]
            if not len(rest):
                return out
            back = self.backoff[width - 1].find(mixed(short >> np.uint64(16)))
            known = back >= 0
            out[rest[known]] += self.backoff[width - 1].values[back[known]]
        out[rest] += np.log(1 / ALPHABET)
        return out


ARRAYS = "lang string, kind string, width int, part int, hashes array<long>, logs array<float>"


def fit_language(counts: pa.Table) -> pa.Table:
    """All grams of one language to its arrays, in rows of bounded length."""
    model = Language.fit(
        counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy().astype(np.float64)
    )
    rows = [
        {
            "lang": counts.column("lang")[0].as_py(), "kind": kind, "width": width, "part": part,
            "hashes": array.hashes[at:at + ROW_GRAMS].view(np.int64), "logs": array.values[at:at + ROW_GRAMS],
        }
        for kind, arrays in (("prob", model.probs), ("backoff", model.backoff))
        for width, array in enumerate(arrays)
        for part, at in enumerate(range(0, len(array.hashes), ROW_GRAMS))
    ]
    return pa.Table.from_pylist(
        rows,
        schema=pa.schema([
            ("lang", pa.string()), ("kind", pa.string()), ("width", pa.int32()), ("part", pa.int32()),
            ("hashes", pa.list_(pa.int64())), ("logs", pa.list_(pa.float32())),
        ]),
    )


@lru_cache(2)
def loaded(files: tuple[str, ...]) -> dict[str, Language]:
    """The models in files that Spark has fetched, by name of language; once a worker."""
    parts: dict[tuple, list] = {}
    for name in files:
        table = pq.read_table(SparkFiles.get(name), partitioning=None)
        for i in range(table.num_rows):
            row = {c: table.column(c)[i] for c in table.column_names}
            key = tuple(row[c].as_py() for c in ("lang", "kind", "width"))
            parts.setdefault(key, []).append(
                (row["part"].as_py(), row["hashes"].values.to_numpy().view(np.uint64), row["logs"].values.to_numpy())
            )
    models: dict[str, Language] = {}
    for lang in sorted({lang for lang, _, _ in parts}):
        arrays = {}
        for kind in ("prob", "backoff"):
            arrays[kind] = [
                HashArray(*(np.concatenate(x) for x in zip(*((h, v) for _, h, v in sorted(parts[lang, kind, width], key=lambda p: p[0])))))
                for width in range(ORDER)
            ]
        models[lang] = Language(arrays["prob"], arrays["backoff"])
    return models


@dataclass
class Model:
    files: tuple[str, ...]  # names under which executors have the languages' arrays
    limits: np.ndarray | None = None  # by the logarithm of the length

    @property
    def langs(self) -> list[str]:
        return list(loaded(self.files))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy per character in each language, characters, letters."""
        languages = loaded(self.files).values()
        packed, owner, letter = grams(texts)
        sums = np.zeros((len(texts), len(languages)))
        for at in range(0, len(packed), WINDOW):
            part = slice(at, at + WINDOW)
            distinct, where = np.unique(packed[part], return_inverse=True)
            for k, language in enumerate(languages):
                logs = language.log_probs(distinct)[where]
                sums[:, k] -= np.bincount(owner[part], weights=logs, minlength=len(texts))
        size = np.bincount(owner, minlength=len(texts))
        return sums / np.maximum(size, 1)[:, None], size, np.bincount(owner, weights=letter, minlength=len(texts))

    def calibrate(self, steps: np.ndarray, reached: np.ndarray) -> None:
        """A limit per power of two of the length, from ``high_entropies``.

        It lies above what the labelled texts reach by ``MARGIN`` of the way to the entropy
        of a model that knows nothing, so texts like the labelled ones stay.  Lengths
        without texts take the limit of the nearest length that has some.
        """
        limits = np.full(64, np.nan)
        limits[steps] = reached + MARGIN * (np.log(ALPHABET) - reached)
        known = np.flatnonzero(~np.isnan(limits))
        if len(known):
            limits = limits[known[np.abs(np.arange(64)[:, None] - known[None, :]).argmin(axis=1)]]
            self.limits = np.maximum.accumulate(limits[::-1])[::-1]  # shorter texts vary more


def high_entropies(counted: DataFrame) -> DataFrame:
    """The exact quantile ``REACHED`` of the entropies of each ``step``, between two ranks in proportion.

    ``counted`` has one row per step and entropy with its number of texts, ``n``.  Counts
    per bin tell in which bins the two ranks fall, and only those bins are ordered.
    """
    binned = counted.withColumn("bin", F.floor(F.col("entropy") * BINS))
    every = Window.partitionBy("step")
    so_far = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        binned.groupBy("step", "bin").agg(F.sum("n").alias("held"))
        .withColumns({"rank": (F.sum("held").over(every) - 1) * F.lit(REACHED), "before": F.sum("held").over(so_far) - F.col("held")})
    )
    low, high = F.floor("rank"), F.ceil("rank")
    ends = placed.where((F.col("before") <= high) & (F.col("before") + F.col("held") > low)).select("step", "bin", "before", "rank")
    within = Window.partitionBy("step", "bin").orderBy("entropy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = binned.join(ends, ["step", "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(within))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("entropy")))

    return ordered.groupBy("step", "rank").agg(at(low).alias("below"), at(high).alias("above")).select(
        "step", (F.col("below") + (F.col("above") - F.col("below")) * (F.col("rank") - low)).alias("entropy")
    )


def trainable(docs: DataFrame, learn: Column, text: str, lang: str) -> DataFrame:
    return docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model | None:
    """Count grams over every row that ``learn`` selects; None where there is none.

    One task fits one language from its distinct 4-grams, 16 bytes each, and every gram
    stays in the model.  Executors fetch the arrays, 12 bytes an entry, as files.  The same
    rows, all of them, then give the rejection limits.
    """
    rows = trainable(docs, learn, text, lang)
    counts = rows.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    arrays = shared(
        counts.groupBy("lang").applyInArrow(fit_language, ARRAYS), "language-arrays"
    )
    if arrays.isEmpty():
        return None
    files = arrays.inputFiles()
    for file in files:
        docs.sparkSession.sparkContext.addFile(file)
    model = Model(tuple(sorted(file.rsplit("/", 1)[1] for file in files)))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in groups(batch.column("text").to_pylist()):
                entropy, size, _ = model.entropies(texts)
                said = size > 0
                steps = np.log2(np.maximum(size, 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(steps[said]), pa.array(entropy.min(axis=1)[said])], ["step", "entropy"])

    counted = rows.select("text").mapInArrow(measure, "step int, entropy double").groupBy("step", "entropy").agg(F.count("*").alias("n"))
    reached = high_entropies(shared(counted, "language-entropies")).toArrow()  # a row per power of two
    model.calibrate(reached.column("step").to_numpy(), reached.column("entropy").to_numpy())
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as one struct, with lang_pred, score, entropy and rejected.

    A null text, or one without a letter, is ``und`` with score 0, and rejected; so is
    every text where nothing could be learned.  ``score`` is the share of the winner
    among the languages' likelihoods, at the length of a short sentence at most;
    languages that tie are taken in order of name.  Marks and digits are no letters.
    Repeated rows are judged alike, long texts whole and a window at a time, an empty
    table gives no rows, and other columns cannot clash.
    """
    rows = packed(docs, F.col(text).cast("string").alias("text"))
    schema = StructType([
        rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("entropy", DoubleType()), StructField("length", LongType()), StructField("rejected", BooleanType()),
    ])
    known = model  # names and limits; the arrays come as files

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = known.langs if known is not None else []
        for batch in batches:
            names, scores, entropies, lengths, refused = [], [], [], [], []
            for _, texts in groups(batch.column("text").to_pylist()):
                if known is None:
                    entropy, size, letters = np.zeros((len(texts), 1)), np.zeros(len(texts), int), np.zeros(len(texts))
                else:
                    entropy, size, letters = known.entropies(texts)
                best = entropy.argmin(axis=1)
                low = entropy.min(axis=1)
                share = 1 / np.exp((low[:, None] - entropy) * np.minimum(size, SURE_CHARS)[:, None]).sum(axis=1)
                blank = letters == 0
                limit = np.inf if known is None or known.limits is None else known.limits[np.log2(np.maximum(size, 1)).astype(int)]
                names += [UNKNOWN if b else names_of[k] for b, k in zip(blank, best)]
                scores.append(np.where(blank, 0.0, share))
                entropies.append(np.where(blank, 0.0, low))
                lengths.append(size)
                refused.append(blank | (low > limit))
            if names:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(names), pa.array(np.concatenate(scores)), pa.array(np.concatenate(entropies)),
                     pa.array(np.concatenate(lengths).astype(np.int64)), pa.array(np.concatenate(refused))],
                    ["row", "lang_pred", "score", "entropy", "length", "rejected"],
                )

    return rows.mapInArrow(judge, schema)
