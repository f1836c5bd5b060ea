"""Licence notices: exact phrases, and short notices found in spite of small errors.

A notice with at most k errors contains at least one of its k + 1 pieces unchanged.
Those pieces are the seeds: only where one occurs is the notice matched with the
``regex`` library's bounded-error matching, in a window as long as the notice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from attestry.llm.common import ROW, packed

# Fixed values of the contract: phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# The method's notices, their labels and the errors (inserted, lost or changed
# characters) each may have.
NOTICES = (
    ("released under the mit license", "mit", 2),
    ("licensed under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 3),
    ("licensed under the apache license version 2", "apache-2", 3),
    ("apache software license", "apache", 1),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("creative commons attribution noderivatives", "cc-by-nd", 3),
    ("licensed under a creative commons attribution", "cc-by", 3),
    ("creative commons zero", "cc0", 1),
    ("licensed under the gnu general public license", "gpl", 3),
    ("gnu general public license version", "gpl", 2),
    ("terms of the gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu library general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("gnu free documentation license", "gfdl", 2),
    ("mozilla public license version", "mpl", 2),
    ("eclipse public license", "epl", 1),
    ("european union public licence", "eupl", 2),
    ("common development and distribution license", "cddl", 3),
    ("common public license version", "cpl", 2),
    ("microsoft public license", "ms-pl", 1),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("bsd 3 clause license", "bsd", 1),
    ("bsd 2 clause license", "bsd", 1),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 3),
    ("boost software license", "bsl", 1),
    ("artistic license", "artistic", 1),
    ("sil open font license", "ofl", 1),
    ("open database license", "odbl", 1),
    ("python software foundation license", "psf", 2),
    ("this software is provided as is without any express or implied warranty", "zlib", 3),
    ("free and unencumbered software released into the public domain", "unlicense", 3),
    ("dedicated to the public domain", "public-domain", 2),
    ("all rights reserved", "all-rights-reserved", 1),
)

# What counts as part of a word once A-Z are lower case.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    errors: int
    seeds: tuple[tuple[bytes, int], ...]  # piece and its place in the phrase
    pattern: regex.Pattern

    @staticmethod
    def of(phrase: str, label: str, errors: int) -> Notice:
        size, parts = len(phrase), errors + 1
        cuts = [size * k // parts for k in range(parts + 1)]
        seeds = tuple((phrase[a:b].encode(), a) for a, b in zip(cuts, cuts[1:]))
        pattern = regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(phrase, literal_spaces=True)}){{e<={errors}}}(?!\S)")
        return Notice(phrase, label, errors, seeds, pattern)


@lru_cache(4)
def notices(listed: tuple = NOTICES) -> tuple[Notice, ...]:
    return tuple(Notice.of(*n) for n in listed)


def places(padded: bytes, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand in a row."""
    needle, found = f" {phrase} ".encode(), []
    at, before, words = padded.find(needle), 0, 0
    while at >= 0:
        words += padded.count(b" ", before, at)
        found.append(words)
        before, at = at, padded.find(needle, at + 1)
    return found


def windows(padded: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Stretches between blanks, no longer than the notice and its errors, that hold a seed.

    The notice begins and ends at blanks within ``errors`` of where its seed puts them;
    where no blank stands there, it is not there.
    """
    size, k, found = len(notice.phrase.encode()), notice.errors, set()
    for seed, offset in notice.seeds:
        at = padded.find(seed)
        while at >= 0:
            begin = at - offset
            low = padded.find(b" ", max(0, begin - k - 1), max(0, begin + k) + 1)
            high = padded.rfind(b" ", at, begin + size + k + 1) if low >= 0 else -1
            if low < high:
                found.add((low + 1, high))
            at = padded.find(seed, at + 1)
    return sorted(found)


def fuzzy(padded: bytes, notice: Notice) -> list[tuple[str, int, int, int]]:
    """Spans ``(label, first word, end word, errors)`` of a notice, not overlapping.

    Of overlapping places that with fewer errors counts, then the earlier.  Time grows
    with the text: words are counted once, equal stretches are matched once.
    """
    found: dict[int, tuple[str, int, int, int]] = {}
    known: dict[bytes, tuple[int, int, int] | None] = {}
    counted, words = 0, -1
    for low, high in windows(padded, notice):
        words += padded.count(b" ", counted, low)
        counted, stretch = low, padded[low:high]
        if stretch not in known:
            match = notice.pattern.search(stretch.decode("utf-8", "replace"))
            known[stretch] = match and (
                match.string.count(" ", 0, match.start()), match.group().strip().count(" ") + 1, sum(match.fuzzy_counts)
            )
        if known[stretch]:
            skipped, length, errors = known[stretch]
            first = words + skipped
            if first not in found or errors < found[first][3]:
                found[first] = (notice.label, first, first + length, errors)
    spans, taken = [], set()
    for span in sorted(found.values(), key=lambda s: (s[3], s[1])):
        held = range(span[1], span[2])
        if taken.isdisjoint(held):
            taken.update(held)
            spans.append(span)
    return sorted(spans, key=lambda s: s[1])


def scan_text(text: bytes, listed: tuple = NOTICES) -> tuple:
    words = text.translate(WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    padded = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in BASE for at in places(padded, phrase)]
    spans = sorted((s for n in notices(listed) for s in fuzzy(padded, n)), key=lambda s: (s[1], s[2], s[0]))
    score = 1.0 if base else max((1 - s[3] / 10 for s in spans), default=0.0)
    starts = [at for at, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in base})),
        ",".join(sorted({label for _, label in base} | {s[0] for s in spans})), score, spans,
    )


SPANS = ArrayType(StructType([
    StructField("label", StringType()), StructField("first_word", LongType()), StructField("end_word", LongType()),
    StructField("errors", IntegerType()),
]))
RESULT = [
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
    StructField("last_word", LongType()), StructField("base_labels", StringType()), StructField("labels", StringType()),
    StructField("score", DoubleType()), StructField("spans", SPANS),
]
ARROW_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int32())]))
ARROW_RESULT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), ARROW_SPANS]


def scan(docs: DataFrame, text: str = "text", listed: tuple = NOTICES) -> DataFrame:
    """The rows of ``docs`` as one struct, with what the scan found in each.

    ``spans`` holds the notices found with errors: label, first and end word, errors.
    ``score`` is 1 with an exact phrase, else falls with the errors of the best
    notice, 0 without one.  A null text counts as empty: no words, empty label
    strings, null places.  Very long texts are scanned whole in time that grows with
    their length.  Notices of different labels may overlap, places of one notice do not:
    fewer errors win, then the earlier.  Rows are scanned each by itself, so repeated
    rows give repeated results and empty tables none; other columns cannot clash.
    """
    rows = packed(docs, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scan_text(t, listed) for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            columns = [list(c) for c in zip(*out)] or [[] for _ in RESULT]
            columns[-1] = [[dict(zip(("label", "first_word", "end_word", "errors"), s)) for s in spans] for spans in columns[-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), *[pa.array(c, k) for c, k in zip(columns, ARROW_RESULT)]],
                [ROW, *[f.name for f in RESULT]],
            )

    return rows.mapInArrow(run, StructType([rows.schema[ROW], *RESULT]))
