"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates come from exact patterns and from wider ones.  Every candidate gets the
votes of shape, gazetteer, context and neighbour labelers, and features of the span and
the words around it.  Vote patterns are counted over all documents; there are few of
them, so expectation-maximisation runs on exact counts of the whole corpus and estimates
each labeler's reliability kind by kind.  The classifier sees features only, never votes;
it learns the soft labels from a bounded sample of spans and scores every span.  Base
spans always stay; wider candidates are reported where the classifier accepts them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from attestry.llm.common import ROW, packed, shared

# Fixed values of the contract: kinds as listed, their patterns and rules.
BASE = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# The method's wider kinds.
WIDER = ("iban", "person", "ssn", "telephone")
KINDS = BASE + WIDER
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TELEPHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
PERSON = re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20)?([A-Z][a-z]+)\x20[A-Z][a-z]+\b")
FIRST_NAMES = frozenset(
    "Anna Carlos Charles David Elena Elizabeth Emily Emma Francisco Hans James Jean Jennifer Jessica John Jose Juan "
    "Julia Karen Karl Klaus Linda Lucia Maria Marie Mary Michael Miguel Patricia Paul Peter Pierre Richard Robert "
    "Sarah Sophie Susan Thomas William".split()
)
TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\b")
# Countries with an account number and its length, from the public registry.
IBAN_SIZES = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LT": 20, "LU": 20, "LV": 21,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
FILES = (".png", ".jpg", ".gif", ".svg", ".css", ".js")
ISSUERS = ("34", "37", "4", "5", "6", "2")
PRIVATE = ("10.", "127.", "192.168.", "169.254.")
CUES = {
    "email": re.compile(r"(?i)e-?mail|mail ?to|contact|write"), "ip": re.compile(r"(?i)\bip\b|host|address|server|from"),
    "card": re.compile(r"(?i)card|visa|credit|payment|account"), "phone": re.compile(r"(?i)phone|tel|call|mobile|fax|contact"),
    "iban": re.compile(r"(?i)iban|account|bank|transfer"), "person": re.compile(r"(?i)\bname|signed|contact|patient|born|\bby\b"),
    "ssn": re.compile(r"(?i)ssn|social|security|tax"), "telephone": re.compile(r"(?i)phone|tel|call|mobile|fax|contact"),
}
FOLLOWS = {
    "person": re.compile(r"(?i)^[\s,]*(?:said|wrote|born|lives|was|is|has|and (?:his|her)|\(?b\.)\b"),
    "email": re.compile(r"^[\s>,;.)\]]|^$"), "card": re.compile(r"(?i)exp|cvv|cvc|valid"),
}
AGAINST = re.compile(r"(?i)version|isbn|issn|order|part|serial|page|chapter|section|release|build|doi|license")
NEAR_WORD = re.compile(r"[^\W\d_]+")
CONTEXT = 40

YES, NO, ABSTAIN = 1, 2, 0
LABELERS = 6  # shape, gazetteer, cue before, cue after, counter-cue, neighbours
ACCEPT = 0.5
FEATURES = 4096  # hashed features of spans and their context
SAMPLE_SPANS = 5_000  # of each kind, about; what the classifier is fitted on


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (2 if place % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an address starts where its run of local characters does.

    A later start in the same run meets the same ``@`` and domain, so each ``@`` is
    tried once and time stays linear in the text.
    """
    floor, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > floor and text[low - 1] in LOCAL:
            low -= 1
        match = DOMAIN.match(text, at + 1) if low < at else None
        if match:
            yield low, match.end()
            floor = match.end()
        at = text.find("@", max(at + 1, floor))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four numbers: each run of digits and dots is split once."""
    for run in DOTTED.finditer(text):
        parts, at, place = run.group().split("."), run.start(), 0
        while place < len(parts):
            four = parts[place : place + 4]
            if len(four) == 4 and all(four):
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, end
                at, place = end + 1, place + 4
            else:
                at, place = at + len(parts[place]) + 1, place + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the contract's matches; failing matches are dropped."""
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, a, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def wider_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns that no base span and no earlier kind covers."""
    taken = sorted((a, b) for _, a, b in base)
    out: list[tuple[int, int, int]] = []
    for kind, pattern in zip(WIDER, (IBAN, PERSON, SSN, TELEPHONE)):
        new = []
        at = 0
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                new.append((KINDS.index(kind), *m.span()))
        out += new
        taken = sorted(taken + [(a, b) for _, a, b in new])
    return out


def iban_valid(value: str) -> bool:
    packed_value = value.replace(" ", "")
    return 15 <= len(packed_value) <= 34 and int("".join(str(int(c, 36)) for c in packed_value[4:] + packed_value[:4])) % 97 == 1


def shape_vote(name: str, value: str) -> int:
    """Whether the span's own digits and letters are those of its kind."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if name == "iban":
        good = iban_valid(value)
    elif name == "ssn":
        good = not (value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000")
    elif name == "telephone":
        good = digits[0] in "23456789" and digits[3] in "23456789"
    elif name == "person":
        return YES if TITLE.match(value) else ABSTAIN
    elif name == "ip":
        good = value.split(".")[0].lstrip("0") not in ("", "127", "255") and not any(len(p) > 3 for p in value.split("."))
    elif name == "card":
        good = len(set(digits)) > 3
    elif name == "phone":
        good = value[1] != "0" and len(digits) >= 10
    else:
        good = ".." not in value and not value.startswith(".") and any(c.isalpha() for c in value.partition("@")[0])
    return YES if good else NO


def gazetteer_vote(name: str, value: str, first_names: Collection[str]) -> int:
    """Whether the span is in, or begins or ends with, what lists know of its kind."""
    if name == "person":
        return YES if PERSON.match(value).group(1) in first_names else NO
    if name == "iban":
        size = IBAN_SIZES.get(value[:2])
        return ABSTAIN if size is None else YES if size == len(value.replace(" ", "")) else NO
    if name == "email":
        return NO if value.lower().endswith(FILES) else ABSTAIN
    if name == "ip":
        return NO if value.startswith(PRIVATE) else ABSTAIN
    if name == "card":
        return YES if value.startswith(ISSUERS) else NO
    if name == "ssn":
        return NO if value in ("078-05-1120", "123-12-1234") else ABSTAIN
    return NO if "555-01" in value else ABSTAIN


def votes(text: str, kind: int, start: int, end: int, first_names: Collection[str] = FIRST_NAMES) -> int:
    """Votes of the labelers as base-3 digits."""
    name, value = KINDS[kind], text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    follows = FOLLOWS.get(name)
    glued = NO if (before[-1:].isalnum() or after[:1].isalnum()) and name != "email" else ABSTAIN
    code = 0
    for vote in (
        shape_vote(name, value), gazetteer_vote(name, value, first_names), YES if CUES[name].search(before) else ABSTAIN,
        YES if follows and follows.search(after) else ABSTAIN, NO if AGAINST.search(before) else ABSTAIN, glued,
    ):
        code = code * 3 + vote
    return code


def outline(value: str) -> str:
    """Character classes in runs, each with its length up to five."""
    out, last, run = [], "", 0
    for c in value[:64] + "\0":
        kind = "" if c == "\0" else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if kind != last:
            out.append(f"{last}{min(run, 5)}")
            last, run = kind, 0
        run += 1
    return "".join(out[1:])


def span_features(text: str, kind: int, start: int, end: int, first_names: Collection[str] = FIRST_NAMES) -> list[int]:
    """Hashed features: the span's outline, length and checks, its neighbours and its place."""
    name, value = KINDS[kind], text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    near = NEAR_WORD.findall(before)[-2:]
    line = text.rfind("\n", max(0, start - 80), start)
    told = [
        "", f"outline {outline(value)}", f"long {min(len(value) // 4, 8)}", f"shape {shape_vote(name, value)}",
        f"listed {gazetteer_vote(name, value, first_names)}", f"left {before[-1:]}", f"right {after[:1]}",
        f"begins {line == start - 1 or start == 0}", f"edge {start < 200} {len(text) - end < 200}",
        *[f"before {w.lower()}" for w in near], *[f"after {w.lower()}" for w in NEAR_WORD.findall(after)[:1]],
    ]
    if name == "person":
        told += [f"word {w}" for w in value.split()]
    return sorted({zlib.crc32(f"{name} {t}".encode("utf-8", "replace")) % FEATURES for t in told})


CANDIDATES = ArrayType(StructType([
    StructField("kind", IntegerType()), StructField("start", LongType()), StructField("end", LongType()),
    StructField("votes", IntegerType()), StructField("told", ArrayType(IntegerType())),
]))
ARROW_CANDIDATES = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("told", pa.list_(pa.int32()))]))


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(batches: Iterable[pa.RecordBatch], first_names: Collection[str] = FIRST_NAMES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, spans = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            for kind, column in enumerate(counts):
                column.append(sum(k == kind for k, _, _ in base))
            digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
            spans.append([
                {"kind": k, "start": a, "end": b, "votes": votes(text, k, a, b, first_names),
                 "told": span_features(text, k, a, b, first_names)}
                for k, a, b in base + wider_spans(text, base)
            ])
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
             pa.array(spans, ARROW_CANDIDATES)],
            [ROW, *[f"n_{k}" for k in BASE], "base_sha256", "candidates"],
        )


def digits_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(LABELERS - 1, -1, -1) % 3


# What is believed of a labeler before its votes are seen, as votes: better than chance.
BELIEF = np.array([[0.4, 0.1, 0.5], [0.4, 0.5, 0.1]]) * 4  # of no personal data, of some: abstain, yes, no


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over one kind's vote patterns: posterior of each, and P(vote | class) per labeler.

    Starts from majority votes; a few votes of belief keep every table proper.
    """
    given = digits_of(codes)
    balance = (given == YES).sum(axis=1) - (given == NO).sum(axis=1)
    posterior = 1 / (1 + np.exp(-2.0 * balance))
    tables = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        for labeler in range(LABELERS):
            for vote in range(3):
                tables[:, labeler, vote] = (weight * (given[:, labeler] == vote)).sum(axis=1) + BELIEF[:, vote]
        tables /= tables.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        logs = np.log(prior)[:, None] + sum(np.log(tables[:, j, given[:, j]]) for j in range(LABELERS))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, tables


def classifier(told: list[list[int]], weight: np.ndarray, soft: np.ndarray, steps: int = 300) -> np.ndarray:
    """Feature weights of a logistic regression on soft labels, by adaptive gradient steps."""
    rows = np.repeat(np.arange(len(told)), [len(t) for t in told])
    columns = np.array([f for t in told for f in t], np.int64)
    share, w, seen = weight / weight.sum(), np.zeros(FEATURES), np.full(FEATURES, 1e-12)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], len(told)), -30, 30)))
        slope = np.bincount(columns, (share * (p - soft))[rows], FEATURES) + 1e-6 * w
        seen += slope**2
        w -= 0.3 * slope / np.sqrt(seen)
    return w


def fit(found: DataFrame, sample: int = SAMPLE_SPANS) -> np.ndarray | None:
    """Feature weights, learned from the corpus itself; None where no candidate is.

    Collects at most kinds x 3**labelers counts and about ``sample`` spans of a kind.
    """
    spans = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.told")
    table = spans.groupBy("kind", "votes").count().collect()
    if not table:
        return None
    soft, rates = {}, {}
    for kind in sorted({r.kind for r in table}):
        mine = sorted((r.votes, r["count"]) for r in table if r.kind == kind)
        codes, counts = (np.array(c, np.int64) for c in zip(*mine))
        posterior, _ = reliabilities(codes, counts.astype(float))
        soft.update({(kind, int(c)): p for c, p in zip(codes, posterior)})
        rates[kind] = min(1.0, sample / int(counts.sum()))
    # Equal spans are drawn together and weigh as many as they are.
    drawn = F.pmod(F.xxhash64("kind", "votes", "told"), F.lit(1_000_000))
    kept = F.lit(False)
    for kind, rate in rates.items():
        kept = kept | ((F.col("kind") == kind) & (drawn < int(rate * 1_000_000)))
    rows = spans.where(kept).groupBy("kind", "votes", "told").count().orderBy("kind", "votes", "told").collect()
    if not rows:
        return None
    each = {k: sum(r["count"] for r in rows if r.kind == k) for k in rates}
    weight = np.array([r["count"] / each[r.kind] for r in rows])  # every kind counts alike
    return classifier([r.told for r in rows], weight, np.array([soft[r.kind, r.votes] for r in rows]))


def scan(docs: DataFrame, text: str = "text", first_names: Collection[str] = FIRST_NAMES, sample: int = SAMPLE_SPANS) -> DataFrame:
    """The rows of ``docs`` as one struct, with base counts, digest, reported spans and their chances.

    ``chances`` holds the classifier's probability of every reported span, in the order
    of ``spans``.  A null text counts as empty: zero counts, empty strings.  Wider
    candidates need the classifier's approval; where there is nothing to learn from,
    nothing is added.  Of overlapping candidates base spans win, then the kind listed
    first.  Very long texts are scanned whole in time that grows with their length.
    Repeated rows are scanned each by itself, empty tables give no rows, other columns
    cannot clash.  Texts are read once.
    """
    rows = packed(docs, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = StructType([
        rows.schema[ROW], *[StructField(f"n_{k}", LongType()) for k in BASE], StructField("base_sha256", StringType()),
        StructField("candidates", CANDIDATES),
    ])
    listed = frozenset(first_names)
    found = shared(rows.mapInArrow(lambda b: find(b, listed), schema), "pii-candidates")
    learned = fit(found, sample)
    weights = F.expr("array(" + ",".join(f"{w:.6f}D" for w in (learned if learned is not None else np.zeros(FEATURES))) + ")")
    names = F.array(*[F.lit(k) for k in KINDS])

    def judged(c: Column) -> Column:
        total = F.aggregate(c["told"], F.lit(0.0), lambda sum_, f: sum_ + F.get(weights, f))
        return F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))).alias("chance"),
        )

    def reported(c: Column) -> Column:
        return (c["kind"] < len(BASE)) | ((c["chance"] >= ACCEPT) & F.lit(learned is not None))

    def spelled_out(c: Column) -> Column:
        return F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))

    ordered = found.withColumn("_spans", F.sort_array(F.filter(F.transform("candidates", judged), reported)))
    return ordered.select(
        ROW, *[f"n_{k}" for k in BASE], "base_sha256", F.array_join(F.transform("_spans", spelled_out), ",").alias("spans"),
        F.array_join(F.transform("_spans", lambda c: c["chance"].cast("decimal(5,4)").cast("string")), ",").alias("chances"),
    )
