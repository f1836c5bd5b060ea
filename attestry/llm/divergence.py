"""How far the sources of a language diverge in their words.

1. Words are counted per language, source and term inside each batch, then by Spark; a
   language keeps the terms of at least ``min_docs`` of its documents.
2. Each kept term is one row: its nonzero counts in source order.  Equal rows become one
   row with a multiplicity, and rows are dealt out sorted, so that rows that begin alike
   are neighbours.
3. Each task inserts its rows into a frequent-pattern tree.  A node stands for a shared
   beginning; its multiplicity is the number of terms below it.  What two sources differ
   by is, for most terms, what two zero counts give, so only corrections are summed, once
   for a node and each of its ancestors, times the node's multiplicity.  Sums are linear
   in multiplicities, so a beginning that lies in two tasks loses nothing.

All sums are exact: whole numbers in Python, decimals in Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import shared

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # fixed value of the contract; in UTF-8 as in code points
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCALE = 1_000_000_000
HELD_TERMS, HELD_PAIRS = 1 << 19, 1 << 18  # counts and combinations a task holds before it passes them on
SLICE = 1 << 24  # bytes of a text searched at a time


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, a slice at a time; slices end behind a term."""
    low, start = text.translate(LOWER), 0
    while start < len(low):
        end = start + SLICE
        while end < len(low) and TERM.match(low, end, end + 1):
            end += 1
        yield TERM.findall(low, start, end)
        start = end


def count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: lang, source, term, occurrences, documents; a null term marks the group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def passed_on() -> pa.RecordBatch:
        lengths = [1 + len(counts) for counts, _ in held.values()]
        langs, sources = (np.repeat(np.array([k[i] for k in held], object), lengths) for i in (0, 1))
        rows = [
            [x for cells in held.values() for x in column(*cells)]
            for column in (lambda n, d: (None, *n), lambda n, d: (0, *n.values()), lambda n, d: (0, *(d[t] for t in n)))
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()), pa.array(sources, pa.string()), pc.cast(pa.array(rows[0], pa.binary()), pa.string()),
                pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        for lang, source, text in zip(
            batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
            pc.cast(batch.column("text"), pa.binary()).to_pylist(),
        ):
            counts, spread = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(counts), set()
            for terms in term_slices(text):
                counts.update(terms)
                seen.update(terms)
            spread.update(seen)
            size += len(counts) - before
            if size >= HELD_TERMS:
                yield passed_on()
                size = 0
    if held:
        yield passed_on()


def chance(count: int, total: int, kept: int) -> int:
    return 1 + SCALE * (count + 1) // (total + kept)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Both at most SCALE + 1, so squares fit 64 bits."""
    return (p - q) * (p - q) // q


class Tree:
    """A frequent-pattern tree over rows that come sorted: only the open path is held.

    A row's items are (source, count, total of the source).  When a node closes, its
    multiplicity is known and is added to the node's and each ancestor's combination.
    """

    def __init__(self):
        self.names: dict[tuple, int] = {}  # item -> its number
        self.items: list[tuple] = []
        self.path: list[list[int]] = []  # [number of the item, multiplicity]
        self.pairs: dict[tuple[int, int], int] = {}

    def insert(self, row: list[tuple], times: int) -> None:
        shared_depth = 0
        for node, item in zip(self.path, row):
            if self.items[node[0]] != item:
                break
            shared_depth += 1
        self.close(shared_depth)
        for item in row[shared_depth:]:
            number = self.names.get(item)
            if number is None:
                number = self.names[item] = len(self.items)
                self.items.append(item)
            self.path.append([number, 0])
        for node in self.path:
            node[1] += times

    def close(self, depth: int = 0) -> None:
        pairs = self.pairs
        while len(self.path) > depth:
            number, times = self.path.pop()
            for above, _ in self.path:
                key = (above, number)
                pairs[key] = pairs.get(key, 0) + times

    def corrections(self, lang: str, kept: int) -> list[dict]:
        """Per ordered pair of sources, what their common terms add; forgets the combinations."""
        if not self.pairs:
            return []
        keys = np.array(list(self.pairs), np.int64)
        times, sources = list(self.pairs.values()), [source for source, _, _ in self.items]
        p = np.array([chance(c, total, kept) for _, c, total in self.items], np.int64)
        zero = np.array([chance(0, total, kept) for _, _, total in self.items], np.int64)
        sums: dict[tuple, int] = {}
        for one, other in ((keys[:, 0], keys[:, 1]), (keys[:, 1], keys[:, 0])):
            gains = (
                distance(p[one], p[other]) - distance(p[one], zero[other])
                - distance(zero[one], p[other]) + distance(zero[one], zero[other])
            )
            for a, b, n, gain in zip(one.tolist(), other.tolist(), times, gains.tolist()):
                pair = (sources[a], sources[b])
                sums[pair] = sums.get(pair, 0) + n * gain
        self.pairs = {}
        if not self.path:
            self.names, self.items = {}, []
        return [{"lang": lang, "source": s, "item": t, "value": str(v)} for (s, t), v in sums.items()]


def tree_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to exact sums per ordered pair of sources, as texts of whole numbers."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.string())])
    tree, lang, kept = Tree(), None, 0
    for batch in batches:
        flat = batch.column("items").flatten()
        items = list(zip(*(flat.field(name).to_pylist() for name in ("source", "n", "total"))))
        ends = np.cumsum(pc.list_value_length(batch.column("items")).to_numpy(zero_copy_only=False)).tolist()
        rows = zip(*(batch.column(name).to_pylist() for name in ("lang", "times", "kept")), [0, *ends], ends)
        for row_lang, times, row_kept, start, end in rows:
            if row_lang != lang:
                tree.close()
                if found := tree.corrections(lang, kept):
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                tree, lang, kept = Tree(), row_lang, row_kept
            tree.insert(items[start:end], times)
            if len(tree.pairs) >= HELD_PAIRS:
                tree.close()
                yield pa.RecordBatch.from_pylist(tree.corrections(lang, kept), schema=schema)
    tree.close()
    if found := tree.corrections(lang, kept):
        yield pa.RecordBatch.from_pylist(found, schema=schema)


def chance_of(count: Column, total: Column, kept: Column) -> Column:
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", scaled, (total + kept).cast("decimal(20,0)")) + 1


def distance_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
          min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language and how far this one is from it
    over all kept terms.  Part ``term``: the ``top_terms`` kept terms that stand out most
    in this source against its language.  Ranks start at 1; ties go by the item's bytes.
    Null texts, languages and sources are empty ones; empty texts have no terms, and a
    group without terms still takes part.  Where a language keeps no term all pairs are 0.
    Repeated rows count as often as they occur.  Long texts are searched slice by slice.
    Empty tables give no rows; other columns are not read.  A term's row holds one count
    per source of its language: a task must be able to hold that many.
    """
    def named(column: str) -> Column:
        return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))

    # One exchange by term serves both groupings: batches have counted already.
    terms = shared(
        docs.select(named(lang).alias("lang"), named(source).alias("source"), named(text).alias("text"))
        .mapInArrow(count_batches, "lang string, source string, term string, n long, docs long")
        .repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"), F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where((F.col("docs") >= min_docs) | F.col("term").isNull()).drop("docs"),
        "kept-terms",
    )
    kept_rows = terms.where("term is not null")
    groups = terms.where("term is null").select("lang", F.explode("cells.source").alias("source"))
    cells = kept_rows.select("lang", "term", "lang_n", F.explode("cells").alias("cell")).select("lang", "term", "lang_n", "cell.*")
    langs = kept_rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = shared(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"]),
        "source-totals",
    )

    # One small row per source of a language, looked up by the term rows' own sources.
    by_lang = stats.groupBy("lang", "kept").agg(F.map_from_entries(F.collect_list(F.struct("source", "total"))).alias("totals"))
    items = F.transform("cells", lambda c: F.struct(c["source"], c["n"], F.element_at("totals", c["source"]).alias("total")))
    rows = shared(
        kept_rows.groupBy("lang", "cells").agg(F.count("*").alias("times")).join(by_lang, "lang")
        .select("lang", items.alias("items"), "times", "kept"),
        "term-rows",
    )
    start = F.slice(F.transform("items", lambda i: F.struct(i["source"], i["n"])), 1, 4)
    met = (
        rows.where(F.size("items") > 1).repartitionByRange("lang", start, F.xxhash64("items"))
        .sortWithinPartitions("lang", "items")
        .mapInArrow(tree_batches, "lang string, source string, item string, value string")
        .select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    )

    # What a source's own counts add against another's zeros, once per distinct count.
    nodes = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    zero = chance_of(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    bases = stats.where("kept > 0").withColumn("zero", zero)
    others = bases.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    own = nodes.join(bases, ["lang", "source"]).withColumn("p", chance_of(F.col("n"), F.col("total"), F.col("kept")))
    against = own.join(others, "lang").where("source <> item")
    times = F.col("times").cast("decimal(20,0)")
    as_p = against.select(
        "lang", "source", "item",
        (times * (distance_of(F.col("p"), F.col("other")) - distance_of(F.col("zero"), F.col("other")))).cast("decimal(38,0)").alias("value"),
    )
    as_q = against.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"),
        (times * (distance_of(F.col("other"), F.col("p")) - distance_of(F.col("other"), F.col("zero")))).cast("decimal(38,0)").alias("value"),
    )
    all_zero = bases.join(others, "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("kept").cast("decimal(20,0)") * distance_of(F.col("zero"), F.col("other"))).cast("decimal(38,0)").alias("value")
    )
    bare = stats.where("kept = 0")
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select(
        "lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value")
    )
    pairs = (
        all_zero.unionByName(as_p).unionByName(as_q).unionByName(met).unionByName(none)
        .groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
        .withColumn("part", F.lit("pair"))
    )

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = (chance_of(F.col(n), F.col(t), F.col("kept")) for n, t in (("n", "total"), ("lang_n", "lang_total")))
    stand_out = (
        cells.join(stats, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .where("p > q").select("lang", "source", "item", distance_of(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
        .withColumn("part", F.lit("term"))
    )
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(stand_out.select(columns))
