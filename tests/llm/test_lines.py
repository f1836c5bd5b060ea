import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from attestry.llm import lines
from attestry.llm.common import BLANK_BYTES


def plain(rows, min_chars=10):
    """Brute force over ``(doc_id, text)``: counts and the text that stays."""
    def key(line):
        return line.encode().strip(BLANK_BYTES).decode().translate({c: c + 32 for c in range(65, 91)})

    order = lambda d: (d is None, d or 0)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(order(doc))
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [
            p for p in parts
            if len(key(p)) < min_chars or len(holders[key(p)]) < 2 or order(doc) == min(holders[key(p)])
        ]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def ours(df):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


COMMON = "All rights reserved here"
ODD = [
    (4, f"  {COMMON}\t\nbody of four\n{COMMON.upper()}"),
    (2, f"{COMMON}\nshort\nbody of two is long"),
    (3, "short\nshort\nÀÉÎÕÜàéîõü\nbody of two is long"),
    (7, "ÀÉÎÕÜàéîõü\n\n ÀÉÎÕÜàéîõü"),
    (1, None), (5, ""), (6, "\n\n"), (None, f"{COMMON}\nonly without an id"), (None, "only without an id\nshort line"),
    (8, "twice in one row\ntwice in one row"), (9, "nine chars\n" * 3), (10, "NINE CHARS "), (9, "row with a repeated id\nnine chars"),
    (11, "x" * 200_000 + "\n" + "y" * 12), (12, "y" * 12 + "\r"), (-3, COMMON),
]


def test_odd_rows(table):
    result = lines.drop_repeated_lines(table(*ODD))
    assert ours(result) == plain(ODD)
    assert "rid" in result.schema["row"].dataType.names


def test_empty_table(table):
    assert lines.drop_repeated_lines(table()).collect() == []


@pytest.mark.parametrize("page_lines, max_pages", [(1, 1), (2, 4), (4096, 1 << 16)])
def test_filters_of_any_size_give_the_same_rows(spark, page_lines, max_pages):
    rows = [(i, "\n".join([COMMON] * (i % 3 != 0) + [f"line number {i * j % 97} of all" for j in range(i % 7)])) for i in range(400)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows]).repartition(5)
    assert ours(lines.drop_repeated_lines(docs, page_lines=page_lines, max_pages=max_pages)) == plain(rows)


def test_no_repeat_is_missed_and_few_others_pass():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)
    twice = hashes[:2_000]
    stream = rng.permutation(np.concatenate([hashes, twice]))
    shift = 16 - 4
    page = (stream >> np.uint64(60)).astype(np.int32)
    order = np.argsort(page, kind="stable")
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(page[part]), pa.array(stream[part].view(np.int64)), pa.array(np.zeros(len(part), bool))],
            ["page", "hash", "again"],
        )
        for part in np.array_split(order, 9)
    ]
    pages = {}
    for out in lines.page_batches(batches):
        pages[out.column("page")[0].as_py()] = out.column("bits")[0].as_py()
    held = lines.Again(pages, shift)
    assert held.holds(twice.view(np.int64)).all()
    assert held.holds(hashes[2_000:].view(np.int64)).mean() < 0.02


def test_only_suspects_are_shuffled(spark):
    rows = [(i, f"a line of document {i}\nthe line of all") for i in range(300)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows]).repartition(3)
    result = lines.drop_repeated_lines(docs)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert sum(r.n_dropped for r in result.collect()) == 299


def test_kept_text_digest_matches(table):
    row = lines.drop_repeated_lines(table((1, "one line of text"), (2, "ONE line of text\nrest"))).orderBy("row.doc_id").collect()[1]
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == hashlib.sha256(b"rest").hexdigest()
