import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row

from attestry.llm import prefix_trie
from attestry.llm.prefix_trie import Full, Indexed, RadixTree, Sparse

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows):
    """Brute force over ``(conv_id, turn, role, text)``: every prefix of every conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs_of in members.items():
        words = len(WORD.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs_of) - 1) * words
    return sorted(
        (
            min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
        )
        for path, m in members.items()
    )


def table_of(spark, rows, partitions=4):
    full = [Row(conv_id=c, turn=t, role=r, text=x, id=b"i", base=3, key="k") for c, t, r, x in rows]
    schema = "conv_id long, turn long, role string, text string, id binary, base int, key string"
    return spark.createDataFrame(full, schema).repartition(partitions)


def ours(df):
    return sorted(tuple(r) for r in df.collect())


ODD = [
    (0, 1, "user", "hello there"), (0, 2, "bot", "hi"), (0, None, "system", "be kind"), (0, 3, "user", "bye now"),
    (1, 1, "user", "one two"), (1, 2, "bot", "three"), (1, 3, "user", "four"), (1, 4, "bot", "five six"), (1, 5, None, None),
    (2, 1, "user", "hello there"), (3, 1, "user", "hello there"), (4, 1, "user", None), (5, 1, "", ""),
    (6, 2, "b", "tie"), (6, 2, "a", "tie"), (6, 2, "a", "eit"), (6, 2, "a", "tie"), (6, 3, "a", "end"), (6, 4, "a", "end"),
    (25, 1, "user", "no base"), (26, 1, "user", "x"), (27, 1, "user", "x"), (27, 2, "user", "y"), (28, 1, "u", "z"),
    (29, 1, "u", "z"), (29, 2, "u", "z"), (29, 3, "u", "z"), (29, 4, "u", "z"), (29, 5, "u", "z"),
    (-1, 1, "u", "minus"), (-7, 1, "u", "minus"), (-20, 1, "u", "base"), (-21, 1, "u", "q"), (-21, 2, "u", "r"), (-39, 1, "u", "s"),
    (None, 1, "user", "nobody's"), (40, 1, "u", "w " * 50_000), (41, 1, "u", "w " * 50_000), (41, 9, "u", "tail"),
    (60, 1, "uv", "w"), (80, 1, "u", "vw"),
]


def test_odd_rows(spark):
    result = prefix_trie.prefix_trie(table_of(spark, ODD))
    assert ours(result) == plain(ODD)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(table_of(spark, ODD).where("false")).collect() == []
    assert prefix_trie.prefix_trie(table_of(spark, [(None, 1, "u", "x")])).collect() == []


def many(seed, convs=600, long=False):
    dice = random.Random(seed)
    rows = []
    for c in range(convs):
        turns = dice.choice([1, 2, 3, 4, 6]) if not long else dice.choice([2, 40])
        for t in range(turns):
            text = "same start" if c % 3 else f"start {dice.randrange(3)}"
            rows.append((c, t, "user" if t % 2 else "bot", f"{text} {t} {dice.randrange(2) if t > turns - 3 else 0}"))
    return rows


@pytest.mark.parametrize("chunk, partitions", [(1, 3), (3, 5), (1 << 15, 1)])
def test_nodes_of_several_chunks_are_merged(spark, monkeypatch, chunk, partitions):
    """Any cut into chunks gives the same trie; a third of all conversations is one text."""
    real = prefix_trie.tree_batches

    def small(batches):
        prefix_trie.CHUNK_KEYS = chunk
        yield from real(batches)

    monkeypatch.setattr(prefix_trie, "tree_batches", small)
    rows = many(chunk) + [(c, t, "u", f"copy {t}") for c in range(1000, 1200) for t in range(4)]
    assert ours(prefix_trie.prefix_trie(table_of(spark, rows, partitions))) == plain(rows)


def test_long_shared_beginnings(spark):
    rows = many(5, convs=60, long=True)
    assert ours(prefix_trie.prefix_trie(table_of(spark, rows))) == plain(rows)


def test_layouts_grow_and_keep_byte_order():
    layout, sizes = Sparse(4), []
    for i, byte in enumerate(random.Random(2).sample(range(256), 256)):
        layout = layout.put(byte, byte)
        sizes.append((type(layout), layout.room))
        assert [b for b, _ in layout] == sorted(b for b, _ in layout) and len(list(layout)) == i + 1
    assert [sizes[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [
        (Sparse, 4), (Sparse, 16), (Sparse, 16), (Indexed, 48), (Indexed, 48), (Full, 256), (Full, 256)
    ]
    assert layout.get(77) == 77


def test_tree_compresses_paths_and_yields_aligned_nodes_in_order():
    dice = random.Random(3)
    ids = [dice.randbytes(4) for _ in range(40)]
    keys = {b"".join(dice.choice(ids[: 3 + 5 * d]) for d in range(dice.randrange(7))) for _ in range(900)}
    tree = RadixTree()
    for key in dice.sample(sorted(keys), len(keys)):
        tree.insert(key, key)
    paths, valued = [], set()
    for number, parent, step, value in tree.aligned(4):
        assert number == len(paths) and (parent >= 0 or number == 0)
        paths.append(paths[parent] + step if parent >= 0 else b"")
        if value is not None:
            assert value == paths[-1]
            valued.add(value)
    assert paths == sorted({key[:4 * d] for key in keys for d in range(len(key) // 4 + 1)}) and valued == keys
    lone = RadixTree()
    lone.insert(b"x" * 40, 1)
    assert lone.root.path == b"x" * 40 and lone.root.layout is None and len(list(lone.aligned(4))) == 11
