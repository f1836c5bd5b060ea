"""The trie of conversation beginnings, built in adaptive radix trees.

1. A turn's id is the SHA-256 of its role and text, a 256-bit big-endian number; texts
   never travel.  Families of twenty conversations, which share a head, are dealt out in
   ranges and rebuilt turn by turn.  Equal conversations of a batch become one sequence.
2. Sequences, as bytes of their turn ids, are dealt out in sorted ranges.  Each task
   hashes the ids that end a sequence as they stream by, and inserts sequences into an
   adaptive radix tree, a bounded chunk at a time.  A byte depth that is a multiple of an
   id's width is a node of the trie.
3. Only the paths to a chunk's first and last sequence can go on in another chunk.  They
   are merged by the hash of their path; all other nodes are final in their task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import shared, text_of, word_count

WIDTH = 32
FAMILY, HEADS = 20, 4  # fixed values of the contract: conversations sharing a head, and its longest length + 1
HELD_CONVS, HELD_BYTES = 1 << 13, 1 << 24  # what a task holds of rebuilt conversations
CHUNK_KEYS, CHUNK_BYTES = 1 << 15, 1 << 23  # what one radix tree holds
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Sparse:
    """Up to 4 or 16 children as two sorted rows of bytes and nodes."""

    __slots__ = ("room", "bytes", "kids")

    def __init__(self, room: int, pairs: Iterable[tuple[int, "Node"]] = ()):
        self.room, self.bytes, self.kids = room, bytearray(), []
        for byte, kid in pairs:
            self.bytes.append(byte)
            self.kids.append(kid)

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid: "Node"):
        """The layout that holds the child too: this one, or the next larger one."""
        if len(self.kids) == self.room:
            larger = Sparse(16, self) if self.room == 4 else Indexed(self)
            return larger.put(byte, kid)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def swap(self, byte: int, kid: "Node") -> None:
        self.kids[self.bytes.index(byte)] = kid

    def __iter__(self):
        return iter(zip(self.bytes, self.kids))


class Indexed:
    """Up to 48 children; 256 bytes say where each one is."""

    __slots__ = ("index", "kids")
    room = 48

    def __init__(self, pairs: Iterable[tuple[int, "Node"]]):
        self.index, self.kids = bytearray(256), []
        for byte, kid in pairs:
            self.kids.append(kid)
            self.index[byte] = len(self.kids)

    def get(self, byte: int):
        return self.kids[self.index[byte] - 1] if self.index[byte] else None

    def put(self, byte: int, kid: "Node"):
        if len(self.kids) == self.room:
            return Full(self).put(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def swap(self, byte: int, kid: "Node") -> None:
        self.kids[self.index[byte] - 1] = kid

    def __iter__(self):
        return ((byte, self.kids[at - 1]) for byte, at in enumerate(self.index) if at)


class Full:
    """A slot for each of 256 bytes."""

    __slots__ = ("kids",)
    room = 256

    def __init__(self, pairs: Iterable[tuple[int, "Node"]]):
        self.kids = [None] * 256
        for byte, kid in pairs:
            self.kids[byte] = kid

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid: "Node"):
        self.kids[byte] = kid
        return self

    swap = put

    def __iter__(self):
        return ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)


class Node:
    """The bytes that all keys below share after the branching byte, and where they part."""

    __slots__ = ("path", "value", "layout")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.layout = path, value, None

    def add(self, byte: int, kid: "Node") -> None:
        self.layout = (self.layout or Sparse(4)).put(byte, kid)


def agreeing(one: bytes, other: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(one), len(other))
    while low < high:
        middle = (low + high + 1) // 2
        if one[low:middle] == other[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    def __init__(self):
        self.root = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, above, branch, at = self.root, None, 0, 0
        while True:
            path = node.path
            same = len(path) if key.startswith(path, at) else agreeing(path, key[at:at + len(path)])
            if same < len(path):
                fork = Node(path[:same])
                fork.add(path[same], node)
                node.path = path[same + 1:]
                if above is None:
                    self.root = fork
                else:
                    above.layout.swap(branch, fork)
                node = fork
            at += same
            if at == len(key):
                node.value = value
                return
            kid = node.layout.get(key[at]) if node.layout else None
            if kid is None:
                node.add(key[at], Node(key[at + 1:], value))
                return
            above, branch, node, at = node, key[at], kid, at + 1

    def aligned(self, width: int) -> Iterator[tuple[int, int, bytes, object]]:
        """Nodes at depths that are multiples of ``width``, parents first and in key order.

        Each comes as its number, its parent's number, its last ``width`` bytes and the
        value of the key that ends there.  The root, at depth 0, has no parent (-1).
        """
        if self.root is None:
            return
        number = 0
        open_nodes = [(self.root, b"", -1)]
        while open_nodes:
            node, behind, parent = open_nodes.pop()
            found = behind + node.path
            steps = [found[i:i + width] for i in range(0, len(found) - width + 1, width)]
            behind = found[len(steps) * width:]
            if parent < 0:
                steps.insert(0, b"")
            for step in steps:
                here = node.value if step is steps[-1] and not behind else None
                yield number, parent, step, here
                parent, number = number, number + 1
            if node.layout:
                open_nodes += [(kid, behind + bytes([byte]), parent) for byte, kid in reversed(list(node.layout))]


def rebuilt_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in family order to sequences: key, words, n, low (smallest member) and ids.

    ``ids`` lists the members of a batch; batches hold whole families, in order of ids.
    """
    schema = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int64())), ("n", pa.int64()), ("low", pa.int64()), ("ids", pa.string())])
    held: dict[bytes, tuple[list[int], list[int]]] = {}
    convs = size = 0
    family = conv = None
    head: list[tuple[bytes, int]] = []
    turns: list[tuple[bytes, int]] = []

    def close_conversation() -> None:
        nonlocal head, convs, size
        if conv is None:
            return
        if conv == family:
            head = turns[:HEADS - 1]
        h = zlib.crc32(str(conv).encode()) % HEADS
        rebuilt = head[:h] + turns[h:]
        key = b"".join(turn for turn, _ in rebuilt)
        if key not in held:
            held[key] = ([words for _, words in rebuilt], [])
            size += 2 * len(key)
        held[key][1].append(conv)
        convs += 1

    def passed_on() -> pa.RecordBatch:
        rows = []
        for key, (words, members) in held.items():
            members.sort()
            rows.append({"key": key, "words": words, "n": len(members), "low": members[0], "ids": ",".join(map(str, members))})
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for base, c, turn, words in zip(*(batch.column(name).to_pylist() for name in ("base", "conv_id", "id", "words"))):
            if c != conv:
                close_conversation()
                conv, turns = c, []
                if base != family:
                    family, head = base, []
                    if convs >= HELD_CONVS or size >= HELD_BYTES:
                        yield passed_on()
                        convs = size = 0
            turns.append((turn, words))
    close_conversation()
    if held:
        yield passed_on()


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
STEP = (
    "struct<key: binary, parent: binary, own: boolean, words: long, n: long, low: long, ends: string, inner_children: long, "
    "inner_leaves: long, inner_saved: long, leaves: long, saved: long>"
)
TREE = f"{NODE}, parent_key binary, chunk string, side int, path array<{STEP}>"


def tree_rows(tree: RadixTree, words_of: dict[bytes, int], chunk: str) -> tuple[list[dict], list[dict]]:
    """Final nodes of a chunk, and its first and last path whose nodes may be partial."""
    parent, words, depth, n, low, ends, last = [], [], [], [], [], [], []
    for _, above, step, value in tree.aligned(WIDTH):
        parent.append(above)
        depth.append(depth[above] + 1 if above >= 0 else 0)
        words.append(words_of.get(step, 0))
        n.append(value[0] if value else 0)
        low.append(value[1] if value else None)
        ends.append(value[2] if value else None)
        last.append(step)
    valued = [i for i, e in enumerate(ends) if e is not None]
    size = len(parent)
    edge_paths = []
    for end in (valued[0], valued[-1]):
        path = [end]
        while parent[path[-1]] >= 0:
            path.append(parent[path[-1]])
        edge_paths.append(path[::-1])
    on_edge = set(edge_paths[0]) | set(edge_paths[1])
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    inner = {i: [0, 0, 0] for i in on_edge}
    for i in range(size - 1, -1, -1):  # children come after their parents
        leaves[i] += not children[i]
        saved[i] += (n[i] - 1) * words[i]
        above = parent[i]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
            n[above] += n[i]
            low[above] = low[i] if low[above] is None else min(low[above], low[i])
            if above in inner and i not in inner:
                cell = inner[above]
                cell[0] += 1
                cell[1] += leaves[i]
                cell[2] += saved[i]
    keys: dict[int, bytes] = {}
    for path in edge_paths:
        for i in path:
            if i not in keys:
                keys[i] = hashlib.sha256(keys[parent[i]] + last[i]).digest() if parent[i] >= 0 else b""
    final = [
        {
            "conv_id": low[i], "depth": depth[i], "n_convs": n[i], "n_children": children[i], "n_leaves": leaves[i],
            "saved_tokens": saved[i], "ends_sha256": ends[i] or NO_ENDS, "parent_key": keys.get(parent[i]),
            "parent_conv_id": None if parent[i] in keys else low[parent[i]],
        }
        for i in range(size) if i not in keys
    ]
    first = set(edge_paths[0])
    edges = [
        {
            "chunk": chunk, "side": side,
            "path": [
                {
                    "key": keys[i], "parent": keys.get(parent[i]), "own": side == 0 or i not in first, "words": words[i], "n": n[i], "low": low[i],
                    "ends": ends[i], "inner_children": inner[i][0], "inner_leaves": inner[i][1],
                    "inner_saved": inner[i][2], "leaves": leaves[i], "saved": saved[i],
                }
                for i in path
            ],
        }
        for side, path in enumerate(edge_paths)
    ]
    return final, edges


def tree_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences sorted by key and smallest member to nodes and edge paths."""
    step = pa.struct([
        ("key", pa.binary()), ("parent", pa.binary()), ("own", pa.bool_()), ("words", pa.int64()), ("n", pa.int64()), ("low", pa.int64()),
        ("ends", pa.string()), ("inner_children", pa.int64()), ("inner_leaves", pa.int64()),
        ("inner_saved", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
    ])
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    schema = pa.schema(
        [(name, pa.int64()) for name in numbers]
        + [("ends_sha256", pa.string()), ("parent_key", pa.binary()), ("chunk", pa.string()), ("side", pa.int32()), ("path", pa.list_(step))]
    )
    part, chunks = TaskContext.get().partitionId(), 0
    tree, words_of, keys, size = RadixTree(), {}, 0, 0
    current = None  # the open sequence: key, words, n, low, digest

    def insert() -> None:
        nonlocal keys, size
        key, words, n, low, digest = current
        for i, count in enumerate(words):
            words_of[key[i * WIDTH:(i + 1) * WIDTH]] = count
        tree.insert(key, (n, low, digest.hexdigest()))
        keys, size = keys + 1, size + len(key)

    def passed_on() -> Iterator[pa.RecordBatch]:
        nonlocal tree, words_of, keys, size, chunks
        final, edges = tree_rows(tree, words_of, f"{part}-{chunks}")
        tree, words_of, keys, size, chunks = RadixTree(), {}, 0, 0, chunks + 1
        for start in range(0, len(final), 1 << 14):
            yield pa.RecordBatch.from_pylist(final[start:start + (1 << 14)], schema=schema)
        yield pa.RecordBatch.from_pylist(edges, schema=schema)

    for batch in batches:
        for key, words, n, low, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "n", "low", "ids"))):
            if current and current[0] == key:
                current[2] += n
                current[4].update(b"," + ids.encode())
                continue
            if current:
                insert()
                if keys >= CHUNK_KEYS or size >= CHUNK_BYTES:
                    yield from passed_on()
            current = [key, words, n, low, hashlib.sha256(ids.encode())]
    if current:
        insert()
        yield from passed_on()


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Turns come in order of ``turn``, null first;
    turns with one number come by role, then by the SHA-256 of role and text, so repeated
    rows are repeated turns in any order.  Null roles and texts are empty.  Rows without a
    conversation id belong to no conversation and are left out.  Conversations whose
    rebuilding leaves no turn end at the root.  Empty tables give no rows, not even a
    root.  Other columns are not read.  Texts of any length become ids where they are
    read; one task holds one conversation's ids, 32 bytes a turn.  Sequences that go on
    in another range merge along the turns that both have.
    """
    family = F.col("conv_id") - F.call_function("mod", F.col("conv_id"), F.lit(FAMILY))
    said, spoken = text_of(f"`{text}`"), text_of(f"`{role}`")
    turns = shared(
        conversations.where(F.col(f"`{conv_id}`").isNotNull())
        .select(
            F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), spoken.alias("role"),
            F.unhex(F.sha2(F.concat(F.length(spoken).cast("string"), F.lit(":"), spoken, said), 256)).alias("id"),
            word_count(said).alias("words"),
        )
        .withColumn("base", family),
        "trie-turns",
    )
    sequences = shared(
        turns.repartitionByRange("base")
        .sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "id")
        .select("base", "conv_id", "id", "words")
        .mapInArrow(rebuilt_batches, "key binary, words array<long>, n long, low long, ids string"),
        "trie-sequences",
    )
    built = shared(
        sequences.repartitionByRange("key").sortWithinPartitions("key", "low").mapInArrow(tree_batches, TREE), "trie-nodes"
    )
    inside, edges = built.where("chunk is null"), built.where("chunk is not null")

    # Nodes on the edge of a chunk: one that only one chunk has is final but for its parent.
    steps = edges.select("chunk", "side", F.posexplode(F.col("path")).alias("depth", "step")).select("chunk", "side", "depth", "step.*")
    merged = shared(
        steps.where("own").groupBy("key").agg(
            F.count("*").alias("chunks"), F.first("depth").cast("long").alias("depth"), F.max("parent").alias("parent"),
            F.max("words").alias("words"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("ends").alias("ends"),
            *[F.sum(c).alias(c) for c in ("inner_children", "inner_leaves", "inner_saved", "leaves", "saved")],
        ),
        "trie-edges",
    )
    alone = F.col("chunks") == 1
    below = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("edge_children"), F.sum(F.when(alone, F.col("leaves"))).alias("edge_leaves"),
        F.sum(F.when(alone, F.col("saved"))).alias("edge_saved"),
    )
    whole = merged.join(below, "key", "left").na.fill(0, ["edge_children", "edge_leaves", "edge_saved"]).withColumn(
        "n_children", F.col("inner_children") + F.col("edge_children")
    )
    # Nodes of several chunks: all nodes above them are such too.
    several = merged.where("chunks > 1").select("key")
    reach = steps.join(several, "key").groupBy("chunk", "side").agg(F.max("depth").alias("reach"))
    pairs = (
        edges.join(reach, ["chunk", "side"])
        .select(F.posexplode(F.slice("path.key", 1, F.col("reach") + 1)).alias("at", "key"), F.col("path.key").alias("keys"))
        .select("key", F.explode(F.slice("keys", 1, F.col("at") + 1)).alias("above")).distinct()
    )
    sums = (
        whole.where("chunks > 1").select(
            "key", ((F.col("n_children") == 0).cast("long") + F.col("inner_leaves") + F.col("edge_leaves")).alias("own_leaves"),
            ((F.col("n") - 1) * F.col("words") + F.col("inner_saved") + F.col("edge_saved")).alias("own_saved"),
        )
        .join(pairs, "key").groupBy(F.col("above").alias("key"))
        .agg(F.sum("own_leaves").alias("all_leaves"), F.sum("own_saved").alias("all_saved"))
    )
    parents = merged.select(F.col("key").alias("parent"), F.col("low").alias("parent_conv_id"))
    edge_nodes = whole.join(sums, "key", "left").join(parents, "parent", "left").select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.coalesce("all_leaves", "leaves").alias("n_leaves"), F.coalesce("all_saved", "saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    columns = edge_nodes.columns
    hanging = inside.where("parent_key is not null").drop("parent_conv_id").join(
        parents.withColumnRenamed("parent", "parent_key"), "parent_key"
    )
    return inside.where("parent_key is null").select(columns).unionByName(hanging.select(columns)).unionByName(edge_nodes)
