"""Conversation prefix trie: adaptive radix trees over fixed-width turn ids.

A turn is 16 bytes, the big-endian head of a SHA-256 of its role and text; a conversation is the string of its turns'.
Conversations are sorted by that string and their id and cut by range, so a first turn, or a whole conversation, that a
third of all rows share is cut like everything else. A task takes its sorted conversations in runs of a bounded number of
turns and builds one adaptive radix tree for each run: nodes grow from 4 to 16, 48 and 256 children, single paths are
compressed, and only byte depths at the end of a turn emit nodes. All nodes of a run are whole but those on the paths of
its first and its last conversation, which neighbours may share; these two paths, with what hangs off them summed up, are
all that is passed on. Neighbouring runs are merged sixteen at a time by the same tree until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import BROADCAST_ROWS, forget, give_back, integral_id, materialise, text_batches

WIDTH = 16
#: Turns that one tree holds; a longer conversation is a run of its own.
RUN_TURNS = 50_000
FAN_IN = 16
NOBODY = (1 << 63) - 1
SALTS = 32
NODE, CHUNK, SPINE = 0, 1, 2
ROW = (
    "kind int, part bigint, side int, digest binary, parent binary, depth int, conv bigint, parent_conv bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved bigint, ends string, key binary, sizes array<int>, own array<bigint>"
)
ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int64()), ("side", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32())]
    + [(n, pa.int64()) for n in ("conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved")]
    + [("ends", pa.string()), ("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("own", pa.list_(pa.int64()))]
)


class Kids:
    """The children of a radix node by their first byte; the layout grows with their number: 4, 16, 48, 256."""

    __slots__ = ("index", "nodes", "room")

    def __init__(self) -> None:
        self.room, self.index, self.nodes = 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.index.find(byte)
            return self.nodes[at] if at >= 0 else None
        if self.room == 48:
            at = self.index[byte]
            return self.nodes[at - 1] if at else None
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or replace the one of this byte."""
        if self.find(byte) is None and self.room < 256 and len(self.nodes) == self.room:
            self._grow()
        if self.room <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.nodes[at] = node
            else:
                self.index.append(byte)
                self.nodes.append(node)
        elif self.room == 48:
            if self.index[byte]:
                self.nodes[self.index[byte] - 1] = node
            else:
                self.nodes.append(node)
                self.index[byte] = len(self.nodes)
        else:
            self.nodes[byte] = node

    def _grow(self) -> None:
        pairs = list(self.items())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        self.index = bytearray(256 if self.room == 48 else 0)
        self.nodes = [None] * 256 if self.room == 256 else []
        for byte, node in pairs:
            self.put(byte, node)

    def items(self) -> Iterator[tuple[int, Node]]:
        if self.room <= 16:
            yield from zip(self.index, self.nodes, strict=True)
        else:
            for byte in range(256):
                if (node := self.find(byte)) is not None:
                    yield byte, node


class Node:
    """A compressed path, what ends at its end, and children. ``of``: a (key, sizes) that runs through it."""

    __slots__ = ("path", "kids", "own", "ends", "of", "sum")

    def __init__(self, path: bytes, of: tuple) -> None:
        self.path, self.of = path, of
        self.kids, self.own, self.ends, self.sum = None, [], [], None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"", (b"", ()))

    def insert(self, key: bytes, sizes, stops: list[tuple[int, tuple]], conv: int | None = None) -> None:
        """Give each (turns, sums) of ``stops`` to the node that many turns along ``key``; ``conv`` ends at the last one."""
        node, at = self.root, 0
        for turns, own in stops:
            stop = turns * WIDTH
            while at < stop:
                kid = node.kids.find(key[at]) if node.kids else None
                if kid is None:
                    kid = Node(key[at:stop], (key, sizes))
                    node.kids = node.kids or Kids()
                    node.kids.put(key[at], kid)
                    node, at = kid, stop
                    continue
                m = _common(kid.path, key[at:stop] if stop - at < len(kid.path) else key[at : at + len(kid.path)])
                if m < len(kid.path):
                    mid = Node(kid.path[:m], kid.of)
                    kid.path, mid.kids = kid.path[m:], Kids()
                    mid.kids.put(kid.path[0], kid)
                    node.kids.put(key[at], mid)
                    kid = mid
                node, at = kid, at + m
            node.own.append(own)
        if conv is not None:
            node.ends.append(conv)


def _add(into: list, own: tuple) -> None:
    n, low, heads, leaves, saved = own
    into[0] += n
    into[1] = min(into[1], low)
    into[2] += heads
    into[3] += leaves
    into[4] += saved


def fold(items: list[tuple], last: bool, first_level: bool) -> tuple[list, list, list]:
    """Nodes, chunks of ends and the two open paths of sorted (key, sizes, stops, conv) items.

    With ``last`` nothing lies beyond these items and every node is whole. A node is (digest, parent's digest, depth,
    smallest member, parent's smallest member or None, members, children, leaves, saved, hash of its ends or None).
    """
    tree = RadixTree()
    for key, sizes, stops, conv in items:
        tree.insert(key, sizes, stops, conv)
    edges = () if last else (items[0], items[-1])
    order, stack = [], [(tree.root, 0, hashlib.blake2b(digest_size=16), [True] * len(edges))]
    while stack:
        node, start, state, on = stack.pop()
        key, end = node.of[0], start + len(node.path)
        digests = [state.digest()]
        for q in range(start // WIDTH + 1, end // WIDTH + 1):
            state.update(key[(q - 1) * WIDTH : q * WIDTH])
            digests.append(state.digest())
        until = [start + _common(node.path, e[0][start:end]) if o else start - 1 for e, o in zip(edges, on, strict=True)]
        order.append((node, start, end, digests, until))
        if node.kids:
            stack.extend((kid, end, state.copy(), [u == end for u in until]) for _, kid in node.kids.items())
        node.sum = [0, NOBODY, 0, 0, 0]
    nodes, chunks, spines, lows = [], [], [{}, {}], {}
    parents = {id(kid): node for node, *_ in order if node.kids for _, kid in node.kids.items()}
    for node, start, end, digests, until in reversed(order):
        total = node.sum
        for own in node.own:
            _add(total, own)
        bottom = 0 if node is tree.root else start // WIDTH + 1
        for q in range(end // WIDTH, bottom - 1, -1):
            digest = digests[q - start // WIDTH]
            ends = node.ends if q * WIDTH == end else []
            side = next((i for i, u in enumerate(until) if u >= q * WIDTH), None)
            if side is not None:
                _add(spines[side].setdefault(q, [0, NOBODY, 0, 0, 0]), total)
                total = [0, NOBODY, 0, 0, 0]
                if ends:
                    chunks.append((digest, ",".join(map(str, ends))))
                continue
            n, low, heads, leaves, saved = total
            leaves = leaves if heads else 1
            saved += (n - 1) * (node.of[1][q - 1] if q else 0)
            mark = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if first_level else None
            lows[digest] = low
            nodes.append([digest, digests[q - 1 - start // WIDTH] if q else None, q, low, None, n, heads, leaves, saved, mark])
            total = [n, low, 1, leaves, saved]
        if node is not tree.root:
            _add(parents[id(node)].sum, total)
    for row in nodes:
        row[4] = lows.get(row[1])
    paths = [(*e[:2], sorted((q, tuple(s)) for q, s in spines[i].items()), None) for i, e in enumerate(edges)]
    return nodes, chunks, paths


class _Rows:
    """Arrow rows of folds, given out in batches."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, nodes: list, chunks: list, at: int) -> None:
        names = ("digest", "parent", "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends")
        self.rows += [{"kind": NODE, **dict(zip(names, row, strict=True))} for row in nodes]
        self.rows += [{"kind": CHUNK, "part": at, "digest": digest, "ends": text} for digest, text in chunks]

    def spines(self, part: int, paths: list) -> None:
        for side, (key, sizes, stops, _) in enumerate(paths):
            own = [v for q, s in stops for v in (q, *s)]
            self.rows.append({"kind": SPINE, "part": part, "side": side, "key": key, "sizes": list(sizes), "own": own})

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _trees(batches: Iterator[pa.RecordBatch], run_turns: int) -> Iterator[pa.RecordBatch]:
    """First level: (conv, key, sizes) sorted by key and conv; closed nodes, and one pair of open paths for the partition."""
    part, out, run, turns, seq, paths = TaskContext.get().partitionId(), _Rows(), [], 0, 0, []

    def close() -> None:
        nonlocal run, turns, seq, paths
        nodes, chunks, ends = fold(run, False, True)
        out.add(nodes, chunks, (part << 32) + seq)
        paths += ends
        if len(paths) >= 2 * FAN_IN:
            nodes, _, paths = fold(paths, False, False)
            out.add(nodes, [], 0)
        run, turns, seq = [], 0, seq + 1

    for batch in batches:
        for conv, key, sizes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n = len(sizes)
            run.append((key, sizes, [(n, (1, conv, 0, 0, 0))], conv))
            turns += n + 1
            if turns >= run_turns:
                close()
                yield out.batch()
    if run:
        close()
    if len(paths) > 2:
        nodes, _, paths = fold(paths, False, False)
        out.add(nodes, [], 0)
    if paths:
        out.spines(part, paths)
        yield out.batch()
    give_back()


def _paths(frame: pd.DataFrame) -> list[tuple]:
    out = []
    for row in frame.sort_values(["part", "side"]).itertuples():
        own = [int(v) for v in row.own]
        out.append((row.key, row.sizes, [(own[i], tuple(own[i + 1 : i + 6])) for i in range(0, len(own), 6)], None))
    return out


def _joined(spines: DataFrame, last: bool) -> DataFrame:
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out = _Rows()
        nodes, _, paths = fold(_paths(frame), last, False)
        out.add(nodes, [], 0)
        out.spines(int(frame["part"].iloc[0]) // FAN_IN, paths)
        return out.batch().to_pandas()

    return spines.groupBy(F.expr(f"part div {FAN_IN}").alias("g")).applyInPandas(one, ROW)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text) sorted by digest and order to (digest, ends): the hash of the joined texts, fed as they come."""
    now, state = None, None
    for batch in batches:
        done = []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != now:
                if state:
                    done.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["digest", "found"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["digest", "found"])


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, x): the turns of each conversation in order, each its 16 bytes and its text's code points."""
    integral_id(turns, conv)
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    mark = F.unhex(F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * WIDTH))
    part = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), mark.alias("id"), F.length(said).alias("size")).alias("x")
    )
    listed = part.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("conv", F.transform("x", lambda e: F.struct(e["id"].alias("id"), e["size"].alias("size"))).alias("x"))


def grafted(seqs: DataFrame, every: int = 100, choices: int = 6) -> DataFrame:
    """Conversations with their first turns taken from another: the first h = crc32(id) % ``choices`` turns of conversation
    id - id % ``every`` (as many as it has, none where it is missing), then the own turns after the first h."""
    seqs = materialise(seqs, "sequences")
    heads = seqs.where(f"conv % {every} = 0").select(F.col("conv").alias("base"), F.slice("x", 1, choices - 1).alias("head"))
    if heads.count() <= BROADCAST_ROWS // 10:
        heads = F.broadcast(heads)
    both = seqs.withColumns({"h": F.expr(f"cast(crc32(cast(cast(conv as string) as binary)) % {choices} as int)"), "base": F.expr(f"conv - conv % {every}")}).join(heads, "base", "left")
    new = F.expr("concat(slice(coalesce(head, slice(x, 1, 0)), 1, h), slice(x, h + 1, greatest(size(x) - h, 0)))")
    return both.select("conv", new.alias("x"))


def prefix_trie(seqs: DataFrame, run_turns: int = RUN_TURNS, parts: int | None = None) -> DataFrame:
    """A row for each distinct sequence of first turns, from the root of no turns: members, children, leaves, savings.

    ``seqs`` is (conv, x) as :func:`sequences` gives it: nulls in role or text are empty there, turns with equal numbers go
    by content, repeated rows are turns of their own, rows without a conversation id are left out, further columns are not
    read. Conversations without turns are members of the root and end there. An empty table has no nodes, not even a root.
    ``parts`` fixes the number of ranges, else it is the session's. The turns of one conversation are one row of 20 bytes each, however long its texts; nothing else is held whole.
    """
    spark = seqs.sparkSession
    flat = seqs.select("conv", F.unhex(F.array_join(F.transform("x", lambda e: F.hex(e["id"])), "")).alias("key"), F.col("x.size").alias("sizes"))
    flat = materialise(flat, "keys")
    with text_batches(spark):
        cut = flat.repartitionByRange(*([parts] if parts else []), "key", "conv").sortWithinPartitions("key", "conv").select("conv", "key", "sizes")
        tables = [materialise(cut.mapInArrow(lambda batches: _trees(batches, run_turns), ROW), "trees")]
    forget(flat)
    most = tables[0].where(f"kind = {SPINE}").agg(F.max("part")).first()[0]
    while most is not None:
        last = most < FAN_IN
        tables.append(materialise(_joined(tables[-1].where(f"kind = {SPINE}"), last), "trees"))
        most = None if last else most // FAN_IN
    nodes = tables[0].where(f"kind = {NODE}")
    for more in tables[1:]:
        nodes = nodes.unionByName(more.where(f"kind = {NODE}"))
    chunks = tables[0].where(f"kind = {CHUNK}").select("digest", "ends", "part")
    hashes = chunks.repartition("digest").sortWithinPartitions("digest", "part").select("digest", "ends").mapInArrow(_hashed, "digest binary, found string")
    late = nodes.where("ends is null")  # closed by a merge: ends and names of children are settled now
    names = late.select(F.col("digest").alias("parent"), F.col("conv").alias("name"))
    few = names.count() <= BROADCAST_ROWS
    empty = hashlib.sha256(b"").hexdigest()
    settled = nodes.where("ends is not null").unionByName(
        late.drop("ends").join(F.broadcast(hashes) if few else hashes, "digest", "left").withColumn("ends", F.coalesce("found", F.lit(empty))).drop("found")
    )
    pending = settled.where("parent_conv is null and depth > 0")
    if few:
        named = pending.join(F.broadcast(names), "parent", "left")
    else:  # the root, or a first turn of a third of all conversations, has children everywhere
        spread = names.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        named = pending.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(spread, ["parent", "salt"], "left").drop("salt")
    named = named.withColumn("parent_conv", F.col("name")).drop("name")
    return settled.where("parent_conv is not null or depth = 0").unionByName(named).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
