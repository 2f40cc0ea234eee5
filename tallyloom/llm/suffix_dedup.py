"""Suffix-array dedup of byte strings of a fixed length, through a prefix-free parse of the corpus.

A rolling hash of 18 bytes sets triggers: of the 33 places at which it can lie in a 50-byte string, the one with the least
hash is that string's trigger, so equal strings have it at the same place. The strings that share a trigger form a phrase
(the bytes that they cover). Phrases are the dictionary: a phrase that occurs in many documents is there once, with its
smallest document; documents are sequences of phrases, the parse.

Only phrases around equal triggers can share strings. Where a trigger has one phrase, its strings are those of one smallest
document, and nothing is compared. Where it has several (the ends of repeated passages), a string is the end of a
dictionary part (the bytes before the trigger) and the head of a parse part (the bytes from the trigger on). Both parts are
sorted, the first backwards, with the common prefixes of neighbours; the two orders together place all strings in corpus
order, in which equal strings are neighbours, and each gets its smallest document. Compared are bytes, never hashes alone:
hashes only name phrases (64 bits beside the 64 of the trigger).

Every step is a Spark stage over packed arrays: phrases by trigger, replies by group of documents, ends of passages by
trigger. A hot passage is packed once for each group of documents that a task meets, so copies do not travel.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import forget, give_back, integral_id, materialise, mix, text_batches

GRAM = 18
#: Window starts that are parsed at a time; longer documents take several turns, whatever their length.
BLOCK = 1 << 20
#: Phrases that a task gathers before it packs them, and bytes of text in a group of documents.
PACK, GROUP_BYTES = 500_000, 8 << 20
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)


@functools.cache
def _powers(inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(BLOCK + 4096, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


class Phrases:
    """The phrases of one block: trigger place, first and last start, trigger hash and phrase hash."""

    __slots__ = ("at", "first", "last", "gram", "name")

    def __init__(self, data: np.ndarray, length: int) -> None:
        n, width = len(data), length - GRAM + 1
        with np.errstate(over="ignore"):
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[data] * _powers(False)[:n], out=run[1:])
            back = _powers(True)
            gram = mix((run[GRAM:] - run[:-GRAM]) * back[: n - GRAM + 1])
            # the least hash, and of equal ones the last place
            low = (gram & ~LOW) | (LOW - np.arange(len(gram), dtype=np.uint64))
            span, least = 1, low
            while span * 2 <= width:
                least = np.minimum(least[: len(least) - span], least[span:])
                span *= 2
            starts = n - length + 1
            least = np.minimum(least[:starts], least[width - span : width - span + starts])
            chosen = (LOW - (least & LOW)).astype(np.int64)
            cut = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
            self.first = np.concatenate([[0], cut])
            self.last = np.concatenate([cut - 1, [starts - 1]])
            self.at = chosen[self.first]
            self.gram = gram[self.at]
            self.name = mix((run[self.last + length] - run[self.first]) * back[self.first] ^ np.uint64(length))


def blocks(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, Phrases]]:
    """(offset, bytes, phrases) of a document, in blocks that overlap by ``length`` - 1 bytes; none below ``length`` bytes."""
    for start in range(0, len(data) - length + 1, BLOCK):
        part = data[start : start + BLOCK + length - 1]
        yield start, part, Phrases(part, length)


def _documents(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(document, bytes) of the columns ``doc`` and ``data``."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        docs, column = batch.column("doc").to_pylist(), batch.column("data")
        edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else []
        whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        for i, doc in enumerate(docs):
            yield doc, whole[edge[i] : edge[i + 1]]


def _lists(table: pa.Table, name: str, kind: type, width: int = 0) -> np.ndarray:
    out = np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    return out.reshape(-1, width) if width else out


def _packed(keys: np.ndarray, names: list[str], columns: list[np.ndarray], key: str) -> pa.RecordBatch:
    """A row for each key, with the bytes of its part of every column."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(keys))[: len(cut)]
    parts = [pa.array([c[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(keys[cut].astype(np.int64)), *parts], [key, *names])


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _parsed(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases of the documents, once for each group of documents, packed by trigger."""
    held: list[tuple] = []
    size = 0

    def pack() -> pa.RecordBatch:
        gram, name = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        doc, group = (np.repeat(np.array([h[i] for h in held], np.int64), [len(h[0]) for h in held]) for i in (2, 3))
        order = np.lexsort((name, group))
        gram, name, doc, group = gram[order], name[order], doc[order], group[order]
        first = np.flatnonzero(_starts(group, name))
        least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        held.clear()
        gram = gram[first]
        # half of the trigger's hash goes along, its bucket says more: two triggers taken for one are only compared in vain
        columns = [(gram >> np.uint64(32)).astype(np.uint32), name[first], least, group[first].astype(np.int32), (least != most).astype(np.uint8)]
        return _packed((gram % np.uint64(buckets)).astype(np.int64), ["gram", "name", "doc", "grp", "many"], columns, "bucket")

    for batch in batches:
        for group, (doc, data) in zip(batch.column("grp").to_pylist(), _documents(batch), strict=True):
            for _, _, p in blocks(data, length):
                held.append((p.gram, p.name, doc, group))
                size += len(p.gram)
                if size >= PACK:
                    yield pack()
                    size = 0
    if held:
        yield pack()
    give_back()


def _dictionary(table: pa.Table) -> pa.Table:
    """Of one bucket of triggers: for each group of documents its phrases whose trigger lies in several documents, with their
    smallest document, and whether that document must send the phrase for comparison."""
    gram, name, doc, group, many = (_lists(table, n, k) for n, k in (("gram", np.uint32), ("name", np.uint64), ("doc", np.int64), ("grp", np.int32), ("many", np.uint8)))
    order = np.lexsort((doc, name, gram))
    gram, name, doc, group, many = gram[order], name[order], doc[order], group[order], many[order]
    new_gram, new_name = _starts(gram), _starts(gram, name)
    g, e = np.flatnonzero(new_gram), np.flatnonzero(new_name)
    of_gram, of_name = np.cumsum(new_gram) - 1, np.cumsum(new_name) - 1
    shared = (np.minimum.reduceat(doc, g) != np.maximum.reduceat(doc, g)) | (np.maximum.reduceat(many, g) > 0)
    several = np.add.reduceat(new_name, g) > 1
    least = doc[e][of_name]
    send = several[of_gram] & (doc == least)
    use = shared[of_gram]
    group, name, least, send = group[use], name[use], least[use], send[use].astype(np.uint8)
    return pa.Table.from_batches([_packed(group.astype(np.int64), ["name", "doc", "send"], [name, least, send], "grp")])


def _looked_up(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted name among the sorted ``names``, and whether it is there."""
    at = np.minimum(np.searchsorted(names, wanted), max(len(names) - 1, 0))
    return at, (names[at] == wanted) if len(names) else np.zeros(len(wanted), bool)


def _ends(docs: pa.Table, replies: pa.Table, length: int, buckets: int) -> pa.Table:
    """The bytes of the phrases to be compared, before and from the trigger, packed by trigger."""
    name, least, send = (_lists(replies, n, k) for n, k in (("name", np.uint64), ("doc", np.int64), ("send", np.uint8)))
    name, least = name[send > 0], least[send > 0]
    order = np.argsort(name, kind="stable")
    name, least = name[order], least[order]
    group = docs.column("grp")[0].as_py() if docs.num_rows else 0
    left, found = length - GRAM, []
    for doc, data in _documents(docs) if len(name) else ():
        for _, part, p in blocks(data, length):
            at, hit = _looked_up(name, p.name)
            hit &= least[at] == doc
            if not hit.any():
                continue
            t, first, last = p.at[hit], p.first[hit], p.last[hit]
            padded = np.concatenate([np.zeros(left, np.uint8), part, np.zeros(length, np.uint8)])
            before = padded[t[:, None] + np.arange(left)] * (np.arange(-left, 0) >= (first - t)[:, None])
            after = padded[t[:, None] + left + np.arange(length)] * (np.arange(length) < (last + length - t)[:, None])
            found.append((p.gram[hit], p.name[hit], np.full(len(t), doc), np.full(len(t), group, np.int32), (t - last).astype(np.uint8), (t - first).astype(np.uint8), before, after))
    names = ["gram", "name", "doc", "grp", "near", "far", "before", "after"]
    if not found:
        return pa.table({"bucket": pa.array([], pa.int64())} | {n: pa.array([], pa.binary()) for n in names})
    columns = [np.concatenate([f[i] for f in found]) for i in range(8)]
    once = np.unique(columns[1], return_index=True)[1]
    columns = [c[once] for c in columns]
    return pa.Table.from_batches([_packed((columns[0] % np.uint64(buckets)).astype(np.int64), names, columns, "bucket")])


def suffix_order(gram: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows within their triggers, and each row's common prefix with the one before it (-1: another trigger)."""
    n, wide = rows.shape
    padded = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = rows
    keys = padded.view(">u8")
    order = np.lexsort((*(keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)), gram))
    differs = rows[order][1:] != rows[order][:-1]
    common = np.where(differs.any(1), differs.argmax(1), wide)
    common[gram[order][1:] != gram[order][:-1]] = -1
    return order, np.concatenate([[-1], common])


def _classes(order: np.ndarray, common: np.ndarray, width: int) -> np.ndarray:
    """Numbers of rows, equal where the first ``width`` bytes are."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < width)
    return out


def _compared(table: pa.Table, length: int) -> pa.Table:
    """Of one bucket of triggers: for each phrase the strings (a bit for each distance from the trigger) that a smaller document has too."""
    left = length - GRAM
    kinds = (("gram", np.uint64), ("name", np.uint64), ("doc", np.int64), ("grp", np.int32), ("near", np.uint8), ("far", np.uint8))
    columns = [_lists(table, n, k) for n, k in kinds] + [_lists(table, "before", np.uint8, left), _lists(table, "after", np.uint8, length)]
    every, groups = columns[1], columns[3]
    once, place = np.unique(every, return_index=True, return_inverse=True)[1:]
    gram, name, doc, _, near, far, before, after = (c[once] for c in columns)
    ends, heads = suffix_order(gram, before[:, ::-1]), suffix_order(gram, after)
    bits = np.zeros(len(name), np.uint64)
    for a in range(left + 1):
        there = np.flatnonzero((near <= a) & (a <= far))
        if not len(there):
            continue
        key = _classes(*ends, a)[there] * (len(name) + 1) + _classes(*heads, length - a)[there]
        order = np.lexsort((doc[there], key))
        first = _starts(key[order])
        least = doc[there][order][np.flatnonzero(first)][np.cumsum(first) - 1]
        bits[there[order][least < doc[there][order]]] |= np.uint64(1 << a)
    bits, doc = bits[place], doc[place]  # rows with the same id may have sent a phrase from several groups
    use = bits > 0
    return pa.Table.from_batches([_packed(groups[use].astype(np.int64), ["name", "doc", "bits"], [every[use], doc[use], bits[use]], "grp")])


def _cut(docs: pa.Table, replies: pa.Table, length: int) -> pa.Table:
    """The documents of a group without what smaller documents have."""
    name, least = _lists(replies, "name", np.uint64), _lists(replies, "doc", np.int64)
    pairs = zip(replies.column("name").to_pylist(), replies.column("bits").to_pylist(), strict=True)
    bits = np.frombuffer(b"".join(b or bytes(len(n)) for n, b in pairs), np.uint64)
    order = np.lexsort((bits, name))  # of a phrase's two replies the one with bits comes last
    name, least, bits = name[order], least[order], bits[order]
    last = np.append(name[1:] != name[:-1], True) if len(name) else np.zeros(0, bool)
    name, least, bits = name[last], least[last], bits[last]
    rows = []
    for doc, data in _documents(docs):
        edge = np.zeros(len(data) + 1, np.int32)
        for offset, _, p in blocks(data, length) if len(name) else ():
            at, hit = _looked_up(name, p.name)
            whole = hit & (least[at] < doc)
            np.add.at(edge, offset + p.first[whole], 1)
            np.add.at(edge, offset + p.last[whole] + length, -1)
            some = np.flatnonzero(hit & (least[at] == doc) & (bits[at] > 0))
            for t, b in zip(p.at[some], bits[at[some]].tolist(), strict=True):
                while b:
                    start = offset + int(t) - (b.bit_length() - 1)
                    edge[start] += 1
                    edge[start + length] -= 1
                    b &= ~(1 << (b.bit_length() - 1))
        gone = np.cumsum(edge[:-1]) > 0
        n = int(gone.sum())
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rows.append((None if doc == NO_ID else doc, len(data), n, spans, (data[~gone] if n else data).tobytes()))
    kinds = (("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): the bytes of each text that no ``length``-byte string covers which also starts in
    a document with a smaller id. Overlaps count, matches lie within documents and are judged on the input.

    ``kept`` is binary, as cuts may fall within a character. Null and empty texts have no bytes; texts below ``length`` stay
    whole; texts of any length are read whole, in blocks. Rows with equal ids are one document to each other and keep their
    own rows. A null id comes after all ids: such rows lose what any id has, and take nothing from others. Ids must be whole
    numbers, else a TypeError. No rows give no rows. Only the two columns are read. ``length`` is 19 to 80.
    """
    integral_id(docs, id_col)
    if not GRAM < length <= 80:
        raise ValueError("length is 19 to 80")
    doc, data = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    read = docs.select(doc.alias("doc"), data.alias("data"))
    size = read.agg(F.sum(F.length("data"))).first()[0] or 0
    groups = buckets = max(1, -(-size // GROUP_BYTES))
    # by id and text: rows that share an id, or have none, are no group of their own
    read = read.select(F.pmod(F.xxhash64("doc", "data"), F.lit(groups)).alias("grp"), "doc", "data")
    with text_batches(docs.sparkSession):
        packed = "bucket bigint, gram binary, name binary, doc binary, grp binary, many binary"
        parsed = read.mapInArrow(lambda batches: _parsed(batches, length, buckets), packed)
        phrases = materialise(parsed.groupBy("bucket").applyInArrow(_dictionary, "grp bigint, name binary, doc binary, send binary"), "phrases")
        ends = read.groupBy("grp").cogroup(phrases.groupBy("grp")).applyInArrow(
            lambda d, r: _ends(d, r, length, buckets), "bucket bigint, gram binary, name binary, doc binary, grp binary, near binary, far binary, before binary, after binary"
        )
        strings = materialise(ends.groupBy("bucket").applyInArrow(lambda t: _compared(t, length), "grp bigint, name binary, doc binary, bits binary"), "strings")
        replies = phrases.select("grp", "name", "doc", F.lit(None).cast("binary").alias("bits")).unionByName(strings)
        result = read.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(
            lambda d, r: _cut(d, r, length), "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
        )
        done = materialise(result, "cut")
    forget(phrases, strings)
    return done.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
