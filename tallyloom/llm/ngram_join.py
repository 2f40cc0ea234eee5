"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists.

How a pair of documents meets, without pairing up all documents:

1. Texts become sets of 64-bit shingle hashes; equal sets are one class, stood for by its smallest id.
2. Two sets with Jaccard >= t share a shingle among the first ``n - ceil(t n) + 1`` of each, under any
   order that both use. Sets of similar size have a cell in common, and an order holds within a cell: the
   block of small hashes first, rare before frequent in it, then the other hashes. Only that block's
   shingles are counted, over all classes, in one shuffle that packs many into a row. A prefix of shingles that no other class has needs no partner;
   most classes end here.
3. A prefix longer by ``s - 1`` shares ``s`` shingles. A shingle that few classes of similar size hold counts
   for each of their pairs (a fixed number at most), and pairs counted ``s`` times meet; one that more hold
   makes all of them meet by a star. Classes that meet form clusters (connected components).
4. In each cluster sets are searched in ascending size. The inverted lists lead from a shingle to the sets
   given before; T-occurrence search (short lists merged by counting, binary probes into long ones) finds those
   that hold enough of the set's shingles, which is the exact intersection. Candidates are probed a few at a time,
   those of components that are linked by then no more, so a set of a large group costs a few probes.
5. A cluster with more shingles than one task should have is dealt into blocks: blocks are searched alone.
   A set too few of whose shingles are in sets of other components is done; these are taken off again and again.
   Of what is left, the smallest members of the components are searched, then slices of the sets outside the largest
   component with all blocks of their cluster, a few slices in each pass. No link between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import WordIds, connected_components, digest, forget, give_back, integral_id, materialise, maybe_broadcast, mix, shingles, text_batches

#: Shingles of one search task; larger clusters are dealt into blocks.
BLOCK_TOKENS = 250_000
#: Shingles that two sets must share in prefixes that are longer by one less.
SUPPORT = 4
#: Sets with a shingle in a cell of sizes up to which their pairs are counted; more form a star at once.
PAIRED = 12
#: Size classes of one cell, in which one order of shingles holds.
CLASSES = 4
#: Heads of one bucket, counted together, unless a single head has more; a bucket has about 8 bytes for each when shuffled.
BUCKET_HEADS = 500_000
#: Shingles that one pass of the last search reads, unless a single slice of strangers and what it meets have more.
PASS_TOKENS = 40_000_000
#: Shingles of one bucket, counted together, unless tasks would be left without any.
BUCKET_TOKENS = 2_000_000
#: Ids of copies (8 bytes each), or classes with their blocks (28 bytes), up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def _at_least(n: int, percent: int) -> int:
    """The smallest overlap of a set of ``n`` with any set that is similar enough."""
    return (percent * n + 99) // 100


def _merge_short(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids that the short lists hold often enough to be on ``least`` of all, how often, and the long lists, shorter first.

    The ``least - 1`` longest lists at most are set aside; an id must then be on ``least`` minus their number of the
    short ones, which are merged by counting their ids.
    """
    lists = sorted(lists, key=len)
    # a long list costs a probe for each candidate, a short one a step for each entry
    aside = min(least - 1, int(least / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    counts = np.bincount(np.concatenate(short))
    ids = np.flatnonzero(counts >= least - aside)
    return ids, counts[ids], long


def _probe_long(ids: np.ndarray, n: np.ndarray, long: list[np.ndarray], least: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the sorted ``ids``, on ``n`` lists so far, that are on ``least`` with the long ones, and on how many."""
    least = np.broadcast_to(least, len(ids))
    for k, other in enumerate([*long, None]):
        on = n + len(long) - k >= least
        if not on.all():
            ids, n, least = ids[on], n[on], least[on]
        if other is None or not len(ids):
            break
        at = np.searchsorted(other, ids)
        at[at == len(other)] = 0
        n = n + (other[at] == ids)
    return ids, n


def divide_skip(lists: list, least: int) -> np.ndarray:
    """Ids, small whole numbers, on at least ``least`` of the sorted lists: the short lists are merged, the long ones
    are probed by binary search for what may still be on enough of them."""
    if least <= 0 or len(lists) < least:
        return np.empty(0, np.int64)
    ids, n, long = _merge_short([np.asarray(x, np.int64) for x in lists], least)
    return _probe_long(ids, n, long, least)[0]


class ComponentSearch:
    """Links sets, given in ascending size, to the components of those given before.

    ``known`` labels sets that are known to be of one component. Shingles that no set of a second component has are
    on no list, and a set with too few others links no components and is not searched.
    """

    #: Candidates probed at once at first; more once these leave components without a link.
    PROBED = 16

    def __init__(self, percent: int, sets: list[np.ndarray], known: list[int] | None = None):
        self.percent, self.size = percent, np.array([len(x) for x in sets], np.int64)
        _, self.token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.first = np.cumsum(self.size) - self.size
        # lists lie one behind the other; each is filled as far as sets have been given
        self.start, self.filled = np.cumsum(df) - df, np.zeros(len(df), np.int64)
        self.entries = np.empty(len(self.token), np.int64)
        self.component = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]

    def run(self) -> np.ndarray:
        """The component of each set, as a label."""
        for i in self._meeting().tolist():
            self._add(i)
        return self.component

    def _meeting(self) -> np.ndarray:
        """Sets that hold enough shingles of other components' sets; a set without them takes its shingles off the lists."""
        label, on = np.repeat(self.component, self.size), np.ones(len(self.size), bool)
        while True:
            of = np.repeat(on, self.size)
            low, high = np.full(len(self.start), len(self.size)), np.full(len(self.start), -1)
            np.minimum.at(low, self.token[of], label[of])
            np.maximum.at(high, self.token[of], label[of])
            self.shared = low < high
            held = np.add.reduceat(self.shared[self.token], self.first)
            left = on & (100 * held >= self.percent * self.size)
            if np.count_nonzero(left) >= 0.9 * np.count_nonzero(on):
                return np.flatnonzero(left)
            on = left

    def _add(self, i: int) -> None:
        tokens = self.token[self.first[i] : self.first[i] + self.size[i]]
        tokens = tokens[self.shared[tokens]]
        begin, n = self.start[tokens], self.filled[tokens]
        self.filled[tokens] = n + 1
        self.entries[begin + n] = i
        has = n > 0
        least = _at_least(int(self.size[i]), self.percent)
        if np.count_nonzero(has) < least:
            return
        entries = self.entries
        lists = [entries[a:b] for a, b in zip(begin[has].tolist(), (begin + n)[has].tolist())]
        ids, n, long = _merge_short(lists, least)
        need = -(-self.percent * (self.size[i] + self.size[ids]) // (100 + self.percent))
        step = self.PROBED
        while True:
            other = (self.component[ids] != self.component[i]) & (n + len(long) >= need)
            ids, n, need = ids[other], n[other], need[other]
            if not len(ids):
                return
            # those that share the most rare shingles first: a link spares the others of its component
            now = np.argsort(-n, kind="stable")[:step]
            now.sort()
            for c in set(self.component[_probe_long(ids[now], n[now], long, need[now])[0]].tolist()):
                self.component[self.component == c] = self.component[i]
            ids, n, need = (np.delete(x, now) for x in (ids, n, need))
            step *= 64


def _local_components(frames: Iterator[pd.DataFrame], percent: int, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys`` and size; each run of equal keys is searched as one."""

    def searched(reps: list, sets: list, known: list) -> pd.DataFrame:
        rep = np.array(reps, np.int64)
        label = ComponentSearch(percent, sets, known or None).run()
        order = np.lexsort((rep, label))
        begins = np.flatnonzero(np.diff(label[order], prepend=-1))
        low = np.repeat(rep[order][begins], np.diff(begins, append=len(rep)))
        return pd.DataFrame({"rep": rep[order], "low": low})

    now, reps, sets, known = None, [], [], []
    out, n = [], 0
    for frame in frames:
        named = list(zip(*(frame[k].tolist() for k in keys)))
        labels = frame["known"].tolist() if "known" in frame else None
        for i, (rep, tokens) in enumerate(zip(frame["rep"].tolist(), frame["tokens"])):
            if named[i] != now:
                if reps:
                    out.append(searched(reps, sets, known))
                    n += len(reps)
                now, reps, sets, known = named[i], [], [], []
            reps.append(rep)
            sets.append(np.asarray(tokens, np.int64))
            if labels:
                known.append(labels[i])
        if n > 50_000:
            yield pd.concat(out)
            out, n = [], 0
    if reps:
        out.append(searched(reps, sets, known))
    yield pd.concat(out) if out else pd.DataFrame({"rep": np.empty(0, np.int64), "low": np.empty(0, np.int64)})
    del reps, sets, known, out
    give_back()


def _search(sets: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """(a, b): each set of a group and the smallest name of its component there."""
    names = [*keys, *(["known"] if "known" in sets.columns else []), "n", "rep", "tokens"]
    # a fixed number of parts: rows here cost much more than their bytes tell
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.select(*names).repartition(parts, *keys).sortWithinPartitions(*keys, "n", "rep")
    return dealt.mapInPandas(lambda it: _local_components(it, percent, keys), "rep long, low long").select(
        F.col("rep").alias("a"), F.col("low").alias("b")
    )


def _size_class(n: int, percent: int) -> int:
    """Similar sets are in the same class or in neighbouring ones."""
    return int(math.log(n) / _class_width(percent))


def _class_width(percent: int) -> float:
    return 1.0001 * math.log(100 / min(percent, 99))


def _cells(size: int) -> list[int]:
    """The cell of a size class, and the next one for a cell's largest class."""
    own = size // CLASSES
    return [own, own + 1] if size % CLASSES == CLASSES - 1 else [own]


def _cell_share(cell: int, percent: int) -> float:
    """The share of all hashes that is counted for sets of a cell: somewhat more than their prefixes need."""
    n = max(1.0, math.exp((cell * CLASSES - 1) * _class_width(percent)))
    return min(1.0, (1.2 * (n * (100 - percent) / 100 + 1) + 10) / n)


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, n, fp, size, cell, n_head, head): set size, fingerprint of the set, size class, its cells, and the
    smallest hashes: so many of them may be in the set's prefix in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                h = shingles(text, k, ids)
                n = len(h)
                if not n:
                    rows.append((0, None, 0, [], [], h.view(np.int64)))
                    continue
                size, least = _size_class(n, percent), n - _at_least(n, percent) + 1
                cells, cut = _cells(size), []
                for share in (_cell_share(c, percent) for c in cells):
                    below = n if share == 1 else int(np.searchsorted(h, np.uint64(int(share * (2**64 - 2**11))), "right"))
                    cut.append(max(least, below))
                rows.append((n, digest(h.tobytes()), size, cells, cut, h[: max(cut)].view(np.int64).copy()))
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n", "fp", "size", "cell", "n_head", "head"])
        ids.clear()
        give_back()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, n long, fp binary, size int, cell array<int>, n_head array<int>, head array<long>")


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as all of them need, after one byte for that width."""
    low, high = int(x.min()), int(x.max())
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).astype(np.int64)


def _packed_heads(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, first, reps, cells, tokens): the heads of many classes in a bucket, as columns of bytes: 40 bits of
    each hash, the step from one class to the next and the cell. Hashes that only agree in these bits count as one,
    which adds candidates and takes none away."""

    def flush(reps: list, cells: list, hashes: list) -> pa.RecordBatch:
        rep, cell, h = np.concatenate(reps), np.concatenate(cells), np.concatenate(hashes)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rep, cell, bucket = rep[order], cell[order], bucket[order]
        low = np.ascontiguousarray((h[order] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*at[1:].tolist(), len(bucket)]
        rows = [(int(bucket[a]), int(rep[a]), _narrow(np.diff(rep[a:b], prepend=rep[a])), _narrow(cell[a:b]), low[a:b].tobytes()) for a, b in zip(at.tolist(), ends)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "first", "reps", "cells", "tokens"])

    reps, cells, hashes, n = [], [], [], 0
    for batch in batches:
        heads = batch.column("head")
        at, flat = heads.offsets.to_numpy(), heads.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for i, (rep, own, cut) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rep", "cell", "n_head")))):
            for cell, m in zip(own, cut):
                h = flat[at[i] : at[i] + m]
                with np.errstate(over="ignore"):
                    hashes.append(mix(h + np.uint64(cell + 1) * np.uint64(0x9E3779B97F4A7C15)))
                reps.append(np.full(len(h), rep, np.int64))
                cells.append(np.full(len(h), cell, np.int64))
                n += len(h)
            if n >= 1_000_000:
                yield flush(reps, cells, hashes)
                reps, cells, hashes, n = [], [], [], 0
    if n:
        yield flush(reps, cells, hashes)
    del reps, cells, hashes
    give_back()


def _counted_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, cell, df, token) for heads that several classes have; rows of one bucket follow each other."""

    def settle(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(r[3]) // 5 for r in rows]
        low = np.zeros((sum(sizes), 8), np.uint8)
        low[:, :5] = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, 5)
        low = low.view(np.uint64).ravel()
        several, df = np.unique(low, return_counts=True)
        several, df = several[df > 1], df[df > 1]
        if not len(several):
            return
        a = 0
        for (first, reps, cells, _), n in zip(rows, sizes):
            own = low[a : a + n]
            a += n
            at = np.minimum(np.searchsorted(several, own), len(several) - 1)
            hit = several[at] == own
            if hit.any():
                token = own[hit].view(np.int64) | (bucket << 40)
                columns = (first + np.cumsum(_widened(reps)))[hit], _widened(cells)[hit].astype(np.int32), df[at[hit]], token
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "cell", "df", "token"])

    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "reps", "cells", "tokens"))):
            if bucket != now:
                if rows:
                    yield from settle(now, rows)
                now, rows = bucket, []
            rows.append(row)
    if rows:
        yield from settle(now, rows)
    del rows
    give_back()


def _shared_heads(headed: DataFrame, buckets: int) -> DataFrame:
    """(rep, cell, df, token): heads that ``df`` > 1 classes of a cell have. Heads are shuffled once, packed."""
    packed = headed.select("rep", "cell", "n_head", "head").mapInArrow(
        lambda it: _packed_heads(it, buckets), "bucket int, first long, reps binary, cells binary, tokens binary"
    )
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_counted_heads, "rep long, cell int, df long, token long")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for frame in frames:
            sets = [shingles(t, k, ids) for t in frame["text"]]
            yield pd.DataFrame(
                {"rep": frame["id"], "n": [len(s) for s in sets], "tokens": [np.sort(s.view(np.int64)) for s in sets]}
            )
        ids.clear()
        give_back()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, "rep long, n long, tokens array<long>")


def ngram_jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. Two documents link when
    ``100 * intersection >= percent * union`` of their sets of ``k``-word shingles; a text with fewer words
    is one shingle. Null, empty or blank texts have no shingles, link with nothing and are their own
    component. Repeated rows come back as often as given. A row with a null id has the component of a text
    with the same shingles and an id, else none; it makes no links of its own. Ids are whole numbers, others
    raise. No rows give no rows; other columns are not read, whatever their names.
    """
    integral_id(docs, id_col)
    with text_batches(docs.sparkSession):
        whole = materialise(_fingerprints(docs, id_col, text_col, k, percent), "fp")
    # heads are read for the prefixes only, so that they need not stay to the end
    prints = materialise(whole.select("id", "n", "fp"), "prints")
    named = prints.where("fp is not null and id is not null")
    classes = materialise(named.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    copies = materialise(named.select("id", "fp").join(classes, "fp").where("id <> rep").select("id"), "copies")
    gone = maybe_broadcast(copies, copies.count(), BROADCAST_IDS)
    alone = named.join(gone, "id", "left_anti")
    headed = whole.where("fp is not null and id is not null").join(gone, "id", "left_anti").withColumnRenamed("id", "rep")
    celled = headed.select("rep", "n", "size", F.inline(F.arrays_zip("cell", "n_head"))).distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_heads = headed.agg(F.sum(F.aggregate("n_head", F.lit(0), lambda a, x: a + x))).first()[0] or 0
    shared = materialise(_shared_heads(headed, max(parts, math.ceil(n_heads / BUCKET_HEADS))), "shared")
    held = shared.repartition(parts, "rep", "cell").groupBy("rep", "cell").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    least = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    prefix = (
        held.join(celled, ["rep", "cell"])
        .withColumn("need", F.least(F.lit(SUPPORT), F.col("n_head") - least + 1).cast("int"))
        # shingles of one class only come first; what the prefix has left are the rarest others
        .withColumn("left", F.when(F.col("n_head") == least, F.size("held")).otherwise(least + F.col("need") - 1 - F.col("n_head") + F.size("held")))
        .where("left > 0")
        # within a cell sets meet in the fine cell of the larger one's size class
        .withColumn("own", F.floor(F.col("size") / CLASSES) == F.col("cell"))
        .withColumn("upper", F.col("size") % CLASSES == CLASSES - 1)
        .withColumn("fine", F.when(~F.col("own"), F.array(F.col("size") + 1)).when(F.col("upper"), F.array("size")).otherwise(F.array("size", F.col("size") + 1)))
        .select("rep", "need", "size", "fine", F.explode(F.slice("held", 1, F.col("left").cast("int"))["token"]).alias("token"))
        .select("rep", "need", "size", "token", F.explode("fine").alias("cell"))
    )
    prefix = materialise(prefix, "prefix")
    forget(whole, shared)
    cells = prefix.groupBy("token", "cell").agg(F.min("rep").alias("lead"), F.count("*").alias("held")).where("held > 1")
    placed = materialise(prefix.join(cells, ["token", "cell"]), "placed")
    forget(prefix)
    stars = placed.where(F.col("held") > PAIRED).select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    few = placed.where(F.col("held") <= PAIRED).groupBy("token", "cell").agg(F.collect_list(F.struct("rep", "need", (F.col("size") == F.col("cell")).alias("own"))).alias("m"))
    pairs = (
        few.select("m", F.explode("m").alias("x"))
        .select("x", F.explode("m").alias("y"))
        .where("x.rep < y.rep and (x.own or y.own)")
        .groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(F.least("x.need", "y.need")).alias("need"))
        .where("shared >= need")
    )
    stars = stars.unionByName(pairs.select("a", "b"))
    clusters = materialise(connected_components(stars).select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "clusters")
    forget(placed)

    sizes = alone.select(F.col("id").alias("rep"), "n").distinct().join(clusters, "rep").groupBy("cluster").agg(F.ceil(F.sum("n") / block_tokens).alias("blocks"))
    dealt = materialise(
        clusters.join(sizes, "cluster").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")), "dealt"
    )

    def sets_of(which: DataFrame) -> DataFrame:
        """Sets of the classes in ``which``, with their cluster and block."""
        rows = which.count()
        active = maybe_broadcast(which.select(F.col("rep").alias(id_col)), rows, BROADCAST_IDS)
        # else sets would be shuffled by id first, and then to their blocks
        places = maybe_broadcast(which, rows, BROADCAST_IDS)
        return _sets(docs.join(active, id_col, "left_semi"), id_col, text_col, k).join(places, "rep").where("n > 0")

    with text_batches(docs.sparkSession):
        links = _cluster_links(dealt, sets_of, percent, block_tokens)
    components = connected_components(links)
    forget(clusters, dealt, copies, links)
    merged = (
        classes.join(components, classes["rep"] == components["node"], "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    return prints.select("id", "n", "fp").join(merged, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _packed_sets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, reps, known, counts, tokens): shingles of many sets in a bucket, as columns of bytes, with 40 bits of each
    hash. Hashes that only agree in these bits count as one, which keeps sets and takes none away."""
    for batch in batches:
        rep, known, cluster = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "known", "cluster"))
        held = batch.column("tokens")
        size = np.diff(held.offsets.to_numpy())
        if not size.sum():
            continue
        flat = held.values.to_numpy(zero_copy_only=False)[held.offsets[0].as_py() : held.offsets[-1].as_py()].view(np.uint64)
        with np.errstate(over="ignore"):
            h = mix(flat + np.repeat(mix(cluster.astype(np.int64).view(np.uint64)), size))
        bucket, own = (h % np.uint64(buckets)).astype(np.int64), np.repeat(np.arange(len(size)), size)
        order = np.argsort(bucket, kind="stable")
        bucket, own = bucket[order], own[order]
        low = np.ascontiguousarray((h[order] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
            begins = np.flatnonzero(np.diff(own[a:b], prepend=-1))
            sets = own[a:b][begins]
            rows.append((int(bucket[a]), rep[sets].tobytes(), known[sets].tobytes(), _narrow(np.diff(begins, append=b - a)), low[a:b].tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "reps", "known", "counts", "tokens"])
    give_back()


def _held_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, held): how many of a set's shingles in a bucket a set of another component has; rows of one bucket follow each other."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        rep, known = (np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in (0, 1))
        counts = np.concatenate([_widened(r[2]) for r in rows])
        low = np.zeros((counts.sum(), 8), np.uint8)
        low[:, :5] = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, 5)
        low, label = low.view(np.uint64).ravel(), np.repeat(known, counts)
        order = np.argsort(low, kind="stable")
        low, label = low[order], label[order]
        begins = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        several = np.minimum.reduceat(label, begins) < np.maximum.reduceat(label, begins)
        shared = np.empty(len(low), bool)
        shared[order] = np.repeat(several, np.diff(begins, append=len(low)))
        held = np.add.reduceat(shared, np.cumsum(counts) - counts, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rep[held > 0]), pa.array(held[held > 0])], ["rep", "held"])

    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "reps", "known", "counts", "tokens"))):
            if bucket != now:
                if rows:
                    yield settle(rows)
                now, rows = bucket, []
            rows.append(row)
    if rows:
        yield settle(rows)
    del rows
    give_back()


def _known(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("known"))


def _labelled(sets: DataFrame, known: DataFrame) -> DataFrame:
    return sets.drop("known").join(known, "rep", "left").withColumn("known", F.coalesce("known", "rep"))


def _meeting(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``sets``, a settled table that is deleted, with their components, without those that link no two components:
    too few of their shingles are in sets of other components of their cluster. Sets that go take their shingles along,
    so this is repeated while it takes off a tenth."""

    def shingles_of(df: DataFrame) -> int:
        return df.agg(F.sum("n")).first()[0] or 0

    now = materialise(_labelled(sets, known), "sets")
    forget(sets)
    size, parts = shingles_of(now), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while size:
        buckets = max(min(parts, math.ceil(size / BLOCK_TOKENS)), math.ceil(size / BUCKET_TOKENS))
        packed = now.select("rep", "known", "cluster", "tokens").mapInArrow(
            lambda it, buckets=buckets: _packed_sets(it, buckets), "bucket int, reps binary, known binary, counts binary, tokens binary"
        )
        counted = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_held_elsewhere, "rep long, held long")
        held = counted.groupBy("rep").agg(F.sum("held").alias("held"))
        left = materialise(now.join(held, "rep").where(F.col("held") * 100 >= F.col("n") * percent).drop("held"), "sets")
        forget(now)
        before, now, size = size, left, shingles_of(left)
        if size > 0.9 * before:
            break
    return now


def _cluster_links(dealt: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, block_tokens: int) -> DataFrame:
    """Links (a, b) that connect exactly what the sets' similar pairs connect; ``dealt`` has (rep, cluster, blocks, block).

    Of a cluster, N shingles in sets that may link components are left after the blocks' own search, S of them outside
    the largest component. The last search reads about 2 * N for each block's worth of S, and not more at once.
    """

    def added(links: DataFrame, more: DataFrame) -> DataFrame:
        out = materialise(links.unionByName(more.where("a <> b")), "links")
        forget(links)
        return out

    def in_blocks(sets: DataFrame, sizes: DataFrame) -> DataFrame:
        return sets.join(F.broadcast(sizes), "cluster").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))

    keys = ["cluster", "block"]
    links = materialise(_search(sets_of(dealt), percent, keys), "links")
    if not dealt.where("blocks > 1").limit(1).count():
        return links
    large = materialise(sets_of(dealt.where("blocks > 1")).select("cluster", "n", "rep", "tokens"), "sets")
    rest = _meeting(large, _known(links), percent)
    # the smallest members of what the blocks hold, together; single sets are strangers anyhow
    hubs = rest.groupBy("cluster", "known").agg(F.min("rep").alias("rep"), F.count("*").alias("sets")).where("sets > 1")
    hubs = rest.join(hubs.select("rep"), "rep", "left_semi")
    sizes = hubs.groupBy("cluster").agg(F.ceil(F.sum("n") / block_tokens).alias("blocks"))
    links = added(links, _search(in_blocks(hubs, sizes), percent, keys))
    rest = _meeting(rest, _known(links), percent)
    several = F.col("sets") > 1
    plan = rest.groupBy("cluster", "known").agg(F.sum("n").alias("size"), F.count("*").alias("sets"))
    plan = plan.groupBy("cluster").agg(
        F.sum("size").alias("size"),
        F.max_by(F.when(several, F.col("known")), F.struct(F.when(several, F.col("size")).otherwise(0), "known")).alias("main"),
        F.coalesce(F.max(F.when(several, F.col("size"))), F.lit(0)).alias("own"),
    )
    plan = materialise(
        plan.select("cluster", "size", "main", F.ceil(F.col("size") / block_tokens).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("own")) / block_tokens).cast("int").alias("slices")).where("slices > 0"),
        "plan",
    )
    slices, size = plan.agg(F.max("slices"), F.sum("size")).first()
    step = max(1, PASS_TOKENS // (2 * (size or 1)))
    names = ["cluster", "slice", "block", "known", "n", "rep", "tokens"]
    for begin in range(0, slices or 0, step):
        now, mains = rest, plan
        if begin:
            known = _known(links)
            now = _labelled(rest, known)
            renamed = known.select(F.col("rep").alias("main"), F.col("known").alias("new"))
            mains = plan.join(renamed, "main", "left").withColumn("main", F.coalesce("new", "main")).drop("new")
        end = F.least(F.lit(begin + step), F.col("slices")) - 1
        now = in_blocks(now, mains.where(F.col("slices") > begin)).withColumn("own", F.expr("cast(block * slices div blocks as int)"))
        in_main = F.col("known").eqNullSafe(F.col("main"))
        # strangers of a slice meet each other, those of the slices after theirs, and the largest component
        met = now.withColumn("slice", F.explode(F.sequence(F.lit(begin), end))).where(in_main | (F.col("own") > F.col("slice")))
        first = F.when(F.col("main").isNull(), F.ceil(F.col("own") * F.col("blocks") / F.col("slices")).cast("int")).otherwise(0)
        strangers = now.where(~in_main & F.col("own").between(F.lit(begin), end)).withColumn("slice", F.col("own"))
        strangers = strangers.withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1)))
        links = added(links, _search(met.select(*names).unionByName(strangers.select(*names)), percent, names[:3]))
    forget(rest, plan)
    return links


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """``docs`` without documents whose component has a smaller id.

    Of rows with the smallest id all stay, rows with a null id too. Null, empty and blank texts are near no
    other text and stay. Columns of any name are kept as they are; no rows give no rows.
    """
    found = ngram_jaccard_components(docs, id_col, **settings)
    gone = materialise(found.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct(), "gone")
    return docs.join(maybe_broadcast(gone, gone.count(), BROADCAST_IDS), id_col, "left_anti")
