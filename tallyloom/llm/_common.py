"""Shared pieces: reading tables, cutting lineage in the shared folder, components, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast; beyond it the plain shuffle join is used.
BROADCAST_ROWS = 200_000
#: Bytes of texts, where a side has any, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
#: Edges (16 bytes each) up to which one task connects what is left of them.
COMPONENT_ROWS = 50_000
_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one if all runs in one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, _FALLBACK["dir"], ignore_errors=True)
    return _FALLBACK["dir"]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written within this block deletes its shuffles when it is done, and not when the driver's memory is next tidied."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    path = f"{_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` once all that reads them has itself been materialised."""
    for df in tables:
        _delete(df.sparkSession, df._tallyloom_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written here. Results that are not yet written lose what they read."""
    _delete(spark, _folder(spark))


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within this block texts go to Python at most ``rows`` at a time: whole texts are long, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory of a Python worker, which outlives its task, to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS, size: int = 0) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows``, and the counted bytes of its texts, stay within bounds."""
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def integral_id(docs: DataFrame, id_col: str) -> None:
    """Raise where ids are no whole numbers."""
    kind = id_type(docs, id_col)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids in {id_col} are {kind}, whole numbers are needed")


def words_column(text: Column) -> Column:
    """Words split at ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _contracted(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """(u, v): the nodes of the given edges, each with the smallest one that these connect it to; that one itself if ``roots``."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    found = [(x, r) for x in above if (r := top(x)) != x or roots]
    columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(2)]
    yield pa.RecordBatch.from_arrays(columns, ["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60, part_rows: int = COMPONENT_ROWS) -> DataFrame:
    """Components of an undirected graph: (node, component), component the smallest node reached.

    ``edges`` has two bigint columns ``a`` and ``b``; self loops and repeats are allowed, an empty
    table gives an empty result. Each task contracts its own edges to stars. Where no more than ``part_rows``
    of these are left, one task connects them. More go through alternating large-star and small-star rounds:
    every round is a grouped minimum and a join, contracted again and written to the shared folder.
    """

    def contract(df: DataFrame, roots: bool = False) -> DataFrame:
        return df.mapInArrow(lambda it: _contracted(it, roots), "u long, v long")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    star = materialise(contract(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")), "cc")
    last = mark(star)
    for _ in range(max_rounds):
        if last[0] <= part_rows:
            done = materialise(contract(star.coalesce(1), roots=True), "cc")
            forget(star)
            return done.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, star = star, materialise(contract(small), "cc")
        forget(before)
        now = mark(star)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("v").alias("node")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


class WordIds(dict):
    """64-bit ids of words (bytes), kept while there are few enough of them."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around on purpose)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive ids; none if there are fewer."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * _P + ids[i : i + n]
        return mix(out)


def shingles(text: str | None, k: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a whole text, A-Z lower-cased.

    With fewer than ``k`` words the whole sequence is the one shingle; without words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(ids.of(words), min(k, len(words))))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()
