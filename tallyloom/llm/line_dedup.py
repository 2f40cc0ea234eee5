"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over threshold."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import BROADCAST_ROWS, digest, id_type, materialise

_SPACE = b"\x20\t\n\x0b\x0c\r"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a normalised line; None if it has fewer than ``min_chars`` code points."""
    line = line.strip(_SPACE).lower()
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return digest(line)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _held(docs: DataFrame, min_chars: int, id_type: str) -> DataFrame:
    """(id, seen, line): distinct line keys of each row of ``docs`` (id, seen, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [{_key(x, min_chars) for x in _lines(t)} - {None} for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            lines = pa.array([x for k in keys for x in k], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("seen").take(at), lines], ["id", "seen", "line"])

    return docs.mapInArrow(run, f"id {id_type}, seen long, line binary")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("seen"), F.col(text_col).alias("text"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(line, keeper): hashes of lines that ``min_docs`` documents hold, and the largest id among these."""
    held = _held(_named(docs, id_col, text_col), min_chars, id_type(docs, id_col)).select("id", "line")
    # two steps: a repeated row counts once, and one frequent line is counted by many tasks
    return (
        held.distinct()
        .groupBy("line")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("line", "keeper")
    )


def _rebuild(name: object, text: str | None, gone: dict, min_chars: int) -> tuple[int, int, str]:
    kept, lines = [], _lines(text)
    for x in lines:
        key = _key(x, min_chars)
        if key is None or key not in gone or (name is not None and gone[key] == name):
            kept.append(x)
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All columns of ``docs``, the text rebuilt, and ``n_lines`` (before) and ``n_dropped`` (both long).

    Lines are split at ``\\n``; a null or empty text is one empty line and becomes the empty text. A line's
    key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of ``min_chars`` code
    points or more that ``min_docs`` distinct documents hold lose all their lines, except in the largest id
    that holds them. Repeated rows count as one document and are treated alike; a row with a null id never
    keeps such a line. Ids may be of any type that has an order. No rows give no rows. Input columns named
    ``n_lines`` or ``n_dropped`` are replaced.

    The repeated lines travel to every task while ``broadcast_rows`` bound them; beyond that they meet the
    lines of the documents in a join, and each document its own dropped lines in another.
    """
    found = materialise(repeated_lines(docs, id_col, text_col, min_chars, min_docs), "lines")
    base = docs.drop(*(c for c in ("n_lines", "n_dropped") if c in docs.columns and c not in (id_col, text_col)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    schema = f"{fields}, n_lines long, n_dropped long"
    kept = base.columns

    def put(batch: pa.RecordBatch, gone: Iterator[dict], names: list) -> Iterator[pa.RecordBatch]:
        """The batch in slices, so that few texts are held twice; other columns pass untouched."""
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = part.column(text_col)
            rows = [_rebuild(n, t, g, min_chars) for n, t, g in zip(names[at : at + 500], texts.to_pylist(), gone)]
            columns = {c: part.column(c) for c in kept}
            columns[text_col] = pa.array([r[2] for r in rows], texts.type)
            columns |= {"n_lines": pa.array([r[0] for r in rows], pa.int64()), "n_dropped": pa.array([r[1] for r in rows], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    if found.count() <= broadcast_rows:
        table = docs.sparkSession.sparkContext.broadcast({bytes(r.line): r.keeper for r in found.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from put(batch, itertools.repeat(table.value), batch.column(id_col).to_pylist())

        return base.mapInArrow(run, schema)

    # rows without an id are told apart by their texts, so they are no one group
    gone = (
        _held(_named(docs, id_col, text_col), min_chars, id_type(docs, id_col))
        .join(found, "line")
        .where(~F.col("id").eqNullSafe(F.col("keeper")) | F.col("id").isNull())
        .groupBy("id", "seen")
        .agg(F.collect_set("line").alias("_gone"))
        .withColumnsRenamed({"id": "_id", "seen": "_seen"})
    )
    joined = base.join(gone, base[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(base[text_col]) == gone["_seen"]), "left").drop("_id", "_seen")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from put(batch, (dict.fromkeys(g or ()) for g in batch.column("_gone").to_pylist()), [None] * batch.num_rows)

    return joined.mapInArrow(drop, schema)
