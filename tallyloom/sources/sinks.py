"""Sinks: tables, sorted parts and a file for each entity, written by the executors; for published documents (bounded, and
checked) single files.

Published files are byte-identical from run to run: rows in a total order, keys sorted, ``\\n`` line ends.
"""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Rows that a published document may have.
MAX_PUBLISHED = 100_000


def _rows(df: DataFrame, order: list[str]) -> list:
    rows = df.orderBy(*order).limit(MAX_PUBLISHED + 1).collect()
    if len(rows) > MAX_PUBLISHED:
        raise ValueError(f"more than {MAX_PUBLISHED} rows to publish; write a table instead")
    return rows


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, empty strings as null; partitioned for pruning where asked."""
    cleaned = df.select(*(F.nullif(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes))
    writer = cleaned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_layout(df: DataFrame, name: str, path: str, buckets: int, by: list[str], sort_by: list[str] | None = None, bloom: list[str] | None = None, row_group: int | None = None) -> DataFrame:
    """A table ``name`` in a physical order, where other engines have indexes: tables in equal ``buckets`` of a key join without
    a shuffle, row groups of a sorted column are skipped by their bounds, those of a ``bloom`` column by their filter."""
    writer = df.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, *by)
    writer = writer.sortBy(*sort_by) if sort_by else writer
    for column in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if row_group:
        writer = writer.option("parquet.block.size", str(row_group))
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_checked(df: DataFrame, path: str, metrics: dict[str, Column], expected: dict[str, object] | None = None) -> dict:
    """Write ``df`` as Parquet and give its ``metrics``, gathered while it is written: no second scan.

    A metric that differs from ``expected`` raises, with all that do, after the write; the table stays for a look at it."""
    seen = Observation()
    df.observe(seen, *(c.alias(n) for n, c in metrics.items())).write.mode("overwrite").parquet(path)
    found = seen.get
    wrong = [f"{n}: {found[n]}, not {v}" for n, v in (expected or {}).items() if found[n] != v]
    if wrong:
        raise ValueError("; ".join(wrong))
    return found


def write_csv_parts(df: DataFrame, path: str, columns: list[str], order: list[str], parts: int = 1) -> None:
    """CSV files with exactly these columns, cut by range and sorted: one after the other they are the same bytes each time,
    whatever the number of ``parts``. ``order`` must tell all rows apart. There is no header; others in ``df`` raise."""
    extra = set(df.columns) - set(columns)
    if extra:
        raise ValueError(f"columns without a place: {sorted(extra)}")
    cut = df.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut.write.mode("overwrite").option("emptyValue", "").option("nullValue", "").option("lineSep", "\n").csv(path)


def write_json_parts(df: DataFrame, path: str, order: list[str], parts: int = 1) -> None:
    """Canonical JSON lines, cut by range and sorted as :func:`write_csv_parts`: keys sorted, nulls kept."""
    lines = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lines.select(json_column(df, df.columns).alias("value")).write.mode("overwrite").text(path)


def write_entity_parts(df: DataFrame, path: str, key: str) -> None:
    """A folder ``key=value`` with one canonical JSON line for each row of that key; entities that are gone have none."""
    body = json_column(df, df.columns).alias("value")
    df.select(F.col(key).alias("entity"), body).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("entity").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> int:
    """One CSV file with exactly these columns; others in ``df`` raise."""
    extra = set(df.columns) - set(columns)
    if extra:
        raise ValueError(f"columns without a place: {sorted(extra)}")
    rows = _rows(df.select(*columns), order)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(columns)
        out.writerows(["" if v is None else v for v in r] for r in rows)
    return len(rows)


def plain(value: object, masked: str = "<5") -> object:
    """Rows as dictionaries, whole doubles as integers; a struct with ``masked`` true as the mask sign."""
    if hasattr(value, "asDict"):
        value = value.asDict()
        if value.get("masked"):
            return masked
    if isinstance(value, dict):
        return {str(k): plain(v, masked) for k, v in value.items() if k != "masked"}
    if isinstance(value, (list, tuple)):
        return [plain(v, masked) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def canonical(value: object) -> str:
    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"


def write_json(df: DataFrame, path: str, order: list[str], max_bytes: int | None = None) -> int:
    """All rows as one canonical JSON array; too large a file raises before it is written."""
    data = canonical([r.asDict(recursive=False) for r in _rows(df, order)]).encode()
    if max_bytes is not None and len(data) > max_bytes:
        raise ValueError(f"{path}: {len(data)} bytes, {max_bytes} allowed")
    Path(path).write_bytes(data)
    return len(data)


def write_entities(df: DataFrame, folder: str, key: str) -> tuple[int, int]:
    """One canonical JSON file for each row, named by its key; files of keys that are gone are removed."""
    os.makedirs(folder, exist_ok=True)
    rows = _rows(df, [key])
    names = {f"{r[key]}.json": r for r in rows}
    for name, r in names.items():
        if not name[:-5].replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"no file name: {name}")
        Path(folder, name).write_text(canonical(r), encoding="utf-8")
    stale = [p for p in Path(folder).glob("*.json") if p.name not in names]
    for p in stale:
        p.unlink()
    return len(names), len(stale)


def manifest(tables: dict[str, DataFrame], frequencies: dict[str, tuple[DataFrame, str]] | None = None) -> dict:
    """Row counts of tables and value counts of some columns."""
    out: dict = {"rows": {n: df.count() for n, df in tables.items()}}
    for name, (df, col) in (frequencies or {}).items():
        out[name] = {str(r[0]): r[1] for r in _rows(df.groupBy(col).count(), [col])}
    return out


def json_column(df: DataFrame, columns: list[str]) -> Column:
    """One JSON string of columns in sorted order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_sqlite(df: DataFrame, path: str, table: str, order: list[str], indexes: list[str] | None = None) -> int:
    """A bounded table into an SQLite file, empty strings as null."""
    import sqlite3

    rows = _rows(df, order)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL"}
    with sqlite3.connect(path) as con:
        con.execute(f'drop table if exists "{table}"')
        con.execute(f'create table "{table}" ({", ".join(f"{chr(34)}{n}{chr(34)} {kinds.get(t, "TEXT")}" for n, t in df.dtypes)})')
        con.executemany(f'insert into "{table}" values ({", ".join("?" * len(df.columns))})', ([None if v == "" else v for v in r] for r in rows))
        for c in indexes or []:
            con.execute(f'create index "ix_{table}_{c}" on "{table}" ("{c}")')
    return len(rows)


def write_xlsx(df: DataFrame, path: str, order: list[str]) -> int:
    """A bounded table as a workbook of one sheet with text cells."""
    import zipfile
    from xml.sax.saxutils import escape

    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    rows = [df.columns, *([None if v is None else str(v) for v in r] for r in _rows(df, order))]
    body = "".join(
        f'<row r="{k}">' + "".join(f'<c r="{name(i)}{k}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(r) if v is not None) + "</row>"
        for k, r in enumerate(rows, 1)
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, text in parts.items():
            z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return len(rows) - 1


def report(tables: dict[str, DataFrame]) -> str:
    return "\n".join(f"{n}: {df.count()} rows, {len(df.columns)} columns" for n, df in tables.items())
