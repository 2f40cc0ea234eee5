"""Readers: CSV, JSON, Markdown taxonomy, XLSX and SQLite (as Python data sources), curated labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV file at ``path``, or an empty table of the schema where there is none."""
    return read_csv(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_inputs(spark: SparkSession, paths: list[str]) -> None:
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")


def first_available(spark: SparkSession, sources: list[tuple[str, bool]], schema: str, default: list[tuple]) -> DataFrame:
    """The first existing of ``(path, provisional)`` sources, else ``default``; ``provisional`` is a column."""
    for path, provisional in sources:
        if path_exists(spark, path):
            return read_csv(spark, path, schema).withColumn("provisional", F.lit(provisional))
    return spark.createDataFrame(default, schema).withColumn("provisional", F.lit(True))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(ord, key, polarity, label, definition) of a Markdown file: an index table and a section for each key."""
    page = spark.read.text(path, wholetext=True)
    row = r"(?m)^\|\s*(\d+)\s*\|\s*`?([a-z0-9_]+)`?\s*\|\s*(\w+)\s*\|\s*([^|\n]*?)\s*\|"
    section = r"(?ms)^###\s*\d+\.\s*`?([a-z0-9_]+)`?.*?\*\*Definition\.?\*\*\s*(.*?)(?=\n\s*\n|\n\*\*|\n#|\z)"

    def found(pattern: str, groups: list[str]) -> DataFrame:
        cols = [F.regexp_extract_all("value", F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)]
        return page.select(*cols).select(F.inline(F.arrays_zip(*groups)))

    index = found(row, ["ord", "key", "polarity", "label"]).withColumn("ord", F.col("ord").cast("int"))
    return index.join(found(section, ["key", "definition"]).withColumn("definition", F.trim(F.col("definition"), F.lit(" \n"))), "key", "left")


#: Columns of the curated labels and what they may hold.
LABEL_SCHEMA = "question_id string, question_number int, shorthand string, label string, method string, category string, asks_for string, notes string"


def label_violations(
    labels: DataFrame, vocabularies: dict[str, list[str]], implies: dict[str, str] | None = None, belongs: dict[str, list[str]] | None = None,
    present: tuple[str, ...] = ("label",), noted: tuple[str, ...] = (), digits: bool = True, numbered: bool = False, placeholder: str | None = None,
) -> DataFrame:
    """(rule, id, detail): every broken rule of every label, so that all are seen at once.

    Both editions' rules: ids and shorthands unique, shorthands in snake case, of 40 characters at most and, without
    ``digits``, free of them; ``present`` columns not empty; columns in their closed ``vocabularies`` (null is in none but
    that of a category's method), where a ``placeholder`` is named as what it is; a category ``implies`` a method, or needs
    one; a subcategory ``belongs`` to its category; ``noted`` ids carry notes; with ``numbered`` an id is Qnnn or Qnnn_s and
    agrees with its number columns. Rows are judged in one pass, repeats by counting."""
    has = set(labels.columns)
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    short = text("shorthand")
    rules: list[tuple[str, Column, str]] = [
        ("shorthand form", ~short.rlike("^[a-z][a-z0-9_]*$"), "shorthand"),
        ("shorthand length", F.length(short) > 40, "shorthand"),
        *((f"{c} present", text(c) == "", c) for c in present if c in has),
    ]
    if not digits:
        rules.append(("shorthand digits", short.rlike("[0-9]"), "shorthand"))
    for col, allowed in vocabularies.items():
        value = F.trim(F.col(col))
        rules.append((f"{col} vocabulary", value.isNotNull() & ~value.isin(*allowed) & ~value.eqNullSafe(F.lit(placeholder)), col))
        if placeholder is not None:
            rules.append((f"{col} placeholder", value == placeholder, col))
    if {"category", "method"} <= has:
        rules.append(("category needs method", F.col("category").isNotNull() & F.col("method").isNull(), "category"))
        for category, method in (implies or {}).items():
            rules.append(("category implies method", (F.col("category") == category) & (F.col("method") != method), "method"))
    for category, subs in (belongs or {}).items():
        rules.append(("subcategory of category", (F.col("category") == category) & ~text("subcategory").isin(*subs) & ~text("subcategory").eqNullSafe(F.lit(placeholder)), "subcategory"))
    if noted:
        rules.append(("notes required", F.col("question_id").isin(*noted) & (text("notes") == ""), "notes"))
    if numbered:
        number, sub = F.regexp_extract("question_id", r"^Q(\d{3})(?:_(\d))?$", 1), F.regexp_extract("question_id", r"^Q(\d{3})(?:_(\d))?$", 2)
        rules.append(("id form", number == "", "question_id"))
        rules.append(("number of id", (number != "") & (number.try_cast("int") != F.col("question_number")), "question_number"))
        if "sub_number" in has:
            rules.append(("sub number of id", (number != "") & (sub != text("sub_number")), "sub_number"))
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("detail"))) for rule, bad, c in rules)))
    found = labels.select(F.col("question_id").alias("id"), F.explode(broken).alias("x")).select("x.rule", "id", "x.detail")
    for col in ("question_id", "shorthand"):
        twice = labels.groupBy(col).agg(F.count("*").alias("_n")).where("_n > 1").select(col)
        found = found.unionByName(labels.join(twice, col, "left_semi").select(F.lit(f"{col} unique").alias("rule"), F.col("question_id").alias("id"), F.col(col).cast("string").alias("detail")))
    return found


def load_labels(spark: SparkSession, path: str, vocabularies: dict[str, list[str]], schema: str = LABEL_SCHEMA) -> DataFrame:
    labels = read_csv(spark, path, schema)
    wrong = [f"{r.id}: {r.rule} ({r.detail})" for r in label_violations(labels, vocabularies).limit(50).collect()]
    if wrong:
        raise ValueError("\n".join(wrong))
    return labels


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").schema(...).load(path)``: the first sheet, header row first, all cells text.

    For spreadsheets, so for files that one task can hold."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        header, _ = _sheet(self.options["path"])
        return ", ".join(f"`{h.replace('`', '')}` string" for h in header)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self.options["path"], len(schema))


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in _sheet(self.path)[1]:
            if any(row):
                yield tuple((row + [None] * self.width)[: self.width])


def _sheet(path: str) -> tuple[list[str], list[list[str | None]]]:
    import zipfile
    from xml.etree import ElementTree as E

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        names = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for r in E.fromstring(z.read(names[0])).iter(f"{ns}row"):
            row: list[str | None] = []
            for c in r.iter(f"{ns}c"):
                at = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                row += [None] * (at - 1 - len(row))
                v, t = c.find(f"{ns}v"), c.get("t")
                text = "".join(x.text or "" for x in c.iter(f"{ns}t")) if t == "inlineStr" else (v.text if v is not None else None)
                row.append(shared[int(text)] if t == "s" and text is not None else text)
            rows.append(row)
    return [h or f"column_{i + 1}" for i, h in enumerate(rows[0])] if rows else [], rows[1:]


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("table", t).load(path)``: read-only, by ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema], int(self.options.get("partitions", 4)))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        if not re.fullmatch(r"\w+", table):
            raise ValueError(f"no table name: {table}")
        self.path, self.table, self.columns, self.parts = path.removeprefix("file://"), table, columns, parts

    def _run(self, sql: str, args: tuple = ()) -> Iterator[tuple]:
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(sql, args)

    def partitions(self) -> list[_Range]:
        low, high = next(self._run(f'select min(rowid), max(rowid) from "{self.table}"'))
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(x, x + step) for x in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        cols = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        yield from self._run(f'select {cols} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


def register_sources(spark: SparkSession) -> None:
    for source in (XlsxSource, SqliteSource):
        spark.dataSource.register(source)
