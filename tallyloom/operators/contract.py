"""The contract of published JSON: a walk over nested documents as VARIANT, with all problems at once.

A document is parsed once. Each level is exploded in place, so nothing is shuffled but the problems found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What may stand at a path such as ``$.cells[*].n``.

    ``kind`` is object, array, string, number or boolean. ``low`` and ``high`` bound a number, or a string's length."""

    path: str
    kind: str
    required: bool = True
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean, null, or other."""
    schema = F.schema_of_variant(value)
    number = schema.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    named = [("^OBJECT", "object"), ("^ARRAY", "array"), ("^STRING", "string"), ("^BOOLEAN", "boolean")]
    known = reduce(lambda out, x: out.when(schema.rlike(x[0]), x[1]), named, F.when(F.is_variant_null(value), "null").when(number, "number"))
    return known.otherwise("other")


def walk(docs: DataFrame, doc: str, json: str, depth: int) -> DataFrame:
    """(doc, path, kind, value): every value down to ``depth`` levels below the root; places in arrays are ``[*]``.

    Documents that do not parse have no rows."""
    level = docs.select(F.col(doc).alias("doc"), F.lit("$").alias("path"), F.try_parse_json(json).alias("value")).where("value is not null")
    found = [level]
    for _ in range(depth):
        level = docs.sparkSession.sql(
            "select t.doc, case when e.key is null then t.path || '[*]' else t.path || '.' || e.key end as path, e.value from {level} t, lateral variant_explode(t.value) e", level=level
        )
        found.append(level)
    return reduce(DataFrame.unionByName, found).select("doc", "path", kind_of(F.col("value")).alias("kind"), "value")


def violations(docs: DataFrame, doc: str, json: str, rules: list[Rule]) -> DataFrame:
    """(doc, path, problem, n): where documents break ``rules``, which name all paths that there may be.

    Problems are unparsable, missing (a required key of an object that is there), null, type, range, value and unknown."""
    spark = docs.sparkSession
    depth = max(r.path.count(".") + r.path.count("[*]") for r in rules) + 1
    fields = "path string, want string, required boolean, nullable boolean, low double, high double, allowed array<string>"
    bound = lambda v: None if v is None else float(v)
    table = spark.createDataFrame([(r.path, r.kind, r.required, r.nullable, bound(r.low), bound(r.high), list(r.allowed)) for r in rules], fields)
    seen = walk(docs, doc, json, depth).join(F.broadcast(table), "path", "left")  # the rules are given in code
    number, text = F.expr("try_variant_get(value, '$', 'double')"), F.expr("try_variant_get(value, '$', 'string')")
    size = F.when(F.col("want") == "number", number).when(F.col("want") == "string", F.length(text))
    problem = (
        F.when(F.col("want").isNull(), "unknown").when((F.col("kind") == "null") & F.col("nullable"), None).when(F.col("kind") == "null", "null")
        .when(F.col("kind") != F.col("want"), "type").when((size < F.col("low")) | (size > F.col("high")), "range")
        .when((F.size("allowed") > 0) & ~F.array_contains("allowed", text), "value")
    )
    wrong = seen.select("doc", "path", problem.alias("problem")).where("problem is not null").groupBy("doc", "path", "problem").agg(F.count("*").alias("n"))
    parents = [(r.path, r.path.rpartition(".")[0]) for r in rules if r.required and not r.path.endswith("[*]") and r.path != "$"]
    pairs = spark.createDataFrame(parents, "path string, parent string")
    counts = seen.where("kind <> 'null' or nullable or want is not null").groupBy("doc", "path").agg(F.count("*").alias("k"), F.count_if(F.col("kind") == "object").alias("objects"))
    due = counts.where("objects > 0").select("doc", F.col("path").alias("parent"), "objects").join(F.broadcast(pairs), "parent")
    lacking = due.join(counts.select("doc", "path", "k"), ["doc", "path"], "left").withColumn("n", F.col("objects") - F.coalesce("k", F.lit(0))).where("n > 0")
    broken = docs.where(F.try_parse_json(json).isNull()).select(F.col(doc).alias("doc"), F.lit("$").alias("path"), F.lit("unparsable").alias("problem"), F.lit(1).cast("long").alias("n"))
    return wrong.unionByName(lacking.select("doc", "path", F.lit("missing").alias("problem"), "n")).unionByName(broken)


def not_canonical(docs: DataFrame, doc: str, json: str) -> DataFrame:
    """(doc) of documents that are not their own canonical form: sorted keys, no space, nothing twice."""
    return docs.where(~F.col(json).eqNullSafe(F.to_json(F.try_parse_json(json)))).select(doc)


def expected_groups(kind: str, members: DataFrame, group: str, id_col: str, expected: dict[str, int]) -> DataFrame:
    """(kind, name, expected, actual, ok): sizes of named groups (families, blocs) against what they must be.

    A group that is not there has none; groups that nobody expects are not listed."""
    want = members.sparkSession.createDataFrame([(k, int(v)) for k, v in expected.items()], "name string, expected long")
    sizes = members.groupBy(F.col(group).alias("name")).agg(F.countDistinct(id_col).alias("actual"))
    both = F.broadcast(want).join(sizes, "name", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.select(F.lit(kind).alias("kind"), "name", "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))


def several_groups(kind: str, members: DataFrame, group: str, id_col: str) -> DataFrame:
    """(kind, id, groups): who is in several groups of a kind of which everybody has one at most."""
    found = members.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set(group)).alias("groups"))
    return found.where(F.size("groups") > 1).select(F.lit(kind).alias("kind"), "id", "groups")


def expected_distribution(figure: str, values: DataFrame, value: str, expected: dict[str, int]) -> DataFrame:
    """(figure, value, expected, found, ok) of a whole distribution: values that nobody expects are wrong too."""
    want = values.sparkSession.createDataFrame([(k, int(v)) for k, v in expected.items()], "value string, expected long")
    have = values.groupBy(F.col(value).cast("string").alias("value")).agg(F.count("*").alias("found"))
    both = want.join(have, "value", "full_outer").select("value", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "found")))
    return both.select(F.lit(figure).alias("figure"), "value", "expected", "found", (F.col("expected") == F.col("found")).alias("ok"))


def leaked(published: DataFrame, name: str, redacted: DataFrame, id_col: str) -> DataFrame:
    """Published rows that carry a name of somebody who asked not to be named."""
    return published.where(F.col(name).isNotNull()).join(redacted.select(id_col), id_col, "left_semi")


def cell_problems(docs: DataFrame, doc: str, json: str, cells: str, sizes: DataFrame, mask: int, thin: int, masked: str = "<5") -> DataFrame:
    """(doc, dim, key, problem) of published cells: counts that do not add up to n, small segments that show, masked cells
    with counts, and thin marks that are not where they belong.

    ``cells`` is the path of the array of cells (dim, key, n, c, thin); ``sizes`` has (dim, key, n) of the segments."""
    each = docs.sparkSession.sql(
        f"select d.doc, e.value as v from {{docs}} d, lateral variant_explode(try_variant_get(d.v, '{cells}', 'variant')) e",
        docs=docs.select(F.col(doc).alias("doc"), F.try_parse_json(json).alias("v")),
    )
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    x = each.select("doc", get("dim", "string").alias("dim"), get("key", "string").alias("key"), get("n", "string").alias("shown"), get("c", "array<bigint>").alias("c"), F.coalesce(get("thin", "boolean"), F.lit(False)).alias("thin"))
    x = x.join(sizes.select("dim", "key", F.col("n").alias("size")), ["dim", "key"], "left").withColumn("n", F.col("shown").try_cast("bigint"))
    hidden = F.col("shown") == masked
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + b)
    checks = {
        "does not add up": ~hidden & ~total.eqNullSafe(F.col("n")),
        "shown though small": ~hidden & (F.col("size") < mask),
        "masked with counts": hidden & F.col("c").isNotNull(),
        "thin mark": ~hidden & (F.col("thin") != (F.col("n") < thin)),
        "no such segment": F.col("size").isNull(),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items())))
    return x.select("doc", "dim", "key", F.explode(found).alias("problem"))
