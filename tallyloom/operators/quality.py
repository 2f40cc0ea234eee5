"""Data-quality checks as queries: each gives (check, ok, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """One row: no row of ``df`` is bad."""
    n = F.count_if(F.coalesce(bad, F.lit(False)))
    return df.agg(F.lit(name).alias("check"), (n == 0).alias("ok"), n.cast("string").alias("detail"))


def equal_totals(a: DataFrame, b: DataFrame, name: str, x: Column, y: Column) -> DataFrame:
    """One row: two totals over two tables are the same."""
    both = a.agg(x.alias("x")).crossJoin(b.agg(y.alias("y")))  # one row each
    return both.select(F.lit(name).alias("check"), F.col("x").eqNullSafe(F.col("y")).alias("ok"), F.concat_ws("=", F.col("x").cast("string"), F.col("y").cast("string")).alias("detail"))


def conservation(source: DataFrame, long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each source cell is in the long table once and unchanged: rows missing, added or different."""
    a = source.groupBy(*keys).agg(F.count("*").alias("n_a"), F.max(value).alias("v_a"))
    b = long.groupBy(*keys).agg(F.count("*").alias("n_b"), F.max(value).alias("v_b"))
    same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("v_a").eqNullSafe(F.col("v_b"))
    return check(a.join(b, keys, "full_outer"), "conservation", ~same)


def foreign_key(child: DataFrame, parent: DataFrame, key: str, parent_key: str, name: str) -> DataFrame:
    """Each value of a key names a parent."""
    orphans = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return orphans.agg(F.lit(name).alias("check"), (F.count("*") == 0).alias("ok"), F.count("*").cast("string").alias("detail"))


def bijection(declared: DataFrame, found: DataFrame, keys: list[str], name: str = "vocabulary") -> DataFrame:
    a, b = declared.select(*keys).distinct().withColumn("_a", F.lit(1)), found.select(*keys).distinct().withColumn("_b", F.lit(1))
    return check(a.join(b, keys, "full_outer"), name, F.col("_a").isNull() | F.col("_b").isNull())


def compare(published: DataFrame, again: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Published against recomputed rows: what differs, null-safe."""
    a = published.select(*keys, *(F.col(v).alias(f"{v}_published") for v in values), F.lit(1).alias("_a"))
    b = again.select(*keys, *(F.col(v).alias(f"{v}_again") for v in values), F.lit(1).alias("_b"))
    differs = reduce(lambda x, y: x | y, (~F.col(f"{v}_published").eqNullSafe(F.col(f"{v}_again")) for v in values), F.col("_a").isNull() | F.col("_b").isNull())
    return a.join(b, keys, "full_outer").where(differs).drop("_a", "_b")


def mask_placement(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Every breakdown of a small segment is hidden, and nothing of the whole is."""
    x = cells.join(values.select("dim", "key", F.col("masked").alias("must")), ["dim", "key"])
    return check(x, "mask placement", (F.col("must") & (F.col("dim") != "overall") & F.col("n").isNotNull()) | ((F.col("dim") == "overall") & F.col("n").isNull()))


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(checks: DataFrame) -> DataFrame:
    """``checks``, or an error that names those that fail."""
    failed = [f"{r['check']}: {r['detail']}" for r in checks.where("not ok").limit(20).collect()]
    if failed:
        raise ValueError("; ".join(failed))
    return checks
