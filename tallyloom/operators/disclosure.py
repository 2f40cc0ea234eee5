"""Can a hidden cell be had back? Published tables are equations between cells; what these settle is propagated to the end.

A table's margins say that signed cells add up to nothing (parts less their whole). An equation with one hidden cell gives
that cell away; one whose hidden cells are counts of one sign with nothing left over makes them all zero. What is found is
known in the next round, in every other equation that holds the cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import use_checkpoints


def two_way(counts: DataFrame, table: str, row: str, column: str, n: str, hidden: Column) -> tuple[DataFrame, DataFrame]:
    """(cells, terms) of tables of ``row`` by ``column`` with both margins and the whole: ``hidden`` says of each published
    row (table, row, column, n; null row or column for margins) whether its count is left out."""
    every = counts.groupBy(table, row, column).agg(F.sum(n).alias("n"))
    margins = [(row, column), (row,), (column,), ()]

    def level(keys: tuple) -> DataFrame:
        own = every.groupBy(table, *keys).agg(F.sum("n").alias("n"))
        return own.select(table, *((F.col(k) if k in keys else F.lit(None).cast("string")).cast("string").alias(k) for k in (row, column)), "n")

    published = reduce(DataFrame.unionByName, map(level, margins)).withColumn("cell", F.to_json(F.array(F.col(table).cast("string"), row, column)))
    cells = published.select("cell", F.when(~hidden, F.col("n")).cast("long").alias("value"))
    within = F.col(row).isNotNull() & F.col(column).isNotNull()

    def equation(part: Column, whole: Column, kept: str | None, name: str) -> DataFrame:
        key = F.concat_ws("/", F.lit(name), F.col(table).cast("string"), *([kept] if kept else []))
        return published.where(part | whole).select(key.alias("equation"), "cell", F.when(whole, -1).otherwise(1).alias("sign"))

    none = F.col(row).isNull() & F.col(column).isNull()
    parts = [
        equation(within, F.col(row).isNotNull() & F.col(column).isNull(), row, "row"),
        equation(within, F.col(row).isNull() & F.col(column).isNotNull(), column, "column"),
        equation(F.col(row).isNotNull() & F.col(column).isNull(), none, None, "rows"),
        equation(F.col(row).isNull() & F.col(column).isNotNull(), none, None, "columns"),
    ]
    # an equation of margins has no within cells; those of rows and columns leave out the whole's own row
    return cells, reduce(DataFrame.unionByName, parts)


def revealed(cells: DataFrame, terms: DataFrame, rounds: int = 100) -> DataFrame:
    """(cell, value, step): hidden cells that the published ones give away, with the round in which.

    ``cells`` is (cell, value), null where hidden; counts are not negative. ``terms`` is (equation, cell, sign): signed cells
    of an equation add up to nothing. Each round is two grouped aggregations; it ends when one finds nothing."""
    use_checkpoints(cells.sparkSession)
    state = cells.select("cell", "value", F.when(F.col("value").isNotNull(), 0).alias("step")).checkpoint()
    for step in range(1, rounds + 1):
        both = terms.join(state.select("cell", "value"), "cell")
        unknown = F.col("value").isNull()
        sums = both.groupBy("equation").agg(
            F.count_if(unknown).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("value")), F.lit(0)).alias("rest"),
            F.min(F.when(unknown, F.col("sign"))).alias("low"), F.max(F.when(unknown, F.col("sign"))).alias("high"),
        ).where("n = 1 or (n > 1 and rest = 0 and low = high)")
        found = both.where(unknown).join(sums, "equation").groupBy("cell").agg(F.min(F.when(F.col("n") == 1, -F.col("rest") * F.col("sign")).otherwise(0)).alias("found")).checkpoint()
        if found.isEmpty():
            break
        state = state.join(found, "cell", "left").select("cell", F.coalesce("value", "found").alias("value"), F.coalesce("step", F.when(F.col("found").isNotNull(), step)).alias("step")).checkpoint()
    return state.where("step > 0")
