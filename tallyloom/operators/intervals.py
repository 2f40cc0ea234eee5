"""Points in intervals from a table: a range join by bins, and what is wrong with a table of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import running_max, running_total

#: Bins that an interval covers at its level at most; a wider one goes to a level of bins that many times as wide.
FAN_OUT = 16


def _level(width: Column, bin_width: float) -> Column:
    bins = F.greatest(width / bin_width, F.lit(1.0))
    return F.greatest(F.ceil(F.log(float(FAN_OUT), bins) - 1e-9), F.lit(0)).cast("int")


def within(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, bin_width: float) -> DataFrame:
    """All pairs of a row of ``points`` and a row of ``intervals`` with low <= point < high.

    An interval is exploded into the bins that it touches, at most ``FAN_OUT`` + 1: wide intervals have bins of their own
    level, ``FAN_OUT`` times as wide each. A point looks into its bin of every level there is. Both meet by an equi-join on
    level and bin, and the ends are checked; no pair is found twice, as a point has one bin at a level. A null end is open.
    Null points are in no interval, nor is any point in one that ends where it starts or before."""
    ends = points.agg(F.min(point).cast("double").alias("a"), F.max(point).cast("double").alias("b")).first()
    if ends.a is None:
        ends = points.sparkSession.range(1).selectExpr("cast(0 as double) as a", "cast(0 as double) as b").first()
    # beyond the points nothing needs to be covered
    a, b = F.greatest(F.coalesce(F.col(low).cast("double"), F.lit(ends.a)), F.lit(ends.a)), F.least(F.coalesce(F.col(high).cast("double"), F.lit(ends.b)), F.lit(ends.b))
    fine = intervals.where((F.col(low).isNull() | F.col(high).isNull() | (F.col(low) < F.col(high)))).withColumns({"_a": a, "_b": b}).where("_a <= _b")
    fine = fine.withColumn("_level", _level(F.col("_b") - F.col("_a"), bin_width))
    wide = F.lit(float(bin_width)) * F.pow(F.lit(float(FAN_OUT)), F.col("_level"))
    cut = fine.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / wide), F.floor(F.col("_b") / wide)))).drop("_a", "_b")
    levels = [r[0] for r in fine.select("_level").distinct().collect()]  # a logarithm of the range of points
    if not levels:
        return points.limit(0).crossJoin(intervals.limit(0))
    own = F.array(*(F.struct(F.lit(k).alias("_level"), F.floor(F.col(point).cast("double") / (bin_width * float(FAN_OUT) ** k)).alias("_bin")) for k in sorted(levels)))
    probes = points.where(F.col(point).isNotNull()).select("*", F.inline(own))
    met = probes.join(cut, ["_level", "_bin"])
    met = met.where((F.col(low).isNull() | (F.col(point) >= F.col(low))) & (F.col(high).isNull() | (F.col(point) < F.col(high))))
    return met.drop("_level", "_bin")


def summarised(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, name: str) -> DataFrame:
    """(name, n, least, most): how many points lie in the intervals of a name, and the outermost, as :func:`within` pairs them.

    No pairs are made, so wide intervals cost what narrow ones do: the ends are sorted among the distinct points. An interval has
    the points before its high end less those before its low one, from the first after the low to the last before the high.
    Names without a point have no row."""
    values = points.where(F.col(point).isNotNull()).groupBy(F.col(point).alias("_v")).agg(F.count("*").alias("_c"))
    given = intervals.where(F.col(low).isNull() | F.col(high).isNull() | (F.col(low) < F.col(high)))
    given = given.groupBy(F.col(name).alias("_name"), F.col(low).cast("double").alias("_low"), F.col(high).cast("double").alias("_high")).agg(F.count("*").alias("_same"))
    own = [F.col(c) for c in ("_name", "_low", "_high", "_same")]

    def end(column: str, open_end: int, is_high: bool) -> DataFrame:
        # an open end is before or after all points; ends come before points that are equal to them
        side = F.when(F.col(column).isNull(), open_end).otherwise(1)
        return given.select(*own, F.lit(is_high).alias("_is_high"), side.alias("_side"), (F.col(column) + 0.0).alias("_pos"), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema[point].dataType).alias("_v"), F.lit(0).cast("long").alias("_c"))

    marks = values.select(F.lit(1).alias("_side"), (F.col("_v").cast("double") + 0.0).alias("_pos"), F.lit(1).alias("_kind"), "_v", "_c")
    line = end("_low", 0, False).unionByName(end("_high", 2, True)).unionByName(marks, allowMissingColumns=True)
    order = [F.col(c) for c in ("_side", "_pos", "_kind")]
    line = running_max(running_total(line, order, "_c", "_upto"), order, F.col("_v"), "_last")
    no_number = F.isnan(F.col("_v").cast("double"))  # the largest value, also when negated
    nearest = F.when(F.col("_v").isNotNull(), F.struct((~no_number).alias("number"), (-F.col("_v")).alias("v")))
    line = running_max(line, [c.desc() for c in order], nearest, "_next")
    at_low, at_high = (lambda c: F.max(F.when(~F.col("_is_high"), F.col(c)))), (lambda c: F.max(F.when(F.col("_is_high"), F.col(c))))
    each = line.where("_kind = 0").groupBy(*own).agg((at_high("_upto") - at_low("_upto")).alias("_n"), (-at_low("_next")["v"]).alias("_least"), at_high("_last").alias("_most"))
    return each.where("_n > 0").groupBy(F.col("_name").alias(name)).agg(F.sum(F.col("_n") * F.col("_same")).alias("n"), F.min("_least").alias("least"), F.max("_most").alias("most"))


def interval_faults(intervals: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """(name, fault, a, b): intervals that end before they start, overlap one that starts earlier, or leave a gap before them.

    ``a`` and ``b`` are the ends of the overlap or gap. Sorted by start, each looks at the largest end before it. A null end is
    open and leaves no gap on its side."""
    lower, upper = F.coalesce(F.col(low).cast("double"), F.lit(float("-inf"))), F.coalesce(F.col(high).cast("double"), F.lit(float("inf")))
    x = intervals.select(F.col(name).alias("name"), lower.alias("low"), upper.alias("high"))
    empty = x.where("low >= high").select("name", F.lit("empty").alias("fault"), F.col("low").alias("a"), F.col("high").alias("b"))
    before = running_max(x.where("low < high"), [F.col("low"), F.col("high"), F.col("name")], F.col("high"), "upto")
    overlap = F.col("upto") > F.col("low")
    a, b = F.when(overlap, F.col("low")).otherwise(F.col("upto")), F.when(overlap, F.least("high", "upto")).otherwise(F.col("low"))
    wrong = before.where("upto <> low").select("name", F.when(overlap, "overlap").otherwise("gap").alias("fault"), a.alias("a"), b.alias("b"))
    return empty.unionByName(wrong)
