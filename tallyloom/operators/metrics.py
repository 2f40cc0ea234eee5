"""Second-stage arithmetic over published cells: votes, shifts, gradients, funnels, medians, modal answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.rounding import pct
from tallyloom.operators.ranking import grouped_medians


def dedup_votes(answers: DataFrame, group: Column, opposes: Column) -> DataFrame:
    """One vote for each group; it opposes only with a strict majority."""
    votes = answers.groupBy(group.alias("voter")).agg((F.avg(opposes.cast("double")) > 0.5).alias("opposes"))
    return votes.agg(F.count("*").alias("n_votes"), F.count_if("opposes").alias("n_oppose"), pct(F.count_if("opposes"), F.count("*")).alias("pct_oppose"))


def dedup_counts(answers: DataFrame, bloc: Column, answer: str) -> DataFrame:
    """Raw counts by answer, null answers too, and counts where a bloc gives each distinct answer once.

    Respondents without a bloc are one."""
    return answers.groupBy(answer).agg(F.count("*").alias("n"), F.countDistinct(F.struct(bloc.alias("who"))).alias("n_dedup"))


def theme_counts(coded: DataFrame, who: Column, id_col: str, themes: str = "theme_keys", question: str | None = None) -> DataFrame:
    """(theme, n, n_dedup, share_pct) of ``|``-joined themes; uncodeable answers are in no base.

    ``n`` counts respondents, ``n_dedup`` the members of a bloc once, and where ``question`` is given once for each question."""
    usable = coded.where(F.col(themes) != "uncodeable")
    each = usable.select(F.col(id_col).alias("id"), F.struct(who.alias("who"), F.col(question) if question else F.lit(0)).alias("who"), F.explode(F.split(themes, r"\|")).alias("theme"))
    base = usable.agg(F.countDistinct(id_col).alias("base"))
    counts = each.groupBy("theme").agg(F.countDistinct("id").alias("n"), F.countDistinct("who").alias("n_dedup"))
    return counts.crossJoin(F.broadcast(base)).select("theme", "n", "n_dedup", pct(F.col("n"), F.col("base")).alias("share_pct"))  # the base is one row


def median_mode(values: DataFrame, group: str, value: str, protest_over: float | None = None) -> DataFrame:
    """Rounded median (half up), first most frequent value, and how many lie over the protest limit."""
    over = F.col(value) > protest_over if protest_over is not None else F.lit(False)
    counts = values.where(~over & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    median = grouped_medians(counts, [group], value, "n").select(group, F.round((F.col("low") + F.col("high")) / 2).cast("long").alias("median"))
    first = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value")))
    mode = counts.groupBy(group).agg(first.alias("_m")).select(group, F.col("_m.value").alias("mode"), (-F.col("_m.less")).alias("mode_n"))
    protest = values.groupBy(group).agg(F.count_if(over).alias("n_protest"))
    return protest.join(median, group, "left").join(mode, group, "left")


def side_shift(cells: DataFrame, key: str, option: str, side: str, n: str, sides: tuple[str, str], material: float = 8.0) -> DataFrame:
    """Per question the option whose share differs most between two sides, and whether that is material."""
    wide = cells.groupBy(key, option).agg(*(F.coalesce(F.sum(F.when(F.col(side) == s, F.col(n))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(sides)))
    own = W.partitionBy(key)
    shift = F.round(100.0 * F.col("n0") / F.nullif(F.sum("n0").over(own), F.lit(0)) - 100.0 * F.col("n1") / F.nullif(F.sum("n1").over(own), F.lit(0)), 1)
    rank = F.row_number().over(own.orderBy(F.desc(F.abs("shift")), option))
    top = wide.withColumn("shift", shift).where("shift is not null").withColumn("r", rank).where("r = 1")
    return top.select(key, option, "shift", (F.abs("shift") >= material).alias("is_material"))


def gradient(df: DataFrame, group: str, flag: Column, min_n: int, k: int = 3) -> DataFrame:
    """Groups of at least ``min_n`` with the ``k`` highest and lowest shares of a flag."""
    rates = df.groupBy(group).agg(F.count("*").alias("total"), pct(F.count_if(flag), F.count("*")).alias("share")).where(F.col("total") >= min_n)
    top = F.row_number().over(W.orderBy(F.desc("share"), group))  # one row for each group
    bottom = F.row_number().over(W.orderBy("share", group))
    ranked = rates.withColumns({"top": top, "bottom": bottom})
    return ranked.where(f"top <= {k} or bottom <= {k}").select(group, "total", "share", (F.col("top") <= k).alias("is_top"), (F.col("bottom") <= k).alias("is_bottom"))


def attrition(counts: DataFrame, order: str, n: str) -> DataFrame:
    """The series with each step's change, and marks on the (first) peak and the (first) largest drop."""
    w = W.orderBy(order)  # one row for each question
    x = counts.withColumn("change", F.col(n) - F.lag(n).over(w))
    peak = F.row_number().over(W.orderBy(F.desc(n), order)) == 1
    drop = F.row_number().over(W.orderBy(F.asc_nulls_last("change"), order)) == 1
    return x.withColumns({"is_peak": peak, "is_largest_drop": drop & (F.col("change") < 0)})


def modal(cells: DataFrame, key: str, option: str, n: str, special: Column) -> DataFrame:
    """The most chosen option by question; special ones never win, ties go to the first by name."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(n), option))
    return cells.where(~special).withColumn("r", rank).where("r = 1").select(key, option, n)


def ladder_bins(counts: Column) -> Column:
    """(coarse, middle, fine) of a vector of counts by place around the middle rung."""
    half = F.floor(F.size(counts) / 2).cast("int")
    odd = F.size(counts) % 2

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)

    return F.struct(total(F.slice(counts, 1, half)).alias("coarse"), total(F.slice(counts, half + 1, odd)).alias("middle"), total(F.slice(counts, half + odd + 1, half)).alias("fine"))


def combine_cells(a: Column, b: Column) -> Column:
    """Two masked-or-not vectors added place by place; null if either is hidden."""
    return F.when(a.isNotNull() & b.isNotNull(), F.zip_with(a, b, lambda x, y: x + y))


def bands(x: Column, edges: list[float]) -> Column:
    """Half-open bands ``[edge, next)``; below the first is 0, from the last on the highest."""
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def lead_flip(counts: DataFrame, key: str, option: str, raw: str, dedup: str) -> DataFrame:
    """Per question the leader by either count, whether it changes, and the largest shift of a share."""
    own = W.partitionBy(key)
    x = counts.withColumns(
        {
            "r1": F.row_number().over(own.orderBy(F.desc(raw), option)), "r2": F.row_number().over(own.orderBy(F.desc(dedup), option)),
            "d": F.round(F.abs(100.0 * F.col(raw) / F.sum(raw).over(own) - 100.0 * F.col(dedup) / F.sum(dedup).over(own)), 1),
        }
    )
    return x.groupBy(key).agg(
        F.max(F.when(F.col("r1") == 1, F.col(option))).alias("lead_raw"), F.max(F.when(F.col("r2") == 1, F.col(option))).alias("lead_dedup"), F.max("d").alias("max_shift_pp")
    ).withColumn("flips", F.col("lead_raw") != F.col("lead_dedup"))


def browse(df: DataFrame, search: str = "", name: str = "name", equal: dict[str, object] | None = None, sort: str = "name", descending: bool = False, page: int = 0, size: int = 25) -> DataFrame:
    """A page of a table: substring of either case, equality filters, one sort column with ties by name."""
    if search:
        df = df.where(F.contains(F.lower(name), F.lit(search.lower())))
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    first = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return df.orderBy(first, name).offset(page * size).limit(size)
