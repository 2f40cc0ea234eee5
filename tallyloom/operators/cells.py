"""Segments and disclosure-controlled cells. All panels come from one aggregation over answers x segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.rounding import pct

MASK, THIN = 5, 10
OVERALL = "overall"


def top_n_other(df: DataFrame, col: str, n: int, out: str = "key") -> DataFrame:
    """``df`` with ``out``: the value if among the ``n`` most frequent (ties by value), else ``other (k values)``.

    Null is a value. The head is a limit over counts by value, the tail is counted; no window orders all values."""
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    head = counts.orderBy(F.desc("_n"), "_v").limit(n).select("_v", F.lit(True).alias("_head"))
    values = counts.agg(F.count("*").alias("_k"))
    named = df.join(F.broadcast(head), F.col(col).eqNullSafe(F.col("_v")), "left").crossJoin(F.broadcast(values))  # one row
    other = F.concat(F.lit("other ("), (F.col("_k") - n).cast("string"), F.lit(" values)"))
    return named.withColumn(out, F.when(F.col("_head"), F.col(col)).otherwise(other)).drop("_v", "_head", "_k")


def segments_long(respondents: DataFrame, dims: dict[str, Column], id_col: str = "respondent_id", overall: bool = True) -> DataFrame:
    """(respondent_id, dim, key): one row for each dimension, and a dimension of everybody."""
    pairs = [F.struct(F.lit(d).alias("dim"), c.cast("string").alias("key")) for d, c in dims.items()]
    if overall:
        pairs.append(F.struct(F.lit(OVERALL).alias("dim"), F.lit("all").alias("key")))
    return respondents.select(id_col, F.inline(F.array(*pairs)))


def segment_values(segments: DataFrame, mask: int = MASK, id_col: str = "respondent_id") -> DataFrame:
    """(dim, key, n, masked): sizes are public, breakdowns of fewer than ``mask`` are not."""
    return segments.groupBy("dim", "key").agg(F.countDistinct(id_col).alias("n")).withColumn("masked", F.col("n") < mask)


def lost_answers(answers: DataFrame, segments: DataFrame) -> DataFrame:
    """Answers of respondents without a segment. There must be none; cells count only those that have one."""
    return answers.join(segments, "respondent_id", "left_anti")


def covered(answers: DataFrame, segments: DataFrame) -> DataFrame:
    """``answers``, unless a respondent has no segment: that raises."""
    lost = lost_answers(answers, segments).limit(1).count()
    if lost:
        raise ValueError("answers of respondents without a segment")
    return answers


def by_segment(answers: DataFrame, segments: DataFrame, values: list[str]) -> DataFrame:
    """(values..., dim, key, n): how many answers of each segment have these values.

    A respondent's segments are one combination. Answers are summed by values and combination, which is the only time that
    they are shuffled after they have met their respondent; the sums alone are then spread over the dimensions."""
    held = segments.groupBy("respondent_id").agg(F.array_sort(F.collect_list(F.struct("dim", "key"))).alias("_all"))
    summed = answers.join(held, "respondent_id").groupBy(*values, "_all").agg(F.count("*").alias("_n"))
    return summed.select(*values, "_n", F.inline("_all")).groupBy(*values, "dim", "key").agg(F.sum("_n").alias("n"))


def likert_cells(answers: DataFrame, segments: DataFrame, rungs: list[int], mask: int = MASK, key: str = "question_number") -> DataFrame:
    """Per question, dim and key: counts by rung, off-scale count, n on the scale, mean; masked ones are null."""
    x, k = F.col("answer_numeric"), F.col("_k")
    sizes = segment_values(segments, mask).select("dim", "key", "masked")
    counts = by_segment(answers, segments, [key, "answer_numeric"]).withColumnRenamed("n", "_k")

    def held(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, k)), F.lit(0))

    on = held(x.isNotNull())
    cells = counts.groupBy(key, "dim", "key").agg(
        F.array(*(held(x == r) for r in rungs)).alias("c"), held(x.isNull()).alias("off"), on.alias("n"), F.round(F.sum(x * k) / F.nullif(on, F.lit(0)), 2).alias("mean")
    )
    cells = cells.join(sizes, ["dim", "key"])
    hide = F.col("masked") & (F.col("dim") != OVERALL)
    return cells.select(key, "dim", "key", *(F.when(~hide, F.col(c)).alias(c) for c in ("c", "off", "n", "mean")), hide.alias("masked"))


def stance_cells(answers: DataFrame, segments: DataFrame, ladder: list[str], mask: int = MASK, thin: int = THIN, key: str = "question_number", policy: str = "reference") -> DataFrame:
    """Counts in ladder order with two tiers: cells under ``mask`` answers hidden, under ``thin`` marked.

    ``policy="complementary"`` hides a second cell of a dimension where a single hidden one could be had by
    subtracting its siblings from the whole: the smallest other cell."""
    a = F.col("answer_text")
    sizes = segment_values(segments, mask).select("dim", "key", "masked")
    counts = by_segment(answers, segments, [key, "answer_text"])
    held = [F.coalesce(F.sum(F.when(a == v, F.col("n"))), F.lit(0)) for v in ladder]
    cells = counts.groupBy(key, "dim", "key").agg(F.array(*held).alias("c"), F.coalesce(F.sum(F.when(a.isin(*ladder), F.col("n"))), F.lit(0)).alias("n"))
    cells = cells.join(sizes, ["dim", "key"])
    part = F.col("dim") != OVERALL
    cells = cells.withColumn("hide", part & (F.col("masked") | (F.col("n") < mask)))
    if policy == "complementary":
        own = W.partitionBy(key, "dim")
        rank = F.row_number().over(own.orderBy("hide", "n", "key"))
        cells = cells.withColumns({"_one": F.count_if("hide").over(own), "_rank": rank})
        cells = cells.withColumn("hide", F.col("hide") | (part & (F.col("_one") == 1) & (F.col("_rank") == 1)))
    thinly = part & ~F.col("hide") & (F.col("n") < thin)
    return cells.select(key, "dim", "key", F.when(~F.col("hide"), F.col("c")).alias("c"), F.when(~F.col("hide"), F.col("n")).alias("n"), thinly.alias("thin"), F.col("hide").alias("masked"))


def pick_cells(selections: DataFrame, segments: DataFrame, mask: int = MASK, key: str = "question_number", option: str = "option_text") -> DataFrame:
    """Distinct respondents by option and segment; masked by the segment's size only."""
    sizes = segment_values(segments, mask).select("dim", "key", "masked")
    cells = by_segment(selections.select(key, option, "respondent_id").distinct(), segments, [key, option]).join(sizes, ["dim", "key"])
    hide = F.col("masked") & (F.col("dim") != OVERALL)
    return cells.select(key, option, "dim", "key", F.when(~hide, F.col("n")).alias("n"), hide.alias("masked"))


def picklist(selections: DataFrame, answered: DataFrame, key: str = "question_number", option: str = "option_text") -> DataFrame:
    """Option, distinct respondents, and their share of the question's own base."""
    n = selections.groupBy(key, option).agg(F.countDistinct("respondent_id").alias("n"))
    return n.join(answered, key).select(key, option, "n", pct(F.col("n"), F.col("n_answered")).alias("pct"))


def stance_bucket(score: Column) -> Column:
    return F.when(score <= 2, "oppose").when(score == 3, "neutral").when(score > 3, "support").otherwise("no_anchor")


def basis_panel(selections: DataFrame, stance: DataFrame, option: str = "option_text") -> DataFrame:
    """Options by stance bucket with each bucket's own base of answerers; respondents without a stance apart."""
    joined = selections.join(stance, "respondent_id", "left").withColumn("bucket", stance_bucket(F.col("score")))
    base = joined.groupBy("bucket").agg(F.countDistinct("respondent_id").alias("base"))
    cells = joined.groupBy(option, "bucket").agg(F.countDistinct("respondent_id").alias("n"))
    return cells.join(F.broadcast(base), "bucket").select(option, "bucket", "n", "base", pct(F.col("n"), F.col("base")).alias("pct"))


def rate_by(df: DataFrame, group: str, flag: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), pct(F.count_if(flag), F.count("*")).alias("pct"))


def scoreboard(left: DataFrame, right: DataFrame, option: str = "option_text") -> DataFrame:
    """Two picklists (option, n, base) side by side; each share on its own base, the net of the rounded shares."""
    a = left.select(F.col(option), F.col("n").alias("n_left"), pct(F.col("n"), F.col("base")).alias("pct_left"))
    b = right.select(F.col(option), F.col("n").alias("n_right"), pct(F.col("n"), F.col("base")).alias("pct_right"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_left", "n_right")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("pct_left", "pct_right")}
    return a.join(b, option, "full_outer").withColumns(zero).withColumn("net", F.round(F.col("pct_left") - F.col("pct_right"), 1))


def distribution(df: DataFrame, col: str, vocabulary: list[str]) -> DataFrame:
    """A closed vocabulary in its order with counts, zero where nothing is."""
    order = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(vocabulary)], f"`{col}` string, ord int")
    out = F.broadcast(order).join(df.groupBy(col).agg(F.count("*").alias("n")), col, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("pct", pct(F.col("n"), F.sum("n").over(W.partitionBy())))  # one row for each word of the vocabulary
