"""From a wide grid of text cells to typed long tables: unpivot, shape inference, typing, options, codebook."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.ranking import spread


@dataclass(frozen=True)
class Rules:
    """Thresholds of shape inference and the option catalogue."""

    multi_share: float = 0.9
    single_max_chars: int = 320
    single_max_distinct: int = 12
    single_max_ratio: float = 0.35
    canonical_share: float = 0.05
    canonical_floor: int = 3
    other_max_chars: int = 60
    review_split: int = 5
    other_pattern: str = r"(?i)^other\b|\(please (specify|explain|describe)\)|\(describe\)|\(explain\)"
    off_scale: tuple[str, ...] = field(
        # fixed values
        default=(
            "not applicable", "not applicable (not a preparer)", "n/a", "na", "unsure", "unknown", "insufficient basis to assess", "no basis to assess",
            "not sure / no basis to assess", "prefer not to say", "no opinion", "don't know", "dont know",
        )
    )


def unpivot_grid(grid: DataFrame, id_col: str = "ID") -> DataFrame:
    """(respondent_id, column_index, header, source_chars, answer_text): one row for each cell with text.

    Cells and headers are normalised; a cell's length before that is kept, as it tells whether the survey tool cut it. Rows
    without any text vanish by themselves.
    """
    cols = [c for c in grid.columns if c != id_col]
    cells = [F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("raw")) for i, c in enumerate(cols)]
    long = grid.select(F.col(f"`{id_col}`").try_cast("bigint").alias("respondent_id"), F.inline(F.array(*cells))).where("raw is not null")
    return long.select("respondent_id", "column_index", T.norm_text(F.col("header")).alias("header"), F.length("raw").alias("source_chars"), T.norm_text(F.col("raw")).alias("answer_text")).where("answer_text <> ''")


def explode_selections(cells: DataFrame, keys: list[str], text_col: str = "answer_text", separator: str = ";") -> DataFrame:
    """(keys..., selection_index from 1, option_text): parts trimmed, empty ones dropped."""
    parts = F.filter(F.transform(F.split(text_col, separator), lambda x: F.trim(x)), lambda x: x != "")
    return cells.select(*keys, F.posexplode(parts).alias("pos", "option_text")).select(*keys, (F.col("pos") + 1).alias("selection_index"), "option_text")


def column_shape(cells: DataFrame, key: str, text_col: str = "answer_text", rules: Rules = Rules()) -> DataFrame:
    """Per question: filled, distinct, longest, share ending in ``;``, all one to five, and the inferred kind."""
    x = F.col(text_col)
    shape = cells.groupBy(key).agg(
        F.count("*").alias("filled"),
        F.countDistinct(x).alias("distinct_values"),
        F.max(F.length(x)).alias("max_chars"),
        F.avg(x.endswith(";").cast("int")).alias("semicolon_share"),
        F.bool_and(x.rlike("^[1-5]$")).alias("all_1_5"),
    )
    multi = F.col("semicolon_share") >= rules.multi_share
    few = (F.col("distinct_values") <= rules.single_max_distinct) | (F.col("distinct_values") / F.col("filled") <= rules.single_max_ratio)
    single = ~multi & (F.col("max_chars") <= rules.single_max_chars) & few
    return shape.withColumns({"is_multi": multi, "is_single": single, "is_free": ~multi & ~single})


def question_type(has_scale: Column, is_year: Column, has_ladder: Column, has_sub: Column) -> Column:
    """Type by precedence over the columns of :func:`column_shape`."""
    scale = F.when(F.col("all_1_5"), "likert_1_5").otherwise("scale_labeled")
    return (
        F.when(has_sub, "matrix_rating").when(F.col("is_multi"), "multi_select").when(has_scale, scale).when(is_year, "numeric_year")
        .when(has_ladder, "ordinal_select").when(F.col("is_single"), "single_select").otherwise("free_text")
    )


def option_catalogue(picks: DataFrame, answered: DataFrame, key: str, rules: Rules = Rules(), ladder: Column | None = None, standard: Column | None = None) -> DataFrame:
    """Options with counts, own-base share, canonical, other and off-scale flags, rank and order.

    ``picks`` (key, option_text, row_ord) are chosen options, ``answered`` (key, n_answered) the bases.
    Canonical: at least max(floor, share of the base) picks, or a short "other" label, or a standard option.
    Order: most chosen first, ties by first appearance.
    """
    opts = picks.groupBy(key, "option_text").agg(F.count("*").alias("n_selected"), F.min("row_ord").alias("first_seen")).join(answered, key)
    other = F.col("option_text").rlike(rules.other_pattern)
    often = F.col("n_selected") >= F.greatest(F.lit(float(rules.canonical_floor)), rules.canonical_share * F.col("n_answered"))
    canonical = often | (other & (F.length("option_text") <= rules.other_max_chars)) | (standard if standard is not None else F.lit(False))
    off = T.norm_key(F.col("option_text")).isin(*rules.off_scale)
    rank = F.when(~off, F.regexp_extract("option_text", "^([1-5])", 1).try_cast("int"))
    order = W.partitionBy(key).orderBy(F.desc("n_selected"), "first_seen", "option_text")
    return opts.select(
        key, "option_text", F.coalesce(ladder, rank).alias("option_rank") if ladder is not None else rank.alias("option_rank"),
        canonical.alias("is_canonical"), other.alias("is_other_option"), off.alias("is_off_scale"), "n_selected",
        F.round(100.0 * F.col("n_selected") / F.col("n_answered"), 2).alias("pct_of_answered"), F.row_number().over(order).alias("option_order"),
    )


def write_in_totals(options: DataFrame, key: str, rules: Rules = Rules()) -> DataFrame:
    """Per question: canonical options, write-in picks, and whether a write-in is frequent enough to review."""
    rare = F.when(~F.col("is_canonical"), F.col("n_selected"))
    return options.groupBy(key).agg(
        F.count_if("is_canonical").alias("n_options"),
        F.coalesce(F.sum(rare), F.lit(0)).alias("n_write_in_selections"),
        (F.coalesce(F.max(rare), F.lit(0)) >= rules.review_split).alias("review_option_split"),
    )


def respondent_engagement(responses: DataFrame, n_questions: int) -> DataFrame:
    """Per respondent: answers, substantive answers and their share, free-text answers and characters, picks."""
    free = F.col("question_type") == "free_text"
    real = F.col("role") != "profile"
    return spread(responses, "respondent_id").groupBy("respondent_id").agg(
        F.count("*").alias("n_questions_answered"),
        F.count_if(real).alias("n_substantive_answered"),
        F.round(100.0 * F.count_if(real) / n_questions, 1).alias("substantive_completion_pct"),
        F.count_if(free).alias("n_free_text_answers"),
        F.coalesce(F.sum(F.when(free, F.length("answer_text"))), F.lit(0)).alias("free_text_chars"),
        F.coalesce(F.sum("n_selected"), F.lit(0)).alias("n_multi_select_selections"),
    )


def widen(responses: DataFrame, question_ids: list[str], id_col: str = "respondent_id", key: str = "question_id") -> DataFrame:
    """One row per respondent; ``<id>`` and ``<id>_num`` for each of the listed questions."""
    out = spread(responses, id_col).groupBy(id_col).pivot(key, question_ids).agg(F.min("answer_text").alias("text"), F.min("answer_numeric").alias("num"))
    return out.withColumnsRenamed({f"{q}_text": q for q in question_ids})


def labelled(columns: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Inner join that fails unless each side covers the other."""
    for a, b, side in ((columns, labels, "label"), (labels, columns, "column")):
        missing = [r[0] for r in a.join(b, key, "left_anti").select(key).limit(10).collect()]
        if missing:
            raise ValueError(f"no {side} for {missing}")
    return columns.join(labels, key)


def frequency_ranks(counts: DataFrame, keys: list[str], option: str, n: str) -> DataFrame:
    """``counts`` with ``option_rank``: most frequent first within ``keys``, ties by name. Rows are options, not answers."""
    return counts.withColumn("option_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(n), option)))
