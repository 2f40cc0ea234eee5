"""Queries of the interactive views: heatmap, strips, drills, citation blocks, headcounts, entity variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.rounding import pct
from tallyloom.operators.ranking import grouped_medians, spread


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, v: a + v)


def thirds(counts: Column) -> tuple[Column, Column, Column]:
    """Counts below, at and above the middle rung of a vector; an even one has no middle."""
    half = F.floor(F.size(counts) / 2).cast("int")
    odd = F.size(counts) % 2
    return _total(F.slice(counts, F.lit(1), half)), _total(F.slice(counts, half + 1, odd)), _total(F.slice(counts, half + odd + 1, half))


def heatmap(cells: DataFrame, questions: DataFrame, sizes: DataFrame, dim: str, metric: str, min_n: int = 15, key: str = "question_number") -> DataFrame:
    """(question, key, state, value): each question by each segment of ``dim`` with ``min_n`` respondents.

    ``metric`` is support, oppose, mean or net. A cell is masked, empty (no answer on the scale) or data; only data
    has a value. ``questions`` and segments are few, so every pair of them is a cell."""
    columns = sizes.where((F.col("dim") == dim) & (F.col("n") >= min_n)).select("key", F.col("masked").alias("_masked"))
    grid = questions.select(key).distinct().crossJoin(F.broadcast(columns))  # a codebook by a dimension's values
    low, _, high = thirds(F.col("c"))
    values = {"support": pct(high, F.col("n")), "oppose": pct(low, F.col("n")), "mean": F.col("mean"), "net": F.round(pct(high, F.col("n")) - pct(low, F.col("n")), 1)}
    own = cells.where(F.col("dim") == dim).select(key, "key", "c", "n", "mean", "masked")
    joined = grid.join(own, [key, "key"], "left")
    state = F.when(F.coalesce("masked", "_masked"), "masked").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("data")
    return joined.select(key, "key", state.alias("state"), F.when(state == "data", values[metric]).alias("value"))


def strip(cells: DataFrame, wanted: list[int], dim: str, key: str = "question_number") -> DataFrame:
    """(question, key, n, pct_low, pct_mid, pct_high) of some questions, in the order in which they are named; hidden cells are null."""
    low, mid, high = thirds(F.col("c"))
    order = reduce(lambda out, x: F.when(F.col(key) == x[1], x[0]).otherwise(out), enumerate(wanted), F.lit(None).cast("int"))
    own = cells.where((F.col("dim") == dim) & F.col(key).isin(wanted))
    return own.select(key, order.alias("ord"), "key", "n", *(pct(x, F.col("n")).alias(f"pct_{name}") for x, name in ((low, "low"), (mid, "mid"), (high, "high"))))


def citation_blocks(memberships: DataFrame, cites: Column, clusters: DataFrame, block: str = "block") -> DataFrame:
    """(block, n_answers, n_citing, n_sharers): distinct texts with a citation beside the cluster that shares them, if any."""
    own = memberships.groupBy(block).agg(F.count("*").alias("n_answers"), F.count_if(cites).alias("n_citing")).where(F.col("n_citing") > 0)
    return own.join(clusters.select(F.col("cluster").alias(block), F.col("n").alias("n_sharers")), block, "left")


def citation_interval(blocks: DataFrame, answers: int) -> DataFrame:
    """(n_blocks, n_citing, lo_pct, hi_pct): citing answers as a share of all, each shared text once, and each answer."""
    hi = F.sum("n_citing")
    return blocks.agg(F.count("*").alias("n_blocks"), hi.alias("n_citing"), pct(F.count("*"), F.lit(answers)).alias("lo_pct"), pct(hi, F.lit(answers)).alias("hi_pct"))


def turnout(respondents: DataFrame, answers: DataFrame, redacted: Column) -> DataFrame:
    """One row: respondents, those named and redacted, those who answered, answers, and answers for each respondent.

    A respondent whose flag is null counts as redacted."""
    hidden = F.coalesce(redacted, F.lit(True))
    heads = respondents.agg(F.count("*").alias("n_respondents"), F.count_if(hidden).alias("n_redacted"), F.count_if(~hidden).alias("n_named"))
    given = answers.agg(F.countDistinct("respondent_id").alias("n_answering"), F.count("*").alias("n_answers"))
    return heads.crossJoin(F.broadcast(given)).withColumn("per_respondent", F.round(F.col("n_answers") / F.col("n_respondents"), 1))  # one row each


def bloc_countries(members: DataFrame, bloc: str, country: str) -> DataFrame:
    """(bloc, n_members, n_countries, single_country): a country is published as a count only, never by name."""
    n = F.countDistinct(country)
    return members.groupBy(bloc).agg(F.count("*").alias("n_members"), n.alias("n_countries"), (n == 1).alias("single_country"))


def lead_stats(members: DataFrame, bloc: str, kind: str, groups: dict[str, list[str]]) -> DataFrame:
    """Per bloc its size and, for each named group of organisation types, its members and their share; groups may overlap."""
    parts = [(name, F.count_if(F.col(kind).isin(types))) for name, types in groups.items()]
    n = F.count("*")
    return members.groupBy(bloc).agg(n.alias("n"), *(c.alias(f"n_{name}") for name, c in parts), *(pct(c, n).alias(f"pct_{name}") for name, c in parts))


def _holds(search: str, *columns: str) -> Column:
    text = F.concat_ws(" ", *columns)
    return F.contains(F.lower(text), F.lit(search.lower())) if search else F.lit(True)


def audit_drill(audit: DataFrame, moved_only: bool = False, claimed: str | None = None, audited: str | None = None, search: str = "") -> DataFrame:
    """Rows of an audit (name, basis, claimed, audited): moved ones, one class, a substring of name and basis in either case."""
    out = audit.where(_holds(search, "name", "basis"))
    out = out.where("not claimed <=> audited") if moved_only else out
    for column, wanted in (("claimed", claimed), ("audited", audited)):
        out = out.where(F.col(column) == wanted) if wanted is not None else out
    return out


def quote_filter(quotes: DataFrame, themes: list[str] | None = None, template_only: bool = False, **equal: object) -> DataFrame:
    """Quotes by equality of columns, any of some themes, and being a shared text."""
    for column, wanted in equal.items():
        quotes = quotes.where(F.col(column) == wanted)
    if themes:
        quotes = quotes.where(F.arrays_overlap("themes", F.array(*map(F.lit, themes))))
    return quotes.where("is_template") if template_only else quotes


def named_profile(answers: DataFrame, hidden: list[int]) -> DataFrame:
    """Profile answers of respondents who may be named, without the ``hidden`` questions."""
    return answers.where(~F.col("is_redacted") & (F.col("role") == "profile") & ~F.col("question_number").isin(hidden))


def public_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only columns that may be published; one that is missing raises."""
    missing = [c for c in allowed if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*allowed)


def audit_of_blocs(audit: DataFrame, members: DataFrame) -> DataFrame:
    """(bloc, audited, n): audited classes of the members of each bloc."""
    return audit.join(members, "respondent_id").groupBy("bloc", "audited").agg(F.count("*").alias("n"))


def answer_index(answers: DataFrame, selections: DataFrame, base: DataFrame) -> DataFrame:
    """(question, answer, n, pickers) of the base: how many gave an answer, as a text or as a pick."""
    given = answers.select("question_number", F.col("answer_text").alias("answer"), "respondent_id", F.lit(False).alias("pick"))
    picked = selections.select("question_number", F.col("option_text").alias("answer"), "respondent_id", F.lit(True).alias("pick"))
    # the base is spread, as a semi-join passes below what its left side is dealt by
    own = given.unionByName(picked).join(spread(base.select("respondent_id"), "respondent_id"), "respondent_id", "left_semi")
    return own.groupBy("question_number", "answer").agg(F.count_if(~F.col("pick")).alias("n"), F.countDistinct(F.when(F.col("pick"), F.col("respondent_id"))).alias("pickers"))


def entity_variants(left: DataFrame, right: DataFrame, min_tokens: int = 2) -> DataFrame:
    """(left_id, right_id, tier): equal keys are exact; one name's words all in the other's, ``min_tokens`` (2 at least) of
    them, a variant.

    Both sides are (id, key); empty keys match nothing. A shorter name is looked up by its two rarest words together among
    the pairs of words of longer names, so words that many names have join nothing by themselves. An entity of either side
    with an exact match has no variants."""

    def words(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{name}_id"), F.col("key").alias(f"{name}_key"), F.array_sort(F.array_distinct(F.split("key", " "))).alias(f"{name}_words"))

    a, b = words(left.where("key <> ''"), "left"), words(right.where("key <> ''"), "right")
    exact = a.join(b, F.col("left_key") == F.col("right_key")).select("left_id", "right_id", F.lit("exact").alias("tier"))
    a = a.join(exact.select("left_id").distinct(), "left_id", "left_anti")
    b = b.join(exact.select("right_id").distinct(), "right_id", "left_anti")

    def inside(short: DataFrame, long: DataFrame, s: str, l: str) -> DataFrame:
        held = long.select(F.explode(f"{l}_words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
        each = short.where(F.size(f"{s}_words") >= max(2, min_tokens)).select(f"{s}_id", f"{s}_words", F.explode(f"{s}_words").alias("word")).join(held, "word", "left")
        # a word that no longer name has rules the name out
        rare = each.groupBy(f"{s}_id", f"{s}_words").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w")).where("least > 0")
        rare = rare.select(f"{s}_id", f"{s}_words", F.array_sort(F.array(F.col("w")[0]["word"], F.col("w")[1]["word"])).alias("two"))
        pair = F.flatten(F.transform(f"{l}_words", lambda x: F.transform(F.filter(f"{l}_words", lambda y: y > x), lambda y: F.array(x, y))))
        met = rare.join(long.where(F.size(f"{l}_words") > 2).select(f"{l}_id", f"{l}_words", F.explode(pair).alias("two")), "two")
        met = met.where((F.size(F.array_except(f"{s}_words", f"{l}_words")) == 0) & (F.size(f"{s}_words") < F.size(f"{l}_words")))
        return met.select("left_id", "right_id", F.lit("variant").alias("tier"))

    return exact.unionByName(inside(a, b, "left", "right").unionByName(inside(b, a, "right", "left")).distinct())


def cross_matches(left: DataFrame, right: DataFrame, id_col: str, name: str, redacted: str, excluded: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, tier) of organisations of two consultations, by :func:`entity_variants` of their keys.

    Both-named rule: whoever is redacted on either side, or whose flag is null, is matched with nobody and listed nowhere.
    Placeholders and ``excluded`` ids of the right side take no part either."""
    if excluded is not None:
        right = right.join(excluded.select(id_col), id_col, "left_anti")

    def named(df: DataFrame) -> DataFrame:
        fine = df.where(~F.coalesce(F.col(redacted), F.lit(True)) & ~T.is_placeholder(F.col(name)))
        return fine.select(F.col(id_col).alias("id"), T.entity_key(F.col(name)).alias("key"))

    return entity_variants(named(left), named(right))


def rare_tail(df: DataFrame, group: str, flag: Column, min_n: int = 5) -> DataFrame:
    """(group, n, n_flagged): groups of fewer than ``min_n`` are one row, ``other``; a null group of ``min_n`` or more stays null."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"))
    named = F.when(F.col("n") < min_n, "other").otherwise(F.col(group))
    return sizes.groupBy(named.alias(group)).agg(F.sum("n").alias("n"), F.sum("n_flagged").alias("n_flagged"))


def basis_by_type(selections: DataFrame, stance: DataFrame, types: DataFrame, bucket: Column, option: str = "option_text", kind: str = "organization_type") -> DataFrame:
    """(option, bucket, type, n, base, pct): as the basis panel, with each bucket's own base within a type."""
    joined = selections.join(stance, "respondent_id", "left").withColumn("bucket", bucket).join(types.select("respondent_id", kind), "respondent_id")
    base = joined.groupBy("bucket", kind).agg(F.countDistinct("respondent_id").alias("base"))
    cells = joined.groupBy(option, "bucket", kind).agg(F.countDistinct("respondent_id").alias("n"))
    return cells.join(base, ["bucket", kind]).select(option, "bucket", kind, "n", "base", pct(F.col("n"), F.col("base")).alias("pct"))


def verbosity(lengths: DataFrame, group: str, n_words: str, edges: list[int]) -> DataFrame:
    """(group, band, n, median, max): bands in order, empty ones too, up to the last that is not empty.

    Answers without words are band -1, which is there only if it has any; median and maximum are over those with words."""
    x = F.col(n_words)
    band = F.when(F.coalesce(x, F.lit(0)) == 0, -1).otherwise(sum(((x >= e).cast("int") for e in edges), F.lit(0)))
    counts = lengths.groupBy(group, band.alias("band"), n_words).agg(F.count("*").alias("k"))
    held = counts.groupBy(group, "band").agg(F.sum("k").alias("k"))
    last = held.groupBy(group).agg(F.max("band").alias("last")).where("last >= 0")
    grid = last.select(group, F.explode(F.sequence(F.lit(0), "last")).alias("band")).unionByName(held.where("band = -1").select(group, "band"))
    per = grid.join(held, [group, "band"], "left").select(group, "band", F.coalesce("k", F.lit(0)).alias("n"))
    some = counts.where(x > 0)
    middle = grouped_medians(some, [group], n_words, "k").select(group, ((F.col("low") + F.col("high")) / 2).alias("median"))
    own = middle.join(some.groupBy(group).agg(F.max(x).alias("max")), group)
    return per.join(own, group, "left")


def critical_share(answers: DataFrame, key: str, score: str, at_most: float = 2.0) -> DataFrame:
    """(question, n, pct_critical, n_off, pct_off): low answers of those on the scale, and answers off it of all."""
    x = F.col(score)
    return answers.groupBy(key).agg(F.count(x).alias("n"), pct(F.count_if(x <= at_most), F.count(x)).alias("pct_critical"), F.count_if(x.isNull()).alias("n_off"), pct(F.count_if(x.isNull()), F.count("*")).alias("pct_off"))


def frozen_figures(measured: DataFrame, expected: dict[str, float], tolerance: float = 0.0) -> DataFrame:
    """(figure, expected, found, ok) for figures by name; one that was not measured is not ok."""
    want = measured.sparkSession.createDataFrame([(k, float(v)) for k, v in expected.items()], "figure string, expected double")
    found = F.broadcast(want).join(measured.select("figure", F.col("value").cast("double").alias("found")), "figure", "left")
    return found.withColumn("ok", F.coalesce(F.abs(F.col("found") - F.col("expected")) <= tolerance, F.lit(False)))


def json_contract(docs: DataFrame, column: str, required: list[str], max_bytes: int) -> DataFrame:
    """(check, n_bad) of published JSON: each parses, has the required keys, and is within its size."""
    keys = F.json_object_keys(column)
    lacking = F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))) > 0
    row = docs.agg(F.count_if(keys.isNull()).alias("parses"), F.count_if(lacking).alias("required keys"), F.count_if(F.octet_length(column) > max_bytes).alias("size"))
    return row.unpivot([], ["parses", "required keys", "size"], "check", "n_bad")
