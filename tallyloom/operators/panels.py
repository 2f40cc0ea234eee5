"""Published panels: histograms, effects, audits, blocs by rule, evidence, quotes, nested documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.rounding import net, pct
from tallyloom.operators import derive as D
from tallyloom.operators.ranking import grouped_medians, running_total, spread, use_checkpoints


def year_histogram(answers: DataFrame, text: str, protest_over: int = 2050) -> DataFrame:
    """(year, n, is_protest) of answers that are a year of four digits."""
    y = answers.select(T.parse_year(F.col(text)).alias("year")).where("year is not null")
    return y.groupBy("year").agg(F.count("*").alias("n")).withColumn("is_protest", F.col("year") > protest_over)


def side_effect(answers: DataFrame, key: str, side: str, sides: tuple[str, str], score: str) -> DataFrame:
    """Count and mean by question on two sides; hidden on both where either has fewer than five answers,
    so neither can be had by subtraction."""
    x = F.col(score)
    a, b = (F.col(side) == s for s in sides)
    out = answers.groupBy(key).agg(
        F.count(F.when(a, x)).alias("n_a"), F.round(F.avg(F.when(a, x)), 2).alias("mean_a"), F.count(F.when(b, x)).alias("n_b"), F.round(F.avg(F.when(b, x)), 2).alias("mean_b")
    )
    fine = (F.col("n_a") >= 5) & (F.col("n_b") >= 5)
    return out.select(key, *(F.when(fine, F.col(c)).alias(c) for c in ("n_a", "mean_a", "n_b", "mean_b")), (~fine).alias("masked"))


def two_sided_cells(answers: DataFrame, key: str, side: Column, sides: tuple[str, str], ladder: list[str], mask: int = 5, thin: int = 10, answer: str = "answer_text") -> DataFrame:
    """(question, side, c, n, thin, masked) of the two sides of an effect (redaction; one country against all others).

    A cell under ``mask`` answers is hidden, and the other side with it, which would give it away beside the whole."""
    a = F.col(answer)
    cells = answers.where(a.isin(*ladder)).groupBy(key, side.alias("side")).agg(*(F.count_if(a == v).alias(f"_{i}") for i, v in enumerate(ladder)), F.count("*").alias("n"))
    both = answers.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, sides))).alias("side")).join(cells, [key, "side"], "left").na.fill(0)
    least = both.groupBy(key).agg(F.min("n").alias("_least"))
    out = both.join(least, key).withColumn("masked", F.col("_least") < mask)
    seen = ~F.col("masked")
    return out.select(key, "side", F.when(seen, F.array(*(F.col(f"_{i}") for i in range(len(ladder))))).alias("c"), F.when(seen, F.col("n")).alias("n"), (seen & (F.col("n") < thin)).alias("thin"), "masked")


def heaviest_off_scale(cells: DataFrame, key: str, off: str = "off", n: str = "n") -> DataFrame:
    """One row: the question with the largest share of answers off its scale; of equal ones the first."""
    share = F.col(off) / (F.col(off) + F.coalesce(n, F.lit(0)))
    return cells.where(F.col(off) > 0).select(key, off, n, share.alias("share")).orderBy(F.desc("share"), key).limit(1)


def audit_matrix(audit: DataFrame, claimed: str, audited: str, same: dict[str, str]) -> DataFrame:
    """(claimed, audited, n, matches): ``same`` names the audited class that a claim stands for."""
    known = F.create_map(*(F.lit(x) for kv in same.items() for x in kv)) if same else F.create_map().cast("map<string,string>")
    expected = F.coalesce(F.try_element_at(known, F.col(claimed)), F.col(claimed))
    return audit.groupBy(claimed, audited, (expected == F.col(audited)).alias("matches")).agg(F.count("*").alias("n"))


def blocs_by_rule(parts: dict[str, DataFrame], base: DataFrame | None = None) -> DataFrame:
    """(bloc, respondent_id, rules): members that any rule names, each a table (bloc, respondent_id)."""
    named = reduce(DataFrame.unionByName, (df.select("bloc", "respondent_id", F.lit(rule).alias("rule")) for rule, df in parts.items()))
    if base is not None:
        named = named.join(base.select("respondent_id"), "respondent_id", "left_semi")
    return named.groupBy("bloc", "respondent_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def signature_members(signatures: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(bloc, respondent_id) of respondents whose signature is a bloc's."""
    table = F.create_map(*(F.lit(x) for kv in {v: k for k, v in wanted.items()}.items() for x in kv))
    return signatures.select(F.try_element_at(table, F.col("signature")).alias("bloc"), "respondent_id").where("bloc is not null")


def evidence_flags(selections: DataFrame, prefixes: dict[str, str], id_col: str = "respondent_id", option: str = "option_text") -> DataFrame:
    """One flag for each prefix of an option label, and ``general_only``: general without any other."""
    flags = {n: F.coalesce(F.bool_or(F.col(option).startswith(p)), F.lit(False)) for n, p in prefixes.items()}
    out = selections.groupBy(id_col).agg(*(c.alias(n) for n, c in flags.items()))
    others = [F.col(n) for n in prefixes if n != "general"]
    return out.withColumn("general_only", F.col("general") & ~reduce(lambda a, b: a | b, others)) if "general" in prefixes else out


def spanned(groups: DataFrame, members: DataFrame, min_shared: int = 2) -> DataFrame:
    """Per group: clusters with ``min_shared`` of its members, and distinct members over these clusters.

    Respondents in the same clusters are one profile with a count, so a group meets profiles, not the members of its clusters."""
    use_checkpoints(groups.sparkSession)
    both = groups.select("respondent_id", "group_id").unionByName(members.select("respondent_id", "cluster_id"), allowMissingColumns=True).where("respondent_id is not null")
    each = spread(both, "respondent_id").groupBy("respondent_id").agg(F.array_sort(F.collect_set("group_id")).alias("groups"), F.array_sort(F.collect_set("cluster_id")).alias("profile"))
    # settled, as it is read more than once
    profiles = each.where(F.size("profile") > 0).groupBy("groups", "profile").agg(F.count("*").alias("n")).checkpoint()
    own = profiles.select("n", "profile", F.explode("groups").alias("group_id")).select("n", "group_id", F.explode("profile").alias("cluster_id"))
    shared = own.groupBy("group_id", "cluster_id").agg(F.sum("n").alias("k")).where(F.col("k") >= min_shared)
    sizes = profiles.groupBy("profile").agg(F.sum("n").alias("n"))
    met = sizes.select("profile", "n", F.explode("profile").alias("cluster_id")).join(shared, "cluster_id").groupBy("group_id", "profile").agg(F.first("n").alias("n"))
    heads = met.groupBy("group_id").agg(F.sum("n").alias("n_spanned"))
    return shared.groupBy("group_id").agg(F.count("*").alias("n_shared_texts")).join(heads, "group_id")


def template_copies(memberships: DataFrame, cluster: str, cites: Column) -> DataFrame:
    """Copies that templates add (memberships less distinct texts), and citing answers raw and once for each text."""
    per = memberships.groupBy(cluster).agg(F.count("*").alias("n"), F.max(cites.cast("int")).alias("cites"), F.sum(cites.cast("int")).alias("citing"))
    return per.agg(
        F.sum("n").alias("n_memberships"), F.count("*").alias("n_texts"), (F.sum("n") - F.count("*")).alias("n_copies"), F.sum("citing").alias("citing_raw"), F.sum("cites").cast("long").alias("citing_once")
    )


def theme_mentions(coded: DataFrame, topic: str, themes: str, polarity: dict[str, str]) -> DataFrame:
    """(topic, theme, polarity, n): mentions, not respondents; a theme without a polarity is an orphan."""
    each = coded.select(topic, F.explode(F.split(themes, r"\|")).alias("theme")).where("theme not in ('', 'uncodeable')")
    table = F.create_map(*(F.lit(x) for kv in polarity.items() for x in kv))
    return each.groupBy(topic, "theme").agg(F.count("*").alias("n")).withColumn("polarity", F.coalesce(F.try_element_at(table, F.col("theme")), F.lit("orphan")))


def quote_problems(quotes: DataFrame, answers: DataFrame, keys: list[str], quote: str, stored: str, max_chars: int = 600) -> DataFrame:
    """Quotes without an answer, not verbatim in it, or too long: (keys..., problem)."""
    joined = quotes.join(answers.select(*keys, F.col(stored).alias("_stored")), keys, "left")
    problem = F.when(F.col("_stored").isNull(), "no such answer").when(~T.verbatim_in(F.col(quote), F.col("_stored")), "not verbatim").when(F.length(quote) > max_chars, "too long")
    return joined.select(*keys, problem.alias("problem")).where("problem is not null")


def first_cluster(memberships: DataFrame, keys: list[str], size: str, cluster: str) -> DataFrame:
    """The largest cluster for each key; ties go to the smallest name."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(size), cluster))
    return memberships.withColumn("_r", rank).where("_r = 1").drop("_r")


def matrix_rows(stances: DataFrame, feasible: DataFrame, key: str) -> DataFrame:
    """Low, mid and high counts with the net of rounded shares, beside feasibility; strongest net first."""
    n = F.col("lo") + F.col("mid") + F.col("hi")
    rows = stances.select(key, "lo", "mid", "hi", n.alias("n"), net(F.col("hi"), F.col("lo"), n).alias("net_pct"))
    return rows.join(feasible, key, "left").orderBy(F.desc_nulls_last("net_pct"), key)


def mean_of_means(summary: DataFrame, construct: str, mean: str) -> DataFrame:
    return summary.groupBy(construct).agg(F.count(mean).alias("n_questions"), F.round(F.avg(mean), 2).alias("mean_of_means"))


def weighted_median(histogram: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """Median of a histogram without expanding it, rounded half up."""
    return grouped_medians(histogram, [group], value, n).select(group, F.round((F.col("low") + F.col("high")) / 2).cast("long").alias("median"))


def match_option(options: DataFrame, wanted: str, option: str = "option_text") -> DataFrame:
    """The option that is ``wanted``, else the first that starts with it in either case."""
    rank = F.when(F.col(option) == wanted, 0).when(F.startswith(F.lower(option), F.lit(wanted.lower())), 1)
    return options.withColumn("match_rank", rank).where("match_rank is not null").orderBy("match_rank", option).limit(1)


def heatmap_rows(questions: DataFrame, method: str, types: tuple[str, ...] = ("likert_1_5", "scale_labeled", "ordinal_select"), key: str = "question_number") -> DataFrame:
    """Questions of a method that are rows of the heatmap: scales and ladders, no numbers."""
    return questions.where((F.col("method") == method) & F.col("question_type").isin(*types)).orderBy(key)


def canonical_picks(selections: DataFrame, answers: DataFrame, questions: DataFrame, options: DataFrame, key: str = "question_number", option: str = "option_text") -> DataFrame:
    """(question, option, respondent_id), distinct, of canonical options only, so no write-in is in a picklist.

    Multi-select questions by their selections, others by answers that are a canonical option."""
    kinds = questions.select(key, (F.col("question_type") == "multi_select").alias("_multi"))
    canonical = options.where("is_canonical").select(key, option)
    picked = selections.join(kinds.where("_multi"), key, "left_semi").select(key, option, "respondent_id")
    given = answers.where(F.col("answer_text").isNotNull()).join(kinds.where("not _multi"), key, "left_semi").select(key, F.col("answer_text").alias(option), "respondent_id")
    return spread(picked.unionByName(given).join(canonical, [key, option], "left_semi"), "respondent_id").distinct()


def visible_columns(sizes: DataFrame, min_n: int = 15) -> DataFrame:
    """Segment values with whether their base is large enough to show."""
    return sizes.select("dim", "key", "n", (F.col("n") >= min_n).alias("shown"))


def never_named(published: DataFrame, redacted: DataFrame, key: str) -> DataFrame:
    """Published rows of respondents who asked not to be named; there must be none."""
    return published.join(redacted.select(key), key, "left_semi")


def organisation_answers(answers: DataFrame, order: str, id_col: str = "respondent_id") -> DataFrame:
    """One nested row for each organisation: its answers in survey order, picks inside."""
    item = F.struct(F.col(order).alias("ord"), F.col("answer_text").alias("text"), F.col("selections").alias("selections"))
    return answers.groupBy(id_col).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(F.when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))).alias("answers"))


def flatten_quotes(nested: DataFrame, column: str = "quotes") -> DataFrame:
    """(topic, side, quote) of a map of maps of lists."""
    return nested.select(F.explode(column).alias("topic", "sides")).select("topic", F.explode("sides").alias("side", "list")).select("topic", "side", F.explode("list").alias("quote"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\. "), lambda x: F.trim(x)), lambda x: x != "")


def signature_values(signature: Column) -> Column:
    """Characters of a signature as integers, null for ``-``."""
    return F.transform(F.filter(F.split(signature, ""), lambda c: c != ""), lambda c: c.try_cast("int"))


def domain_classes(domains: DataFrame, exact: dict[str, str], suffixes: list[tuple[str, str]]) -> DataFrame:
    named = domains.withColumn("class", T.classify_domain(F.col("domain"), exact, suffixes))
    return named.groupBy("class").agg(F.count("*").alias("n_domains"), F.sum("n_links").alias("n_links"))


def frequency_map(df: DataFrame, col: str) -> DataFrame:
    """One row: a map from value to count, in the order of values."""
    counts = df.groupBy(F.col(col).cast("string").alias("k")).agg(F.count("*").alias("n")).where("k is not null")
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("frequencies"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of complete pairs with average ranks of ties; ranks come from counts by value, not from rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(col: str, out: str) -> DataFrame:
        counts = running_total(both.groupBy(col).agg(F.count("*").alias("c")), [F.col(col)], "c")
        return counts.select(F.col(col), (F.col("upto") - (F.col("c") - 1) / 2).alias(out))

    return both.join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y).agg(F.count("*").alias("n"), F.round(F.corr("_rx", "_ry"), 6).alias("rho"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, chi2, degrees) of the contingency table of two columns."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # cells without rows add their expectation: the sum over held cells of o^2/e, less n, has them in it
    x = cells.join(rows, a).join(cols, b).crossJoin(F.broadcast(total))  # the total is one row
    return x.agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("r") * F.col("c"))) - F.max("n"), 6).alias("chi2"),
        ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("degrees"),
    )


def resolved_blocs(
    rules: list[tuple[str, str, object]], respondents: DataFrame, signatures: DataFrame, vectors: DataFrame, families: DataFrame, texts: DataFrame, area: str = "country",
) -> DataFrame:
    """(bloc, respondent_id, rules) of blocs by rules (bloc, kind, argument), each of one of five kinds.

    ``anchor_signature``: an exact signature. ``vector_cluster``: who is in the cluster of a seed respondent. ``entity_family``:
    a family by name. ``name_patterns``: patterns, in either case, that a named respondent's organisation holds.
    ``text_component``: (seed, n), who is linked with the seed by n shared texts within its ``area``.
    ``signatures`` is (respondent_id, signature), ``vectors`` (cluster_id, id), ``families`` (id, family), ``texts``
    (cluster_hash, id). A seed in no cluster names nobody by its vector, and itself by its texts."""
    of = {kind: [(bloc, argument) for bloc, k, argument in rules if k == kind] for _, kind, _ in rules}
    unknown = set(of) - {"anchor_signature", "vector_cluster", "entity_family", "name_patterns", "text_component"}
    if unknown:
        raise ValueError(f"unknown kinds of rules: {sorted(unknown)}")
    spark = respondents.sparkSession
    parts: list[DataFrame] = []

    def put(kind: str, df: DataFrame) -> None:
        parts.append(df.select("bloc", "respondent_id", F.lit(kind).alias("rule")))

    def given(kind: str, column: str, dtype: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(of[kind], f"bloc string, {column} {dtype}"))  # rules are given in code

    if "anchor_signature" in of:
        put("anchor_signature", signatures.join(given("anchor_signature", "signature", "string"), "signature"))
    if "vector_cluster" in of:
        wanted = vectors.join(given("vector_cluster", "id", "long"), "id").select("bloc", "cluster_id")
        put("vector_cluster", vectors.join(wanted, "cluster_id").withColumnRenamed("id", "respondent_id"))
    if "entity_family" in of:
        put("entity_family", families.join(given("entity_family", "family", "string"), "family").withColumnRenamed("id", "respondent_id"))
    for bloc, patterns in of.get("name_patterns", []):
        held = reduce(lambda a, b: a | b, (F.col("organization").rlike(f"(?i){p}") for p in patterns))
        named = respondents.where(~F.coalesce("is_redacted", F.lit(True)) & held)
        put("name_patterns", named.select(F.lit(bloc).alias("bloc"), "respondent_id"))
    for least in sorted({n for _, (_, n) in of.get("text_component", [])}):
        seeds = spark.createDataFrame([(bloc, seed) for bloc, (seed, n) in of["text_component"] if n == least], "seed string, id long")
        found = D.seeded_components(seeds, texts, respondents.select(F.col("respondent_id").alias("id"), F.col(area).alias("area")), least)
        put("text_component", found.select(F.col("seed").alias("bloc"), F.col("id").alias("respondent_id")))
    return reduce(DataFrame.unionByName, parts).groupBy("bloc", "respondent_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
