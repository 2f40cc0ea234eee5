"""Registered queries: each operator on the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import rounding as R
from tallyloom.functions import text as T
from tallyloom.operators import cells as C
from tallyloom.operators import derive as D
from tallyloom.operators import ingest as I
from tallyloom.operators import metrics as M
from tallyloom.operators import quality as Q
from tallyloom.operators import tree as TR
from tallyloom.operators import views as V
from tallyloom.operators.ranking import spread
from tallyloom.plans import survey as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = False) -> Callable:
    """Register a query by its function's name; ``base`` puts the survey's tables before the SQL."""

    def put(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (S.SQL + sql) if base else sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _star(s: SparkSession, d: str) -> DataFrame:
    return V.star(S.answers(s, d), S.questions(s), S.respondents(s, d))


def _segments(s: SparkSession, d: str) -> DataFrame:
    r = S.respondents(s, d)
    return C.segments_long(r, {"organization_type": F.col("organization_type"), "region": F.col("region"), "redaction": F.when(F.col("is_redacted"), "redacted").otherwise("named")})


_SEGMENTS = """, segments as (
  select respondent_id, 'organization_type' as dim, organization_type as key from respondents union all
  select respondent_id, 'region', region from respondents union all
  select respondent_id, 'redaction', case when is_redacted then 'redacted' else 'named' end from respondents union all
  select respondent_id, 'overall', 'all' from respondents)
"""
_SCALES = "('likert_1_5', 'scale_labeled', 'matrix_rating')"

# ---- views and recipes ---------------------------------------------------------------------------------------------

_SUMMARY = """, agg as (
  select question_number, count(answer_numeric) as n_scored, round(avg(answer_numeric), 2) as mean_score, count(*) filter (where answer_numeric <= 2) as n_low,
         count(*) filter (where answer_numeric = 3) as n_mid, count(*) filter (where answer_numeric >= 4) as n_high from answers group by question_number),
summary as (
  select q.*, coalesce(n_scored, 0) as n_scored, mean_score, coalesce(n_low, 0) as n_low, coalesce(n_mid, 0) as n_mid, coalesce(n_high, 0) as n_high
  from questions q left join agg using (question_number))
"""


@query(_SUMMARY + "select shorthand, n_scored, mean_score, n_low, n_mid, n_high from summary where scale_construct = 'support'", True)
def q01_scale_by_mean(s, d):
    out = V.scale_summary(S.answers(s, d), S.questions(s)).where("scale_construct = 'support'")
    return out.orderBy(F.desc("mean_score")).select("shorthand", "n_scored", "mean_score", "n_low", "n_mid", "n_high")


@query(_SUMMARY + "select question_number, shorthand, question_type, n_scored, mean_score, n_low, n_mid, n_high from summary", True)
def view_scale_summary(s, d):
    return V.scale_summary(S.answers(s, d), S.questions(s)).select("question_number", "shorthand", "question_type", "n_scored", "mean_score", "n_low", "n_mid", "n_high")


@query(f"select respondent_id, question_number, shorthand, answer_numeric, country, organization_type from answers join questions using (question_number) join respondents using (respondent_id) where question_type in {_SCALES} and section <> 'A'", True)
def view_scale_answers(s, d):
    out = V.scale_answers(S.answers(s, d), S.questions(s), S.respondents(s, d)).where("section <> 'A'")
    return out.select("respondent_id", "question_number", "shorthand", "answer_numeric", "country", "organization_type")


@query("select section, respondent_id, count(*) as n from answers join questions using (question_number) group by all", True)
def q03_answers_per_respondent(s, d):
    sections = S.answers(s, d).join(S.questions(s), "question_number").select("section", "respondent_id")
    return spread(sections, "respondent_id").groupBy("section", "respondent_id").agg(F.count("*").alias("n"))


@query("select organization_type, round(avg(answer_numeric), 2) as mean_score, count(answer_numeric) as n from answers join questions using (question_number) join respondents using (respondent_id) where shorthand = 'support_matching' group by 1", True)
def q07_mean_by_organization_type(s, d):
    return _star(s, d).where("shorthand = 'support_matching'").groupBy("organization_type").agg(F.round(F.avg("answer_numeric"), 2).alias("mean_score"), F.count("answer_numeric").alias("n"))


@query("select question_number, shorthand, answer_text, answer_numeric from answers join questions using (question_number) where respondent_id = 42 and section = 'B'", True)
def q08_one_respondent(s, d):
    return S.answers(s, d).where("respondent_id = 42").join(S.questions(s).where("section = 'B'"), "question_number").select("question_number", "shorthand", "answer_text", "answer_numeric")


@query("select organization_type, answer_text, count(*) as n from answers join questions using (question_number) join respondents using (respondent_id) where role = 'reasons_support' group by 1, 2 order by n desc, organization_type, answer_text limit 10", True)
def q10_reasons_by_type_top(s, d):
    out = _star(s, d).where("role = 'reasons_support'").groupBy("organization_type", "answer_text").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "organization_type", "answer_text").limit(10)


@query("select country, answer_text, count(*) as n from answers join respondents using (respondent_id) where question_number = 1 group by 1, 2 having count(*) > 3", True)
def q11_country_by_answer(s, d):
    return S.answers(s, d).where("question_number = 1").join(S.respondents(s, d), "respondent_id").groupBy("country", "answer_text").agg(F.count("*").alias("n")).where("n > 3")


@query("select shorthand, n, round(100.0 * (hi - lo) / n, 1) as net from (select shorthand, count(answer_numeric) as n, count(*) filter (where answer_numeric >= 4) as hi, count(*) filter (where answer_numeric <= 2) as lo from answers join questions using (question_number) group by 1)", True)
def q13_net_once_rounded(s, d):
    x = F.col("answer_numeric")
    agg = S.answers(s, d).join(S.questions(s), "question_number").groupBy("shorthand").agg(F.count(x).alias("n"), F.count_if(x >= 4).alias("hi"), F.count_if(x <= 2).alias("lo"))
    return agg.select("shorthand", "n", R.net_of_counts(F.col("hi"), F.col("lo"), F.col("n")).alias("net"))


@query("select shorthand, round(round(100.0 * hi / n, 1) - round(100.0 * lo / n, 1), 1) as net from (select shorthand, count(answer_numeric) as n, count(*) filter (where answer_numeric >= 4) as hi, count(*) filter (where answer_numeric <= 2) as lo from answers join questions using (question_number) group by 1)", True)
def m11_net_of_rounded_shares(s, d):
    x = F.col("answer_numeric")
    agg = S.answers(s, d).join(S.questions(s), "question_number").groupBy("shorthand").agg(F.count(x).alias("n"), F.count_if(x >= 4).alias("hi"), F.count_if(x <= 2).alias("lo"))
    return agg.select("shorthand", R.net(F.col("hi"), F.col("lo"), F.col("n")).alias("net"))


@query("select question_number, shorthand, n, round(100.0 * n / (select count(*) from respondents), 1) as rate from (select question_number, count(distinct respondent_id) as n from answers group by 1) join questions using (question_number)", True)
def q16_attrition_spine(s, d):
    n = S.table(s, d, "orders").agg(F.count("*").alias("all"))
    each = S.answers(s, d).groupBy("question_number").agg(F.countDistinct("respondent_id").alias("n")).join(S.questions(s), "question_number")
    return each.crossJoin(F.broadcast(n)).select("question_number", "shorthand", "n", R.pct(F.col("n"), F.col("all")).alias("rate"))


@query(f"select shorthand, question_type, count(case when not is_redacted then answer_numeric end) as n_named, round(avg(case when not is_redacted then answer_numeric end), 2) as mean_named, count(case when is_redacted then answer_numeric end) as n_redacted, round(avg(case when is_redacted then answer_numeric end), 2) as mean_redacted from answers join questions using (question_number) join respondents using (respondent_id) where question_type in {_SCALES} group by 1, 2", True)
def view_scale_by_redaction(s, d):
    return V.scale_by_redaction(V.scale_answers(S.answers(s, d), S.questions(s), S.respondents(s, d)), ["shorthand", "question_type"])


@query("select organization_type, is_redacted, region, count(*) as n_respondents, round(sum(round(completion_pct * 10)::bigint)::double / (10.0::double * count(completion_pct)), 1) as mean_completion_pct from respondents group by 1, 2, 3", True)
def view_redaction_profile(s, d):
    return V.redaction_profile(S.respondents(s, d), ["organization_type", "is_redacted", "region"])


@query("select section, question_type, count(*) as n_questions, coalesce(sum(n), 0)::bigint as n_answers from questions left join (select question_number, count(*) as n from answers group by 1) using (question_number) group by 1, 2", True)
def view_answer_types(s, d):
    return V.answer_types(S.questions(s), S.answers(s, d).groupBy("question_number").agg(F.count("*").alias("n")), ["section", "question_type"])


@query("select respondent_id, question_number, shorthand, answer_text, organization from answers join questions using (question_number) join respondents using (respondent_id) where question_type = 'free_text' and role <> 'profile'", True)
def view_free_text(s, d):
    return V.free_text(S.answers(s, d), S.questions(s), S.respondents(s, d), with_profile=False).select("respondent_id", "question_number", "shorthand", "answer_text", "organization")


@query("""
select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as anchor from conversations where role = 'assistant' or role = 'user'
""")
def w3_nearest_anchor_before(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    c = S.table(s, d, "conversations").where("role in ('assistant', 'user')")
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("anchor"))


@query(S.CODEBOOK_SQL + "select question_number, parent_question, anchor_question from book")
def w2_parents_and_anchors(s, d):
    return TR.linked(S.codebook(s, d), explicit="explicit_parent").select("question_number", "parent_question", "anchor_question")


@query(S.CODEBOOK_SQL + """select a.question_number as anchor_number, a.shorthand as anchor_shorthand, c.question_number, c.shorthand, c.role
from book c join book a on a.question_number = c.anchor_question""")
def view_question_tree(s, d):
    return V.question_tree(TR.linked(S.codebook(s, d), explicit="explicit_parent"))


@query(S.CODEBOOK_SQL + "select question, root, depth, array_to_string(path, '>') as path from tree")
def j4_question_paths(s, d):
    """The path from its root to every question, to any depth."""
    found = TR.paths(TR.linked(S.codebook(s, d), explicit="explicit_parent"))
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(S.CODEBOOK_SQL + """select question_number, parent_question, case when parent_question not in (select question_number from c) then 'missing' when parent_question = question_number then 'itself' else 'later' end as problem
from book where parent_question is not null and (parent_question not in (select question_number from c) or parent_question >= question_number)
union all select question_number, parent_question, 'cycle' from book where question_number not in (select question from tree)""")
def v4_forward_parents(s, d):
    """Parents that are missing, later or the question itself, and all questions that hang on a cycle."""
    book = TR.linked(S.codebook(s, d), explicit="explicit_parent")
    return TR.parent_problems(book).unionByName(TR.unrooted(book).withColumn("problem", F.lit("cycle")))


# ---- reshaping, shape inference, options ---------------------------------------------------------------------------


@query("select respondent_id, question, selection_index, option_text from picks", True)
def r2_explode_selections(s, d):
    return S.picks(s, d).select("respondent_id", "question", "selection_index", "option_text")


@query("""
select c_custkey as respondent_id, 'c_name' as header, c_name as answer_text from customer where c_name <> '' union all
select c_custkey, 'c_mktsegment', c_mktsegment from customer where c_mktsegment <> '' union all
select c_custkey, 'c_nationkey', c_nationkey::varchar from customer
""")
def r1_unpivot_grid(s, d):
    grid = S.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return I.unpivot_grid(grid, "c_custkey").select("respondent_id", "header", "answer_text")


@query("""
, cells as (select question, raw from (select p_type as question, replace(p_name, ' ', ';') || ';' as raw from part) union all select 'brand', p_brand from part union all select 'size', (1 + p_size % 5)::varchar from part),
shape as (select question, count(*) as filled, count(distinct raw) as distinct_values, max(length(raw)) as max_chars, round(avg(case when raw like '%;' then 1.0 else 0.0 end), 6) as semicolon_share, bool_and(regexp_full_match(raw, '[1-5]')) as all_1_5 from cells group by 1)
select *, semicolon_share >= 0.9 as is_multi, semicolon_share < 0.9 and max_chars <= 320 and (distinct_values <= 12 or distinct_values / filled <= 0.35) as is_single from shape
""", True)
def a1_column_shape(s, d):
    p = S.table(s, d, "part")
    cells = p.select(F.col("p_type").alias("question"), F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(";")).alias("raw"))
    cells = cells.unionByName(p.select(F.lit("brand").alias("question"), F.col("p_brand").alias("raw")))
    cells = cells.unionByName(p.select(F.lit("size").alias("question"), (1 + F.col("p_size") % 5).cast("string").alias("raw")))
    return I.column_shape(cells, "question", "raw").withColumn("semicolon_share", F.round("semicolon_share", 6)).drop("is_free")


@query("""
, n as (select question, count(distinct respondent_id) as n_answered from picks group by 1),
o as (select question, option_text, count(*) as n_selected, min(respondent_id) as first_seen from picks group by 1, 2)
select question, option_text, n_selected, round(100.0 * n_selected / n_answered, 2) as pct_of_answered, n_selected >= greatest(3, 0.05 * n_answered) as is_canonical,
       row_number() over (partition by question order by n_selected desc, first_seen, option_text)::int as option_order from o join n using (question)
""", True)
def a6_option_catalogue(s, d):
    p = S.picks(s, d).withColumn("row_ord", F.col("respondent_id"))
    n = p.groupBy("question").agg(F.countDistinct("respondent_id").alias("n_answered"))
    return I.option_catalogue(p, n, "question").select("question", "option_text", "n_selected", "pct_of_answered", "is_canonical", "option_order")


@query("""
, n as (select question, count(distinct respondent_id) as n_answered from picks group by 1),
o as (select question, option_text, count(*) as c from picks group by 1, 2), m as (select question, c, c >= greatest(3, 0.2 * n_answered) as canon from o join n using (question))
select question, count(*) filter (where canon) as n_options, coalesce(sum(c) filter (where not canon), 0)::bigint as n_write_in_selections, coalesce(max(c) filter (where not canon), 0) >= 5 as review_option_split from m group by 1
""", True)
def a5_write_in_totals(s, d):
    p = S.picks(s, d).withColumn("row_ord", F.col("respondent_id"))
    n = p.groupBy("question").agg(F.countDistinct("respondent_id").alias("n_answered"))
    return I.write_in_totals(I.option_catalogue(p, n, "question", I.Rules(canonical_share=0.2)), "question")


@query("""
, typed as (select a.*, q.question_type, q.role, case when q.question_type = 'multi_select' then length(answer_text) end as n_selected from answers a join questions q using (question_number))
select respondent_id, count(*) as n_questions_answered, count(*) filter (where role <> 'profile') as n_substantive_answered, round(100.0 * count(*) filter (where role <> 'profile') / 7, 1) as substantive_completion_pct,
       count(*) filter (where question_type = 'free_text') as n_free_text_answers, coalesce(sum(length(answer_text)) filter (where question_type = 'free_text'), 0)::bigint as free_text_chars,
       coalesce(sum(n_selected), 0)::bigint as n_multi_select_selections from typed group by 1
""", True)
def a4_respondent_engagement(s, d):
    a = S.answers(s, d).join(S.questions(s), "question_number").withColumn("n_selected", F.when(F.col("question_type") == "multi_select", F.length("answer_text")))
    return I.respondent_engagement(a, 7)


@query("""
select respondent_id, min(case when question_number = 2 then answer_text end) as Q002, min(case when question_number = 2 then answer_numeric end) as Q002_num,
       min(case when question_number = 4 then answer_text end) as Q004, min(case when question_number = 4 then answer_numeric end) as Q004_num from answers group by 1
""", True)
def r3_long_to_wide(s, d):
    a = S.answers(s, d).withColumn("question_id", F.format_string("Q%03d", "question_number"))
    return I.widen(a, ["Q002", "Q004"])


# ---- cells and disclosure ------------------------------------------------------------------------------------------


@query(_SEGMENTS + f""", values_ as (select dim, key, count(distinct respondent_id) as n, count(distinct respondent_id) < 5 as masked from segments group by 1, 2),
cells as (select question_number, dim, key, concat_ws(',', count(*) filter (where answer_numeric = 1), count(*) filter (where answer_numeric = 2), count(*) filter (where answer_numeric = 3), count(*) filter (where answer_numeric = 4), count(*) filter (where answer_numeric = 5)) as c,
  count(*) filter (where answer_numeric is null) as off, count(answer_numeric) as n, round(avg(answer_numeric), 2) as mean from answers join segments using (respondent_id) group by 1, 2, 3)
select question_number, dim, key, case when not hide then c end as c, case when not hide then off end as off, case when not hide then n end as n, case when not hide then mean end as mean, hide as masked
from (select cells.*, masked and dim <> 'overall' as hide from cells join values_ using (dim, key))
""".replace("join values_ using (dim, key)", "join (select dim, key, masked from values_) using (dim, key)"), True)
def a13_likert_cells(s, d):
    out = C.likert_cells(S.answers(s, d), _segments(s, d), [1, 2, 3, 4, 5])
    return out.withColumn("c", F.when(F.col("c").isNotNull(), F.array_join(F.transform("c", lambda x: x.cast("string")), ",")))


def _country_segments(s: SparkSession, d: str) -> DataFrame:
    return C.segments_long(S.respondents(s, d), {"country": F.col("country")})


@query(""", seg as (select respondent_id, 'country' as dim, country as key from respondents union all select respondent_id, 'overall', 'all' from respondents),
v as (select dim, key, count(distinct respondent_id) < 5 as masked from seg group by 1, 2),
cells as (select question_number, dim, key, count(*) filter (where answer_text = 'A') as a, count(*) filter (where answer_text = 'N') as b, count(*) filter (where answer_text in ('A', 'N')) as n from answers join seg using (respondent_id) group by 1, 2, 3),
h as (select cells.*, dim <> 'overall' and (masked or n < 5) as hide from cells join v using (dim, key))
select question_number, dim, key, case when not hide then a end as a, case when not hide then b end as b, case when not hide then n end as n, dim <> 'overall' and not hide and n < 10 as thin, hide as masked from h
""", True)
def a14_stance_cells(s, d):
    out = C.stance_cells(S.answers(s, d), _country_segments(s, d), ["A", "N"])
    return out.select("question_number", "dim", "key", F.get("c", F.lit(0)).alias("a"), F.get("c", F.lit(1)).alias("b"), "n", "thin", "masked")


@query(""", seg as (select p_partkey as respondent_id, 'brand' as dim, p_brand as key from part union all select p_partkey, 'overall', 'all' from part),
v as (select dim, key, count(distinct respondent_id) < 5 as masked from seg group by 1, 2),
cells as (select question, option_text, dim, key, count(distinct respondent_id) as n from picks join seg using (respondent_id) group by all)
select question, option_text, dim, key, case when not (masked and dim <> 'overall') then n end as n, masked and dim <> 'overall' as masked from cells join v using (dim, key)
""", True)
def a15_pick_cells(s, d):
    seg = C.segments_long(S.table(s, d, "part").withColumnRenamed("p_partkey", "respondent_id"), {"brand": F.col("p_brand")})
    return C.pick_cells(S.picks(s, d), seg, key="question")


@query(""", n as (select question, count(distinct respondent_id) as n_answered from picks group by 1)
select question, option_text, count(distinct respondent_id) as n, round(100.0 * count(distinct respondent_id) / any_value(n_answered), 1) as pct from picks join n using (question) group by 1, 2
""", True)
def a16_picklist(s, d):
    p = S.picks(s, d)
    return C.picklist(p, p.groupBy("question").agg(F.countDistinct("respondent_id").alias("n_answered")), "question")


@query(""", stance as (select respondent_id, max(answer_numeric) as score from answers where question_number = 2 group by 1),
sel as (select respondent_id, answer_text as option_text from answers where question_number = 3),
j as (select sel.*, case when score <= 2 then 'oppose' when score = 3 then 'neutral' when score > 3 then 'support' else 'no_anchor' end as bucket from sel left join stance using (respondent_id)),
b as (select bucket, count(distinct respondent_id) as base from j group by 1)
select option_text, bucket, count(distinct respondent_id) as n, any_value(base) as base, round(100.0 * count(distinct respondent_id) / any_value(base), 1) as pct from j join b using (bucket) group by 1, 2
""", True)
def a17_basis_panel(s, d):
    a = S.answers(s, d)
    stance = a.where("question_number = 2").groupBy("respondent_id").agg(F.max("answer_numeric").alias("score"))
    return C.basis_panel(a.where("question_number = 3").select("respondent_id", F.col("answer_text").alias("option_text")), stance)


@query("select organization_type, count(*) as n, count(*) filter (where is_redacted) as n_flagged, round(100.0 * count(*) filter (where is_redacted) / count(*), 1) as pct from respondents group by 1", True)
def a20_rate_by_group(s, d):
    return C.rate_by(S.respondents(s, d), "organization_type", F.col("is_redacted"))


@query("""select organization_type, count(*) filter (where is_redacted) as redacted, count(*) filter (where not is_redacted) as named from respondents group by 1""", True)
def a21_crosstab(s, d):
    r = S.respondents(s, d).withColumn("side", F.when(F.col("is_redacted"), "redacted").otherwise("named"))
    return r.groupBy("organization_type").pivot("side", ["redacted", "named"]).count()


@query(""", c as (select country, count(*) as n from respondents group by 1), r as (select country, row_number() over (order by n desc, country) as k from c),
t as (select count(*) as tail from r where k > 10)
select case when k <= 10 then country else 'other (' || tail || ' values)' end as key, count(*) as n from respondents join r using (country), t group by 1
""", True)
def a25_top_n_other(s, d):
    return C.top_n_other(S.respondents(s, d), "country", 10).groupBy("key").agg(F.count("*").alias("n"))


@query("""select v as sector, coalesce(n, 0) as n, ord::int as ord, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) over (), 1) as pct from (values ('1-URGENT', 0), ('2-HIGH', 1), ('none', 2)) t(v, ord) left join (select o_orderpriority as v, count(*) as n from orders group by 1) using (v)""")
def a57_distribution(s, d):
    return C.distribution(S.table(s, d, "orders").select(F.col("o_orderpriority").alias("sector")), "sector", ["1-URGENT", "2-HIGH", "none"])


@query(""", l as (select answer_text as option_text, count(*) as n, (select count(*) from answers where question_number = 2) as base from answers where question_number = 2 group by 1),
r as (select answer_text as option_text, count(*) as n, (select count(*) from answers where question_number = 4 and answer_text <> 'R') as base from answers where question_number = 4 and answer_text <> 'R' group by 1),
j as (select option_text, coalesce(l.n, 0) as n_left, coalesce(round(100.0 * l.n / l.base, 1), 0) as pct_left, coalesce(r.n, 0) as n_right, coalesce(round(100.0 * r.n / r.base, 1), 0) as pct_right from l full join r using (option_text))
select *, round(pct_left - pct_right, 1) as net from j
""", True)
def j23_scoreboard(s, d):
    def side(df: DataFrame) -> DataFrame:
        base = df.agg(F.count("*").alias("base"))
        return df.groupBy(F.col("answer_text").alias("option_text")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(base))

    a = S.answers(s, d)
    return C.scoreboard(side(a.where("question_number = 2")), side(a.where("question_number = 4 and answer_text <> 'R'")))


@query(""", x as (select question_number, count(answer_numeric) as n, count(*) filter (where answer_numeric <= 2) as lo, count(*) filter (where answer_numeric = 3) as mid, count(*) filter (where answer_numeric >= 4) as hi, sum(answer_numeric) as t from answers group by 1)
select question_number, round(100.0 * lo / n, 1) as lo_pct, round(100.0 * mid / n, 1) as mid_pct, round(100.0 * hi / n, 1) as hi_pct, round(t / n, 2) as mean_rung from x
""", True)
def m8_shares_and_mean_rung(s, d):
    x = F.col("answer_numeric")
    c = S.answers(s, d).groupBy("question_number").agg(F.array(*(F.count_if(x == r) for r in range(1, 6))).alias("c"))
    return c.select("question_number", *(v.alias(k) for k, v in R.shares(F.col("c"), 5).items()), R.mean_rung(F.col("c")).alias("mean_rung"))


# ---- derivations ---------------------------------------------------------------------------------------------------

_NORM = r"trim(regexp_replace(lower(text), '[\s\x0B\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))"


@query(f"""with h as (select doc_id, {_NORM} as t from documents) select sha1(t) as cluster_hash, count(distinct doc_id) as n_respondents, max(length(t)) as chars, min(doc_id) as first_id, min(substr(t, 1, 240)) as preview from h where length(t) >= 200 group by 1 having count(distinct doc_id) >= 3""")
def a26_text_clusters(s, d):
    return D.text_clusters(D.text_members(S.table(s, d, "documents"), "doc_id", "text"))


@query(f"""with h as (select distinct sha1({_NORM}) as cluster_hash, doc_id from documents where length({_NORM}) >= 200) select cluster_hash, string_agg(doc_id::varchar, '|' order by doc_id) as members from h group by 1 having count(*) >= 3""")
def a26_text_cluster_members(s, d):
    members = D.text_members(S.table(s, d, "documents"), "doc_id", "text")
    return D.listed(members.join(D.text_clusters(members).select("cluster_hash"), "cluster_hash", "left_semi"), "cluster_hash", "id")


@query(f"""with h as (select doc_id, sha1({_NORM}) as k from documents where length({_NORM}) >= 200), c as (select k from h group by 1 having count(*) >= 2), m as (select h.* from h join c using (k))
select a.doc_id as id, count(distinct a.k)::int as n_shared, count(distinct b.doc_id) - 1 as n_co_sharers, count(distinct b.doc_id) > 3 as is_template from m a join m b using (k) group by 1""")
def a27_sharing_summary(s, d):
    members = D.text_members(S.table(s, d, "documents"), "doc_id", "text")
    return D.sharing_summary(members.join(D.text_clusters(members, 2).select("cluster_hash"), "cluster_hash", "left_semi"))


@query(""", a as (select respondent_id, question_number, max(answer_numeric) as sc from answers where answer_numeric is not null group by 1, 2),
v as (select respondent_id, string_agg(question_number::varchar || '=' || sc::varchar, ',' order by question_number) as v, count(*) as vector_length from a group by 1),
g as (select v, vector_length, count(*) as n_respondents, min(respondent_id) as first_id, string_agg(respondent_id::varchar, '|' order by respondent_id) as members from v where vector_length >= 3 group by 1, 2 having count(*) >= 2)
select 'vc' || lpad((row_number() over (order by n_respondents desc, vector_length desc, first_id))::varchar, greatest(2, length((row_number() over (order by n_respondents desc, vector_length desc, first_id))::varchar))::int, '0') as cluster_id, n_respondents, vector_length::int as vector_length, members from g
""", True)
def a28_vector_clusters(s, d):
    a = S.answers(s, d).groupBy("respondent_id", "question_number").agg(F.max("answer_numeric").alias("sc"))
    clusters, members = D.vector_clusters(a, "respondent_id", "question_number", "sc", 3)
    return clusters.join(D.listed(members, "cluster_id", "id"), "cluster_id").select("cluster_id", "n_respondents", "vector_length", "members")


@query(""", a as (select respondent_id, question_number, max(answer_numeric)::int as sc from answers group by 1, 2)
select respondent_id, coalesce(max(case when question_number = 2 then sc end)::varchar, '-') || coalesce(max(case when question_number = 4 then sc end)::varchar, '-') || coalesce(max(case when question_number = 7 then sc end)::varchar, '-') as signature from a group by 1
""", True)
def a29_anchor_signature(s, d):
    a = S.answers(s, d).withColumn("sc", F.col("answer_numeric").cast("int"))
    return D.anchor_signature(a, "respondent_id", "question_number", "sc", [2, 4, 7])


@query(""", sig as (select respondent_id, max(case when question_number = 2 then answer_numeric end)::int::varchar as p0, max(case when question_number = 4 then answer_numeric end)::int::varchar as p1 from answers group by 1)
select bloc, case when count(distinct p0) = 1 then max(p0) end as p0, case when count(distinct p1) = 1 then max(p1) end as p1 from sig join respondents using (respondent_id) group by 1
""", True)
def a36_agreed_signature(s, d):
    sig = D.anchor_signature(S.answers(s, d).withColumn("sc", F.col("answer_numeric").cast("int")), "respondent_id", "question_number", "sc", [2, 4])
    out = D.agreed_signature(sig.join(S.respondents(s, d).select("respondent_id", "bloc"), "respondent_id"), "bloc", 2)
    return out.select("bloc", F.col("agreed")[0].alias("p0"), F.col("agreed")[1].alias("p1"))


@query("""select p_partkey as id, case when p_name like '%widget%' then 'widget' when regexp_matches(p_name, 'red|blue') then 'colour' else 'ring' end as family,
 ((p_name like '%widget%')::int + regexp_matches(p_name, 'red|blue')::int + (p_name like '%ring%')::int) as n_matches from part where p_name like '%widget%' or regexp_matches(p_name, 'red|blue') or p_name like '%ring%'""")
def j9_families_by_pattern(s, d):
    out = D.families_by_pattern(S.table(s, d, "part"), "p_name", [("widget", "widget"), ("colour", "red|blue"), ("ring", "ring")], "p_partkey")
    return out.withColumnRenamed("p_partkey", "id")


@query("""select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') as family, count(*) over (partition by lower(p_name)) as n_members from part qualify count(*) over (partition by lower(p_name)) >= 2""")
def a35_families_by_name(s, d):
    return D.families_by_name(S.table(s, d, "part"), "p_name", "p_partkey")


@query("""with x as (select p_partkey, lower(p_name) as n from part) select p_partkey, max(p_partkey) over (partition by n) as kept_id, lead(p_partkey) over (partition by n order by p_partkey) as next_id, p_partkey < max(p_partkey) over (partition by n) as superseded from x qualify count(*) over (partition by n) > 1""")
def a34_resubmissions(s, d):
    return D.resubmissions(S.table(s, d, "part"), "p_name", "p_partkey")


@query(r"""with u as (select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host from pages), l as (select page_id, string_split(host, '.') as p from u)
select array_to_string(p[-2:], '.') as domain, count(distinct page_id) as n_answers, count(*) as n_links from l group by 1""")
def a31_linked_domains(s, d):
    return D.linked_domains(S.table(s, d, "pages"), "page_id", "url")


@query(r"""select page_id, regexp_matches(html, '(?i)(?:https?://|www\.)[^\s<>"'')\]]+') as has_url, regexp_matches(html, '(?i)peer[-\s]?review') as has_peer_review, regexp_matches(html, '(?i)\.pdf\b') as has_pdf,
 regexp_matches(html, '\((?:[^()]{0,40}?,\s*)?(?:19|20)\d{2}[a-z]?\)') as has_year from pages""")
def f12_signals(s, d):
    x = S.table(s, d, "pages").select("page_id", T.signals(F.col("html")).alias("x"))
    return x.select("page_id", *(F.array_contains("x", k).alias(n) for n, k in (("has_url", "url"), ("has_peer_review", "peer_review"), ("has_pdf", "pdf"), ("has_year", "paren_year"))))


@query("""with t as (select doc_id, unnest(string_split(text, ' ')) as w from documents), k as (select doc_id, w, regexp_replace(lower(w), '[^a-z]', '', 'g') as az, regexp_replace(lower(w), '[^0-9a-z]', '', 'g') as an, regexp_replace(lower(w), '[^\\p{L}]', '', 'g') as le from t where w <> '' and not regexp_matches(w, '\\s')),
g as (select doc_id, length(w) < 20 and ((an <> '' and length(replace(an, an[1], '')) = 0) or case when le = '' then 0.0 else length(regexp_replace(le, '[^aeiou]', '', 'g')) / length(le) end < 0.3 or regexp_matches(az, '""" + T.keyboard_pattern() + """')) as bad from k)
select doc_id, count(*) as n_words, count(*) filter (where bad) as n_gibberish from g group by 1""")
def f21_gibberish_words(s, d):
    return D.gibberish_words(S.table(s, d, "documents"), "doc_id", "text")


@query(f"""with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as text from documents),
m as (select distinct doc_id, sha1({_NORM}) as k from l where length({_NORM}) >= 60),
e as (select a.doc_id as a, b.doc_id as b from m a join m b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2 having count(*) >= 2),
r(id, bloc) as (select distinct a, a from e union select e.b, r.bloc from r join e on e.a = r.id)
select id, min(bloc) as bloc from r group by 1""")
def d15_blocs_by_shared_lines(s, d):
    """Documents in two or more clusters of long shared lines together."""
    lines = S.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return D.blocs(D.common_edges(D.text_members(lines, "doc_id", "line", min_chars=60), min_shared=2))


@query("""with w as (select doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g') as x, regexp_replace(text, '\\s+', ' ', 'g') as c from documents)
select doc_id, regexp_replace(x, '^_+|_+$', '', 'g') as slug, case when length(trim(c)) > 60 then rtrim(substr(trim(c), 1, 59)) || '…' else trim(c) end as preview from w""")
def f5_slug_and_truncate(s, d):
    t = S.table(s, d, "documents")
    return t.select("doc_id", T.slugify(F.col("text")).alias("slug"), T.truncate(F.col("text"), 60).alias("preview"))


@query("""with w as (select item_id, text, string_split(text, ' ') as p from benchmark), q as (
  select *, array_to_string(p[1:3], ' ') as a, array_to_string(p[len(p) - 2:len(p)], ' ') as b, length(text) % 2 = 1 as turned from w),
r as (select *, case when turned then b else a end as x, case when turned then a else b end as y from q)
select item_id, text as stored, strpos(text, x) > 0 and strpos(substr(text, strpos(text, x) + length(x)), y) > 0 as in_order from r""")
def f16_verbatim_in(s, d):
    """The ends of each text as a quote with a gap, in the wrong order for every other one."""
    w = S.table(s, d, "benchmark").withColumn("p", F.split("text", " "))
    a, b = F.array_join(F.slice("p", 1, 3), " "), F.array_join(F.slice("p", -3, 3), " ")
    turned = F.length("text") % 2 == 1
    quote = F.concat(F.when(turned, b).otherwise(a), F.lit(" […] "), F.when(turned, a).otherwise(b))
    return w.select("item_id", F.col("text").alias("stored"), T.verbatim_in(quote, F.col("text")).alias("in_order"))


@query("""select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) as entity, s_suppkey from customer left join supplier on trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) = replace(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), 'supplier', 'customer')""")
def j22_entity_match(s, d):
    c = S.table(s, d, "customer").select("c_custkey", T.entity_key(F.col("c_name")).alias("entity"))
    p = S.table(s, d, "supplier").select("s_suppkey", F.replace(T.entity_key(F.col("s_name")), F.lit("supplier"), F.lit("customer")).alias("entity"))
    return c.join(p, "entity", "left")


# ---- second-stage metrics ------------------------------------------------------------------------------------------


@query(""", v as (select bloc, avg(case when answer_numeric <= 2 then 1.0 else 0.0 end) > 0.5 as opp from answers join respondents using (respondent_id) where question_number = 2 and answer_numeric is not null group by 1)
select count(*) as n_votes, count(*) filter (where opp) as n_oppose, round(100.0 * count(*) filter (where opp) / count(*), 1) as pct_oppose from v""", True)
def a45_dedup_votes(s, d):
    a = S.answers(s, d).where("question_number = 2 and answer_numeric is not null").join(S.respondents(s, d), "respondent_id")
    return M.dedup_votes(a, F.col("bloc"), F.col("answer_numeric") <= 2)


@query(""", j as (select answer_text, bloc from answers join respondents using (respondent_id) where question_number = 3)
select answer_text, count(*) as n, count(distinct bloc) as n_dedup from j group by 1""", True)
def a39_dedup_effect(s, d):
    a = S.answers(s, d).where("question_number = 3").join(S.respondents(s, d), "respondent_id")
    return M.dedup_counts(a, F.col("bloc"), "answer_text")


@query("""with x as (select p_partkey, p_brand, unnest(string_split(p_name, ' ')) as theme from part where p_type <> 'ECONOMY')
select theme, count(distinct p_partkey) as n, count(distinct p_brand) as n_dedup, round(100.0 * count(distinct p_partkey) / (select count(*) from part where p_type <> 'ECONOMY'), 1) as share_pct from x group by 1""")
def a40_theme_counts(s, d):
    keys = F.when(F.col("p_type") == "ECONOMY", "uncodeable").otherwise(F.replace("p_name", F.lit(" "), F.lit("|")))
    return M.theme_counts(S.table(s, d, "part").withColumn("theme_keys", keys), F.col("p_brand"), "p_partkey")


@query("""with x as (select p_brand as brand, p_size as size from part), f as (select * from x where size <= 40), c as (select brand, size, count(*) as n from f group by 1, 2)
select brand, count(*) filter (where size > 40) as n_protest, any_value(median) as median, any_value(mode)::int as mode, any_value(mode_n) as mode_n from x left join (select brand, round(median(size))::bigint as median from f group by 1) using (brand)
 left join (select brand, size as mode, n as mode_n from c qualify row_number() over (partition by brand order by n desc, size) = 1) using (brand) group by 1""")
def a46_median_and_mode(s, d):
    return M.median_mode(S.table(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")), "brand", "size", 40)


@query(""", c as (select question_number, answer_text, count(*) filter (where is_redacted) as n0, count(*) filter (where not is_redacted) as n1 from answers join respondents using (respondent_id) group by 1, 2),
x as (select *, round(100.0 * n0 / sum(n0) over (partition by question_number) - 100.0 * n1 / sum(n1) over (partition by question_number), 1) as shift from c)
select question_number, answer_text, shift, abs(shift) >= 8 as is_material from x qualify row_number() over (partition by question_number order by abs(shift) desc, answer_text) = 1""", True)
def a50_side_shift(s, d):
    c = S.answers(s, d).join(S.respondents(s, d), "respondent_id").withColumn("side", F.when(F.col("is_redacted"), "r").otherwise("n"))
    return M.side_shift(c.groupBy("question_number", "answer_text", "side").agg(F.count("*").alias("n")), "question_number", "answer_text", "side", "n", ("r", "n"))


@query(""", g as (select country, count(*) as total, round(100.0 * count(*) filter (where is_redacted) / count(*), 1) as share from respondents group by 1 having count(*) >= 20),
x as (select *, row_number() over (order by share desc, country) as t, row_number() over (order by share, country) as b from g)
select country, total, share, t <= 3 as is_top, b <= 3 as is_bottom from x where t <= 3 or b <= 3""", True)
def a51_gradient(s, d):
    return M.gradient(S.respondents(s, d), "country", F.col("is_redacted"), 20)


@query(""", n as (select question_number, count(*) as n from answers group by 1), x as (select *, n - lag(n) over (order by question_number) as change from n)
select *, row_number() over (order by n desc, question_number) = 1 as is_peak, row_number() over (order by change nulls last, question_number) = 1 and change < 0 as is_largest_drop from x""", True)
def a52_attrition(s, d):
    return M.attrition(S.answers(s, d).groupBy("question_number").agg(F.count("*").alias("n")), "question_number", "n")


@query(""", c as (select question_number, answer_text, count(*) as n from answers group by 1, 2) select * from c where answer_text <> 'R' qualify row_number() over (partition by question_number order by n desc, answer_text) = 1""", True)
def a49_modal(s, d):
    c = S.answers(s, d).groupBy("question_number", "answer_text").agg(F.count("*").alias("n"))
    return M.modal(c, "question_number", "answer_text", "n", F.col("answer_text") == "R")


@query("""select case when n_chars < 500 then 0 when n_chars < 2000 then 1 when n_chars < 10000 then 2 else 3 end as band, count(*) as n from documents group by 1""")
def a47_length_bands(s, d):
    return S.table(s, d, "documents").select(M.bands(F.col("n_chars"), [500, 2000, 10000]).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query(""", j as (select question_number, answer_text, count(*) as n, count(distinct bloc) as k from answers join respondents using (respondent_id) group by 1, 2),
x as (select *, row_number() over (partition by question_number order by n desc, answer_text) as r1, row_number() over (partition by question_number order by k desc, answer_text) as r2,
 round(abs(100.0 * n / sum(n) over (partition by question_number) - 100.0 * k / sum(k) over (partition by question_number)), 1) as sh from j)
select question_number, max(case when r1 = 1 then answer_text end) as lead_raw, max(case when r2 = 1 then answer_text end) as lead_dedup, max(sh) as max_shift_pp, max(case when r1 = 1 then answer_text end) <> max(case when r2 = 1 then answer_text end) as flips from x group by 1""", True)
def a53_lead_flip(s, d):
    a = S.answers(s, d).join(S.respondents(s, d).select("respondent_id", "bloc"), "respondent_id")
    c = a.groupBy("question_number", "answer_text").agg(F.count("*").alias("n"), F.countDistinct("bloc").alias("k"))
    return M.lead_flip(c, "question_number", "answer_text", "n", "k")


@query("""select c_custkey, c_name as name, c_mktsegment, c_acctbal from customer where contains(lower(c_name), '00012') and c_mktsegment = 'BUILDING' order by c_acctbal desc nulls last, c_name limit 25""")
def p11_browse(s, d):
    c = S.table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment", "c_acctbal")
    return M.browse(c, "00012", equal={"c_mktsegment": "BUILDING"}, sort="c_acctbal", descending=True)


@query("""select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')""")
def j12_base_exclusion(s, d):
    base = S.table(s, d, "orders").where("o_orderstatus = 'F'")
    return S.table(s, d, "customer").join(base, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


# ---- quality and publishing ----------------------------------------------------------------------------------------


@query("""select 'parts' as "check", count(*) = 0 as ok, count(*)::varchar as detail from orders where o_custkey not in (select c_custkey from customer) union all
select 'scores', count(*) = 0, count(*)::varchar from (select floor((l_quantity - 1) / 10) + 1 as x from lineitem where l_discount <> 0) where x not between 1 and 5""")
def v1_checks(s, d):
    fk = Q.foreign_key(S.table(s, d, "orders"), S.table(s, d, "customer"), "o_custkey", "c_custkey", "parts")
    return Q.all_checks(fk, Q.check(S.answers(s, d), "scores", ~F.col("answer_numeric").between(1, 5)))


@query("""with p as (select p_partkey, string_split(p_name, ' ') as w from part),
back as (select p_partkey, array_to_string(list_filter(w, lambda x: x <> 'red'), ' ') as n, array_to_string(w, ' ') as p_name from p)
select 'conservation' as "check", count(*) filter (where n <> p_name) = 0 as ok, count(*) filter (where n <> p_name)::varchar as detail from back""")
def v1_conservation(s, d):
    """Names put together again without one of their words: the rows that had it are not conserved."""
    p = S.table(s, d, "part").select("p_partkey", "p_name")
    back = I.explode_selections(p.withColumn("raw", F.replace("p_name", F.lit(" "), F.lit(";"))), ["p_partkey"], "raw").where("option_text <> 'red'")
    joined = back.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("selection_index", "option_text"))), lambda x: x["option_text"]), " ").alias("p_name"))
    return Q.conservation(p, joined, ["p_partkey"], "p_name")


@query("""select event_type, date_trunc('day', ts) as day, count(*) as n, count(*) filter (where value >= 100) as n_high from events group by 1, 2""")
def stream_shape_daily_counts(s, d):
    e = S.table(s, d, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 100).alias("n_high"))
