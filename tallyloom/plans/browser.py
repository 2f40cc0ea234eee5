"""Queries of the interactive views and the publishing checks, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import browser as B
from tallyloom.operators import cells as C
from tallyloom.operators import derive as D
from tallyloom.operators import ingest as I
from tallyloom.operators import metrics as M
from tallyloom.operators import views as V
from tallyloom.plans import survey as S
from tallyloom.plans.registry import _SEGMENTS, _segments, query

_CELLS = _SEGMENTS + """, sizes as (select dim, key, count(distinct respondent_id) as size from segments group by 1, 2),
cells as (
  select question_number, dim, key, count(answer_numeric) as n, count(*) filter (where answer_numeric <= 2) as lo, count(*) filter (where answer_numeric = 3) as mid,
         count(*) filter (where answer_numeric >= 4) as hi, round(avg(answer_numeric), 2) as mean, any_value(size) < 5 and dim <> 'overall' as masked
  from answers join segments using (respondent_id) join sizes using (dim, key) group by 1, 2, 3)
"""


def _cells(s, d):
    answers, segments = S.answers(s, d), _segments(s, d)
    return C.likert_cells(C.covered(answers, segments), segments, [1, 2, 3, 4, 5]), segments


def _heatmap_sql(dim: str, value: str) -> str:
    return _CELLS + f"""select question_number, key, case when coalesce(masked, size < 5) then 'masked' when coalesce(n, 0) = 0 then 'empty' else 'data' end as state,
 case when not coalesce(masked, size < 5) and n > 0 then {value} end as value
 from questions cross join (select * from sizes where dim = '{dim}' and size >= 15) z left join cells using (question_number, dim, key)"""


@query(_heatmap_sql("organization_type", "round(100.0 * hi / n, 1) - round(100.0 * lo / n, 1)").replace("then round(100.0 * hi / n, 1) - round(100.0 * lo / n, 1) end", "then round(round(100.0 * hi / n, 1) - round(100.0 * lo / n, 1), 1) end"), True)
def b1_heatmap_net(s, d):
    cells, segments = _cells(s, d)
    return B.heatmap(cells, S.questions(s), C.segment_values(segments), "organization_type", "net")


@query(_heatmap_sql("region", "mean"), True)
def b1_heatmap_mean(s, d):
    cells, segments = _cells(s, d)
    return B.heatmap(cells, S.questions(s), C.segment_values(segments), "region", "mean")


@query(_CELLS + """select question_number, case question_number when 7 then 0 when 2 then 1 else 2 end::int as ord, key, n, round(100.0 * lo / n, 1) as pct_low, round(100.0 * mid / n, 1) as pct_mid, round(100.0 * hi / n, 1) as pct_high
from cells where dim = 'redaction' and question_number in (7, 2, 4)""", True)
def b2_strip(s, d):
    return B.strip(_cells(s, d)[0], [7, 2, 4], "redaction")


@query("""select a.respondent_id, a.question_number, a.option_text, q.shorthand, r.organization_type, r.is_redacted
from (select respondent_id, question_number, answer_text as option_text from answers) a join questions q using (question_number) join respondents r using (respondent_id) where q.question_type = 'multi_select'""", True)
def view_selections(s, d):
    picked = S.answers(s, d).select("respondent_id", "question_number", F.col("answer_text").alias("option_text"))
    out = V.selections_view(picked, S.questions(s).where("question_type = 'multi_select'"), S.respondents(s, d))
    return out.select("respondent_id", "question_number", "option_text", "shorthand", "organization_type", "is_redacted")


@query("""select question_number, option_text, n, shorthand from (select question_number, answer_text as option_text, count(*) as n from answers group by 1, 2) join questions using (question_number)""", True)
def view_option_counts(s, d):
    options = S.answers(s, d).groupBy("question_number", F.col("answer_text").alias("option_text")).agg(F.count("*").alias("n"))
    return V.option_counts(options, S.questions(s)).select("question_number", "option_text", "n", "shorthand")


@query(r"""with x as (select page_id, len(regexp_extract_all(html, '(?i)(?:https?://|www\.)[^\s<>"'')\]]+')) as n_urls from pages) select page_id, n_urls::int as n_urls from x where n_urls > 0""")
def a31_citations(s, d):
    found = D.citations(S.table(s, d, "pages"), "page_id", "html")
    return found.where(F.array_contains("signals", "url")).select("page_id", "n_urls")


@query("""with m as (select p_name as block, p_partkey, p_type = 'PROMO' as cites from part), c as (select block, count(*) as n_sharers from m group by 1 having count(*) >= 3)
select block, count(*) as n_answers, count(*) filter (where cites) as n_citing, any_value(n_sharers) as n_sharers from m left join c using (block) group by 1 having count(*) filter (where cites) > 0""")
def j17_citation_blocks(s, d):
    m = S.table(s, d, "part").select(F.col("p_name").alias("block"), "p_partkey", (F.col("p_type") == "PROMO").alias("cites"))
    clusters = m.groupBy(F.col("block").alias("cluster")).agg(F.count("*").alias("n")).where("n >= 3")
    return B.citation_blocks(m, F.col("cites"), clusters)


@query("""with m as (select p_name as block, count(*) filter (where p_type = 'PROMO') as c from part group by 1 having count(*) filter (where p_type = 'PROMO') > 0), n as (select count(*) as n from part)
select count(*) as n_blocks, sum(c)::bigint as n_citing, round(100.0 * count(*) / any_value(n), 1) as lo_pct, round(100.0 * sum(c) / any_value(n), 1) as hi_pct from m, n""")
def a44_citation_interval(s, d):
    m = S.table(s, d, "part").select(F.col("p_name").alias("block"), (F.col("p_type") == "PROMO").alias("cites"))
    none = m.select(F.col("block").alias("cluster"), F.lit(0).alias("n")).limit(0)
    return B.citation_interval(B.citation_blocks(m, F.col("cites"), none), S.table(s, d, "part").count())


@query(""", r as (select count(*) as n_respondents, count(*) filter (where is_redacted) as n_redacted, count(*) filter (where not is_redacted) as n_named from respondents),
a as (select count(distinct respondent_id) as n_answering, count(*) as n_answers from answers) select *, round(n_answers / n_respondents, 1) as per_respondent from r, a""", True)
def a41_turnout(s, d):
    return B.turnout(S.respondents(s, d), S.answers(s, d), F.col("is_redacted"))


@query("select sector as bloc, count(*) as n_members, count(distinct country) as n_countries, count(distinct country) = 1 as single_country from respondents group by 1 union all select organization, count(*), count(distinct country), count(distinct country) = 1 from respondents group by 1", True)
def x6_bloc_countries(s, d):
    r = S.respondents(s, d)
    members = r.select(F.col("sector").alias("bloc"), "country").unionByName(r.select(F.col("organization").alias("bloc"), "country"))
    return B.bloc_countries(members, "bloc", "country")


@query("""select country, count(*) as n, count(*) filter (where organization_type in ('BUILDING', 'MACHINERY')) as n_business, count(*) filter (where organization_type = 'HOUSEHOLD') as n_nonprofit,
round(100.0 * count(*) filter (where organization_type in ('BUILDING', 'MACHINERY')) / count(*), 1) as pct_business, round(100.0 * count(*) filter (where organization_type = 'HOUSEHOLD') / count(*), 1) as pct_nonprofit from respondents group by 1""", True)
def a56_lead_stats(s, d):
    return B.lead_stats(S.respondents(s, d), "country", "organization_type", {"business": ["BUILDING", "MACHINERY"], "nonprofit": ["HOUSEHOLD"]})


_AUDIT = "select c_custkey as respondent_id, c_name as name, c_mktsegment as claimed, case when c_acctbal < 0 then 'BUILDING' else c_mktsegment end as audited, n_name as basis from customer join nation on c_nationkey = n_nationkey"


def _audit(s, d):
    c = S.table(s, d, "customer").join(S.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    audited = F.when(F.col("c_acctbal") < 0, "BUILDING").otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("respondent_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("claimed"), audited.alias("audited"), F.col("n_name").alias("basis"))


@query(f"select * from ({_AUDIT}) where claimed <> audited and claimed = 'HOUSEHOLD' and lower(name || ' ' || basis) like '%nation_1%'")
def p12_audit_drill(s, d):
    return B.audit_drill(_audit(s, d), moved_only=True, claimed="HOUSEHOLD", search="NATION_1")


@query(f"select basis as bloc, audited, count(*) as n from ({_AUDIT}) group by 1, 2")
def j24_audit_of_blocs(s, d):
    a = _audit(s, d)
    return B.audit_of_blocs(a.select("respondent_id", "audited"), a.select("respondent_id", F.col("basis").alias("bloc")))


@query("""with c as (select p_name, count(*) as k from part group by 1) select p_partkey, p_type as topic from part join c using (p_name) where p_type = 'PROMO' and (p_name like '%red%' or p_name like '%ring%') and k >= 3""")
def p13_quote_filter(s, d):
    p = S.table(s, d, "part")
    shared = p.groupBy("p_name").agg(F.count("*").alias("k"))
    quotes = p.join(shared, "p_name").select("p_partkey", F.col("p_type").alias("topic"), F.array_compact(F.array(*(F.when(F.contains("p_name", F.lit(t)), F.lit(t)) for t in ("red", "ring", "cold")))).alias("themes"), (F.col("k") >= 3).alias("is_template"))
    return B.quote_filter(quotes, ["red", "ring"], True, topic="PROMO").select("p_partkey", "topic")


@query("select respondent_id, question_number, answer_text from answers join respondents using (respondent_id) where not is_redacted and question_number in (1, 5)", True)
def p7_named_profile(s, d):
    """Questions 1, 3 and 5 as profile questions, of which 3 is hidden."""
    star = V.star(S.answers(s, d), S.questions(s), S.respondents(s, d))
    star = star.withColumn("role", F.when(F.col("question_number").isin(1, 3, 5), "profile").otherwise(F.col("role")))
    return B.public_columns(B.named_profile(star, [3, 15, 17]), ["respondent_id", "question_number", "answer_text"])


@query("select respondent_id, organization_type, is_redacted from respondents", True)
def p16_public_columns(s, d):
    return B.public_columns(S.respondents(s, d), ["respondent_id", "organization_type", "is_redacted"])


@query("""select question_number, answer_text as answer, count(*) filter (where question_number <> 3) as n, count(distinct case when question_number = 3 then respondent_id end) as pickers
from answers join respondents using (respondent_id) where not is_redacted group by 1, 2""", True)
def s11_answer_index(s, d):
    a = S.answers(s, d)
    picks = a.where("question_number = 3").select("respondent_id", "question_number", F.col("answer_text").alias("option_text"))
    return B.answer_index(a.where("question_number <> 3"), picks, S.respondents(s, d).where("not is_redacted"))


@query("""with l as (select n_nationkey as left_id, lower(n_name || ' ' || r_name) as k from nation join region on n_regionkey = r_regionkey), r as (select r_regionkey as right_id, lower('in ' || r_name) as k from region union all select 100 + n_nationkey, lower(n_name || ' ' || r_name || ' land') from nation join region on n_regionkey = r_regionkey)
select left_id, right_id, 'variant' as tier from l join r on len(list_filter(string_split(l.k, ' '), lambda x: not list_contains(string_split(r.k, ' '), x))) = 0""")
def j22_entity_variants(s, d):
    r = S.table(s, d, "region")
    n = S.table(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.lower(F.concat_ws(" ", "n_name", "r_name"))
    left = n.select(F.col("n_nationkey").cast("long").alias("id"), own.alias("key"))
    right = r.select(F.col("r_regionkey").cast("long").alias("id"), F.lower(F.concat(F.lit("in "), "r_name")).alias("key")).unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.concat(own, F.lit(" land")).alias("key")))
    return B.entity_variants(left, right)


@query(""", n as (select country, count(*) as n, count(*) filter (where is_redacted) as f from respondents group by 1) select case when n < 600 then 'other' else country end as country, sum(n)::bigint as n, sum(f)::bigint as n_flagged from n group by 1""", True)
def a21_rare_tail(s, d):
    return B.rare_tail(S.respondents(s, d), "country", F.col("is_redacted"), 600)


@query(""", stance as (select respondent_id, max(answer_numeric) as score from answers where question_number = 2 group by 1),
j as (select a.respondent_id, a.answer_text as option_text, organization_type, case when score <= 2 then 'oppose' when score = 3 then 'neutral' when score > 3 then 'support' else 'no_anchor' end as bucket
 from answers a join respondents using (respondent_id) left join stance using (respondent_id) where question_number = 3),
b as (select bucket, organization_type, count(distinct respondent_id) as base from j group by 1, 2)
select option_text, bucket, organization_type, count(distinct respondent_id) as n, any_value(base) as base, round(100.0 * count(distinct respondent_id) / any_value(base), 1) as pct from j join b using (bucket, organization_type) group by 1, 2, 3""", True)
def a17_basis_by_type(s, d):
    a = S.answers(s, d)
    stance = a.where("question_number = 2").groupBy("respondent_id").agg(F.max("answer_numeric").alias("score"))
    picked = a.where("question_number = 3").select("respondent_id", F.col("answer_text").alias("option_text"))
    return B.basis_by_type(picked, stance, S.respondents(s, d), C.stance_bucket(F.col("score")))


@query(""", p as (select answer_text as option_text, organization_type, is_redacted, respondent_id from answers join respondents using (respondent_id) where question_number = 3)
select option_text, organization_type as by, count(distinct respondent_id) as n from p group by 1, 2 union all select option_text, case when is_redacted then 'redacted' else 'named' end, count(distinct respondent_id) from p group by 1, 2""", True)
def a16_picklist_by(s, d):
    picked = S.answers(s, d).where("question_number = 3").select("respondent_id", "question_number", F.col("answer_text").alias("option_text"))
    segments = _segments(s, d).where("dim in ('organization_type', 'redaction')")
    return C.pick_cells(picked, segments).select("option_text", F.col("key").alias("by"), "n")


@query("""with w as (select source, len(regexp_extract_all(text, '\\S+')) as n from documents), m as (select source, median(n) as median, max(n)::int as max from w where n > 0 group by 1),
b as (select source, case when n = 0 then -1 when n < 50 then 0 when n < 200 then 1 when n < 1000 then 2 when n < 3000 then 3 else 4 end::int as band from w),
g as (select source, unnest(range(0, max(band) + 1))::int as band from b group by 1 union all select distinct source, -1 from b where band = -1)
select source, band, (select count(*) from b where b.source = g.source and b.band = g.band) as n, median, max from g left join m using (source)""")
def a47_verbosity(s, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return B.verbosity(S.table(s, d, "documents").select("source", n.alias("n_words")), "source", "n_words", [50, 200, 1000, 3000])


@query("""select question_number, count(answer_numeric) as n, round(100.0 * count(*) filter (where answer_numeric <= 2) / count(answer_numeric), 1) as pct_critical, count(*) filter (where answer_numeric is null) as n_off,
round(100.0 * count(*) filter (where answer_numeric is null) / count(*), 1) as pct_off from answers group by 1""", True)
def a49_critical_share(s, d):
    return B.critical_share(S.answers(s, d), "question_number", "answer_numeric")


@query(""", t as (select respondent_id, bloc, question_number, answer_text from answers join respondents using (respondent_id)), b as (select count(distinct respondent_id) as base from t)
select answer_text as theme, count(distinct respondent_id) as n, count(distinct (bloc, question_number)) as n_dedup, round(100.0 * count(distinct respondent_id) / any_value(base), 1) as share_pct from t, b group by 1""", True)
def a40_theme_counts_by_question(s, d):
    coded = S.answers(s, d).join(S.respondents(s, d), "respondent_id").withColumn("theme_keys", F.col("answer_text"))
    return M.theme_counts(coded, F.col("bloc"), "respondent_id", question="question_number")


@query("select doc_id, substr(text, 1, 120) as short from documents")
def f27_short_text(s, d):
    """The first 120 characters are the published column."""
    return S.table(s, d, "documents").select("doc_id", T.short_text(F.col("text")).alias("short"))


@query("""with m as (select 'respondents' as figure, count(*)::double as found from orders union all select 'answers', count(*)::double from lineitem),
e as (select * from (values ('respondents', -1.0), ('answers', -2.0), ('absent', 0.0)) t(figure, expected))
select figure, expected::double as expected, found, false as ok from e left join m using (figure) union all select 'regions', 5.0, count(*)::double, count(*) = 5 from region""")
def v6_frozen_figures(s, d):
    def figure(name: str, table: str):
        return S.table(s, d, table).agg(F.count("*").alias("value")).select(F.lit(name).alias("figure"), "value")

    measured = figure("respondents", "orders").unionByName(figure("answers", "lineitem")).unionByName(figure("regions", "region"))
    return B.frozen_figures(measured, {"respondents": -1, "answers": -2, "absent": 0, "regions": 5})


@query("""select question_number, answer_text, option_rank from (select question_number, answer_text, row_number() over (partition by question_number order by count(*) desc, answer_text)::int as option_rank from answers group by 1, 2)""", True)
def w7_frequency_ranks(s, d):
    counts = S.answers(s, d).groupBy("question_number", "answer_text").agg(F.count("*").alias("n"))
    return I.frequency_ranks(counts, ["question_number"], "answer_text", "n").select("question_number", "answer_text", "option_rank")
