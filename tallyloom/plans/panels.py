"""More registered queries: the published panels, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import rounding as R
from tallyloom.functions import text as T
from tallyloom.operators import cells as C
from tallyloom.operators import derive as D
from tallyloom.operators import panels as P
from tallyloom.operators import views as V
from tallyloom.plans import survey as S
from tallyloom.plans.registry import _SEGMENTS, _SUMMARY, query


@query("select (1990 + p_size * 2)::int as year, count(*) as n, (1990 + p_size * 2) > 2050 as is_protest from part where p_type <> 'ECONOMY' group by 1, 3")
def a19_year_histogram(s, d):
    text = F.when(F.col("p_type") == "ECONOMY", "n/a").otherwise((1990 + F.col("p_size") * 2).cast("string"))
    return P.year_histogram(S.table(s, d, "part").select(text.alias("t")), "t")


@query(""", e as (select question_number, country, count(case when is_redacted then answer_numeric end) as n_a, round(avg(case when is_redacted then answer_numeric end), 2) as mean_a, count(case when not is_redacted then answer_numeric end) as n_b, round(avg(case when not is_redacted then answer_numeric end), 2) as mean_b
 from answers join respondents using (respondent_id) group by 1, 2)
select question_number || ' ' || country as cell, case when n_a >= 5 and n_b >= 5 then n_a end as n_a, case when n_a >= 5 and n_b >= 5 then mean_a end as mean_a, case when n_a >= 5 and n_b >= 5 then n_b end as n_b, case when n_a >= 5 and n_b >= 5 then mean_b end as mean_b, not (n_a >= 5 and n_b >= 5) as masked from e""", True)
def a22_side_effect(s, d):
    a = S.answers(s, d).join(S.respondents(s, d), "respondent_id")
    a = a.select(F.concat_ws(" ", F.col("question_number").cast("string"), "country").alias("cell"), F.when(F.col("is_redacted"), "r").otherwise("n").alias("side"), "answer_numeric")
    return P.side_effect(a, "cell", "side", ("r", "n"), "answer_numeric")


@query("select p_brand as claimed, p_type as audited, case when p_brand = 'Brand#1' then 'ECONOMY' else p_brand end = p_type as matches, count(*) as n from part group by 1, 2, 3")
def a24_audit_matrix(s, d):
    p = S.table(s, d, "part").select(F.col("p_brand").alias("claimed"), F.col("p_type").alias("audited"))
    return P.audit_matrix(p, "claimed", "audited", {"Brand#1": "ECONOMY"})


@query(""", sig as (select respondent_id, max(case when question_number = 2 then answer_numeric end)::int::varchar || max(case when question_number = 4 then answer_numeric end)::int::varchar as x from answers group by 1),
m as (select 'ones' as bloc, respondent_id, 'signature' as rule from sig where x = '11' union all select 'ones', respondent_id, 'name' from respondents where regexp_matches(organization, '7$'))
select bloc, respondent_id, string_agg(distinct rule, '|' order by rule) as rules from m group by 1, 2""", True)
def a30_blocs_by_rule(s, d):
    sig = D.anchor_signature(S.answers(s, d).withColumn("sc", F.col("answer_numeric").cast("int")), "respondent_id", "question_number", "sc", [2, 4])
    named = S.respondents(s, d).where(F.col("organization").rlike("7$")).select(F.lit("ones").alias("bloc"), "respondent_id")
    out = P.blocs_by_rule({"signature": P.signature_members(sig, {"ones": "11"}), "name": named}, S.respondents(s, d))
    return out.select("bloc", "respondent_id", F.array_join("rules", "|").alias("rules"))


@query(""", f as (select respondent_id, bool_or(option_text like 'widg%') as general, bool_or(option_text like 'red%') as empirical, bool_or(option_text like 'blu%') as operational from picks group by 1)
select *, general and not (empirical or operational) as general_only from f""", True)
def a32_evidence_flags(s, d):
    return P.evidence_flags(S.picks(s, d), {"general": "widg", "empirical": "red", "operational": "blu"})


@query("""with g as (select distinct p_brand as group_id, p_partkey as respondent_id from part), c as (select distinct p_name as cluster_id, p_partkey as respondent_id from part),
sh as (select group_id, cluster_id, count(*) as k from g join c using (respondent_id) group by 1, 2 having count(*) >= 2)
select group_id, any_value(n) as n_shared_texts, count(distinct respondent_id) as n_spanned from sh join c using (cluster_id) join (select group_id, count(*) as n from sh group by 1) using (group_id) group by 1""")
def a38_spanned_headcount(s, d):
    p = S.table(s, d, "part")
    members = p.select(F.col("p_name").alias("cluster_id"), F.col("p_partkey").alias("respondent_id"))
    return P.spanned(p.select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("respondent_id")), members)


@query("""with x as (select p_name, count(*) as n, max((p_size > 45)::int) as c, sum((p_size > 45)::int) as k from part group by 1)
select sum(n)::bigint as n_memberships, count(*) as n_texts, (sum(n) - count(*))::bigint as n_copies, sum(k)::bigint as citing_raw, sum(c)::bigint as citing_once from x""")
def a44_template_copies(s, d):
    return P.template_copies(S.table(s, d, "part"), "p_name", F.col("p_size") > 45)


@query("""with x as (select p_type as topic, unnest(string_split(p_name, ' ')) as theme from part)
select topic, theme, count(*) as n, case theme when 'red' then 'concern' when 'blue' then 'support' else 'orphan' end as polarity from x group by 1, 2""")
def a48_theme_mentions(s, d):
    p = S.table(s, d, "part").select(F.col("p_type").alias("topic"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("t"))
    return P.theme_mentions(p, "topic", "t", {"red": "concern", "blue": "support"})


@query("select item_id, 'not verbatim' as problem from benchmark where item_id % 2 = 1 union all select item_id + 1000000, 'no such answer' from benchmark where item_id % 10 = 0")
def j14_quote_problems(s, d):
    b = S.table(s, d, "benchmark")
    quote = F.when(F.col("item_id") % 2 == 1, F.concat(F.substring("text", 1, 20), F.lit("#"))).otherwise(F.substring("text", 1, 20))
    quotes = b.select("item_id", quote.alias("q")).unionByName(b.where("item_id % 10 = 0").select((F.col("item_id") + 1000000).alias("item_id"), F.col("text").alias("q")))
    return P.quote_problems(quotes, b, ["item_id"], "q", "text")


@query("with c as (select p_name, count(*) as size from part group by 1) select p_brand, p_name, size from (select distinct p_brand, p_name from part) join c using (p_name) qualify row_number() over (partition by p_brand order by size desc, p_name) = 1")
def j15_first_cluster(s, d):
    p = S.table(s, d, "part")
    m = p.select("p_brand", "p_name").distinct().join(p.groupBy("p_name").agg(F.count("*").alias("size")), "p_name")
    return P.first_cluster(m, ["p_brand"], "size", "p_name").select("p_brand", "p_name", "size")


@query(""", st as (select shorthand, count(*) filter (where answer_numeric <= 2) as lo, count(*) filter (where answer_numeric = 3) as mid, count(*) filter (where answer_numeric >= 4) as hi from answers join questions using (question_number) group by 1),
fe as (select shorthand, count(*) as n_feasible from answers join questions using (question_number) where answer_text = 'A' and section <> 'C' group by 1)
select shorthand, lo, mid, hi, lo + mid + hi as n, round(round(100.0 * hi / (lo + mid + hi), 1) - round(100.0 * lo / (lo + mid + hi), 1), 1) as net_pct, n_feasible from st left join fe using (shorthand)""", True)
def j20_matrix_rows(s, d):
    a, x = S.answers(s, d).join(S.questions(s), "question_number"), F.col("answer_numeric")
    stances = a.groupBy("shorthand").agg(F.count_if(x <= 2).alias("lo"), F.count_if(x == 3).alias("mid"), F.count_if(x >= 4).alias("hi"))
    return P.matrix_rows(stances, a.where("answer_text = 'A' and section <> 'C'").groupBy("shorthand").agg(F.count("*").alias("n_feasible")), "shorthand")


@query(""", o as (select respondent_id as old_id, question_number, min(answer_text) as old_text from answers group by 1, 2),
p as (select bloc, min(respondent_id) as old_id, max(respondent_id) as new_id from respondents group by 1 having count(*) > 1)
select p.old_id, p.new_id, a.question_number, a.old_text, b.old_text as new_text from p join o a using (old_id) join o b on b.old_id = p.new_id and b.question_number = a.question_number where a.old_text <> b.old_text""", True)
def j21_changed_answers(s, d):
    a = S.answers(s, d).groupBy("respondent_id", "question_number").agg(F.min("answer_text").alias("t"))
    pairs = S.respondents(s, d).groupBy("bloc").agg(F.min("respondent_id").alias("old_id"), F.max("respondent_id").alias("new_id")).where("old_id < new_id").drop("bloc")
    return D.changed_answers(a, pairs, "respondent_id", "question_number", "t").select("old_id", "new_id", "question_number", F.lower("old_text").alias("l"), "old_text", "new_text").drop("l")


@query("""with v as (select p_name || ' ' || p_size as cluster_id, p_partkey as id from part), g as (select p_type as group_id, p_partkey as id from part),
c as (select cluster_id, count(*) as size from v group by 1)
select group_id, cluster_id from v join g using (id) join c using (cluster_id) group by 1, 2 having count(*) = any_value(size)""")
def j18_contained_runs(s, d):
    p = S.table(s, d, "part")
    members = p.select(F.concat_ws(" ", "p_name", "p_size").alias("cluster_id"), F.col("p_partkey").alias("id"))
    return D.contained_runs(members, p.select(F.col("p_type").alias("group_id"), F.col("p_partkey").alias("id")))


@query(_SUMMARY + "select coalesce(scale_construct, 'none') as construct, count(mean_score) as n_questions, round(avg(mean_score), 2) as mean_of_means from summary group by 1", True)
def a54_mean_of_means(s, d):
    x = V.scale_summary(S.answers(s, d), S.questions(s)).withColumn("construct", F.coalesce("scale_construct", F.lit("none")))
    return P.mean_of_means(x, "construct", "mean_score")


@query("select p_brand, round(median(p_size))::bigint as median from part group by 1")
def r10_weighted_median(s, d):
    h = S.table(s, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return P.weighted_median(h, "p_brand", "p_size", "n")


@query("select distinct p_name as option_text, 1 as match_rank from part where p_name like 'red%' order by 1 limit 1")
def p14_match_option(s, d):
    return P.match_option(S.table(s, d, "part").select(F.col("p_name").alias("option_text")).distinct(), "RED")


@query(_SEGMENTS + "select dim, key, count(distinct respondent_id) as n, count(distinct respondent_id) >= 3000 as shown from segments group by 1, 2", True)
def p9_visible_columns(s, d):
    from tallyloom.plans.registry import _segments

    return P.visible_columns(C.segment_values(_segments(s, d)), 3000)


@query("select o_custkey as respondent_id, count(*)::int as n_answers, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as in_order from orders group by 1")
def r5_organisation_answers(s, d):
    a = S.table(s, d, "orders").select(F.col("o_custkey").alias("respondent_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("answer_text"), F.array("o_orderpriority").alias("selections"))
    out = P.organisation_answers(a, "ord")
    return out.select("respondent_id", F.size("answers").alias("n_answers"), F.array_join(F.transform("answers", lambda x: x["ord"].cast("string")), ",").alias("in_order"))


@query("""select doc_id, len(list_filter(string_split(text, '. '), lambda x: trim(x) <> ''))::int as n_sentences from documents""")
def r8_sentences(s, d):
    return S.table(s, d, "documents").select("doc_id", F.size(P.sentences(F.col("text"))).alias("n_sentences"))


@query("""with l as (select regexp_extract(url, '://([^/?#]*)', 1) as h from pages), x as (select array_to_string(string_split(lower(h), '.')[-2:], '.') as domain, count(*) as n from l group by 1)
select case when domain = 'example.net' then 'network' when domain like '%.org' then 'nonprofit' else 'other' end as class, count(*) as n_domains, sum(n)::bigint as n_links from x group by 1""")
def a43_domain_classes(s, d):
    return P.domain_classes(D.linked_domains(S.table(s, d, "pages"), "page_id", "url"), {"example.net": "network"}, [(".org", "nonprofit")])


@query("select o_orderstatus as k, count(*) as n from orders group by 1")
def a42_frequency_map(s, d):
    return P.frequency_map(S.table(s, d, "orders"), "o_orderstatus").select(F.explode("frequencies").alias("k", "n"))


@query("""with k as (select p_size, p_retailprice from part where p_type <> 'PROMO'),
r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2 as b from k)
select count(*) as n, round(corr(a, b), 6) as rho from r""")
def m14_spearman(s, d):
    """Over complete pairs: one type's sizes count as missing."""
    return P.spearman(S.table(s, d, "part").withColumn("size", F.when(F.col("p_type") != "PROMO", F.col("p_size"))), "size", "p_retailprice")


@query("""with c as (select p_brand, p_type, count(*) as o from part group by 1, 2), x as (select o, sum(o) over (partition by p_brand) as r, sum(o) over (partition by p_type) as k, sum(o) over () as n, p_brand, p_type from c)
select max(n)::bigint as n, round(sum(o::double * o * n / (r * k)) - max(n), 6) as chi2, ((count(distinct p_brand) - 1) * (count(distinct p_type) - 1))::bigint as degrees from x""")
def m14_chi_square(s, d):
    return P.chi_square(S.table(s, d, "part"), "p_brand", "p_type")


@query("select respondent_id from respondents where is_redacted and sector = '1-URGENT'", True)
def x4_never_named(s, d):
    """Published: all who are not redacted, and by mistake one sector whole."""
    r = S.respondents(s, d)
    return P.never_named(r.where("not is_redacted or sector = '1-URGENT'").select("respondent_id"), r.where("is_redacted"), "respondent_id")


@query(""", x as (select question_number, answer_text, count(*) as n from answers group by 1, 2) select question_number, to_json({'n': n, 'text': answer_text})::varchar as doc from x""", True)
def k7_json_documents(s, d):
    from tallyloom.sources.sinks import json_column

    x = S.answers(s, d).groupBy("question_number", F.col("answer_text").alias("text")).agg(F.count("*").alias("n"))
    return x.select("question_number", json_column(x, ["text", "n"]).alias("doc"))


@query("""select doc_id, case when length(trim(c)) = 0 then 0 else len(string_split(trim(c), ' ')) end::int as n_words, length(text) >= 3990 as truncated from (select doc_id, text, regexp_replace(text, '\\s+', ' ', 'g') as c from documents)""")
def f14_word_counts(s, d):
    return S.table(s, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.likely_truncated(F.length("text"), 4000, 10).alias("truncated"))


@query("select s_suppkey, s_name, round(s_acctbal, 2) as balance, case when s_acctbal = floor(s_acctbal) then floor(s_acctbal)::bigint::varchar else s_acctbal::varchar end as shown from supplier")
def m5_whole_or_double(s, d):
    x = S.table(s, d, "supplier")
    return x.select("s_suppkey", "s_name", R.r2(F.col("s_acctbal")).alias("balance"), R.whole_or_double(F.col("s_acctbal")).alias("shown"))
