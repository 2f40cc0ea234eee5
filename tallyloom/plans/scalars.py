"""Registered queries of the scalar functions, on the driver's texts, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import rounding as R
from tallyloom.functions import text as T
from tallyloom.operators import metrics as M
from tallyloom.operators import panels as P
from tallyloom.plans import survey as S
from tallyloom.plans.registry import query

_WS = r"[\s\x0B\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+"


@query(rf"select doc_id, sha1(trim(regexp_replace(lower(text), '{_WS}', ' ', 'g'))) as h from documents")
def f3_f4_normalised_hash(s, d):
    return S.table(s, d, "documents").select("doc_id", T.text_hash(T.normalize(F.col("text"))).alias("h"))


@query(r"select doc_id, length(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g')) as n from documents")
def f1_norm_text(s, d):
    return S.table(s, d, "documents").select("doc_id", F.length(T.norm_text(F.col("text"))).alias("n"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') as k from (select p_partkey, '. ' || p_name || '  X.' as raw from part)")
def f2_norm_key(s, d):
    return S.table(s, d, "part").select("p_partkey", T.norm_key(F.concat(F.lit(". "), "p_name", F.lit("  X."))).alias("k"))


@query("select doc_id, case when length(text) <= 600 then text else coalesce(nullif(regexp_extract(substr(text, 1, 600), '(?s)^(.*) ', 1), ''), substr(text, 1, 600)) end as quote from documents")
def f8_quote_cut(s, d):
    return S.table(s, d, "documents").select("doc_id", T.quote_cut(F.col("text")).alias("quote"))


@query("""with h as (select page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') as host from pages), p as (select page_id, string_split(host, '.') as l from h) select page_id, array_to_string(l[-2:], '.') as domain from p""")
def f10_registrable_domain(s, d):
    return S.table(s, d, "pages").select("page_id", T.registrable_domain(F.col("url"), strict=True).alias("domain"))


@query(r"""select page_id, len(regexp_extract_all(html, '(?i)(?:https?://|www\.)[^\s<>"'')\]]+'))::int as n_urls from pages""")
def f13_find_urls(s, d):
    return S.table(s, d, "pages").select("page_id", F.size(T.find_urls(F.col("html"))).alias("n_urls"))


@query("select p_partkey, case when strpos(p_name, ' ') > 0 then substr(p_name, 1, strpos(p_name, ' ')) end as part_text from part")
def f17_between_markers(s, d):
    p = S.table(s, d, "part").withColumn("x", F.concat(F.lit("<"), "p_name"))
    return p.select("p_partkey", F.substr(T.between_markers(F.col("x"), "<", " "), F.lit(2)).alias("part_text"))


@query("select p_partkey, length(regexp_replace(lower(p_name), '[^aeiou]', '', 'g')) / length(regexp_replace(lower(p_name), '[^a-z]', '', 'g')) as ratio, regexp_matches(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), '" + T.keyboard_pattern() + "') as keys from part")
def f18_f20_vowels_and_keys(s, d):
    return S.table(s, d, "part").select("p_partkey", T.vowel_ratio(F.col("p_name")).alias("ratio"), T.has_keyboard_run(F.col("p_name")).alias("keys"))


@query("select o_orderkey, lower(trim(o_orderstatus)) in ('-', '.', '/', 'x') as placeholder from orders")
def f22_placeholder(s, d):
    return S.table(s, d, "orders").select("o_orderkey", T.is_placeholder(F.col("o_orderstatus")).alias("placeholder"))


@query("select p_partkey, array_to_string(list_filter(range(p_size, p_size + 4), lambda v: v >= 3 and v <> 10), ',') as refs from part")
def f23_references(s, d):
    text = F.concat(F.lit("see questions "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit(" and Q10"))
    refs = T.question_references(text, F.lit(10))
    return S.table(s, d, "part").select("p_partkey", F.array_join(F.transform(refs, lambda v: v.cast("string")), ",").alias("refs"))


@query("select p_partkey, 'Q' || lpad(p_size::varchar, 3, '0') || '_1' as question_id, p_name as wording from part")
def f26_question_header(s, d):
    h = T.question_header(F.concat(F.col("p_size").cast("string"), F.lit(".1. "), "p_name"))
    return S.table(s, d, "part").select("p_partkey", h["question_id"].alias("question_id"), h["wording"].alias("wording"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'Redacted' else c_name end || ' — ' || c_mktsegment || ', ' || n_name as who from customer join nation on c_nationkey = n_nationkey")
def f29_attribution(s, d):
    c = S.table(s, d, "customer").join(S.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", T.attribution(F.col("c_name"), F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"), F.col("n_name")).alias("who"))


@query("select o_orderkey, coalesce(try_cast(substr(o_orderpriority, 1, 1) as int), 0) as level, 0 as none, 1990 + o_orderkey % 9 as year from orders")
def f30_f31_numbers(s, d):
    y = (1990 + F.col("o_orderkey") % 9).cast("string")
    return S.table(s, d, "orders").select("o_orderkey", T.int_or_zero(F.substring("o_orderpriority", 1, 1)).alias("level"), T.int_or_zero(F.col("o_orderpriority")).alias("none"), T.parse_year(y).cast("long").alias("year"))


@query("select p_partkey, case when regexp_matches(p_name, '(?i)WIDGET') then 'strong' when regexp_matches(p_name, '(?i)ring|bolt') then 'weak' else 'none' end as tier from part")
def f33_evidence_tier(s, d):
    return S.table(s, d, "part").select("p_partkey", T.first_match(F.col("p_name"), [("strong", "WIDGET"), ("weak", "ring|bolt")], "none").alias("tier"))


@query("select p_partkey, upper(substr(p_type, 1, 1)) || substr(replace(p_type, '_', ' '), 2) as shown, p_brand as label from part")
def f36_labels(s, d):
    return S.table(s, d, "part").select("p_partkey", T.humanise(F.col("p_type")).alias("shown"), T.short_label(F.concat("p_brand", F.lit(" (please specify)"))).alias("label"))


@query("select p_partkey, length(p_brand) = 8 and p_brand like 'Brand#1_' as ok from part")
def f38_patterns(s, d):
    return S.table(s, d, "part").select("p_partkey", F.col("p_brand").rlike("^Brand#1[0-9]$").alias("ok"))


@query("select o_orderkey, make_date(1992 + (o_orderkey % 7)::int, 1 + (o_orderkey % 12)::int, 3)::varchar as day from orders")
def d1_date_in_file_name(s, d):
    name = F.concat(F.lit("export_"), (1992 + F.col("o_orderkey") % 7).cast("string"), F.lit("."), F.lpad((1 + F.col("o_orderkey") % 12).cast("string"), 2, "0"), F.lit(".03.xlsx"))
    return S.table(s, d, "orders").select("o_orderkey", T.iso_date_in(name).cast("string").alias("day"))


@query("select p_brand, round(100.0 * count(*) filter (where p_size > 25) / count(*), 1) as pct, round(count(*)::double / count(distinct p_type), 1) as per_type, round(avg(p_size), 2) as mean from part group by 1")
def m2_rates(s, d):
    return S.table(s, d, "part").groupBy("p_brand").agg(R.pct(F.count_if(F.col("p_size") > 25), F.count("*")).alias("pct"), R.r1(F.count("*") / F.countDistinct("p_type")).alias("per_type"), R.r2(F.avg("p_size")).alias("mean"))


@query("""with c as (select p_brand, count(*) filter (where p_size <= 10) as a, count(*) filter (where p_size between 11 and 20) as b, count(*) filter (where p_size between 21 and 30) as c, count(*) filter (where p_size between 31 and 40) as d, count(*) filter (where p_size > 40) as e from part group by 1)
select p_brand, a + b as coarse, c as middle, d + e as fine, round(round(100.0 * (d + e) / (a + b + c + d + e), 1) - round(100.0 * (a + b) / (a + b + c + d + e), 1), 1) as net from c""")
def a49_ladder_bins_and_metric(s, d):
    x = M.bands(F.col("p_size"), [11, 21, 31, 41])
    c = S.table(s, d, "part").withColumn("band", x).groupBy("p_brand").agg(F.array(*(F.count_if(F.col("band") == i) for i in range(5))).alias("c"))
    return c.select("p_brand", F.inline(F.array(M.ladder_bins(F.col("c")))), "c").select("p_brand", "coarse", "middle", "fine", R.metric(F.col("c"), 5, "net").alias("net"))


@query("select p_type as topic, p_brand as side, p_name as quote from part")
def r7_flatten_quotes(s, d):
    p = S.table(s, d, "part")
    lists = p.groupBy("p_type", "p_brand").agg(F.collect_list("p_name").alias("q")).groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "q"))).alias("sides"))
    return P.flatten_quotes(lists.select(F.create_map("p_type", "sides").alias("quotes")))


@query("select p_partkey, 1 + p_size % 5 as a, case when p_size % 2 = 1 then 3 end as b from part")
def r9_signature_values(s, d):
    sig = F.concat((1 + F.col("p_size") % 5).cast("string"), F.when(F.col("p_size") % 2 == 1, "3").otherwise("-"))
    v = P.signature_values(sig)
    return S.table(s, d, "part").select("p_partkey", v[0].alias("a"), v[1].alias("b"))


@query("select p_brand, sum((p_size <= 25)::int)::bigint + sum((p_size <= 25)::int)::bigint as a, 2 * sum((p_size > 25)::int)::bigint as b from part group by 1")
def a55_combine_cells(s, d):
    c = S.table(s, d, "part").groupBy("p_brand").agg(F.array(F.count_if(F.col("p_size") <= 25), F.count_if(F.col("p_size") > 25)).alias("c"))
    both = M.combine_cells(F.col("c"), F.col("c"))
    return c.select("p_brand", both[0].alias("a"), both[1].alias("b"))
