"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import chat, decontaminate, line_dedup, mixing, ngram_join, pii, prefix_trie, quality_rules, site_quality, suffix_dedup, toxicity, url_filter, whitening
from tallyloom.llm._common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior is the share of toxic texts among the labelled ones that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = ~toxicity.held_out()
    model = toxicity.train_toxicity(docs.where(train), labels.where(train), prior=toxicity.labelled_share(labels.where(train)))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs that a rule fits are the labelled ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train_url_model(url_filter.rule_labels(pages, URL_RULES), statistics=url_filter.STATISTICS)
    return url_filter.judge_urls(pages, URL_RULES, model)


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.tallyloom.pii.key``; where that is unset, one for demonstrations."""
    key = spark.conf.get("spark.tallyloom.pii.key", "tallyloom-demo-key")
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), max_repetition=2.0)


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a host here, its languages are the paths."""
    docs = table(spark, sf_dir, "documents")
    model = site_quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return site_quality.site_quality(docs, model, F.col("source"), F.col("lang")).withColumnsRenamed({"host": "source", "path": "lang"})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.grafted(seqs, every=100, choices=6))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TRIMMED = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

OP6_SQL = """
with turns as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as place from conversations where conv_id is not null),
whole as (
  select conv_id, count(*) as n_turns, to_json(list([role, text] order by place)) as body from turns group by conv_id),
held as (
  select conv_id, place, to_json(list([role, text]) over (partition by conv_id order by place)) as body from turns),
kept as (
  select min(conv_id) as conv_id from whole where body not in (select body from held join (select conv_id, n_turns from whole) using (conv_id) where place < n_turns) group by body)
select conv_id, count(*)::bigint as n_turns,
       string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by place) as rendered
from turns join kept using (conv_id) group by conv_id
"""

OP9_SQL = rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select doc_id, pos, line, translate({_TRIMMED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
found as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (
  select keyed.*, found.k is not null and found.keeper <> doc_id as gone from keyed left join found using (k))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP10_SQL = rf"""
with items as (
  select item_id::varchar as item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as k,
         unnest(list_transform(range(len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 10)], ' '))) as key
  from items where len(w) > 0),
docs as (select doc_id, {_WORDS} as w from documents),
placed as (
  select doc_id, k, unnest(range(greatest(len(w) - k + 1, 0))) as i,
         unnest(list_transform(range(greatest(len(w) - k + 1, 0)), lambda i: array_to_string(w[i + 1 : i + k], ' '))) as key
  from docs, (select distinct k from windows)),
spans as (select doc_id, i, placed.k, item_id from placed join windows using (k, key)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from spans) group by doc_id),
held as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from spans) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (doc_id) left join held using (doc_id)
"""

OP13_SQL = """
with t as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, role, text) as p
  from conversations where conv_id is not null),
own as (select conv_id, list({'r': r, 'x': x} order by p) as l from t group by conv_id),
hashed as (
  select conv_id, l, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end)) % 6 as h
  from own),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) as l
  from hashed c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
held as (select conv_id, l, unnest(range(0, len(l) + 1)) as d from rebuilt),
named as (select conv_id, d, len(l) as n, l[1:d] as head, md5(to_json(l[1:d])::varchar) as k from held),
nodes as (
  select k, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(head) as head,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends
  from named group by k, d),
up as (
  select conv_id, d, n_convs, ends, k, case when d > 0 then md5(to_json(head[1:d - 1])::varchar) end as parent,
         case when d > 0 then (n_convs - 1) * length(head[d].x) else 0 end as saved, head from nodes),
kids as (select parent as k, count(*) as n from up where parent is not null group by parent),
spread as (
  select up.k, up.saved, kids.n is null as leaf, md5(to_json(head[1:a])::varchar) as above
  from (select *, unnest(range(0, d + 1)) as a from up) up left join kids using (k)),
sums as (select above as k, sum(saved)::bigint as saved, count(*) filter (where leaf) as leaves from spread group by above)
select up.conv_id, up.d::bigint as depth, p.conv_id as parent_conv_id, up.n_convs, coalesce(kids.n, 0)::bigint as n_children,
       sums.leaves::bigint as n_leaves, sums.saved as saved_tokens, up.ends as ends_sha256
from up join sums using (k) left join kids using (k) left join nodes p on p.k = up.parent
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filter": op4_url_filter,
        "op5_pii_pseudonyms": op5_pii_pseudonyms,
        "op6_chat_snapshots": op6_chat_snapshots,
        "op7_source_mixing": op7_source_mixing,
        "op8_site_quality": op8_site_quality,
        "op9_line_dedup": op9_line_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_snapshots": OP6_SQL, "op9_line_dedup": OP9_SQL, "op10_decontamination": OP10_SQL, "op13_prefix_trie": OP13_SQL}
