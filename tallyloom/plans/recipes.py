"""The public SQL surface: recipes over registered views, the same text on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import tree as TR
from tallyloom.operators import views as V
from tallyloom.plans import registry
from tallyloom.plans import survey as S

_VIEWS = """, v_scale_answers as (
  select a.respondent_id, a.question_number, a.answer_numeric, a.answer_text, q.shorthand, q.section, q.question_type, q.role, q.scale_construct, r.organization_type, r.country, r.sector, r.is_redacted
  from answers a join questions q on a.question_number = q.question_number join respondents r on a.respondent_id = r.respondent_id where q.question_type in ('likert_1_5', 'scale_labeled', 'matrix_rating')),
v_option_counts as (select question, option_text, count(*) as n from picks group by question, option_text),
option_ranks as (select * from (values ('A', 1), ('N', 2), ('R', 3)) t(answer_text, option_rank))
"""


def register_views(spark: SparkSession, d: str) -> None:
    """Temporary views for the recipes, lazily planned."""
    answers, questions, respondents = S.answers(spark, d), S.questions(spark), S.respondents(spark, d)
    picks = S.picks(spark, d)
    V.register(
        {
            "answers": answers, "questions": questions, "respondents": respondents, "picks": picks,
            "v_scale_answers": V.scale_answers(answers, questions, respondents), "v_option_counts": picks.groupBy("question", "option_text").agg(F.count("*").alias("n")),
            "option_ranks": spark.createDataFrame([("A", 1), ("N", 2), ("R", 3)], "answer_text string, option_rank int"),
        }
    )


def register_tree(spark: SparkSession, d: str) -> None:
    """The drill-down tree of the codebook; its links are settled first, so it is registered only where it is asked for."""
    V.register({"v_question_tree": V.question_tree(TR.linked(S.codebook(spark, d), explicit="explicit_parent"))})


RECIPES = {
    "q02_all_but_one_construct": "select respondent_id, shorthand, answer_numeric from v_scale_answers where scale_construct <> 'support'",
    "q04_discrete_answers_of_a_section": "select shorthand, answer_text, count(*) as n from v_scale_answers where section = 'B' group by shorthand, answer_text order by shorthand, n desc",
    "q05_everything_of_a_section": "select respondent_id, question_number, answer_text from v_scale_answers where section = 'C'",
    "q06_option_counts": "select option_text, n from v_option_counts where question = 'ECONOMY' order by n desc, option_text",
    "q12_stance_by_organization_type": "select organization_type, answer_text, count(*) as n from v_scale_answers where shorthand = 'support_matching' group by organization_type, answer_text",
    "q14_own_base_netting": """select a.option_text, a.pct as pct_a, coalesce(b.pct, cast(0 as double)) as pct_b, round(a.pct - coalesce(b.pct, cast(0 as double)), 1) as net from
 (select option_text, cast(round(100.0 * n / (select sum(n) from v_option_counts where question = 'ECONOMY'), 1) as double) as pct from v_option_counts where question = 'ECONOMY') a left join
 (select option_text, cast(round(100.0 * n / (select sum(n) from v_option_counts where question = 'PROMO'), 1) as double) as pct from v_option_counts where question = 'PROMO' and n > 3) b on a.option_text = b.option_text""",
    "q15_escape_hatches_apart": "select option_text, option_text in ('ring', 'widget') as is_special, n from v_option_counts where question = 'STANDARD' order by is_special, n desc, option_text",
    "q17_redaction_by_stance": "select is_redacted, answer_text, count(*) as n, count(answer_numeric) as n_scored from v_scale_answers group by is_redacted, answer_text",
    "q18_cross_cutting_role": "select q.role, count(*) as n from answers a join questions q on a.question_number = q.question_number where q.role <> 'primary' group by q.role",
    "q19_ladders_with_ranks": "select a.respondent_id, a.question_number, o.option_rank from answers a join option_ranks o on a.answer_text = o.answer_text where a.question_number = 6",
    "q21_one_respondent_in_order": "select q.question_number, q.section, a.answer_text, a.answer_numeric from answers a join questions q on a.question_number = q.question_number where a.respondent_id = 7 order by q.section, q.question_number",
    "q22_group_and_map": "select case when answer_numeric >= 4 then 'for' when answer_numeric <= 2 then 'against' when answer_numeric is null then 'off' else 'between' end as side, sector, count(*) as n from v_scale_answers group by 1, 2",
}


def _put(name: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        register_views(spark, d)
        return spark.sql(sql)

    run.__name__ = name
    registry.query(_VIEWS + sql, True)(run)


for _name, _sql in RECIPES.items():
    _put(_name, _sql)


_TREE = "select anchor_number, count(*) as n_questions, max(question_number) as last_question from v_question_tree where role <> 'primary' group by anchor_number"


def q09_drill_down_tree(spark: SparkSession, d: str) -> DataFrame:
    register_tree(spark, d)
    return spark.sql(_TREE)


registry.query(S.CODEBOOK_SQL + ", v_question_tree as (select a.question_number as anchor_number, c.question_number, c.role from book c join book a on a.question_number = c.anchor_question) " + _TREE)(q09_drill_down_tree)


def q20_tree_of_a_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Some primary questions are matrices of three rows: their first row stands for the whole as an anchor."""
    book = TR.linked(S.codebook(spark, d), explicit="explicit_parent")
    matrix = (F.col("role") == "primary") & (F.col("question_number") % 2 == 0)
    rows = book.withColumn("sub_number", F.explode(F.when(matrix, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(None).cast("int")))))
    return V.question_tree(rows, sub="sub_number").select("anchor_number", "question_number", "sub_number", "role")


registry.query(
    S.CODEBOOK_SQL
    + """, rows as (select *, unnest(case when role = 'primary' and question_number % 2 = 0 then [1, 2, 3] else [null]::int[] end)::int as sub_number from book)
select a.question_number as anchor_number, c.question_number, c.sub_number, c.role from rows c join rows a on a.question_number = c.anchor_question and (a.sub_number is null or a.sub_number = 1)"""
)(q20_tree_of_a_matrix)
