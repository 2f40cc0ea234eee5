"""A survey over the relational tables: orders answer as respondents, their lines as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = [
    (1, "inventory_status", "A", "single_select", "profile", None),
    (2, "support_matching", "A", "likert_1_5", "primary", "support"),
    (3, "support_reasons", "A", "multi_select", "reasons_support", None),
    (4, "effort_internal", "B", "likert_1_5", "primary", "burden_relative"),
    (5, "effort_comment", "B", "free_text", "comment", None),
    (6, "report_impact", "B", "scale_labeled", "primary", "impact_magnitude"),
    (7, "support_phase_in", "C", "likert_1_5", "primary", "support"),
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    fields = "question_number int, shorthand string, section string, question_type string, role string, scale_construct string"
    # given in code: without the hint answers would be dealt by question, of which there are seven
    return F.broadcast(spark.createDataFrame(QUESTIONS, fields))


def respondents(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("respondent_id"), F.col("c_mktsegment").alias("organization_type"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("sector"), (F.col("o_orderstatus") == "F").alias("is_redacted"), F.round(F.col("o_totalprice") / 5000, 1).alias("completion_pct"),
        F.col("c_name").alias("organization"), F.col("o_custkey").alias("bloc"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("l_discount") != 0, (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"), F.col("l_linenumber").alias("question_number"), score.alias("answer_numeric"), F.col("l_returnflag").alias("answer_text")
    )


def picks(spark: SparkSession, d: str) -> DataFrame:
    """Multi-select answers: the words of part names, one respondent for each part, one question for each type."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("respondent_id"), F.col("p_type").alias("question"), F.replace("p_name", F.lit(" "), F.lit(" ;")).alias("raw"))
    from tallyloom.operators.ingest import explode_selections

    return explode_selections(part, ["respondent_id", "question"], "raw")


def codebook(spark: SparkSession, d: str) -> DataFrame:
    """A codebook with faults: each part a question, types as sections; some explicit parents are later, missing, or the question itself."""
    roles = "element_at(array('primary', 'comment', 'basis', 'free_text_primary', 'profile'), p_size % 5 + 1)"
    number = "cast(p_partkey as int)"
    explicit = f"case when p_size > 46 then {number} + 1 when p_size = 46 then {number} when p_size = 42 then -1 when p_size < 18 then {number} div 2 end"
    return table(spark, d, "part").selectExpr(
        f"{number} as question_number", "p_type as section", "p_name as shorthand", f"{roles} as role", f"cast({explicit} as int) as explicit_parent",
        f"case when p_size % 3 = 0 then array(cast({number} div 3 as int), {number} + 1, -5) else cast(array() as array<int>) end as references_questions",
    )


CODEBOOK_SQL = """
with recursive c as (
  select p_partkey::int as question_number, p_type as section, p_name as shorthand, (['primary', 'comment', 'basis', 'free_text_primary', 'profile'])[p_size % 5 + 1] as role,
         case when p_size > 46 then p_partkey + 1 when p_size = 46 then p_partkey when p_size = 42 then -1 when p_size < 18 then p_partkey // 2 end::int as explicit_parent,
         case when p_size % 3 = 0 then [p_partkey // 3, p_partkey + 1, -5] else [] end as refs from part),
r as (select question_number, max(x) as reference from (select question_number, unnest(refs) as x from c) where x < question_number and x in (select question_number from c) group by 1),
book as (
  select c.*, case when role in ('comment', 'basis') then coalesce(explicit_parent, reference, lag(question_number) over (order by question_number)) end::int as parent_question,
         case when role in ('comment', 'basis') then max(case when role in ('primary', 'profile') then question_number end) over (partition by section order by question_number rows between unbounded preceding and 1 preceding)
              when role in ('primary', 'free_text_primary') then question_number end as anchor_question
  from c left join r using (question_number)),
tree(question, root, depth, path) as (
  select question_number, question_number, 0, [question_number] from book where parent_question is null or parent_question not in (select question_number from c)
  union all select b.question_number, root, depth + 1, list_append(path, b.question_number) from tree join book b on b.parent_question = tree.question)
"""

_ROWS = ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in q) + ")" for q in QUESTIONS)

SQL = f"""
with respondents as (
  select o_orderkey as respondent_id, c_mktsegment as organization_type, n_name as country, r_name as region, o_orderpriority as sector,
         o_orderstatus = 'F' as is_redacted, round(o_totalprice / 5000, 1) as completion_pct, c_name as organization, o_custkey as bloc
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
answers as (
  select l_orderkey as respondent_id, l_linenumber as question_number,
         case when l_discount <> 0 then (floor((l_quantity - 1) / 10) + 1)::double end as answer_numeric, l_returnflag as answer_text from lineitem),
questions as (select * from (values {_ROWS}) t(question_number, shorthand, section, question_type, role, scale_construct)),
picks as (
  select respondent_id, question, unnest(parts) as option_text, unnest(range(1, len(parts) + 1))::int as selection_index
  from (select p_partkey as respondent_id, p_type as question, string_split(p_name, ' ') as parts from part))
"""
