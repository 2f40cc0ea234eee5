"""The public views over the tidy tables: responses, questions, respondents, selections, options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE_TYPES = ("likert_1_5", "scale_labeled", "matrix_rating")


def star(responses: DataFrame, questions: DataFrame, respondents: DataFrame) -> DataFrame:
    """Answers with their question's codebook row (small, so broadcast by its size) and their respondent's row."""
    return responses.join(questions, "question_number").join(respondents, "respondent_id")


def scale_answers(responses: DataFrame, questions: DataFrame, respondents: DataFrame, types: tuple[str, ...] = SCALE_TYPES) -> DataFrame:
    return star(responses, questions.where(F.col("question_type").isin(*types)), respondents)


def scale_summary(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: answers on the scale, mean, and low, mid and high counts; questions without answers stay."""
    x = F.col("answer_numeric")
    agg = responses.groupBy("question_number").agg(
        F.count(x).alias("n_scored"), F.round(F.avg(x), 2).alias("mean_score"),
        F.count_if(x <= 2).alias("n_low"), F.count_if(x == 3).alias("n_mid"), F.count_if(x >= 4).alias("n_high"),
    )
    counts = ["n_scored", "n_low", "n_mid", "n_high"]
    return questions.join(agg, "question_number", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def selections_view(selections: DataFrame, questions: DataFrame, respondents: DataFrame) -> DataFrame:
    return star(selections, questions, respondents)


def question_tree(questions: DataFrame, sub: str | None = None) -> DataFrame:
    """Each question beside its anchor; a primary question is its own. ``sub`` numbers the rows of a matrix, whose first
    row stands for the whole as an anchor."""
    anchors = questions.where(F.col(sub).isNull() | (F.col(sub) == 1)) if sub else questions
    a = anchors.select(F.col("question_number").alias("anchor_number"), F.col("shorthand").alias("anchor_shorthand"))
    c = questions.where("anchor_question is not null")
    return c.join(a, c["anchor_question"] == a["anchor_number"]).select("anchor_number", "anchor_shorthand", "question_number", "shorthand", "role", *([sub] if sub else []))


STANCE_TYPES = ("single_select", "ordinal_select", "matrix_rating")


def stance_summary(responses: DataFrame, questions: DataFrame, types: tuple[str, ...] = STANCE_TYPES) -> DataFrame:
    """Per closed-choice question: answers, those on its ladder, and the mean rank where it has one, else null."""
    agg = responses.groupBy("question_number").agg(F.count("answer_text").alias("n_answered"), F.count("answer_numeric").alias("n_ranked"), F.round(F.avg("answer_numeric"), 2).alias("mean_rank"))
    counts = ["n_answered", "n_ranked"]
    return questions.where(F.col("question_type").isin(*types)).join(agg, "question_number", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def stance_by_redaction(answers: DataFrame, keys: list[str], answer: str = "answer_text") -> DataFrame:
    """Counts of each answer by whether identity was withheld; no means of stances."""
    red = F.col("is_redacted")
    return answers.groupBy(*keys, answer).agg(F.count_if(~red).alias("n_named"), F.count_if(red).alias("n_redacted"), F.count("*").alias("n_total"))


def response_rates(questions: DataFrame, responses: DataFrame, options: DataFrame, n_respondents: int, key: str = "question_number") -> DataFrame:
    """The codebook's columns of response: answers, their share of all respondents, canonical options; zero where there are none."""
    given = responses.groupBy(key).agg(F.countDistinct("respondent_id").alias("n_answered"))
    canonical = options.where("is_canonical").groupBy(key).agg(F.count("*").alias("n_options"))
    out = questions.join(given, key, "left").join(canonical, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_answered", "n_options")})
    return out.withColumn("response_rate_pct", F.round(100.0 * F.col("n_answered") / n_respondents, 1))


def answer_types(questions: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Questions and answers by codebook keys."""
    return questions.join(counts, "question_number", "left").groupBy(*keys).agg(F.count("*").alias("n_questions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"))


def option_counts(options: DataFrame, questions: DataFrame) -> DataFrame:
    return options.join(questions.select("question_number", "shorthand"), "question_number")


def redaction_profile(respondents: DataFrame, keys: list[str]) -> DataFrame:
    # whole tenths add up alike in any order, so a mean that lies between two tenths rounds up everywhere
    tenths = F.sum(F.round(F.col("completion_pct") * 10).cast("long"))
    return respondents.groupBy(*keys).agg(F.count("*").alias("n_respondents"), F.round(tenths / (10.0 * F.count("completion_pct")), 1).alias("mean_completion_pct"))


def scale_by_redaction(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and means of named and redacted respondents side by side."""
    x, red = F.col("answer_numeric"), F.col("is_redacted")
    return answers.groupBy(*keys).agg(
        F.count(F.when(~red, x)).alias("n_named"), F.round(F.avg(F.when(~red, x)), 2).alias("mean_named"),
        F.count(F.when(red, x)).alias("n_redacted"), F.round(F.avg(F.when(red, x)), 2).alias("mean_redacted"),
    )


def free_text(responses: DataFrame, questions: DataFrame, respondents: DataFrame, with_profile: bool = True) -> DataFrame:
    q = questions.where(F.col("question_type") == "free_text")
    return star(responses, q if with_profile else q.where("role <> 'profile'"), respondents)


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views by name, for ``spark.sql`` recipes."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
