"""The question tree: what a follow-up hangs on, over a codebook of any size and to any depth.

Parents and anchors come from joins and distributed running maxima; the paths below the roots are a recursive query, whose
every step joins the questions found last with their follow-ups. What no root reaches hangs on a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import ranked, running_max, use_checkpoints

FOLLOW_ON = ("other_specify", "reasons_support", "reasons_oppose", "comment", "basis")
OWN_ANCHOR = ("primary", "free_text_primary")


def linked(
    questions: DataFrame, references: str | None = "references_questions", explicit: str | None = None, follow_on: tuple[str, ...] = FOLLOW_ON,
    anchors: tuple[str, ...] = ("primary", "profile"), key: str = "question_number", section: str = "section",
) -> DataFrame:
    """``questions`` with ``parent_question`` and ``anchor_question``.

    A follow-up's parent is the ``explicit`` one (taken as it stands), else the largest question it refers to that is there
    and comes before it, else the question before it; the first question has none. Its anchor is the nearest question before
    it in its section with a role of ``anchors``. A primary question is its own anchor; other roles have neither."""
    later = F.col("role").isin(*follow_on)
    parent = F.col(explicit) if explicit else F.lit(None)
    out = ranked(questions, [F.col(key)], "_no")
    previous = out.select((F.col("_no") + 1).alias("_no"), F.col(key).alias("_previous"))
    out = out.join(previous, "_no", "left").drop("_no")
    if references:
        named = questions.select(F.col(key).alias("_q"), F.explode(references).alias("_r")).where("_r < _q")
        known = named.join(questions.select(F.col(key).alias("_r")), "_r", "left_semi").groupBy("_q").agg(F.max("_r").alias("_reference"))
        out = out.join(known, out[key] == known["_q"], "left").drop("_q")
        parent = F.coalesce(parent, F.col("_reference"))
    at = F.when(F.col("role").isin(*anchors), F.struct(F.col(section).alias("s"), F.col(key).alias("q")))
    out = running_max(out, [F.col(section), F.col(key)], at, "_anchor")
    near = F.when(F.col("_anchor.s").eqNullSafe(F.col(section)), F.col("_anchor.q"))
    out = out.withColumns({"parent_question": F.when(later, F.coalesce(parent, "_previous")), "anchor_question": F.when(later, near).when(F.col("role").isin(*OWN_ANCHOR), F.col(key))})
    return out.drop("_previous", "_reference", "_anchor")


def parent_problems(questions: DataFrame, key: str = "question_number", parent: str = "parent_question") -> DataFrame:
    """(question, parent, problem): a parent that is missing, the question itself, or a later one."""
    known = questions.select(F.col(key).alias("_k"))
    named = questions.where(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("_k"), "left")
    problem = F.when(F.col("_k").isNull(), "missing").when(F.col(parent) == F.col(key), "itself").when(F.col(parent) > F.col(key), "later")
    return named.select(key, parent, problem.alias("problem")).where("problem is not null")


def paths(questions: DataFrame, key: str = "question_number", parent: str = "parent_question", levels: int = 1000) -> DataFrame:
    """(question, root, depth, path) of all questions below a root, which is one without a parent that is there.

    Any number of rows, where a recursive query by default has a million at most. More than ``levels`` levels raise; questions that hang on a cycle have no row (see :func:`unrooted`)."""
    nodes = questions.select(F.col(key).alias("question"), F.col(parent).alias("parent"))
    use_checkpoints(questions.sparkSession)
    # settled, as every level reads it again
    up = nodes.join(nodes.select(F.col("question").alias("parent"), F.lit(True).alias("there")).distinct(), "parent", "left").checkpoint()
    return questions.sparkSession.sql(
        f"""with recursive t(question, root, depth, path) max recursion level {levels} as (
          select question, question, 0, array(question) from {{up}} where parent is null or there is null
          union all select n.question, t.root, t.depth + 1, array_append(t.path, n.question) from t join {{up}} n on n.parent = t.question)
        select * from t limit all""",
        up=up,
    )


def unrooted(questions: DataFrame, key: str = "question_number", parent: str = "parent_question") -> DataFrame:
    """(question, parent) of questions that no root reaches: they are on a cycle, or hang on one."""
    return questions.select(key, parent).join(paths(questions, key, parent).select(F.col("question").alias(key)), key, "left_anti")
