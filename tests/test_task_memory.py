"""What a task holds: no join that deals answers by their few questions, respondents in parts that are not merged, no fan-out of members."""

import random

import pytest

from tallyloom import plans as registry
from tallyloom.operators import panels as P

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q18_cross_cutting_role", "j20_matrix_rows", "a4_respondent_engagement", "q03_answers_per_respondent"])
def test_questions_are_not_a_shuffle_key(spark, name):
    assert "SortMergeJoin [l_linenumber" not in plan(registry.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["a4_respondent_engagement", "q03_answers_per_respondent", "s11_answer_index", "p4_canonical_picks", "a38_spanned_headcount", "r3_long_to_wide"])
def test_respondents_are_dealt_into_a_fixed_number_of_parts(spark, name):
    if name == "a38_spanned_headcount":  # its parts end in a checkpoint
        assert "SortMergeJoin [respondent_id" not in plan(registry.queries()[name](spark, DATA))
    else:
        assert "REPARTITION_BY_NUM" in plan(registry.queries()[name](spark, DATA))


def test_spanned_equals_sets(spark):
    rng = random.Random(3)
    groups = [(rng.choice(["a", "b", "c", None]), rng.choice([*range(30), None])) for _ in range(60)]
    members = [(rng.choice(["x", "y", "z", "w", None]), rng.choice([*range(40), None])) for _ in range(90)]
    got = P.spanned(spark.createDataFrame(groups, "group_id string, respondent_id int"), spark.createDataFrame(members, "cluster_id string, respondent_id int"))
    want = []
    for g in ("a", "b", "c"):
        own = {r for k, r in groups if k == g and r is not None}
        of = {c: {r for k, r in members if k == c and r is not None} for c in "xyzw"}
        met = [c for c in of if len(of[c] & own) >= 2]
        if met:
            want.append((g, len(met), len(set().union(*(of[c] for c in met)))))
    assert sorted((r.group_id, r.n_shared_texts, r.n_spanned) for r in got.collect()) == want
