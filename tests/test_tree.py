"""The question tree: rules, depth, cycles."""

from tallyloom.operators import tree as TR

HEAD = "question_number int, section string, role string, explicit int, references_questions array<int>"


def test_rules_of_parents_and_anchors(spark):
    rows = [
        (1, "A", "comment", None, []), (2, "A", "primary", 1, [1]), (3, "A", "basis", None, [2, 9, 7, -1]), (4, "A", "comment", 9, [2]), (5, "B", "comment", None, [99, 5]),
        (6, "B", "free_text_primary", None, []), (7, "B", "profile", None, []), (8, "B", "comment", None, [7, 2]), (10, "B", "comment", None, [9]), (11, None, "basis", None, None),
    ]
    got = {r.question_number: (r.parent_question, r.anchor_question) for r in TR.linked(spark.createDataFrame(rows, HEAD).repartition(4), explicit="explicit").collect()}
    assert got == {1: (None, None), 2: (None, 2), 3: (2, 2), 4: (9, 2), 5: (4, None), 6: (None, 6), 7: (None, None), 8: (7, 7), 10: (8, 7), 11: (10, None)}


def test_paths_cycles_and_problems(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 5), (7, 7), (8, 77), (9, 8), (10, 3)]
    q = spark.createDataFrame(rows, "question_number int, parent_question int")
    got = {r.question: (r.root, r.depth, r.path) for r in TR.paths(q).collect()}
    assert got == {1: (1, 0, [1]), 2: (1, 1, [1, 2]), 3: (1, 2, [1, 2, 3]), 10: (1, 3, [1, 2, 3, 10]), 8: (8, 0, [8]), 9: (8, 1, [8, 9])}
    assert sorted(r.question_number for r in TR.unrooted(q).collect()) == [4, 5, 6, 7]
    assert {(r.question_number, r.problem) for r in TR.parent_problems(q).collect()} == {(4, "later"), (7, "itself"), (8, "missing")}
    assert TR.paths(q.limit(0)).count() == 0


def test_deeper_than_a_hundred_levels(spark):
    q = spark.range(1, 131).selectExpr("cast(id as int) as question_number", "cast(nullif(id - 1, 0) as int) as parent_question")
    assert TR.paths(q, levels=200).agg({"depth": "max"}).first()[0] == 129


def test_more_rows_than_a_recursive_query_may_have(spark):
    q = spark.range(1, 301).selectExpr("cast(id as int) as question_number", "cast(nullif(id div 2, 0) as int) as parent_question")
    q = q.unionByName(spark.createDataFrame([(1001, 1002), (1002, 1001)], q.schema))
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert TR.paths(q).count() == 300
        assert sorted(r.question_number for r in TR.unrooted(q).collect()) == [1001, 1002]
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
