import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import cells as C
from tallyloom.operators import derive as D
from tallyloom.operators import ingest as I
from tallyloom.operators import metrics as M
from tallyloom.operators import quality as Q


def test_grid_to_long_to_selections(spark):
    grid = spark.createDataFrame([("5", "A ;B;;", " "), ("7", None, '["x"]'), ("9", "", None)], "ID string, `1. Pick.` string, `2. Say` string")
    long = I.unpivot_grid(grid)
    assert sorted((r.respondent_id, r.header, r.answer_text) for r in long.collect()) == [(5, "1. Pick.", "A ;B;;"), (7, "2. Say", "x")]
    picks = I.explode_selections(long.where("respondent_id = 5"), ["respondent_id"])
    assert sorted((r.selection_index, r.option_text) for r in picks.collect()) == [(1, "A"), (2, "B")]


def test_shape_thresholds(spark):
    rows = [("m", "a;")] * 9 + [("m", "a")] + [("s", "x" * 320)] + [("f", "y" * 321)] + [("l", str(1 + i % 5)) for i in range(20)]
    got = {r.q: r for r in I.column_shape(spark.createDataFrame(rows, "q string, answer_text string"), "q").collect()}
    assert got["m"].is_multi and got["s"].is_single and got["f"].is_free and got["l"].all_1_5 and not got["m"].all_1_5
    typed = spark.createDataFrame([(True, False, True), (False, True, False)], "all_1_5 boolean, is_multi boolean, is_single boolean")
    kinds = [r[0] for r in typed.select(I.question_type(F.lit(True), F.lit(False), F.lit(False), F.lit(False))).collect()]
    assert kinds == ["likert_1_5", "multi_select"]


def test_options_canonical_rank_and_ties(spark):
    picks = spark.createDataFrame([("q", "5 - High", 1), ("q", "Unsure", 0)] + [("q", "1 - Low", i) for i in range(3)] + [("q", "Other (please specify)", 9)], "k string, option_text string, row_ord int")
    base = spark.createDataFrame([("q", 50)], "k string, n_answered int")
    got = {r.option_text: r for r in I.option_catalogue(picks, base, "k").collect()}
    assert got["1 - Low"].is_canonical and not got["5 - High"].is_canonical and got["Other (please specify)"].is_canonical
    assert got["Unsure"].is_off_scale and got["Unsure"].option_rank is None and got["5 - High"].option_rank == 5
    assert [got[o].option_order for o in ("1 - Low", "Unsure", "5 - High", "Other (please specify)")] == [1, 2, 3, 4]


def test_masks_and_complementary_policy(spark):
    answers = spark.createDataFrame([(i, 1, "yes" if i % 2 else "no") for i in range(30)], "respondent_id int, question_number int, answer_text string")
    seg = C.segments_long(answers, {"g": F.when(F.col("respondent_id") < 3, "tiny").when(F.col("respondent_id") < 10, "some").otherwise("many")})
    got = {r.key: r for r in C.stance_cells(answers, seg, ["yes", "no"]).collect()}
    assert got["tiny"].masked and got["tiny"].c is None and got["some"].thin and not got["many"].masked and got["all"].n == 30
    safe = {r.key: r.masked for r in C.stance_cells(answers, seg, ["yes", "no"], policy="complementary").collect()}
    assert safe == {"tiny": True, "some": True, "many": False, "all": False}
    scores = answers.withColumn("answer_numeric", (F.col("respondent_id") % 5 + 1).cast("double"))
    cells = C.likert_cells(scores, seg, [1, 2, 3, 4, 5])
    assert Q.mask_placement(cells, C.segment_values(seg)).first().ok
    assert sum(cells.where("key = 'all'").first().c) == 30


def test_blocs_close_cycles_and_popular_clusters(spark):
    groups = {"a": [1, 2, 3], "b": [1, 2, 3], "c": [3, 4], "d": [3, 4], "e": range(100, 160)}
    members = spark.createDataFrame([(k, i) for k, ids in groups.items() for i in ids], "cluster_hash string, id int")
    edges = D.common_edges(members, 2, max_pairs=20)
    got = {r.id: r.bloc for r in D.blocs(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}  # 60 holders of one cluster alone share no second one


def test_division_overlap_and_changes(spark):
    clusters = spark.createDataFrame([("v1", 1), ("v1", 2), ("v2", 2), ("v2", 9)], "cluster_id string, id int")
    groups = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "group_id string, id int")
    assert [tuple(r) for r in D.contained_runs(clusters, groups).collect()] == [("g", "v1")]
    assert sorted(tuple(r) for r in D.overlapping(clusters, groups).collect()) == [("g", "v1", 2), ("g", "v2", 1)]
    a = spark.createDataFrame([(1, "q1", "x "), (1, "q2", "y"), (2, "q1", "x"), (2, "q2", "z")], "id int, q string, t string")
    pairs = spark.createDataFrame([(1, 2)], "old_id int, new_id int")
    assert [r.q for r in D.changed_answers(a, pairs, "id", "q", "t").collect()] == ["q2"]


def test_junk_and_sharing(spark):
    a = spark.createDataFrame([(1, "asdf"), (1, "qwe"), (1, "a nice idea"), (2, "fine by me"), (2, "zzz")], "id int, t string")
    assert [(r.id, r.n_gibberish, r.evidence) for r in D.junk_candidates(a, "id", "t", min_share=0.6).collect()] == [(1, 2, ["asdf", "qwe"])]
    long = "same text " * 30
    other = "another text " * 30
    m = D.text_members(spark.createDataFrame([(1, long), (2, long.upper()), (3, long + " "), (4, "short"), (3, other), (5, other)], "id int, t string"), "id", "t")
    assert [(r.n_respondents, r.first_id) for r in D.text_clusters(m).collect()] == [(3, 1)]
    assert [(r.id, r.n_shared, r.n_co_sharers) for r in D.sharing_summary(m).orderBy("id").collect()] == [(1, 1, 2), (2, 1, 2), (3, 2, 3), (5, 1, 1)]
    with pytest.raises(Exception, match="too many members"):
        D.listed(m, "cluster_hash", "id", max_members=1).collect()


def test_vote_median_and_signature(spark):
    a = spark.createDataFrame([("b", 1), ("b", 5), ("x", 1)], "bloc string, v int")
    assert tuple(M.dedup_votes(a, F.col("bloc"), F.col("v") <= 2).first()) == (2, 1, 50.0)
    years = spark.createDataFrame([("q", 2027), ("q", 2028), ("q", 2099), ("q", 2030), ("q", 2027)], "q string, y int")
    assert tuple(M.median_mode(years, "q", "y", 2050).first()) == ("q", 1, 2028, 2027, 2)
    s = spark.createDataFrame([(1, 19, "Yes"), (1, 24, "odd"), (2, 19, "No")], "id int, q int, t string")
    sig = D.anchor_signature(s, "id", "q", "t", [19, 24], {19: {"Yes": "Y", "No": "N"}, 24: {"x": "E"}})
    assert {r.id: r.signature for r in sig.collect()} == {1: "Y?", 2: "N-"}
    bins = spark.range(1).select(M.ladder_bins(F.array(*map(F.lit, (1, 2, 3, 4, 5)))).alias("b")).first().b
    assert tuple(bins) == (3, 3, 9)
    both = spark.range(1).select(M.combine_cells(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))).alias("x"), M.combine_cells(F.array(F.lit(1)), F.lit(None).cast("array<int>")).alias("y")).first()
    assert both.x == [4, 6] and both.y is None


def test_labelled_and_checks_fail_loudly(spark):
    cols, labels = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError, match="no label for"):
        I.labelled(cols, labels, "k")
    bad = Q.bijection(cols, labels, ["k"])
    with pytest.raises(ValueError, match="vocabulary"):
        Q.require(bad)
    assert json.loads(json.dumps(Q.compare(cols.withColumn("v", F.lit(1)), labels, ["k"], ["v"]).first().asDict()))["k"] == "b"


def test_gibberish_words_are_judged_where_their_text_is(spark):
    odd = ["", "asdf", "aaaa", "xkcd", "0000", "Ab1", "ÄÖÜ", "éaé", "a-a-a", "1a1", "İİ", "\u212a\u212a", "日本", "…", "qwertyqwertyqwertyqwerty", "plain", "Answer", "ſſ", "sdfg's", "ΑΣ", "uio"]
    verdict = {r.w: r.bad for r in spark.createDataFrame([(w,) for w in odd], "w string").select("w", T.is_gibberish(F.col("w")).alias("bad")).collect()}
    seen = D.WordVerdicts()
    assert {w: seen[w] > 1 for w in odd} == verdict
    rows = [(1, "plain  asdf a\tb\nc xkcd"), (1, "words asdf"), (2, None), (3, " "), (None, "asdf\x0b q"), (4, " ".join(odd))]
    got = D.gibberish_words(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    assert {tuple(r) for r in got.collect()} == {(1, 5, 4), (None, 2, 2), (4, len(odd) - 1, sum(verdict.values()))}
