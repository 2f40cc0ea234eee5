"""Distributed order numbers, totals, medians and co-sharers: results, and what the plans do not hold."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import browser as B
from tallyloom.operators import cells as C
from tallyloom.operators import derive as D
from tallyloom.operators import metrics as M
from tallyloom.operators import ranking as R


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_order_numbers_and_totals(spark, parts):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x int, w int").repartition(6)
    order = [F.desc("x"), F.col("id")]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r.id: r["rank"] for r in R.ranked(df, order, parts=parts).collect()} == {r[0]: i for i, r in enumerate(want, 1)}
    total, upto = 0, {}
    for r in want:
        total += r[2]
        upto[r[0]] = total
    assert {r.id: r.upto for r in R.running_total(df, order, "w", parts=parts).collect()} == upto


def test_order_numbers_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None,), (3,), (None,), (1,)], "x int")
    assert [r["rank"] for r in R.ranked(df, [F.col("x")]).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert R.ranked(df.limit(0), [F.col("x")]).count() == 0


def test_only_sums_of_parts_meet_in_one_task(spark):
    text = plan(R.ranked(spark.range(1000).repartition(5), [F.col("id")], parts=8))
    assert text.count("SinglePartition") == 1
    below = text[text.index("SinglePartition") :]
    assert "partial_count" in below and "HashAggregate(keys=[_part" in below


@pytest.mark.parametrize("parts", [None, 9])
def test_medians_from_counts(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(30)) for _ in range(400)] + [("one", 7), ("two", 1), ("two", 4)]
    counts = spark.createDataFrame(rows + [("none", None)], "g string, v int").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r.g: (r.n, (r.low + r.high) / 2) for r in R.grouped_medians(counts, ["g"], "v", "n", parts).collect()}
    own = {g: [v for h, v in rows if h == g] for g, _ in rows}
    assert got == {g: (len(v), statistics.median(v)) for g, v in own.items()}


def test_sketched_quantiles_are_near(spark):
    rng = random.Random(3)
    rows = [(g, rng.gauss(0, 10)) for g in "ab" for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    for share in (0.1, 0.5, 0.9):
        for r in R.sketched_quantile(df, ["g"], "v", share).collect():
            below = sum(v <= r.quantile for g, v in rows if g == r.g) / r.n
            assert abs(below - share) < 0.03


def test_no_percentile_buffers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "g string, v int")
    assert "percentile" not in plan(M.median_mode(df, "g", "v")) + plan(B.verbosity(df, "g", "v", [2]))
    got = {(r.g, r.band): (r.n, r.median, r.max) for r in B.verbosity(df.unionByName(df.where("v = 3").withColumn("v", F.lit(40))), "g", "v", [2, 10, 30, 99]).collect()}
    assert got == {("a", 0): (1, 3.0, 40), ("a", 1): (1, 3.0, 40), ("a", 2): (0, 3.0, 40), ("a", 3): (1, 3.0, 40), ("b", -1): (1, None, None)}


def test_top_values_without_a_window(spark):
    rows = [(k,) for k, n in ((None, 5), ("a", 4), ("b", 3), ("c", 1), ("d", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string")
    out = C.top_n_other(df, "k", 3)
    assert "Window" not in plan(out)
    assert {r.key: r["count"] for r in out.groupBy("key").count().collect()} == {None: 5, "a": 4, "b": 3, "other (2 values)": 2}
    assert {r.key for r in C.top_n_other(df, "k", 9).collect()} == {None, "a", "b", "c", "d"}


def brute(own, least):
    return {i: (len(cs), n := sum(1 for j, o in own.items() if j != i and o & cs), n >= least) for i, cs in own.items()}


@pytest.mark.parametrize(("large", "least"), [(3, 3), (8, 1), (1000, 3), (0, 5)])
def test_co_sharers_by_bitmaps(spark, large, least):
    rng = random.Random(large)
    own = {i: {c for c in range(6) if rng.random() < 0.3} | {rng.randrange(6, 60)} for i in range(90)}
    members = spark.createDataFrame([(f"c{c}", i) for i, cs in own.items() for c in cs] * 2, "cluster_hash string, id int")
    got = {r.id: (r.n_shared, r.n_co_sharers, r.is_template) for r in D.sharing_summary(members, least, large).collect()}
    assert got == brute(own, least)


def test_two_popular_texts_with_different_others(spark):
    n = 100_000
    both = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("own "), (F.col("id") / 2).cast("long").cast("string")))).alias("cluster_hash"), "id")
    out = D.sharing_summary(both)
    assert out.agg(F.min("n_co_sharers"), F.max("n_co_sharers"), F.min("n_shared"), F.count("*")).first() == (n - 1, n - 1, 3, n)


def test_answers_are_summed_before_they_are_spread(spark):
    a = spark.createDataFrame([(i % 50, i % 3, float(i % 5), "x") for i in range(600)], "respondent_id int, question_number int, answer_numeric double, answer_text string")
    r = a.select("respondent_id").distinct()
    segments = C.segments_long(r, {"half": (F.col("respondent_id") % 2).cast("string"), "third": (F.col("respondent_id") % 3).cast("string")})
    text = plan(C.likert_cells(a, segments, [1, 2, 3, 4]))
    spread = text.index("Generate inline(_all")
    assert text.index("HashAggregate", spread) > spread  # the sums lie below the spreading, as plans read upwards


def test_resubmissions_of_a_common_name(spark):
    rows = [(i, "Acme") for i in (5, 1, 9)] + [(2, "Solo"), (3, "N/A"), (4, "N/A")]
    got = sorted(tuple(r) for r in D.resubmissions(spark.createDataFrame(rows, "id int, name string"), "name", "id").collect())
    assert got == [(1, 9, 5, True), (5, 9, 9, True), (9, 9, None, False)]
