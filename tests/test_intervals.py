"""Range joins by bins against all pairs, and faults of interval tables."""

import random

import pytest

from tallyloom.operators import intervals as N


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bin_width", [0.5, 7.0, 1000.0])
def test_pairs_equal_all_pairs(spark, bin_width):
    rng = random.Random(5)
    points = [(i, rng.choice([None, rng.uniform(-50, 400), float(rng.randrange(40))])) for i in range(200)]
    ranges = [(i, low := float(rng.randrange(-60, 380)), low + rng.choice([0, 1, 3, 40, 500, -5])) for i in range(80)] + [(900, None, 10.0), (901, 10.0, None), (902, None, None)]
    got = N.within(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "i int, low double, high double"), "x", "low", "high", bin_width)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    want = sorted((p, i) for p, x in points for i, a, b in ranges if x is not None and (a is None or a <= x) and (b is None or x < b))
    assert sorted((r.p, r.i) for r in got.collect()) == want


def test_empty_tables(spark):
    points, ranges = spark.createDataFrame([(1, 2.0)], "p int, x double"), spark.createDataFrame([(1, 1.0, 3.0)], "i int, low double, high double")
    assert N.within(points.limit(0), ranges, "x", "low", "high", 1.0).count() == 0
    assert N.within(points, ranges.limit(0), "x", "low", "high", 1.0).count() == 0
    assert N.interval_faults(ranges.limit(0), "low", "high", "i").count() == 0


def test_overlaps_gaps_and_empty_intervals(spark):
    rows = [("a", 0, 10), ("b", 10, 20), ("c", 15, 18), ("d", 25, 30), ("e", 29, 40), ("f", 50, 50), ("g", 40, None), ("h", 60, 61)]
    got = sorted(tuple(r) for r in N.interval_faults(spark.createDataFrame(rows, "name string, low int, high int").repartition(5), "low", "high", "name").collect())
    assert got == [("c", "overlap", 15.0, 18.0), ("d", "gap", 20.0, 25.0), ("e", "overlap", 29.0, 30.0), ("f", "empty", 50.0, 50.0), ("h", "overlap", 60.0, 61.0)]


def test_summaries_equal_those_of_all_pairs_without_making_them(spark):
    rng = random.Random(6)
    points = [(i, rng.choice([None, rng.uniform(-50, 400), float(rng.randrange(40)), -0.0])) for i in range(200)] + [(900, float("inf")), (901, float("nan"))]
    ranges = [(i % 30, low := float(rng.randrange(-60, 380)), low + rng.choice([0, 1, 3, 40, 500, -5])) for i in range(80)] + [(40, None, 10.0), (41, 10.0, None), (42, None, None), (42, None, None), (43, 0.0, 1e-9)]
    got = N.summarised(spark.createDataFrame(points, "p int, x double").repartition(5), spark.createDataFrame(ranges, "i int, low double, high double"), "x", "low", "high", "i")
    key = lambda x: (x != x, x)  # noqa: E731  as Spark orders: NaN is the largest
    found = {}
    for i, a, b in ranges:
        found.setdefault(i, []).extend(x for _, x in points if x is not None and (a is None or key(a) <= key(x)) and (b is None or key(x) < key(b)))
    want = sorted((i, len(v), repr(min(v, key=key) + 0.0), repr(max(v, key=key) + 0.0)) for i, v in found.items() if v)
    assert sorted((r.i, r.n, repr(r.least + 0.0), repr(r.most + 0.0)) for r in got.collect()) == want


def test_wide_ranges_do_not_multiply(spark):
    """20,000 points in each of 20,000 intervals: 400 million pairs, none of them made."""
    n = 20_000
    points, ranges = spark.range(n).selectExpr("cast(id as double) as x"), spark.range(n).selectExpr("id as i", "-1.0d as low", "1e6d as high")
    got = N.summarised(points, ranges, "x", "low", "high", "i")
    assert tuple(got.selectExpr("count(*)", "min(n)", "max(n)", "min(least)", "max(most)").first()) == (n, n, n, 0.0, n - 1.0)
    assert N.summarised(points.limit(0), ranges, "x", "low", "high", "i").count() == 0
    assert N.summarised(points, ranges.limit(0), "x", "low", "high", "i").count() == 0
