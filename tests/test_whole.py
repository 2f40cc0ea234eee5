"""Queries that hold for groups of any size, against brute force on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyloom import plans as registry
from tallyloom.operators import cells as C
from tallyloom.operators import derive as D
from tallyloom.operators import metrics as M
from tallyloom.operators import panels as P

def test_contained_runs_count_members_of_all_parts(spark, tmp_path):
    part = [(10, "in", "g", 1), (11, "in", "g", 1), (20, "out", "g", 1), (21, "out", "h", 1), (3, "odd", "h", 1)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["j18_contained_runs"](spark, str(tmp_path)).collect()
    assert sorted((r.group_id, r.cluster_id) for r in got) == [("g", "in 1"), ("h", "odd 1")]


def test_one_popular_line_makes_no_bloc(spark, tmp_path):
    licence, more = "this line of a licence stands in very many documents of the corpus", "a second line that some of the documents have in common as well"
    docs = [(i, f"{licence}\nown {i}") for i in range(250)] + [(i, f"{licence}\n{more}") for i in (300, 301)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["d15_blocs_by_shared_lines"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.bloc) for r in got) == [(300, 300), (301, 300)]


@pytest.mark.parametrize("min_shared", [1, 2, 3])
def test_common_edges_have_the_components_of_all_pairs(spark, min_shared):
    rng = random.Random(min_shared)
    own = {i: {c for c in range(6) if rng.random() < 0.25} | {rng.randrange(6, 120) for _ in range(2)} for i in range(80)}
    own |= {i: own[i - 80] for i in range(80, 95)}
    members = spark.createDataFrame([(f"c{c}", i) for i, cs in own.items() for c in cs], "cluster_hash string, id int")
    edges = D.common_edges(members, min_shared, max_pairs=4).collect()
    assert edges and all(r.n_shared == len(own[r.a] & own[r.b]) >= min_shared and r.a < r.b for r in edges)

    def components(pairs):
        low = {i: i for i in own}
        for _ in own:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    assert components([(r.a, r.b) for r in edges]) == components([p for p in itertools.combinations(own, 2) if len(own[p[0]] & own[p[1]]) >= min_shared])


def test_co_sharers_are_counted_once(spark):
    rng = random.Random(4)
    own = {i: {c for c in range(7) if rng.random() < 0.4} or {0} for i in range(60)}
    members = spark.createDataFrame([(f"c{c}", i) for i, cs in own.items() for c in cs] * 2, "cluster_hash string, id int")
    got = {r.id: (r.n_shared, r.n_co_sharers) for r in D.sharing_summary(members).collect()}
    assert got == {i: (len(cs), sum(1 for j, o in own.items() if j != i and o & cs)) for i, cs in own.items()}


def test_spearman_ranks_complete_pairs(spark):
    rows = [(1, 5), (2, None), (3, None), (4, None), (5, 2), (6, 9), (7, 1), (None, 3)]
    r = P.spearman(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()
    assert r.n == 4 and abs(r.rho + 0.4) < 1e-9  # ranks 1 2 3 4 against 3 2 4 1


def test_null_answers_count_and_uncovered_answers_raise(spark):
    a = spark.createDataFrame([(1, None, "b"), (2, None, "b"), (3, "x", None), (4, "x", "c")], "respondent_id int, answer string, bloc string")
    assert {r.answer: (r.n, r.n_dedup) for r in M.dedup_counts(a, F.col("bloc"), "answer").collect()} == {None: (2, 1), "x": (2, 2)}
    segments = a.where("respondent_id < 4").select("respondent_id")
    with pytest.raises(ValueError):
        C.covered(a, segments)
    assert C.covered(a.where("respondent_id < 4"), segments).count() == 3
