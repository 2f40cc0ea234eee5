import random

import pytest

from tallyloom.llm import decontaminate as D
from tallyloom.llm import line_dedup as L
from tests.llm.brute import contamination, dedup_lines

LONG = "This Line Has Twenty Or More Characters"


def lined():
    rng = random.Random(2)
    pool = [f"a common line of the corpus number {i}" for i in range(12)] + ["short", "", "   ", "éééééééééé short it is", "ÉÉÉÉÉÉÉÉÉÉ short it is"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, f"{LONG}\r\n\t{LONG.upper()} "), (103, LONG), (104, LONG + "\n" + LONG), (105, "x" * 300_000)]
    return rows


@pytest.mark.parametrize("limit", [100_000, 0])
def test_line_dedup_equals_brute_force(spark, limit):
    rows = lined()
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_lines string")
    got = L.dedup_lines(docs, broadcast_rows=limit)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == dedup_lines(rows)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_line_dedup_repeats_nulls_and_empty(spark, limit):
    rows = [(1, LONG), (1, LONG), (2, LONG), (None, LONG), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(docs, broadcast_rows=limit).collect()), key=str)
    # three documents hold the line: 1 (twice given), 2 and the one without an id
    assert got == sorted([(1, 1, 1, ""), (1, 1, 1, ""), (2, 1, 0, LONG), (None, 1, 1, ""), (None, 1, 0, "")], key=str)
    assert L.dedup_lines(docs.limit(0), broadcast_rows=limit).count() == 0


def passages():
    rng = random.Random(4)
    words = ["the", "of", "É", "é", "data", "x1", "ok"] + [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(10, 30)))) for i in range(8)]
    items += [(20, "The of"), (21, None), (22, "..."), (23, "data x1 ok the v1"), (24, items[0][1])]
    rows = [(0, None), (1, ""), (2, "?!"), (3, "the")]
    for i in range(10, 60):
        w = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            src = items[rng.randrange(8)][1].split()
            a = rng.randrange(len(src) - 9)
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randint(8, 20)]
        rows.append((i, rng.choice([" ", ", ", "\n", "-"]).join(w).title()))
    rows.append((99, " ".join(["filler"] * 30_000) + " " + items[1][1]))
    return rows, items


@pytest.mark.parametrize("window", [10, 4, 1])
def test_contamination_equals_brute_force(spark, window):
    rows, items = passages()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.decontaminate(docs, bench, window=window).collect()}
    assert got == contamination(rows, items, window)


def test_contamination_edges(spark):
    rows = [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k"), (2, "a b c")]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, "A b c d e f g h i j")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit) for r in D.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted([(1, 11, 10), (1, 11, 10), (None, 11, 0), (2, 3, 0)], key=str)
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in D.decontaminate(docs, bench.limit(0)).collect()} == {0}
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    spans = {r.doc_id: r.text for r in D.remove_spans(docs.where("doc_id is not null"), bench).collect()}
    assert spans == {1: "k", 2: "a b c"}


def test_ids_of_any_type_and_beyond_doubles(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, LONG), (big + 2, LONG), (None, LONG), (7, LONG)], "doc_id long, text string")
    for limit in (100, 0):
        got = {r.doc_id: r.text for r in L.dedup_lines(docs, broadcast_rows=limit).collect()}
        assert got == {big: "", big + 2: LONG, None: "", 7: ""}
        named = docs.selectExpr("concat('n', doc_id) as doc_id", "text")
        assert {r.doc_id: r.text for r in L.dedup_lines(named, broadcast_rows=limit).collect()} == {f"n{big}": "", f"n{big + 2}": "", None: "", "n7": LONG}
    bench = spark.createDataFrame([("i", LONG)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in D.decontaminate(docs.selectExpr("concat('n', doc_id) as doc_id", "text"), bench).collect()} == {f"n{big}": 7, f"n{big + 2}": 7, None: 0, "n7": 7}


def test_probes_shuffle_hashes_only(spark, monkeypatch):
    """With broadcasts off neither words nor texts go through the join of sampled runs."""
    rows, items = passages()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plans = []
    real = D.materialise
    monkeypatch.setattr(D, "materialise", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), real(df, tag))[1])
    monkeypatch.setattr(D, "RUNS", 0)
    monkeypatch.setattr(D, "maybe_broadcast", lambda df, rows, limit=0, size=0: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.decontaminate(docs, bench).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == contamination(rows, items, 10)
    plan = dict(plans)["hits"]
    assert plan.count("Scan ExistingRDD") == 1  # one scan of the documents for all lengths of items
    assert "Exchange hashpartitioning(h" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "text" in x]


def test_spans_keep_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 1, "y"), (2, None, 2, "z")], "doc_id long, text string, id int, x string")
    bench = spark.createDataFrame([(1, "A b c d e f g h i j")], "item_id long, text string")
    got = D.remove_spans(docs, bench)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [(1, "k", 1, "y"), (2, None, 2, "z")]
