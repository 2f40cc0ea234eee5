import random

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import ngram_join as N
from tallyloom.llm._common import connected_components, materialise
from tests.llm.brute import components


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "one"), (4, "One"), (5, "one two"), (6, "x " * 5000)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(12)]
    for i in range(10, 10 + n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("k, percent, block", [(3, 90, N.BLOCK_TOKENS), (3, 90, 120), (5, 80, 120), (2, 50, 300)])
def test_components_equal_brute_force(spark, k, percent, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in N.ngram_jaccard_components(docs, k=k, percent=percent, block_tokens=block).collect()}
    assert got == components(rows, k, percent)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t"), (9, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, N.ngram_jaccard_components(docs, k=3, percent=90).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 2, None), (9, 2, 5)], key=str)
    assert N.ngram_jaccard_components(docs.limit(0), k=3, percent=90).count() == 0


def test_keep_one_keeps_columns_that_clash(spark):
    rows = [(1, "a b c d e f g", 7, 8), (2, "A b c d e f g", 7, 8), (3, "else is here and new", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, n int")
    got = N.keep_one_per_component(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_divide_skip_counts_like_a_full_merge():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 25))) for _ in range(rng.randint(1, 14))]
        least = rng.randint(1, 10)
        want = [x for x in range(30) if sum(x in own for own in lists) >= least]
        assert sorted(N.divide_skip(lists, least)) == want


def test_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"c{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for block in (N.BLOCK_TOKENS, 5000):
        got = N.ngram_jaccard_components(docs, k=3, percent=90, block_tokens=block)
        assert [tuple(r) for r in got.select("component_id").distinct().collect()] == [(0,)]


def test_connected_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def lowest(edges, nodes):
    low = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_components_of_a_small_table_take_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long").repartition(7)
    spark.sparkContext.setJobGroup("components of a chain", "")
    try:
        assert connected_components(edges).where("component = 0").count() == 101
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components of a chain")) <= 9


@pytest.mark.parametrize("part_rows", [0, 20, 120])
def test_components_beyond_one_task_go_through_rounds(spark, part_rows):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2)) if a != b] + [(i + 1, i) for i in range(300, 340)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9), part_rows=part_rows).collect()
    assert sorted(map(tuple, got)) == sorted(lowest(edges, {x for e in edges for x in e}).items())


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_search_links_what_brute_force_links(percent):
    rng = np.random.default_rng(percent)
    common, sets = rng.integers(0, 2**62, 60), []
    for i in range(150):
        own = rng.choice(common, rng.integers(1, 60), replace=False) if i % 3 else common[rng.random(60) > rng.choice([0.02, 0.1])]
        sets.append(np.unique(np.r_[own, rng.integers(0, 2**62, rng.integers(0, 4))]))
    sets.sort(key=len)
    held = [set(s.tolist()) for s in sets]
    links = [(i, j) for i in range(150) for j in range(i) if 100 * len(held[i] & held[j]) >= percent * len(held[i] | held[j])]
    for known in (None, [i % 100 for i in range(150)]):
        got = N.ComponentSearch(percent, sets, known).run().tolist()
        want = lowest(links + ([] if known is None else [(i, i - 100) for i in range(100, 150)]), range(150))
        assert len(set(got)) == len(set(want.values())) == len(set(zip(got, want.values())))


def test_strangers_that_share_most_shingles_are_not_searched(monkeypatch):
    """Of 120 shingles 20 are each set's own, so that no two sets reach nine tenths."""
    sets = [np.r_[np.arange(100), np.arange(20) + 1000 * (i + 1)] for i in range(300)]
    searched, merge = [], N._merge_short
    monkeypatch.setattr(N, "_merge_short", lambda lists, least: searched.append(least) or merge(lists, least))
    assert len(set(N.ComponentSearch(90, sets).run().tolist())) == 300 and not searched
    near = [np.r_[np.arange(100), np.arange(2) + 1000 * (i + 1)] for i in range(300)]
    assert len(set(N.ComponentSearch(90, near).run().tolist())) == 1 and len(searched) == 299


def test_strangers_in_a_dealt_cluster_find_their_likes(spark):
    """Near copies of two texts that share common shingles, in one cluster of many blocks."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(120):
        own = [f"own{i % 3 if i < 6 else 0}-{j}" for j in range(70)]
        w = common + own
        w[40 + rng.randrange(50)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in N.ngram_jaccard_components(docs, k=3, percent=80, block_tokens=600).collect()}
    assert got == components(rows, 3, 80)


def searches(monkeypatch):
    """The shingles that each search reads from now on."""
    read, search = [], N._search

    def counted(sets, percent, keys):
        read.append(sum(r.n for r in sets.select("n").collect()))
        return search(sets, percent, keys)

    monkeypatch.setattr(N, "_search", counted)
    return read


def test_strangers_of_a_cluster_are_not_searched_in_all_its_blocks(spark, monkeypatch):
    """Texts that share 60 of 100 words, two of them near copies, in one cluster of 30 blocks and more."""
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"own{max(i, 1)}-{j}" for j in range(40)])) for i in range(200)]
    rows[0] = (0, rows[0][1] + " end")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read = searches(monkeypatch)
    got = {r[0]: (r[1], r[2]) for r in N.ngram_jaccard_components(docs, k=3, percent=80, block_tokens=600).collect()}
    assert got == components(rows, 3, 80)
    assert read[0] > 30 * 600 and sum(read) < 4 * read[0]


def test_passes_of_the_last_search_are_bounded(spark, monkeypatch):
    """Variants of one text that share most shingles with some others, so that all have to be searched."""
    rng = random.Random(7)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(70):
        w = list(base)
        for p in rng.sample(range(100), rng.randint(0, 6)):
            w[p] = f"{rng.choice('ab')}{p // 10}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components(rows, 3, 90)
    assert 10 < len({c for _, c in want.values()}) < 60
    monkeypatch.setattr(N, "PASS_TOKENS", 1, raising=False)
    read = searches(monkeypatch)
    got = {r[0]: (r[1], r[2]) for r in N.ngram_jaccard_components(docs, k=3, percent=90, block_tokens=900).collect()}
    assert got == want
    assert len(read) > 4 and max(read) < 3 * read[0]
    passes = len(read)
    monkeypatch.setattr(N, "PASS_TOKENS", 4 * read[0], raising=False)
    assert {r[0]: (r[1], r[2]) for r in N.ngram_jaccard_components(docs, k=3, percent=90, block_tokens=900).collect()} == want
    assert 2 < len(read) - passes < passes


def test_shingles_of_other_components_equal_plain_counting():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 400).view(np.int64)
    sets = [np.sort(rng.choice(pool, rng.integers(0, 30), replace=False)) for _ in range(120)]
    known, cluster = rng.integers(-40, 40, 120), rng.integers(0, 2, 120)
    of = {}
    for x, c, g in zip(sets, known.tolist(), cluster.tolist()):
        for t in x.tolist():
            of.setdefault((g, t), set()).add(c)
    held = [sum(len(of[g, t]) > 1 for t in x.tolist()) for x, g in zip(sets, cluster.tolist())]
    columns = [pa.array(np.arange(120) * 2**33 - 7), pa.array(known), pa.array(cluster), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, ["rep", "known", "cluster", "tokens"])
    for buckets in (1, 9):
        packed = pa.Table.from_batches(N._packed_sets(iter([batch.slice(0, 50), batch.slice(50)]), buckets)).sort_by("bucket")
        got = Counter()
        for b in N._held_elsewhere(packed.to_batches(max_chunksize=3)):
            got.update(dict(zip(*(b.column(c).to_pylist() for c in ("rep", "held")))))
        assert got == {i * 2**33 - 7: n for i, n in enumerate(held) if n}


def test_ids_that_are_no_numbers_raise(spark):
    with pytest.raises(TypeError):
        N.ngram_jaccard_components(spark.createDataFrame([("a", "x y z")], "doc_id string, text string"))


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    N.keep_one_per_component(spark.createDataFrame([(1, "x y z")], "doc_id long, text string")).count()
    assert spark.conf.get(key) == before


def heads_batch(rng, n_rows, step):
    """Heads of classes with ids from about zero, ``step`` apart at most; the second cell has fewer of them than the first."""
    pool = rng.integers(0, 2**63, 300).view(np.int64)
    heads = [np.sort(rng.choice(pool, rng.integers(1, 40), replace=False)) for _ in range(n_rows)]
    ids = [int(x) for x in np.cumsum(rng.integers(-3, step, n_rows)) - 5]
    cells, cut = [[c % 400, c % 400 + 1] for c in range(n_rows)], [[len(h), (len(h) + 1) // 2] for h in heads]
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    columns = [pa.array(x, kind) for x, kind in zip((ids, cells, cut, [h.tolist() for h in heads]), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["rep", "cell", "n_head", "head"])


def test_shared_heads_equal_plain_counting(spark):
    batch = heads_batch(np.random.default_rng(2), 500, 2**34)
    rows = batch.to_pylist()
    held = [(r["rep"], c, h) for r in rows for c, m in zip(r["cell"], r["n_head"]) for h in r["head"][:m]]
    df = Counter((c, h) for _, c, h in held)
    want = Counter((rep, c, df[c, h]) for rep, c, h in held if df[c, h] > 1)
    headed = spark.createDataFrame([tuple(r.values()) for r in rows], "rep long, cell array<int>, n_head array<int>, head array<long>").repartition(3)
    for buckets in (1, 7):
        got = N._shared_heads(headed, buckets).collect()
        assert Counter((r.rep, r.cell, r.df) for r in got) == want
        assert Counter(Counter((r.cell, r.token) for r in got).values()) == Counter(n for n in df.values() if n > 1)


def test_heads_are_shuffled_in_few_bytes(spark):
    batch = heads_batch(np.random.default_rng(4), 2000, 2**20)
    n_heads = sum(map(sum, batch.column("n_head").to_pylist()))
    packed = list(N._packed_heads(iter([batch]), 4))
    assert sum(len(x) for b in packed for c in ("reps", "cells", "tokens") for x in b.column(c).to_pylist()) < 12 * n_heads
    assert sum(b.num_rows for b in packed) == 4


def test_shuffles_of_a_settled_table_are_deleted(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    out = materialise(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "few")
    assert not shuffles() - before
    assert sorted(map(tuple, out.collect())) == [(k, 1000 // 7 + (k < 1000 % 7)) for k in range(7)]
