"""The pipeline and the queries without SQL against plain Python on small inputs."""

import collections
import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import queries as Q
from tallyloom.llm import toxicity as T
from tests.llm.brute import components, contamination, dedup_lines, statistics

DATA = "/root/testdata/sf0.001"


def planted(spark, folder):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    bench = [(i, prose(25)) for i in range(4)]
    line = "A passage of more than twenty letters that many hold"
    docs, toxic = [], {}
    for i in range(160):
        t = prose(rng.randint(30, 120))
        if i % 8 == 1:
            t += " vilest grubby rotten"
        toxic[i] = int(i % 8 == 1)
        if i % 10 == 2:
            t += "\n" + line + "\nend " + prose(5)
        if i % 20 == 4:
            t += " " + bench[i % 4][1]
        docs.append((i, t))
    docs += [(200 + i, docs[i][1] if i % 2 else docs[i][1] + " tail") for i in (0, 3, 6)] + [(300, None), (301, ""), (302, " \n ")]
    rows = [(i, t, rng.choice(["en", "de", None]), f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, bench, toxic


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, bench, toxic = planted(spark, str(tmp_path))
    rows = [(i, t) for i, t in docs if not toxic.get(i)]
    rows = [(i, x[2]) for i, x in dedup_lines(rows).items()]
    found = components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if found[i][1] == i]
    hit = contamination(rows, bench)
    rows = [(i, t) for i, t in rows if not hit[i][3]]
    want = {i for i, t in rows if t.split()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == want
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in rows if t.split()}
    tokens = {i: len(t.split()) for i, t in rows}
    assert all(r.n_tokens == tokens[r.doc_id] for r in got)
    assert len(got) == len({(r.doc_id, r.epoch) for r in got}) and max(r.epoch for r in got) <= 1


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
        odd = spark.createDataFrame([(None, None, None, None, None), (7, "a b", None, None, None), (7, "a b", None, None, None)], docs.schema)
        out = stage(spark, odd, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == 3, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@needs_data
def test_queries_equal_brute_force_on_driver_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op2_ngram_jaccard(spark, DATA).collect()}
    assert got == components(list(docs.items()), 3, 90)
    rows = {r.doc_id: r for r in Q.op3_quality_rules(spark, DATA).collect()}
    for i, t in docs.items():
        x = statistics(t)
        assert tuple(rows[i][n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == x
        assert rows[i].base_failed == (x[0] < 20 or 100 * x[4] > 30 * x[0]) and not (rows[i].base_failed and rows[i].kept)
    scored = Q.op1_toxicity(spark, DATA)
    assert scored.count() == len(docs) and scored.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert scored.where("held_out").count() == scored.where(T.held_out()).count()
    pii = {r.doc_id: r for r in Q.op5_pii_pseudonyms(spark, DATA).collect()}
    assert all((pii[i].text == t) == (pii[i].n_changed == 0) for i, t in docs.items())
    kept = [r.kept for r in Q.op8_site_quality(spark, DATA).collect()]
    assert len(kept) == len(docs) and sum(kept) > len(docs) / 2
    mixed = Q.op7_source_mixing(spark, DATA).collect()
    read = collections.Counter(r.doc_id for r in mixed)
    assert set(read) == {i for i, t in docs.items() if t.split()} and max(read.values()) <= 2


@needs_data
def test_every_query_is_registered(spark):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert names["op4_url_filter"](spark, DATA).where("verdict not in ('allow', 'block')").count() == 0
