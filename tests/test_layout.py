"""Physical layouts, metrics gathered while writing, and files that executors write."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import sinks


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df) -> int:
    """Rows that the scans of ``df`` gave out, once it has run."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [node.executedPlan() if "AdaptiveSparkPlan" in node.getClass().getSimpleName() else node]
    while todo:
        x = todo.pop()
        if "Scan" in x.getClass().getSimpleName() and x.metrics().contains("numOutputRows"):
            found += x.metrics().apply("numOutputRows").value()
        todo += [x.children().apply(i) for i in range(x.children().size())]
    return found


def test_star_join_without_a_shuffle_and_lookups_by_row_group(spark, tmp_path):
    n = 20_000
    answers = spark.range(n).selectExpr("id % 500 as respondent_id", "cast(id % 7 as int) as question_number", "id as answer_id", "md5(cast(id as string)) as mark")
    people = spark.range(500).selectExpr("id as respondent_id", "concat('p', id) as name")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        a = sinks.write_layout(answers.coalesce(1), "answers_by_person", f"{tmp_path}/a", 4, ["respondent_id"], ["respondent_id", "answer_id"], ["mark"], 20_000)
        p = sinks.write_layout(people, "people_by_person", f"{tmp_path}/p", 4, ["respondent_id"], ["respondent_id"])
        joined = a.join(p, "respondent_id")
        assert "Exchange" not in plan(joined) and joined.count() == n
        assert "Exchange" in plan(answers.join(people, "respondent_id"))
        one = a.where("respondent_id = 123")
        assert "PushedFilters: [IsNotNull(respondent_id), EqualTo(respondent_id,123)]" in plan(one)
        assert one.count() == n // 500 and scanned(one) < n / 8  # one bucket, and not all of it
        mark = answers.where("answer_id = 4321").first().mark
        found = a.where(F.col("mark") == mark)
        assert [r.answer_id for r in found.collect()] == [4321] and scanned(found) < n / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("drop table if exists answers_by_person")
        spark.sql("drop table if exists people_by_person")


def test_metrics_of_the_write_itself(spark, tmp_path):
    df = spark.range(100).withColumn("text", F.when(F.col("id") % 3 == 0, "x"))
    metrics = {"rows": F.count(F.lit(1)), "texts": F.count("text"), "total": F.sum("id")}
    assert sinks.write_checked(df, f"{tmp_path}/t", metrics, {"rows": 100, "total": 4950}) == {"rows": 100, "texts": 34, "total": 4950}
    with pytest.raises(ValueError, match="texts: 34, not 35; total: 4950, not 1"):
        sinks.write_checked(df, f"{tmp_path}/u", metrics, {"rows": 100, "texts": 35, "total": 1})
    assert spark.read.parquet(f"{tmp_path}/u").count() == 100


def test_parts_are_the_same_bytes_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 101, f'a "{i}",\né', None if i % 2 else "") for i in range(101)], "id int, text string, note string")

    def bytes_of(folder):
        return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))

    for k, parts in enumerate((1, 5)):
        sinks.write_csv_parts(df.repartition(3 + k), f"{tmp_path}/c{k}", ["id", "text", "note"], ["id"], parts)
        sinks.write_json_parts(df.repartition(3 + k), f"{tmp_path}/j{k}", ["id"], parts)
    assert bytes_of(tmp_path / "c0") == bytes_of(tmp_path / "c1") != b""
    assert bytes_of(tmp_path / "j0") == bytes_of(tmp_path / "j1")
    assert bytes_of(tmp_path / "j0").split(b"\n")[1].decode() == '{"id":1,"note":null,"text":"a \\"71\\",\\né"}'
    with pytest.raises(ValueError):
        sinks.write_csv_parts(df, f"{tmp_path}/x", ["id", "text"], ["id"])


def test_a_folder_for_each_entity(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "slug string, n int")
    sinks.write_entity_parts(df, f"{tmp_path}/e", "slug")
    sinks.write_entity_parts(df.where("slug <> 'a'"), f"{tmp_path}/e", "slug")
    assert [p.name for p in sorted((tmp_path / "e").glob("entity=*"))] == ["entity=b"]
    lines = sorted(x for p in (tmp_path / "e" / "entity=b").glob("part-*") for x in p.read_text().splitlines())
    assert lines == ['{"n":2,"slug":"b"}', '{"n":3,"slug":"b"}']
