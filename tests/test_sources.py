import json

import pytest
from pyspark.sql import functions as F

from pagewise.functions import annotations as an
from pagewise.operators import compare
from pagewise.plans import queries as plans
from pagewise.sources import sinks, texts
from pagewise.streaming import stats as streaming


def test_csv_and_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,language,name\n"one, two\nthree",en,t\nمرحبا,ar,\n,xx,n\n', encoding="utf-8")
    rows = texts.read_csv(spark, str(tmp_path / "a.csv"), title="name").collect()
    assert sorted((r.content, r.title) for r in rows) == [("one, two\nthree", "t"), ("مرحبا", "")]
    with pytest.raises(ValueError, match="no column"):
        texts.read_csv(spark, str(tmp_path / "a.csv"), text="body")
    spark.createDataFrame([("text1",), (None,), ("",)], "text string").write.parquet(str(tmp_path / "p"))
    assert sorted(r.content for r in texts.read_parquet(spark, str(tmp_path / "p")).collect()) == ["", "text1"]
    with pytest.raises(ValueError, match="no column"):
        texts.read_parquet(spark, str(tmp_path / "p"), text="body")
    with pytest.raises(ValueError, match="unknown source"):
        texts.open_source(spark, "hub")


def test_mappings_and_provider(spark, tmp_path):
    rows = [{"text": "a", "label": "x"}, {"label": "y"}, {"text": ""}, {"text": None}, "text"]
    assert sorted(r.content for r in texts.read_mappings(spark, rows).collect()) == ["", "a"]
    assert [r.content for r in texts.provider(spark, "csv", str(tmp_path / "none.csv"), ["in  line"]).collect()] == ["in  line"]


def test_overrides():
    config = {"gate": {"least_ink": 0.5}, "paper": 3}
    got = texts.apply_overrides(config, ["gate.least_ink=0.25", "paper.margins=[7,9]", "title=plain words"])
    assert got == {"gate": {"least_ink": 0.25}, "paper": {"margins": [7, 9]}, "title": "plain words"} and config["paper"] == 3
    with pytest.raises(ValueError):
        texts.apply_overrides({}, ["broken"])


def test_records_and_predictions(spark, tmp_path):
    (tmp_path / "annotations-00000.jsonl").write_text('{"id":"a","text":"x"}\n\n{"id":"b","text":"y"}\n')
    (tmp_path / "other.jsonl").write_text('{"id":"c"}\n')
    assert sorted(r.id for r in texts.read_records(spark, str(tmp_path)).collect()) == ["a", "b"]
    (tmp_path / "p.jsonl").write_text('{"id":"a","prediction":"1"}\n{"id":"b","text":"2"}\n{"id":"c"}\n')
    assert {r.id: r.prediction for r in texts.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()} == {"a": "1", "b": "2", "c": ""}
    (tmp_path / "p.json").write_text('{"a":"1"}')
    assert {r.id: r.prediction for r in texts.read_predictions(spark, str(tmp_path / "p.json")).collect()} == {"a": "1"}


def test_sinks(spark):
    word = {"text": "w", "bbox": {"x0": 10.0, "y0": 10.0, "x1": 60.0, "y1": 30.0}, "polygon": None}
    line = {"text": "w", "bbox": word["bbox"], "direction": "ltr", "words": [word], "baseline": None, "polygon": None}
    blank = line | {"text": " ", "words": []}
    region = {"type": "title", "bbox": word["bbox"], "reading_order": 0, "lines": [line, blank], "table": None, "attributes": None}
    page = {"width": 200, "height": 100, "direction": "ltr", "regions": [region], "attributes": None}
    df = spark.createDataFrame([(0, "a", page)], f"shard int, id string, page {an.PAGE}")
    rows = sinks.coco_annotations(df).orderBy("annotation_id").collect()
    assert [(r.annotation_id, r.category_id) for r in rows] == [(1, 3), (2, 2), (3, 1), (4, 2)] and rows[0].bbox == [10, 10, 50, 20] and rows[0].area == 1000
    label = df.select(sinks.detection_label(F.lit("images/a.png"), F.col("page"))).first()[0]
    path, made = label.split("\t")
    assert path == "images/a.png" and json.loads(made) == [{"transcription": "w", "points": [[10, 10], [60, 10], [60, 30], [10, 30]]}]
    record = json.loads(df.select(sinks.record(F.col("id"), F.col("page"), F.lit("images/a.png"))).first()[0])
    assert record["markdown"] == "# w\n " and "baseline" not in record["page"]["regions"][0]["lines"][0]
    chat = json.loads(df.select(sinks.chat(F.col("id"), F.lit("i.png"), F.lit("# w"))).first()[0])
    assert [m["role"] for m in chat["messages"]] == ["user", "assistant"]
    assert sinks.line_crops(df).count() == 2


def test_comparison(spark):
    a = spark.createDataFrame([(float(i), 1.0) for i in range(100)], "x double, y double")
    rows = {r.feature: r for r in compare.compare(a, a, ["x", "y"]).collect()}
    assert rows["x"].overlap == pytest.approx(1) and rows["y"].overlap == 1 and rows["x"].cohens_d == 0
    far = spark.createDataFrame([(500.0, 2.0)], "x double, y double")
    rows = {r.feature: r for r in compare.compare(a, far, ["x", "y"]).collect()}
    assert rows["x"].overlap == 0 and rows["y"].cohens_d == 10 and rows["x"].made_std == 0
    with pytest.raises(Exception, match="empty"):
        compare.moments(a, far.limit(0), ["x"]).collect()


def test_streaming_gate(spark, tmp_path):
    spark.createDataFrame([(1, "enough words in here"), (2, "no"), (3, None)], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    schema = "doc_id int, text string"
    for _ in range(2):
        stream = streaming.read_documents(spark, str(tmp_path / "in"), schema)
        streaming.gate(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert sorted((r.doc_id, r.validator) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [(2, "NonEmptyText"), (3, "NonEmptyText")]


def test_queries_agree_with_their_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from read_parquet('{data}/{name}.parquet')")
    sql = plans.oracle_sql()
    for name in ("text_strip_and_count", "sentences", "bidi_order", "gate_verdicts", "stats_percentiles", "eval_report", "compare_overlap"):
        rows = plans.queries()[name](spark, data)
        want = con.sql(sql[name])
        columns = sorted(rows.columns)
        assert columns == sorted(want.columns)
        expected = sorted(str([dict(zip(want.columns, r))[c] for c in columns]) for r in want.fetchall())
        assert sorted(str([r[c] for c in columns]) for r in rows.collect()) == expected, name
