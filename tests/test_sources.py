"""Readers, streams and the driver's contract."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quillmesh.operators import exports, ops
from quillmesh.sources import messages as src
from quillmesh.streaming import live

NOW = dt.datetime(2024, 5, 1)


def test_storage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"message_id": "1", "message": "hi", "created_at": "2024-01-02T03:04:05Z", "label": "spam", "lang": "en"}\nbroken\n{"id": "2", "text": " "}\n')
    (tmp_path / "b.json").write_text(json.dumps({"logs": [{"id": "3", "content": "yo", "time": "1700000000", "is_spam": "no"}]}))
    (tmp_path / "c.csv").write_text("id,text,date,spam\n4,hello,nonsense,maybe\n")
    got = {r.external_id: r for r in src.read_storage(spark, str(tmp_path), NOW).collect()}
    assert set(got) == {"1", "3", "4"} and got["1"].is_spam and got["1"].meta == {"lang": "en"} and got["3"].is_spam is False and got["4"].is_spam is None
    assert got["1"].timestamp == dt.datetime(2024, 1, 2, 3, 4, 5) and got["4"].timestamp == NOW and got["3"].timestamp == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_platform(spark):
    rows = spark.createDataFrame([("1", "2024-01-01T00:00:00", "a", "true", None), ("2", None, "b", None, "true"), (None, None, "c", None, None), ("3", None, "d", None, None)], "message_id string, created_at string, text string, label_spam string, label_not_spam string")
    assert {r.external_id: r.is_spam for r in src.platform_messages(rows, NOW).collect()} == {"1": True, "2": False, "3": False}


def test_reports(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Report ID,Message Content,Is Spam\n1,"a, b",1\n2,,1\n3,x,0\n4,y,\n')
    assert {(r.report_id, r.text, r.is_spam) for r in src.read_reports(spark, str(tmp_path / "r.csv")).collect()} == {("1", "a, b", True), ("3", "x", False)}


def test_new_rows(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "external_id string, n int")
    stored = spark.createDataFrame([("b",), (None,)], "external_id string")
    assert sorted((r.external_id or "") for r in src.new_rows(batch, stored).collect()) == ["", "", "a"]


def test_package(spark, tmp_path):
    rules = spark.createDataFrame([(1, "SELECT id FROM messages WHERE text LIKE '%a%'", "active", 0.9, 0.1)], "rule_id long, sql_expression string, status string, precision double, coverage double")
    exports.write_package(rules, str(tmp_path / "p"))
    assert json.loads(spark.read.text(str(tmp_path / "p/ruleset")).first()[0])["weight"] == 0.9


def test_stream_equals_batch(spark, sf, tmp_path):
    e = src.table(spark, sf, "events")
    folder = str(tmp_path / "in")
    e.repartition(4).write.parquet(folder)
    q = live.windowed(live.events(spark, folder, e.schema), "1 hour", "400 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.n, r.errors) for r in spark.table("w").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "errors").collect()}
    assert got == {(r.start, r.n, r.errors) for r in ops.windowed(e, "1 hour").collect()}


def test_mining_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "visit http://a.b now buy", True) for i in range(6)], "id long, text string, is_spam boolean")
    rows.repartition(3).write.parquet(str(tmp_path / "m"))
    q = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m")).writeStream.foreachBatch(live.mine_into(str(tmp_path / "s"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.key: r.cnt for r in live.signal_totals(spark, str(tmp_path / "s")).collect()}["http://a.b"] == 6


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
    assert e.entry(spark).count() == 5
