"""The engine end to end on a small campaign."""

import datetime as dt

from pyspark.sql import functions as F

from quillmesh.engine import Engine
from quillmesh.operators import advice


def test_engine(spark, tmp_path):
    at = dt.datetime(2024, 3, 1)
    rows = [(i, f"m{i}", at, f"Great casino prize at http://casino-prize.tk/win now {i}", True) for i in range(30)] + [(100 + i, f"h{i}", at, "see you at lunch tomorrow", False) for i in range(30)]
    m = spark.createDataFrame(rows, "id long, external_id string, timestamp timestamp, text string, is_spam boolean")
    engine = Engine(m)
    rules = engine.mine(at, days=2)
    assert any("casino-prize.tk" in r.sql for r in rules)
    best = engine.evaluate().orderBy(F.desc("precision"), F.desc("recall")).first()
    assert best.precision == 1.0 and best.recall == 1.0
    engine.export(str(tmp_path / "out"), engine.evaluate())
    assert spark.read.text(str(tmp_path / "out/rules_sql")).count() >= len(rules)
    assert Engine(m).mine(at, min_spam=1000) == []
    got = engine.analyze(m, at)
    assert got["rules"] and got["report"].startswith("# ")
    assert engine.ingest(m).count() == 0


def test_advice(spark):
    assert advice.regex_keywords(r"(?i)\b(?:купить|buy|sell|the)\b") == ["купить", "buy", "sell"]
    assert advice.warnings("SELECT id FROM messages WHERE length(text) < 15") and not advice.warnings("SELECT id FROM messages WHERE contains(lower(text), 'casino')")
    assert advice.insight_only("price") and advice.insight_only("a long enough description", risk=80)
    cache = spark.createDataFrame([], "key string, vector array<double>")
    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "c")], "id long, text string")
    vectors, fresh = advice.embed(rows, cache, lambda texts: [[len(t)] for t in texts])
    assert {r.id: r.vector for r in vectors.collect()} == {1: [2.0], 2: [2.0], 3: [1.0]} and fresh.count() == 2
