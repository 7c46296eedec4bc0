"""Decisions as columns against the decisions on one rule, and the text tests of rule quality case by case."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import advice, quality, signals

HEAD = "SELECT id FROM messages WHERE "
LIKE = lambda *w, by=" OR ": HEAD + by.join(f"LOWER(text) LIKE '%{x}%'" for x in w)
RULES = [
    LIKE("casino"), LIKE("dinosaur"), LIKE("ab"), LIKE("work"), LIKE("a longer phrase here"), LIKE("casino", "bonus"), LIKE("casino", "dinosaur"), LIKE("casino", "bonus", by=" AND "), LIKE(*"dino saur trex stego".split()), LIKE(*(f"word{i}" for i in range(12))),
    LIKE("a.b"), HEAD + "1=1", HEAD + "TRUE", HEAD + "text REGEXP '\\d{3}' AND length(text) < 15", HEAD + "contains(lower(text), 'dinosaur') AND contains(lower(text), 'saurian')", HEAD + "contains(lower(text), 'x\\'y long')", HEAD + "text REGEXP '+7 (900) 123-45-67'", "", LIKE("СКИДКА", "Dinosaur"),
]
KINDS = {"short words": "too short", "common words": "common words", "one common word": "a single common word", "everything": "matches everything", "one test": "a single test", "shadow runs": "precision", "false positives": "false positives", "known words": "known literals", "no review": "no review"}


@pytest.mark.parametrize("precision,hits,ham", [(None, None, None), (0.99, 100, 1), (0.96, 50, 2), (0.5, 9, 4), (0.99, 5, 0)])
def test_columns_decide_as_the_function_does(spark, precision, hits, ham):
    df = spark.createDataFrame([(i, sql, precision, hits, ham) for i, sql in enumerate(RULES)], "rule_id long, sql_expression string, precision double, hits_total long, ham_hits long")
    evaluation = None if hits is None else {"precision": precision, "hits_total": hits, "ham_hits": ham}
    for r in advice.decisions(df).collect():
        if not r.sql_expression:
            assert (r.kind, r.risk) == ("dangerous", "high")
            continue
        kind, why = quality.rule_safety(r.sql_expression, evaluation)
        assert r.kind == kind and (KINDS.get(r.why, "alternatives") in why), (r.sql_expression, why, r.why)
        assert (r.risk, r.warnings) == (advice.risk(r.sql_expression, evaluation)[0], len(advice.warnings(r.sql_expression)))


@pytest.mark.parametrize("sql,want", [
    (LIKE("for"), ("low", "medium", "high", ["one common word"])), (LIKE("http://fake-promo.com/x"), ("high", "high", "low", [])), (LIKE("ab", "cd"), ("medium", "medium", "high", ["short needle"])), (LIKE("abc", "def", by=" AND "), ("medium", "high", "low", [])),
    (LIKE("buy", *(f"w{i}x" for i in range(6))), ("medium", "medium", "high", ["alternatives"])), (LIKE("buy", *(f"w{i}x" for i in range(4))), ("medium", "medium", "medium", [])), (HEAD + "phone REGEXP '1'", ("medium", "medium", "medium", ["phone numbers"])),
    (HEAD + "phone REGEXP '1' AND x", ("medium", "high", "low", ["phone numbers"])), ("DELETE FROM messages", ("medium", "low", "critical", ["no SELECT", "changes tables"])), (LIKE("please update now"), ("medium", "medium", "low", [])), (None, ("medium", "low", "low", ["no SELECT"])),
    (LIKE("the", "spam-link.com"), ("high", "high", "low", [])),
])
def test_static_quality(spark, sql, want):
    r = quality.static_quality(spark.createDataFrame([(1, sql)], "rule_id long, sql_expression string")).first()
    assert (r.adequacy, r.quality, r.fp_risk, r.issues) == want


def test_risk_distribution(spark):
    df = spark.createDataFrame([(1, LIKE("for")), (2, LIKE("abc")), (3, LIKE("abcd")), (4, None)], "rule_id long, sql_expression string")
    assert {(r.fp_risk, r.rules, r.share) for r in quality.risk_distribution(df).collect()} == {("high", 1, 0.25), ("low", 3, 0.75)}


def test_similarity_reason(spark):
    df = spark.createDataFrame([("URL pattern: http://a.b found in 3",), ("Keyword: job_offer found in 9",), ("Signature cluster: x",), ("something else",)], "d string")
    assert [r.x for r in df.select(advice.similarity_reason(F.col("d")).alias("x")).collect()] == ["one address: http://a.b", "one group of words: job_offer", "their wording, apart from numbers and links", "something else"]


def test_suspicious_cuts_among_equals(spark):
    """As many as the share says, the most counted ones, equal ones by their digests: as sorting all gives."""
    import hashlib

    rng = random.Random(4)
    rows = [(rng.choice(["url", "tag"]), f"k{i}", rng.choice([1, 1, 1, 2, 3, 9])) for i in range(400)]
    for share in (0.0, 0.01, 0.3, 0.77, 1.0):
        got = {(r.signal_type, r.key) for r in signals.suspicious(spark.createDataFrame(rows, "signal_type string, key string, cnt long"), F.lit(50), share).collect()}
        order = sorted(rows, key=lambda r: (-r[2], hashlib.md5(f"{r[1]} {r[0]}".encode()).hexdigest()))
        assert got == {r[:2] for r in order[: max(1, int(400 * share))]}
    assert signals.suspicious(spark.createDataFrame([], "signal_type string, key string, cnt long"), F.lit(1), 0.5).collect() == []


def test_costs_and_jaccard(spark):
    from quillmesh.functions import text as tx

    assert advice.costs(10, 5000, True, True) == {"llm_calls": 10, "embedding_calls": 5, "estimated_cost_usd": pytest.approx(0.01 + 0.05)}
    assert advice.costs(10, 5, False, False) == {"llm_calls": 0, "embedding_calls": 0, "estimated_cost_usd": 0}
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [r.j for r in df.select(tx.jaccard(F.col("x"), F.col("y")).alias("j")).collect()][0] == pytest.approx(1 / 3)


def test_rules_of_kind(spark):
    from quillmesh.operators import rules as rl

    rules = spark.createDataFrame([(1, 10, HEAD + "language = 'RU' AND text LIKE '%a%'"), (2, 10, HEAD + "text LIKE '%a%'"), (3, 11, HEAD + "x"), (4, None, HEAD + "language='en'")], "rule_id long, pattern_id long, sql_expression string")
    patterns = spark.createDataFrame([(10, "keyword"), (11, "url")], "pattern_id long, pattern_type string")
    ids = lambda *a: sorted(r.rule_id for r in rl.of_kind(rules, patterns, *a).collect())
    assert (ids(), ids("keyword"), ids("keyword", "ru"), ids(None, "en"), ids("url", "en")) == ([1, 2, 3, 4], [1, 2], [1, 2], [2, 3, 4], [3])


def test_report(spark):
    from quillmesh.operators import exports

    assert exports.report({"new_rules": 3, "by": {"a": 1}}) == '# Pattern report\n\n- **new rules**: 3\n- **by**: {"a": 1}\n'


def test_csv_messages(spark):
    import datetime as dt

    from quillmesh.sources import messages as src

    rows = spark.createDataFrame([("2024-01-02", "a", "spam"), ("nonsense", "b", "0"), (None, "", "1"), ("1700000000", None, "1")], "at string, said string, kind string")
    now = dt.datetime(2024, 5, 1)
    assert {(r.timestamp, r.text, r.is_spam) for r in src.csv_messages(rows, "at", "said", "kind", now).collect()} == {(dt.datetime(2024, 1, 2), "a", True), (now, "b", False)}


def test_mined_rules_go_into_shadow(spark):
    """New candidates are evaluated on the messages and decided on: precise ones are safe, the others are for review."""
    from quillmesh.operators import lifecycle
    from quillmesh.operators import rules as rl

    rows = [(i, "exclusive dinosaur offer here" if i < 40 else "an ordinary message of the day", i < 40) for i in range(100)]
    messages = spark.createDataFrame(rows, "id long, text string, is_spam boolean")
    made = [rl.Rule.literal(1, ["exclusive dinosaur"], ["offer here"]), rl.Rule.literal(2, ["ordinary message"], ["of the day"])]
    got = {r.rule_id: (r.status, r.safety) for r in lifecycle.mined_to_shadow(messages, made, None).collect()}
    assert got == {1: ("shadow", "auto_safe"), 2: ("shadow", "requires_review")}
