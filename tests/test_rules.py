"""Rules, evaluation and lifecycle against known numbers."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import evaluation as ev
from quillmesh.operators import exports, lifecycle, quality, signals, similarity
from quillmesh.operators import rules as rl


def messages(spark, *groups):
    rows, n = [], 0
    for count, text, spam in groups:
        for _ in range(count):
            n += 1
            rows.append((n, text, spam))
    return spark.createDataFrame(rows, "id long, text string, is_spam boolean")


def test_f1(spark):
    m = messages(spark, (80, "a test", True), (20, "other", True), (10, "Test", False), (40, "fine", False))
    e = rl.evaluate(m, [rl.Rule(1, rl.contains("test"))]).first()
    assert (e.hits_total, e.spam_hits, e.ham_hits) == (90, 80, 10)
    assert (e.precision, e.recall, e.f1_score) == pytest.approx((0.889, 0.8, 0.842), abs=1e-3)


def test_many_rules_agree(spark):
    m = messages(spark, (3, "alpha", True), (2, "beta", None), (4, "alpha beta", False))
    rules = [rl.Rule(1, rl.contains("alpha")), rl.Rule(2, rl.contains("beta")), rl.Rule(3, rl.contains("x_%'\\"))]
    few = sorted(map(tuple, rl._counts(m, rules).collect()))
    many = sorted(map(tuple, rl._counts(m, rules, batch=1).collect()))
    assert few == many == [(1, 7, 3, 4, 9, 3), (2, 6, 0, 4, 9, 3), (3, 0, 0, 0, 9, 3)]


@pytest.mark.parametrize(
    "sql, ok",
    [
        ("SELECT id, is_spam FROM messages WHERE lower(text) LIKE '%call; drop%'", True), ("SELECT id FROM messages WHERE text RLIKE 'update'", True), ("WITH m AS (SELECT id, text FROM messages) SELECT id FROM m WHERE text LIKE '%a%'", True),
        ("SELECT id FROM messages", False), ("SELECT id FROM messages WHERE text LIKE '%a%' OR 1=1", False), ("DELETE FROM messages WHERE id = 1", False), ("SELECT id FROM users WHERE text LIKE '%a%'", False),
        ("SELECT id FROM messages WHERE secret LIKE '%a%'", False), ("SELECT id FROM messages WHERE id IN (SELECT id FROM messages)", False), ("SELECT id FROM messages WHERE text LIKE '%a%' UNION SELECT id FROM messages", False), ("SELECT * FRO", False),
        ("SELECT id, 'Filter' AS is_spam FROM messages WHERE 1=1", False), ("SELECT id, is_spam FROM messages WHERE text LIKE '%%'", False), ("SELECT id FROM messages WHERE text IS NOT NULL", False), ("SELECT id FROM messages WHERE length(text) >= 0", False),
        ("SELECT id FROM messages WHERE text = 'deleted from posts where'", True), ("SELECT id FROM messages WHERE EXISTS (SELECT 1 FROM messages)", False), ("SELECT m.id FROM messages m JOIN messages n ON m.id = n.id WHERE m.text LIKE '%a%'", False), ("WITH m AS (SELECT id, text FROM secrets) SELECT id FROM m WHERE text LIKE '%a%'", False),
    ],
)
def test_validation(spark, sql, ok):
    assert (rl.problem(spark, sql) is None) == ok


def test_retarget(spark):
    assert rl.retarget(spark, "SELECT id WHERE text LIKE '%a%';") == "SELECT id FROM messages WHERE text LIKE '%a%'"
    assert rl.retarget(spark, "SELECT id FROM posts WHERE x") == "SELECT id FROM messages WHERE x"
    assert rl.retarget(spark, "SELECT id FROM a.posts p WHERE text LIKE '%it''s from here where%'") == "SELECT id FROM messages p WHERE text LIKE '%it''s from here where%'"
    assert rl.retarget(spark, "SELECT id, 'from x' AS y WHERE text = 'where'") == "SELECT id, 'from x' AS y FROM messages WHERE text = 'where'"


def test_compile(spark):
    m = messages(spark, (1, "join our group at https://x", True), (1, "a group of trees", False), (1, "ABCDEFGHIJKL sale", True), (1, "ABCDEFGHIJKL", False))
    hits = lambda p: {r.id for r in rl.hits(m, [rl.Rule(1, p)]).collect()}
    assert hits(rl.compile_pattern("group_invite", ["join our group"])) == {1}
    assert hits(rl.compile_pattern("excessive_caps")) == {3}


def test_drift(spark):
    e = spark.createDataFrame([(1, 1, 0.95), (1, 2, 0.85), (2, 1, 0.5), (2, 2, 0.6)], "rule_id long, created_at int, precision double")
    got = {(r.rule_id, r.created_at): r for r in rl.drift(e).collect()}
    assert got[1, 2].drift == pytest.approx(0.105, abs=1e-3) and got[1, 2].verdict == "DRIFT" and got[2, 2].verdict == "IMPROVED" and got[1, 1].verdict is None


@pytest.mark.parametrize("args, want", [((0.99, 1000, 5, 10000), "safe_auto"), ((0.95, 500, 25, 10000), "review_only"), ((0.85, 200, 35, 10000), "feature_only"), ((0.88, 1000, 600, 10000), "feature_only")])
def test_tiers(spark, args, want):
    assert spark.range(1).select(quality.tier(*map(F.lit, args)).alias("t")).first().t == want


def test_lifecycle(spark):
    rules = spark.createDataFrame([(1, "shadow"), (2, "active"), (3, "candidate"), (4, "active")], "rule_id long, status string")
    e = spark.createDataFrame([(1, 1, 100, 5, 0.95, 0.05), (2, 1, 100, 5, 0.80, 0.05), (4, 1, 100, 5, 0.95, 0.05), (4, 2, 100, 5, 0.90, 0.05)], "rule_id long, created_at int, hits_total long, ham_hits long, precision double, coverage double")
    assert {r.rule_id: r.status for r in lifecycle.promote(rules, e, quality.PROFILES["balanced"], None).collect()} == {1: "active", 2: "active", 3: "candidate", 4: "active"}
    assert {r.rule_id: r.status for r in lifecycle.monitor(rules, e, quality.PROFILES["balanced"], None).collect()}[2] == "deprecated"
    wrong = spark.createDataFrame([(3, "active"), (2, "deprecated")], "rule_id long, to_status string")
    assert {r.rule_id: r.status for r in lifecycle.transition(rules, wrong, None).collect()} == {1: "shadow", 2: "deprecated", 3: "candidate", 4: "active"}


def test_safety():
    like = "SELECT id FROM messages WHERE text LIKE '%{}%'"
    assert quality.rule_safety(like.format("ab"))[0] == "dangerous" and quality.rule_safety(like.format("work"))[0] == "dangerous" and quality.rule_safety(like.format("hello"))[0] == "dangerous"
    assert quality.rule_safety(like.format("bit.ly"))[0] == "auto_safe"
    assert quality.rule_safety(like.format("casino") + " AND x", {"precision": 0.99, "hits_total": 100, "ham_hits": 1})[0] == "auto_safe"
    assert quality.rule_safety(like.format("casino"), {"precision": 0.96, "hits_total": 100, "ham_hits": 4})[0] == "requires_review"


def test_keyword_gates(spark):
    df = spark.createDataFrame([("casino", 10, 0), ("now", 50, 0), ("ab", 50, 0), ("free-x", 10, 9), ("rare", 1, 0)], "k string, s long, h long")
    got = {r.k: r.ok for r in df.select("k", signals.keyword_safe(F.col("k"), F.col("s"), F.col("h"), F.lit(100), F.lit(100)).alias("ok")).collect()}
    assert got == {"casino": True, "now": False, "ab": False, "free-x": False, "rare": False}


def test_quantiles(spark):
    df = spark.createDataFrame([(1, float(x)) for x in range(1, 31)], "g int, v double")
    assert ev.exclusive_quantile(df, ["g"], "v", 0.95, "p").first().p == pytest.approx(29.45)
    assert ev.index_percentiles(df, ["g"], "v", [F.desc("v")], 1000, (0.95,)).first().p95 == 29.0


def test_jaccard_pairs_exact(spark):
    import random

    rng = random.Random(3)
    sets = [(i, sorted({str(rng.randrange(12)) for _ in range(rng.randrange(1, 9))})) for i in range(80)]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}
    got = similarity.jaccard_pairs(spark.createDataFrame(sets, "id long, shingles array<string>"), 0.6)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_leaders_walk(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 5), (6, 7)]
    want, led = {}, []
    for i in range(1, 8):
        near = [x for x in led if (x, i) in edges]
        want[i] = near[0] if near else i
        led += [] if near else [i]
    pairs = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.leader for r in similarity.leaders(pairs, spark.range(1, 8)).collect()} == want


@pytest.mark.parametrize("walk_pairs", [1 << 18, 16])
def test_leaders_of_a_long_path(spark, walk_pairs):
    """Each id is like the one before only. With few walk_pairs the path is too large to be walked until rounds have cut it."""
    n = 200 if walk_pairs > 16 else 24
    pairs = spark.range(1, n).selectExpr("id as a", "id + 1 as b")
    got = similarity.leaders(pairs, spark.range(1, n + 1), **({} if n == 200 else {"rounds": 4, "walk_pairs": walk_pairs})).collect()
    assert len(got) == n and {r.id: r.leader for r in got} == {i: i if i % 2 else i - 1 for i in range(1, n + 1)}


def test_leaders_walk_of_random_pairs(spark):
    import random

    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    want, led = {}, []
    for i in range(60):
        near = [x for x in led if (x, i) in edges]
        want[i] = near[0] if near else i
        led += [] if near else [i]
    got = similarity.leaders(spark.createDataFrame(edges, "a long, b long"), spark.range(60), rounds=2).collect()
    assert len(got) == 60 and {r.id: r.leader for r in got} == want


def test_components_of_a_zigzag_path(spark):
    """A path whose ids jump up and down: minima of neighbours and jumps alone take 33 rounds."""
    order = [int(f"{i:06b}"[::-1], 2) for i in range(64)]
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.root for r in similarity.components(edges, spark.range(64)).collect()} == {0}


def test_dbscan(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (8, 9)], "a long, b long")
    assert {(r.id, r.cluster, r.core) for r in similarity.dbscan(pairs, spark.range(10)).collect()} == {(1, 1, True), (2, 1, True), (3, 1, True), (4, 1, False)}


def test_package(spark, tmp_path):
    import json

    rows = [(1, "active", "SELECT id FROM messages WHERE text LIKE '%free%'"), (2, "shadow", "SELECT id FROM messages\nWHERE text LIKE '%%' OR id > 0")]
    rules = rl_table(spark, rows)
    exports.write_package(rules, f"file://{tmp_path}/p")
    text = lambda name: "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/p/{name}").collect())
    assert "WHERE text LIKE '%free%';" in text("rules_sql") and "LIKE '%%'" not in text("rules_sql")
    assert all(x.startswith("--") for x in text("unsafe_sql").split("\n")) and "LIKE '%%'" in text("unsafe_sql")
    assert json.loads(text("metadata")) == {"rules": 2, "by_status": {"active": 1, "shadow": 1}}
    assert sorted(text("rollback").split("\n"))[0] == "UPDATE rules SET status = 'deprecated' WHERE rule_id = 1;"


def rl_table(spark, rows):
    return spark.createDataFrame([(*r, 10, "manual", "2024-01-01", 0.9, 0.5, 0.1) for r in rows], "rule_id long, status string, sql_expression string, pattern_id long, origin string, created_at string, precision double, recall double, coverage double")


def test_sample_is_cut_before_it_is_shuffled(spark):
    """The first rows of each label are found in each task, so no task reads all texts of one label."""
    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "id % 5 = 0 as is_spam", "repeat('free words ', 3) as text").repartition(8, "id")
    out = rl.accepted_on_sample(rows, [rl.Rule(1, rl.contains("free"))])
    assert [(r.spam_matches, r.ham_matches, r.accepted) for r in out.collect()] == [(20, 50, False)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()
