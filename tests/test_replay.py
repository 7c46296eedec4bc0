"""Thousands of literal rules by one automaton against the rules' own predicates."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import replay
from quillmesh.operators import rules as rl


def rows(spark, n=120):
    rng = random.Random(2)
    pool = ["Alpha", "beta%", "ga_mma", "дельта", "b\\c", "it's", "日本", "eps", "zeta", "alphabet"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(6))) for _ in range(n)] + [None, ""]
    return spark.createDataFrame([(i, t, rng.choice([True, False, None])) for i, t in enumerate(texts)], "id long, text string, is_spam boolean").withColumn("rule_ids", F.lit("own"))


def made(n=300):
    rng = random.Random(7)
    pool = ["ALPHA", "alphabet", "beta%", "%", "_", "ДЕЛЬТА", "b\\c", "'", "本", "nowhere", "a", "eps z", ""]
    return [rl.Rule.literal(i, *(rng.sample(pool, rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4)))) for i in range(n)]


def test_automaton_finds_what_predicates_find(spark, monkeypatch):
    rules = [*made(), rl.Rule(1000, "length(text) > 20"), rl.Rule(1001, "text IS NULL")]
    monkeypatch.setattr(rl, "_ONE_BY_ONE", 310)
    want = sorted((r.rule_id, r.id) for r in rl.hits(rows(spark), rules).collect())
    counts = sorted(map(tuple, rl.evaluate(rows(spark), rules).collect()))
    monkeypatch.setattr(rl, "_ONE_BY_ONE", 250)
    monkeypatch.setattr(replay, "matched", lambda m, literals, others: m.select("id", "is_spam", F.concat(others, F.filter(F.array(*[F.when(r.column(), F.lit(r.rule_id).cast("long")) for r in literals]), lambda x: x.isNotNull())).alias("rule_ids")))
    union = rl.union_metrics(rows(spark), rules).first()
    monkeypatch.undo()
    monkeypatch.setattr(rl, "_ONE_BY_ONE", 10)
    for most in (200_000, 70):
        monkeypatch.setattr(replay, "PASS_RULES", most)
        assert sorted((r.rule_id, r.id) for r in rl.hits(rows(spark), rules).collect()) == want and len(want) > 1000
        assert sorted(map(tuple, rl.evaluate(rows(spark), rules).collect())) == counts
        assert rl.union_metrics(rows(spark), rules).first() == union


def test_matcher_time_is_flat_in_rules():
    """A hundred times the rules over the same text: the walk goes over the text, not over the rules."""
    text = "some words that go by in a text of a few hundred characters " * 10
    took = []
    for n in (100, 10_000):
        m = replay.Matcher([[[f"needle{i}", f"other{i}"], ["words"]] for i in range(n - 1)] + [[["text"], ["few"]]])
        assert m.match(text).tolist() == [n - 1]
        began = time.perf_counter()
        for _ in range(20):
            m.match(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]  # parts of the one frequent needle are counted; a test of each rule would take a hundred times


def test_rules_without_needles(spark):
    with pytest.raises(ValueError, match="without needles"):
        replay.matched(rows(spark), [rl.Rule(1, "true", parts=((),))]).collect()
    assert replay.matched(rows(spark), []).where(F.size("rule_ids") > 0).isEmpty()


def test_compiled_rules_are_literal():
    r = rl.compile_rule(3, "group_invite", ["join", "группа"], pattern_id=9)
    assert r.parts[0] == ("join", "группа") and "t.me" in r.parts[1] and r.pattern_id == 9 and r.predicate == rl.compile_pattern("group_invite", ["join", "группа"])
    assert rl.compile_rule(4, "phone").parts == ()


def test_rules_test_a_text_once(spark):
    """One lower-casing and one array of tests in the plan of hits; the same matches as of the predicates one by one."""
    texts = ["Join our GROUP, money", "join us", "Группа канал t.me/x", None, "", "AAAAAAAAAAAA sale", "call +1 234", "JOINſ deal buy"]
    rows = spark.createDataFrame([(i, i % 2 == 0, t) for i, t in enumerate(texts)], "id long, is_spam boolean, text string")
    rules = [rl.compile_rule(1, "group_invite", ["Join", "группа"]), rl.compile_rule(2, "keyword", ["sale", "US"]), rl.compile_rule(3, "phone"), rl.compile_rule(4, "excessive_caps")]
    found = rl.hits(rows, rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_lower") == sum(map(len, (x for r in rules for x in r.parts))) and plan.count("AS _lower") == 1
    assert {(r.rule_id, r.id) for r in found.collect()} == {(k.rule_id, r.id) for k in rules for r in rows.where(k.predicate).collect()}
