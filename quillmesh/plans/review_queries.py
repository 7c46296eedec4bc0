"""Extended evaluation, profile safety, proposals, training sets, suggestions, alerts and usage, over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillmesh.operators import evaluation as ev
from quillmesh.operators import exports, lifecycle, ops, quality
from quillmesh.operators import rules as rl
from quillmesh.plans.base import EVALUATIONS, MESSAGES, PATTERN_TABLE, RULE_CTES, RULE_TABLE, RULES, evaluations, messages, pattern_table, query, r6, rule_table, table
from quillmesh.plans.stat_queries import _CONFUSION, _SCORED, _scored
from quillmesh.sources.messages import training_set

# ---- evaluation -------------------------------------------------------------------------------------------------------

_TIMED = f"{_SCORED}, t AS (SELECT s.*, e.value * 10 AS latency_ms, CASE WHEN s.id % 7 = 0 THEN 'unknown' ELSE m.language END AS language, m.text FROM s JOIN messages m USING (id) LEFT JOIN events e ON e.event_id = s.id)"


def _timed(spark, sf_dir):
    latency = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") * 10).alias("latency_ms"))
    m = messages(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.col("language")).alias("language"), "text")
    return _scored(spark, sf_dir).join(m, "id").join(latency, "id", "left")


@query(f"""WITH {MESSAGES}, {_TIMED}, g AS (SELECT 0.3::DOUBLE AS threshold), {_CONFUSION}, o AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) AS r FROM t WHERE latency_ms IS NOT NULL),
n AS (SELECT count(*) AS processed, count(*) FILTER (latency_ms > 200) AS slow, count(*) FILTER (coalesce(language, 'unknown') = 'unknown') AS unknown_languages, avg(latency_ms) AS mean, count(latency_ms) AS k FROM t),
q AS (SELECT f, floor((k + 1) * f) AS lo, (k + 1) * f - floor((k + 1) * f) AS part FROM n, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) x(f)),
p AS (SELECT f, max(v) FILTER (r = lo) + (max(v) FILTER (r = lo + 1) - max(v) FILTER (r = lo)) * any_value(part) AS v FROM o, q GROUP BY f)
SELECT tp, fp, tn, fn, round(f1, 6) AS f1, processed, round(mean, 4) AS avg_latency_ms, round((SELECT v FROM p WHERE f = 0.5), 4) AS p50_latency_ms, round(CASE WHEN k >= 20 THEN (SELECT v FROM p WHERE f > 0.9) ELSE mean END, 4) AS p95_latency_ms, round(100 * slow::DOUBLE / processed, 4) AS pct_over_200ms, unknown_languages, round(unknown_languages::DOUBLE / processed, 6) AS unknown_lang_rate FROM m, n""")
def extended_evaluation(spark, sf_dir):
    r4 = lambda c: F.round(c, 4).alias(c)
    e = ev.extended(_timed(spark, sf_dir), 0.3)
    return e.select("tp", "fp", "tn", "fn", r6("f1"), "processed", *[r4(c) for c in ("avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "pct_over_200ms")], "unknown_languages", r6("unknown_lang_rate"))


@query(f"WITH {MESSAGES}, {_TIMED}, w AS (SELECT CASE WHEN score >= 0.3 THEN 'fp' ELSE 'fn' END AS kind, id, md5(substr(text, 1, 500)) AS example, row_number() OVER (PARTITION BY score >= 0.3 ORDER BY id) AS place FROM t WHERE label IS NOT NULL AND (score >= 0.3) <> label) SELECT * FROM w WHERE place <= 50")
def error_examples(spark, sf_dir):
    """The first fifty false positives and false negatives."""
    return ev.error_samples(_timed(spark, sf_dir), 0.3).withColumn("example", F.md5(F.col("example").cast("binary")))


_PROFILE_RULES = {"conservative": (1,), "balanced": (1, 2), "aggressive": (1, 2, 3, 4)}
_LIMITS = {"conservative": {"ham_hit_rate_max": 0.001, "precision_min": 0.98}, "balanced": {"ham_hit_rate_max": 0.02, "spam_recall_min": 0.1}, "aggressive": {"ham_hit_rate_max": 0.9, "spam_recall_max": 1.0}}
_IN_PROFILE = "x(profile, rule_id) AS (VALUES " + ", ".join(f"('{p}', {k}::BIGINT)" for p, ks in _PROFILE_RULES.items() for k in ks) + ")"


@query(f"""WITH {RULE_CTES}, {_IN_PROFILE}, n AS (SELECT count(*) FILTER (is_spam)::DOUBLE AS ts, count(*) FILTER (NOT is_spam)::DOUBLE AS th FROM messages),
c AS (SELECT x.profile, count(DISTINCT x.rule_id) AS patterns, count(DISTINCT h.id) FILTER (h.is_spam) AS unique_spam_hits, count(DISTINCT h.id) FILTER (NOT h.is_spam) AS unique_ham_hits, count(*) FILTER (h.is_spam)::BIGINT AS spam_matches, count(*) FILTER (NOT h.is_spam)::BIGINT AS ham_matches FROM x LEFT JOIN h USING (rule_id) GROUP BY x.profile),
d AS (SELECT c.*, coalesce(unique_spam_hits / nullif(ts, 0), 0) AS spam_recall, coalesce(unique_ham_hits / nullif(th, 0), 0) AS ham_hit_rate, coalesce(spam_matches::DOUBLE / nullif(spam_matches + ham_matches, 0), 0) AS precision FROM c, n),
v AS (SELECT *, concat_ws(',', CASE WHEN ham_hit_rate > CASE profile WHEN 'conservative' THEN 0.001 WHEN 'balanced' THEN 0.02 ELSE 0.9 END THEN 'ham_hit_rate_max' END, CASE WHEN profile = 'balanced' AND spam_recall < 0.1 THEN 'spam_recall_min' END, CASE WHEN profile = 'aggressive' AND spam_recall > 1.0 THEN 'spam_recall_max' END, CASE WHEN profile = 'conservative' AND precision < 0.98 THEN 'precision_min' END) AS violations FROM d)
SELECT profile, patterns, unique_spam_hits, unique_ham_hits, spam_matches, ham_matches, round(spam_recall, 6) AS spam_recall, round(ham_hit_rate, 6) AS ham_hit_rate, round(precision, 6) AS precision, violations, violations = '' AS safe FROM v""")
def profile_safety(spark, sf_dir):
    own = {p: [RULES[k - 1] for k in ks] for p, ks in _PROFILE_RULES.items()}
    out = quality.profile_safety(messages(spark, sf_dir), own, _LIMITS)
    return out.select("profile", "patterns", "unique_spam_hits", "unique_ham_hits", "spam_matches", "ham_matches", r6("spam_recall"), r6("ham_hit_rate"), r6("precision"), F.array_join("violations", ",").alias("violations"), "safe")


_LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY created_at DESC) AS k FROM evaluations) WHERE k = 1)"


@query(f"""WITH {RULE_CTES}, {EVALUATIONS}, {_LAST}, {RULE_TABLE}, t AS (SELECT t.rule_id, l.precision, l.coverage, ['safe_auto', 'review_only', 'feature_only'][1 + (t.rule_id % 3)] AS tier, ['conservative', 'balanced', 'aggressive'][1 + (t.rule_id % 2)] AS mode FROM rules t LEFT JOIN l USING (rule_id))
SELECT rule_id, CASE WHEN precision IS NULL THEN 'not evaluated' WHEN precision >= 0.95 AND coverage <= 0.05 THEN 'auto-ban' WHEN precision >= 0.90 THEN 'ban with review' WHEN precision >= 0.80 THEN 'flag for moderation' ELSE 'feature only' END AS usage,
coalesce(CASE mode WHEN 'conservative' THEN tier = 'safe_auto' AND precision >= 0.98 WHEN 'balanced' THEN tier = 'safe_auto' ELSE tier = 'safe_auto' OR (tier = 'review_only' AND precision >= 0.95) END, FALSE) AS bans, tier = 'safe_auto' OR coalesce(tier = 'review_only' AND precision >= 0.95, FALSE) AS in_balanced FROM t""")
def rule_usage(spark, sf_dir):
    """Suggested usage, automatic bans by mode, and who is in the balanced profile, from the last evaluations."""
    t = rule_table(spark).join(rl.latest(evaluations(messages(spark, sf_dir))).drop("created_at"), "rule_id", "left")
    t = t.withColumn("tier", F.element_at(F.array(*[F.lit(x) for x in quality.TIERS]), (1 + F.col("rule_id") % 3).cast("int")))
    mode = F.when(F.col("rule_id") % 2 == 0, "conservative").otherwise("balanced")
    inside = quality.profile_patterns(t, "balanced").select("rule_id", F.lit(True).alias("inside"))
    bans = F.coalesce(quality.can_auto_ban(mode, F.col("tier"), F.col("precision")), F.lit(False))
    return t.join(inside, "rule_id", "left").select("rule_id", quality.suggested_usage(F.col("precision"), F.col("coverage")).alias("usage"), bans.alias("bans"), F.coalesce("inside", F.lit(False)).alias("in_balanced"))


@query(f"WITH {RULE_CTES}, {EVALUATIONS}, {_LAST}, {RULE_TABLE} SELECT rule_id, round(coalesce(l.coverage, 0), 6) AS coverage, rank() OVER (ORDER BY coalesce(l.coverage, 0) DESC, rule_id)::INT AS place FROM rules LEFT JOIN l USING (rule_id)")
def rules_by_coverage(spark, sf_dir):
    from pyspark.sql import Window

    out = rl.by_metric(rule_table(spark), evaluations(messages(spark, sf_dir)), "coverage")
    place = F.rank().over(Window.orderBy(F.desc("coverage"), "rule_id"))  # a row a rule
    return out.select("rule_id", r6("coverage"), place.alias("place"))


@query(f"WITH {RULE_CTES}, {RULE_TABLE} SELECT t.rule_id, t.status, list_position(['candidate', 'shadow', 'active'], t.status)::BIGINT AS place, (SELECT count(*) FROM h WHERE h.rule_id = t.rule_id) AS hits FROM rules t WHERE t.status IN ('candidate', 'shadow', 'active')")
def rules_in_states(spark, sf_dir):
    """Candidates, then shadow, then active rules, with their hits."""
    hits = rl.evaluate(messages(spark, sf_dir), RULES).select("rule_id", F.col("hits_total").alias("hits"))
    return rl.in_states(rule_table(spark)).join(hits, "rule_id", "left").select("rule_id", "status", "place", F.coalesce("hits", F.lit(0)).alias("hits"))


@query(f"WITH {RULE_CTES}, {EVALUATIONS}, {_LAST}, {RULE_TABLE} SELECT rule_id, sql_expression AS expression, round(precision, 6) AS precision, round(coverage, 6) AS coverage FROM rules LEFT JOIN l USING (rule_id) WHERE status = 'active'")
def platform_export(spark, sf_dir):
    """Active rules as a platform gets them, read back from their JSON."""
    joined = rule_table(spark).join(rl.latest(evaluations(messages(spark, sf_dir))).drop("created_at"), "rule_id", "left")
    read = exports.platform_rules(joined).select(F.from_json("entry", "rule_id long, expression string, precision double, coverage double").alias("e"))
    return read.select("e.rule_id", "e.expression", F.round("e.precision", 6).alias("precision"), F.round("e.coverage", 6).alias("coverage"))


# ---- patterns of the messages -----------------------------------------------------------------------------------------

_MATCHES = "m2 AS (SELECT r.pattern_id, count(DISTINCT h.id)::BIGINT AS hits FROM rules r JOIN h USING (rule_id) WHERE r.pattern_id IS NOT NULL GROUP BY 1), pm AS (SELECT p.pattern_id, p.pattern_type, p.description, coalesce(m2.hits, 0) AS matches FROM patterns p LEFT JOIN m2 USING (pattern_id))"
PATTERN_CTES = f"{RULE_CTES}, {RULE_TABLE}, {PATTERN_TABLE}, {_MATCHES}"


def matched_patterns(spark, sf_dir):
    """The patterns with how many messages their rules match."""
    h = rl.hits(messages(spark, sf_dir), RULES).join(F.broadcast(rule_table(spark).select("rule_id", "pattern_id")), "rule_id")  # a row a rule
    counts = h.where("pattern_id is not null").groupBy("pattern_id", "id").agg(F.lit(1).alias("one")).groupBy("pattern_id").agg(F.count("*").alias("hits"))
    return pattern_table(spark).drop("matches").join(counts, "pattern_id", "left").select("pattern_id", "pattern_type", "description", F.coalesce("hits", F.lit(0)).alias("matches"))


@query(f"WITH {PATTERN_CTES}, z AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY matches DESC, pattern_id) AS k FROM pm) SELECT pattern_id, matches, CASE WHEN matches = 0 THEN 'zombie' WHEN k > 1 THEN 'duplicate' ELSE 'keep' END AS verdict FROM z")
def zombie_patterns(spark, sf_dir):
    """Patterns that match no message, and copies of others."""
    p = matched_patterns(spark, sf_dir)
    return ops.zombies(p).join(p.select("pattern_id", "matches"), "pattern_id").select("pattern_id", "matches", "verdict")


@query(f"WITH {PATTERN_CTES} SELECT p.pattern_id, p.matches FROM pm p WHERE p.pattern_id NOT IN (SELECT pattern_id FROM rules WHERE pattern_id IS NOT NULL)")
def patterns_without_rules(spark, sf_dir):
    return rl.without_rules(matched_patterns(spark, sf_dir), rule_table(spark)).select("pattern_id", "matches")


@query(f"WITH {PATTERN_CTES} SELECT r.pattern_id, p.pattern_type, any_value(p.matches) AS matches, array_to_string(list(r.rule_id ORDER BY r.rule_id), ',') AS rule_ids FROM rules r LEFT JOIN pm p USING (pattern_id) GROUP BY 1, 2")
def rules_under_patterns(spark, sf_dir):
    p = matched_patterns(spark, sf_dir)
    g = rl.grouped_by_pattern(rule_table(spark), p).join(p.select("pattern_id", "matches"), "pattern_id", "left")
    return g.select("pattern_id", "pattern_type", "matches", F.array_join(F.transform("rule_ids", lambda x: x.cast("string")), ",").alias("rule_ids"))


@query(f"WITH {PATTERN_CTES}, c AS (SELECT rule_id, count(*) AS hits FROM h GROUP BY 1) SELECT r.rule_id, r.pattern_id, p.pattern_type, p.description, p.matches, coalesce(c.hits, 0) AS hits FROM rules r LEFT JOIN pm p USING (pattern_id) LEFT JOIN c ON c.rule_id = r.rule_id")
def rules_with_pattern(spark, sf_dir):
    """Rules with their hits, and their pattern with its matches."""
    hits = rl.evaluate(messages(spark, sf_dir), RULES).select("rule_id", F.col("hits_total").alias("hits"))
    joined = rl.with_patterns(rule_table(spark), matched_patterns(spark, sf_dir)).join(hits, "rule_id", "left")
    return joined.select("rule_id", "pattern_id", "pattern_type", "description", "matches", F.coalesce("hits", F.lit(0)).alias("hits"))


@query(f"""WITH {PATTERN_CTES}, c AS (SELECT status, count(DISTINCT t.rule_id) AS n, count(h.id)::BIGINT AS matches FROM rules t LEFT JOIN h USING (rule_id) GROUP BY 1)
SELECT 'pattern' AS kind, pattern_type AS key, count(*) AS n, sum(matches)::BIGINT AS matches FROM pm GROUP BY 2 UNION ALL SELECT 'rule', status, n, matches FROM c UNION ALL SELECT 'message', CASE WHEN is_spam THEN 'spam' WHEN NOT is_spam THEN 'ham' ELSE 'none' END, count(*), count(*) FILTER (id IN (SELECT id FROM h)) FROM messages GROUP BY 2""")
def report_counts(spark, sf_dir):
    """What a report counts: patterns by type, rules by status, messages by label, each with its matches."""
    m = messages(spark, sf_dir)
    p = matched_patterns(spark, sf_dir).groupBy(F.col("pattern_type").alias("key")).agg(F.count("*").alias("n"), F.sum("matches").alias("matches"))
    hits = rl.evaluate(m, RULES).select("rule_id", F.col("hits_total").alias("hits"))
    r = rule_table(spark).join(hits, "rule_id", "left").groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("matches"))
    hit = F.lit(False)
    for rule in RULES:
        hit = hit | F.coalesce(rule.column(), F.lit(False))
    s = m.groupBy(F.when(F.col("is_spam"), "spam").when(~F.col("is_spam"), "ham").otherwise("none").alias("key")).agg(F.count("*").alias("n"), F.count_if(hit).alias("matches"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "key", "n", "matches")
    return named(p, "pattern").unionByName(named(r, "rule")).unionByName(named(s, "message"))


# ---- training data and proposals --------------------------------------------------------------------------------------


@query(f"""WITH {PATTERN_CTES}, d AS (SELECT DISTINCT r.pattern_id, h.id FROM h JOIN rules r USING (rule_id) WHERE r.pattern_id IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY id) AS place FROM d)
SELECT p.pattern_id, p.pattern_type, p.description, count(*) AS n, md5(string_agg(m.external_id || ':' || substr(m.text, 1, 500), '|' ORDER BY k.place)) AS messages FROM k JOIN messages m USING (id) JOIN patterns p USING (pattern_id) WHERE k.place <= 50 GROUP BY 1, 2, 3""")
def discovery_dataset(spark, sf_dir):
    """Fifty matching messages of each pattern, as rows for training."""
    m = messages(spark, sf_dir)
    d = exports.discovery_rows(pattern_table(spark), rule_table(spark), rl.hits(m, RULES), m)
    shown = F.array_join(F.transform("messages", lambda x: F.concat(x["external_id"], F.lit(":"), x["text"])), "|")
    return d.select("pattern_id", "pattern_type", "description", F.size("messages").cast("long").alias("n"), F.md5(shown.cast("binary")).alias("messages"))


@query(f"WITH {PATTERN_CTES}, c AS (SELECT rule_id, min(id) AS first_id FROM h GROUP BY 1) SELECT r.rule_id, r.pattern_id, r.sql_expression AS sql_rule, coalesce(p.description, 'Rule ' || r.rule_id || ': ' || substr(r.sql_expression, 1, 100) || '...') AS explanation, c.first_id FROM rules r LEFT JOIN patterns p USING (pattern_id) LEFT JOIN c ON c.rule_id = r.rule_id")
def explanation_dataset(spark, sf_dir):
    """Every rule with its explanation and the first message it matches."""
    first = rl.hits(messages(spark, sf_dir), RULES).groupBy("rule_id").agg(F.min("id").alias("first_id"))
    return exports.explanation_rows(pattern_table(spark), rule_table(spark)).join(first, "rule_id", "left").select("rule_id", "pattern_id", "sql_rule", "explanation", "first_id")


_LABELLED = "d AS (SELECT d.source AS namespace, CASE WHEN d.doc_id % 11 = 0 THEN '  ' ELSE ' ' || d.text || ' ' END AS text, CASE WHEN l.toxic = 1 THEN ' spam ' WHEN l.toxic = 0 THEN 'ham' END AS label FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"WITH {_LABELLED} SELECT namespace, trim(label) AS label, coalesce(trim(text), '') <> '' AND coalesce(trim(label), '') <> '' AS accepted, count(*) AS n, sum(length(trim(text, ' ')))::BIGINT AS characters FROM d GROUP BY 1, 2, 3")
def training_import(spark, sf_dir):
    """Documents imported as training examples by namespace: those accepted and those skipped."""
    word = F.when(F.col("toxic") == 1, " spam ").when(F.col("toxic") == 0, "ham")
    text = F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("source", text.alias("text"), word.alias("label"))
    return training_set(d, F.col("source")).groupBy("namespace", "label", "accepted").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("""WITH p AS (SELECT user_id AS response_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, upper(['safe_auto', 'REVIEW_ONLY', 'DANGEROUS', 'INSIGHT_ONLY', 'other'][1 + event_id % 5]) AS tier, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 103 END AS risk, CASE WHEN event_id % 29 = 0 THEN 'SURE' ELSE ['HIGH', 'LOW', 'MEDIUM'][1 + event_id % 3] END AS confidence FROM events),
c AS (SELECT *, CASE WHEN risk IS NULL THEN 'missing risk_level' WHEN tier = 'OTHER' THEN 'invalid tier' WHEN risk > 100 THEN 'risk out of range' WHEN confidence = 'SURE' THEN 'invalid confidence' END AS problem FROM p)
SELECT response_id, arg_min(problem, place) FILTER (problem IS NOT NULL) AS problem, min(place) FILTER (problem IS NOT NULL) AS problem_at, round(count(*) FILTER (tier <> 'INSIGHT_ONLY')::DOUBLE / count(*), 6) AS conversion_rate,
count(*) FILTER (confidence <> 'LOW' AND tier = 'REVIEW_ONLY' AND (risk < 30 OR risk IS NULL) OR confidence <> 'LOW' AND tier = 'SAFE_AUTO' AND risk >= 10) AS for_review FROM c GROUP BY 1""")
def proposals_validated(spark, sf_dir):
    """Responses (a user's events stand for one) with their first problem, and how many patterns are for review once tiers are in
    line with risks."""
    e = F.col("event_id")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (1 + e % n).cast("int"))
    risk = F.when(e % 13 != 0, e % 103)
    one = F.struct(e.alias("at"), F.lit("keyword").alias("type"), F.lit("words").alias("description"), pick(("safe_auto", "REVIEW_ONLY", "DANGEROUS", "INSIGHT_ONLY", "other"), 5).alias("tier"), risk.alias("risk_level"), F.when(e % 29 == 0, "sure").otherwise(pick(("HIGH", "low", "MEDIUM"), 3)).alias("confidence_level"))
    responses = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("response_id")).agg(F.array_sort(F.collect_list(one)).alias("patterns"))
    aligned = F.transform("patterns", lambda p: quality.align_tier(F.upper(p["tier"]), p["risk_level"], F.upper(p["confidence_level"])))
    v = quality.validated(responses).withColumn("for_review", F.size(F.filter(aligned, lambda t: t == "REVIEW_ONLY")).cast("long"))
    return v.select("response_id", "problem", "problem_at", r6("conversion_rate"), "for_review")


_QUEUE = "q AS (SELECT date_trunc('day', ts) AS batch_at, CASE WHEN event_type = 'click' THEN 'sql' ELSE 'pattern' END AS kind, event_id AS item, user_id % 3 = 0 AS validated FROM events WHERE event_type IN ('click', 'error'))"


@query(f"WITH {_QUEUE}, p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY batch_at, item) - 1 AS number FROM q WHERE NOT validated) SELECT q.kind, q.item, p.number AS number, q.validated OR coalesce(p.kind = 'sql' AND p.number = 3, FALSE) AS validated_after, CASE WHEN p.kind = 'sql' AND p.number = 3 THEN 'me' END AS validated_by FROM q LEFT JOIN p ON p.kind = q.kind AND p.batch_at = q.batch_at AND p.item = q.item")
def suggestion_queue(spark, sf_dir):
    """Pending suggestions by number, and the queue after one of them is validated."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    q = e.select(F.date_trunc("day", "ts").alias("batch_at"), F.when(F.col("event_type") == "click", "sql").otherwise("pattern").alias("kind"), F.col("event_id").alias("at"), (F.col("user_id") % 3 == 0).alias("validated"))
    after = exports.validate_suggestion(q, "sql", 3, "me", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)).select("kind", "batch_at", "at", F.col("validated").alias("validated_after"), "validated_by")
    numbered = exports.pending(q).select("kind", "batch_at", "at", F.col("number").cast("long").alias("number"))
    return after.join(numbered, ["kind", "batch_at", "at"], "left").select("kind", F.col("at").alias("item"), "number", "validated_after", "validated_by")


@query("""WITH s AS (SELECT source AS stage, doc_id AS id FROM documents), h AS (SELECT stage, (min(id) + max(id)) // 2 AS half FROM s GROUP BY 1), a AS (SELECT s.stage, max(id) AS last_id FROM s JOIN h USING (stage) WHERE id <= half GROUP BY 1)
SELECT s.stage, max(id) AS last_id, count(*) AS cnt, count(*) FILTER (a.last_id IS NULL OR id > a.last_id) AS resumed FROM s LEFT JOIN a USING (stage) WHERE s.stage IS NOT NULL GROUP BY 1""")
def mining_checkpoints(spark, sf_dir):
    """A run that stopped half-way through each source, resumed from its checkpoint: the state after it and what was left."""
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("stage"), F.col("doc_id").alias("id")).where("stage is not null")
    half = s.groupBy("stage").agg(F.expr("(min(id) + max(id)) div 2").alias("half"))
    empty = spark.createDataFrame([], "stage string, last_id long, cnt long")
    state = lifecycle.checkpoint(empty, s.join(half, "stage").where("id <= half"))
    rest = lifecycle.unprocessed(state, s)
    left = rest.groupBy("stage").agg(F.count("*").alias("resumed"))
    return lifecycle.checkpoint(state, rest).join(left, "stage", "left").select("stage", "last_id", "cnt", F.coalesce("resumed", F.lit(0)).alias("resumed"))


# ---- operations -------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type AS provider, 'm' || (user_id % 3) AS model, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-03')
SELECT provider, model, count(*) AS calls, round(sum(value), 3) AS cost FROM e GROUP BY GROUPING SETS ((provider), (model), ())""")
def usage_cube(spark, sf_dir):
    model = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    c = ops.usage_cube(table(spark, sf_dir, "events"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), F.col("event_type"), model)
    return c.withColumn("cost", F.round("cost", 3))


@query("SELECT 'day' AS period, user_id, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS calls FROM events GROUP BY 2, 3 UNION ALL SELECT 'month', user_id, date_trunc('month', ts)::TIMESTAMP, count(*) FROM events GROUP BY 2, 3")
def usage_days_months(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    by = lambda p: ops.usage(e, p).groupBy(F.lit(p).alias("period"), "user_id", F.col("period").alias("start")).agg(F.sum("calls").alias("calls"))
    return by("day").unionByName(by("month"))


_BOUNDS = [5.0, 10.0, 20.0, 50.0, 100.0]


@query("""WITH e AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000, FALSE) AS hit FROM events),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(value) AS n, count(*) FILTER (event_type = 'error') AS increase, 100.0 * count(*) FILTER (hit) / count(*) AS hit_rate, count(*) FILTER (value <= 5) AS a, count(*) FILTER (value <= 10) AS b, count(*) FILTER (value <= 20) AS c, count(*) FILTER (value <= 50) AS d, count(*) FILTER (value <= 100) AS f FROM e GROUP BY 1),
p AS (SELECT start, n, increase, hit_rate, CASE WHEN n = 0 THEN NULL WHEN a >= 0.95 * n THEN 5 * (0.95 * n / a) WHEN b >= 0.95 * n THEN 5 + 5 * (0.95 * n - a) / (b - a) WHEN c >= 0.95 * n THEN 10 + 10 * (0.95 * n - b) / (c - b) WHEN d >= 0.95 * n THEN 20 + 30 * (0.95 * n - c) / (d - c) WHEN f >= 0.95 * n THEN 50 + 50 * (0.95 * n - d) / (f - d) ELSE 100 END AS p95 FROM w)
SELECT start, n, increase, round(p95::DOUBLE, 6) AS p95, round(hit_rate::DOUBLE, 6) AS hit_rate, sum((p95 > 30)::INT) OVER o = 2 AS slow_firing, sum((hit_rate < 50)::INT) OVER o = 2 AS cache_firing, increase > 0 AS errors_firing FROM p WINDOW o AS (ORDER BY start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def alert_rules_1h(spark, sf_dir):
    """Latency and cache alerts that held for two hours, and any increase of errors, by hour."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.withColumn("hit", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")) < 7_200_000_000, F.lit(False)))
    w = ops.alert_windows(e, "1 hour", _BOUNDS, F.col("hit"))
    slow = ops.firing(w, F.col("p95") > 30, 2).withColumnRenamed("firing", "slow_firing").drop("breach")
    both = ops.firing(slow, F.col("hit_rate") < 50, 2).withColumnRenamed("firing", "cache_firing").drop("breach")
    return both.select("start", "n", "increase", r6("p95"), r6("hit_rate"), "slow_firing", "cache_firing", (F.col("increase") > 0).alias("errors_firing"))
