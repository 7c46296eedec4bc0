"""Rule replay, evaluation tables, tiers and lifecycle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillmesh.operators import exports, lifecycle, quality
from quillmesh.operators import rules as rl
from quillmesh.plans.base import EVALUATIONS, MESSAGES, PATTERN_TABLE, RULE_CTES, RULE_TABLE, RULES, as_of, evaluations, messages, pattern_table, query, r6, rule_table, table
from quillmesh.sources.messages import recent

_METRICS = """round(CASE WHEN hits_total > 0 THEN spam_hits::DOUBLE / hits_total END, 6) AS precision, round(spam_hits::DOUBLE / nullif(total_spam, 0), 6) AS recall,
round(CASE WHEN hits_total > 0 THEN CASE WHEN spam_hits = 0 THEN 0.0 ELSE 2 * (spam_hits::DOUBLE / hits_total) * (spam_hits::DOUBLE / total_spam) / (spam_hits::DOUBLE / hits_total + spam_hits::DOUBLE / total_spam) END END::DOUBLE, 6) AS f1_score,
round(hits_total::DOUBLE / total, 6) AS coverage"""
_COUNTS = """c AS (SELECT r.rule_id, count(h.id)::BIGINT AS hits_total, count(*) FILTER (h.is_spam)::BIGINT AS spam_hits, count(*) FILTER (NOT h.is_spam)::BIGINT AS ham_hits FROM r LEFT JOIN h ON h.rule_id = r.rule_id GROUP BY r.rule_id),
n AS (SELECT count(*) AS total, count(*) FILTER (is_spam) AS total_spam FROM messages)"""


@query(f"WITH {RULE_CTES}, {_COUNTS} SELECT rule_id, hits_total, spam_hits, ham_hits, {_METRICS} FROM c, n")
def rule_shadow_eval(spark, sf_dir):
    """The flagship: all rules, one scan."""
    e = rl.evaluate(messages(spark, sf_dir), RULES)
    return e.select("rule_id", "hits_total", "spam_hits", "ham_hits", r6("precision"), r6("recall"), r6("f1_score"), r6("coverage"))


@query(f"WITH {RULE_CTES} SELECT rule_id, id, is_spam FROM h")
def rule_hits(spark, sf_dir):
    return rl.hits(messages(spark, sf_dir), RULES).select("rule_id", "id", "is_spam")


@query(f"WITH {RULE_CTES}, {_COUNTS} SELECT rule_id, round(hits_total::DOUBLE / total, 6) AS coverage, hits_total::DOUBLE / total > 0.05 AS rejected FROM c, n")
def rule_coverage(spark, sf_dir):
    return rl.too_broad(messages(spark, sf_dir), RULES, 0.05).select("rule_id", r6("coverage"), "rejected")


@query(f"""WITH {RULE_CTES}, p AS (SELECT m.id, m.is_spam, count(h.id) AS n FROM messages m LEFT JOIN h ON h.id = m.id GROUP BY m.id, m.is_spam),
s AS (SELECT count(*) FILTER (is_spam AND n > 0) AS unique_spam_hits, count(*) FILTER (NOT is_spam AND n > 0) AS unique_ham_hits, sum(n) FILTER (is_spam)::BIGINT AS summed_spam_hits, sum(n) FILTER (NOT is_spam)::BIGINT AS summed_ham_hits, count(*) FILTER (is_spam) AS ts, count(*) FILTER (NOT is_spam) AS th FROM p)
SELECT unique_spam_hits, unique_ham_hits, summed_spam_hits, summed_ham_hits, round(unique_spam_hits::DOUBLE / ts, 6) AS recall, round(unique_ham_hits::DOUBLE / th, 6) AS ham_hit_rate, round(summed_spam_hits::DOUBLE / (summed_spam_hits + summed_ham_hits), 6) AS precision FROM s""")
def rule_union_profile(spark, sf_dir):
    u = rl.union_metrics(messages(spark, sf_dir), RULES)
    return u.select("unique_spam_hits", "unique_ham_hits", "summed_spam_hits", "summed_ham_hits", r6("recall"), r6("ham_hit_rate"), r6("precision"))


@query(f"WITH {MESSAGES} SELECT id FROM messages WHERE NOT (contains(lower(text), 'trash') OR contains(lower(text), 'free') OR contains(lower(text), 'http://'))")
def rule_complement(spark, sf_dir):
    m = messages(spark, sf_dir)
    found = rl.hits(m, [RULES[0], RULES[2], RULES[3]]).select("id").distinct()
    return m.select("id").join(found, "id", "left_anti")


@query(f"WITH {RULE_CTES} SELECT DISTINCT CASE WHEN rule_id <= 2 THEN 1 ELSE 2 END::BIGINT AS rule_id, id, is_spam FROM h")
def rule_flat_or_replay(spark, sf_dir):
    needles = spark.createDataFrame([(1, "trash"), (1, "worthless"), (2, "free"), (2, "http://"), (2, "example.net")], "rule_id long, needle string")
    return rl.flat_or(messages(spark, sf_dir), needles)


#: Rules as they may arrive: a clause, and whether it may be run.
_ARRIVING = [("contains(lower(text), 'trash')", True), ("text RLIKE '.*'", False), ("coalesce(reflect('java.lang.System', 'getProperty', text), 'q') = '3'", False), ("lower(text) LIKE '%free%' AND NOT coalesce(user_complaint, false)", True), ("rand() < 0.5", False), ("text = text", False), ("length(text) > 2000", True), ("id IN (SELECT id FROM messages)", False)]
_ARRIVED = ", ".join("({}::BIGINT, {})".format(i, "true" if ok else "false") for i, (_, ok) in enumerate(_ARRIVING, 1))


@query(f"""WITH {MESSAGES}, a(rule_id, accepted) AS (VALUES {_ARRIVED}),
h AS (SELECT 1::BIGINT AS rule_id, id FROM messages WHERE contains(lower(text), 'trash') UNION ALL SELECT 4, id FROM messages WHERE contains(lower(text), 'free') AND NOT coalesce(user_complaint, false) UNION ALL SELECT 7, id FROM messages WHERE length(text) > 2000)
SELECT a.rule_id, accepted, count(h.id) AS hits FROM a LEFT JOIN h USING (rule_id) GROUP BY a.rule_id, accepted""")
def rules_judged(spark, sf_dir):
    """Arriving rules judged from their plans; those accepted are replayed over all messages."""
    m = messages(spark, sf_dir)
    arriving = spark.createDataFrame([(i, f"SELECT id, is_spam FROM messages WHERE {c}") for i, (c, _) in enumerate(_ARRIVING, 1)], "rule_id long, sql_expression string")
    found = rl.judged(arriving, m)
    taken = {r.rule_id for r in found.where("accepted").collect()}
    counts = rl.hits(m, [rl.Rule(i, c) for i, (c, _) in enumerate(_ARRIVING, 1) if i in taken]).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return found.join(counts, "rule_id", "left").select("rule_id", "accepted", F.coalesce("hits", F.lit(0)).alias("hits"))


_THOUSAND = """k AS (SELECT key, row_number() OVER (ORDER BY count(*) DESC, key) - 1 AS place FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS key FROM messages) WHERE length(key) >= 4 GROUP BY key QUALIFY place < 1000),
n AS (SELECT count(*) AS n FROM k), x AS (SELECT k.place AS rule_id, k.key AS a, b.key AS b, CASE WHEN k.place % 2 = 1 THEN c.key ELSE '' END AS c FROM k, n JOIN k b ON b.place = k.place * 7 % n.n JOIN k c ON c.place = (k.place * 13 + 5) % n.n)"""


def _thousand_rules(rows):
    """A rule for each of the thousand most widespread words: that word or another; every second one needs a third besides."""
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("key")).where(F.length("key") >= 4)
    k = [r.key for r in words.groupBy("key").count().orderBy(F.desc("count"), "key").limit(1000).collect()]
    return [rl.Rule.literal(i, [k[i], k[i * 7 % len(k)]], *([[k[(i * 13 + 5) % len(k)]]] if i % 2 else [])) for i in range(len(k))]


@query(f"""WITH {MESSAGES}, {_THOUSAND}, t AS MATERIALIZED (SELECT id, is_spam, lower(text) AS l FROM messages)
SELECT x.rule_id, count(*) AS hits_total, count(*) FILTER (is_spam) AS spam_hits, count(*) FILTER (NOT is_spam) AS ham_hits FROM x JOIN t ON (contains(l, a) OR contains(l, b)) AND contains(l, c) GROUP BY x.rule_id""")
def replay_of_a_thousand_rules(spark, sf_dir):
    """A thousand rules of the messages' own words by one automaton."""
    m = messages(spark, sf_dir)
    e = rl.evaluate(m, _thousand_rules(m))
    return e.select("rule_id", "hits_total", "spam_hits", "ham_hits").where("hits_total > 0")


@query(f"""WITH {MESSAGES} SELECT 1::BIGINT AS rule_id, id, is_spam FROM messages WHERE contains(lower(text), 'trash') OR regexp_matches(text, '(?i)wor[a-z]+ss\\b')
UNION ALL SELECT 2, id, is_spam FROM messages WHERE contains(lower(text), 'free')""")
def rule_flat_or_regexp(spark, sf_dir):
    """Literals and regular expressions of a rule, each enough by itself."""
    needles = spark.createDataFrame([(1, "trash", "like"), (1, r"wor[a-z]+ss\y", "regexp"), (2, "free", None)], "rule_id long, needle string, kind string")
    return rl.flat_or(messages(spark, sf_dir), needles)


@query(f"WITH {RULE_CTES}, {EVALUATIONS} SELECT rule_id, created_at, hits_total, spam_hits, ham_hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coverage, 6) AS coverage FROM evaluations")
def rule_daily_evaluations(spark, sf_dir):
    return evaluations(messages(spark, sf_dir)).select("rule_id", "created_at", "hits_total", "spam_hits", "ham_hits", r6("precision"), r6("recall"), r6("coverage"))


@query(f"WITH {RULE_CTES}, {EVALUATIONS} SELECT rule_id, max(created_at) AS created_at, round(arg_max(precision, created_at), 6) AS precision, arg_max(hits_total, created_at) AS hits_total FROM evaluations GROUP BY rule_id")
def rule_latest_eval(spark, sf_dir):
    return rl.latest(evaluations(messages(spark, sf_dir))).select("rule_id", "created_at", r6("precision"), "hits_total")


_DRIFT = "d AS (SELECT rule_id, created_at, precision, hits_total, ham_hits, coverage, lag(precision) OVER (PARTITION BY rule_id ORDER BY created_at) AS previous_precision FROM evaluations), v AS (SELECT *, (previous_precision - precision) / nullif(previous_precision, 0) AS drift FROM d)"


@query(f"WITH {RULE_CTES}, {EVALUATIONS}, {_DRIFT} SELECT rule_id, created_at, round(precision, 6) AS precision, round(previous_precision, 6) AS previous_precision, round(drift, 6) AS drift, CASE WHEN drift > 0.10 THEN 'DRIFT' WHEN drift < -0.05 THEN 'IMPROVED' WHEN drift IS NOT NULL THEN 'STABLE' END AS verdict FROM v")
def rule_drift(spark, sf_dir):
    return rl.drift(evaluations(messages(spark, sf_dir))).select("rule_id", "created_at", r6("precision"), r6("previous_precision"), r6("drift"), "verdict")


_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY created_at DESC) AS k FROM v) WHERE k = 1)"
_LOOSE = quality.Profile(0.30, 0.20, 3, 10)


@query(f"WITH {RULE_CTES}, {EVALUATIONS}, {_DRIFT}, {_LATEST}, {RULE_TABLE} SELECT t.rule_id, CASE WHEN t.status = 'shadow' AND l.precision >= 0.30 AND (l.coverage = 0 OR l.coverage <= 0.20) AND l.hits_total >= 3 AND l.ham_hits <= 10 THEN 'active' ELSE t.status END AS status FROM rules t LEFT JOIN l ON l.rule_id = t.rule_id")
def rule_promote(spark, sf_dir):
    return lifecycle.promote(rule_table(spark), evaluations(messages(spark, sf_dir)), _LOOSE, None).select("rule_id", "status")


@query(f"WITH {RULE_CTES}, {EVALUATIONS}, {_DRIFT}, {_LATEST}, {RULE_TABLE} SELECT t.rule_id, CASE WHEN t.status = 'active' AND (coalesce(l.precision < 0.30, FALSE) OR coalesce(l.drift > 0.10, FALSE) OR coalesce(l.ham_hits > 10, FALSE) OR coalesce(l.coverage > 0.40, FALSE)) THEN 'deprecated' ELSE t.status END AS status FROM rules t LEFT JOIN l ON l.rule_id = t.rule_id")
def rule_degrade(spark, sf_dir):
    return lifecycle.monitor(rule_table(spark), evaluations(messages(spark, sf_dir)), _LOOSE, None).select("rule_id", "status")


@query(f"""WITH {RULE_CTES}, {_COUNTS}, p AS (SELECT rule_id, spam_hits, ham_hits, CASE WHEN spam_hits + ham_hits > 0 THEN spam_hits::DOUBLE / (spam_hits + ham_hits) ELSE 0 END AS precision, ham_hits::DOUBLE / nullif((SELECT count(*) FROM messages WHERE NOT is_spam), 0) AS rate FROM c)
SELECT rule_id, round(precision, 6) AS precision, CASE WHEN precision >= 0.98 AND spam_hits >= 50 AND rate <= 0.01 THEN 'safe_auto' WHEN (precision >= 0.90 AND precision < 0.98 AND spam_hits >= 20) OR (precision >= 0.95 AND rate <= 0.05) THEN 'review_only' WHEN precision < 0.90 OR rate > 0.05 THEN 'feature_only' ELSE 'review_only' END AS tier FROM p""")
def pattern_tier(spark, sf_dir):
    m = messages(spark, sf_dir)
    e = rl.evaluate(m, RULES)
    ham = m.where("not is_spam").count()
    p = F.coalesce(F.try_divide(F.col("spam_hits").cast("double"), F.col("spam_hits") + F.col("ham_hits")), F.lit(0.0))
    return e.select("rule_id", F.round(p, 6).alias("precision"), quality.tier(p, F.col("spam_hits"), F.col("ham_hits"), F.lit(ham)).alias("tier"))


@query(f"""WITH {RULE_CTES}, g AS (SELECT h.rule_id, count(*)::BIGINT AS group_size, count(DISTINCT m.source)::BIGINT AS sources, count(DISTINCT m.sender)::BIGINT AS senders, min(h.id) AS first_id FROM h JOIN messages m ON m.id = h.id GROUP BY h.rule_id)
SELECT rule_id, group_size, sources, senders, first_id, round(CASE WHEN group_size > 20 AND sources > 5 THEN least(least(0.5 + CASE WHEN senders > 10 THEN 0.2 WHEN senders > 5 THEN 0.1 ELSE 0 END + CASE WHEN group_size > 100 THEN 0.1 ELSE 0 END, 0.95) + 0.15, 0.95) ELSE least(0.5 + CASE WHEN senders > 10 THEN 0.2 WHEN senders > 5 THEN 0.1 ELSE 0 END + CASE WHEN group_size > 100 THEN 0.1 ELSE 0 END, 0.95) END::DOUBLE, 2) AS bot_likelihood FROM g""")
def pattern_stats(spark, sf_dir):
    m = messages(spark, sf_dir)
    found = F.filter(F.array(*[F.when(r.column(), F.lit(r.rule_id).cast("long")) for r in RULES]), lambda x: x.isNotNull())
    g = m.select("id", "source", "sender", F.explode(found).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("group_size"), F.count_distinct("source").alias("sources"), F.count_distinct("sender").alias("senders"), F.min("id").alias("first_id"))
    return g.withColumn("bot_likelihood", quality.bot_likelihood(F.lit("url"), F.col("group_size"), F.col("senders"), F.col("sources")).cast("double"))


@query(f"WITH {RULE_CTES}, {EVALUATIONS}, {_DRIFT}, {_LATEST}, {RULE_TABLE} SELECT t.rule_id, coalesce(l.precision, 0.5) IS NOT NULL AS ranked, round(coalesce(l.precision, 0.5), 6) AS rank_precision FROM rules t LEFT JOIN l USING (rule_id) WHERE t.status = 'shadow' ORDER BY coalesce(l.precision, 0.5) DESC, t.rule_id LIMIT 2")
def rules_best_shadow(spark, sf_dir):
    return rl.best_shadow(rule_table(spark), evaluations(messages(spark, sf_dir)), 2).select("rule_id", F.lit(True).alias("ranked"), r6("rank_precision"))


@query(f"WITH {RULE_CTES}, {EVALUATIONS}, {_DRIFT}, {_LATEST}, {RULE_TABLE} SELECT rule_id, status, round(precision, 6) AS precision FROM rules JOIN l USING (rule_id) WHERE precision >= 0.2")
def rules_filtered(spark, sf_dir):
    return rl.filtered(rule_table(spark), evaluations(messages(spark, sf_dir)), 0.2).select("rule_id", "status", r6("precision"))


@query(f"""WITH {RULE_CTES}, {EVALUATIONS}, {_DRIFT}, {_LATEST}, {RULE_TABLE}, f AS (SELECT *, row_number() OVER (PARTITION BY sql_expression ORDER BY rule_id) AS k FROM rules)
SELECT f.rule_id, f.pattern_id, l.hits_total, CASE WHEN f.status = 'active' THEN 'block' ELSE 'flag' END AS action, round(coalesce(l.precision, 0.5), 6) AS weight FROM f LEFT JOIN l USING (rule_id) WHERE f.k = 1""")
def export_ruleset(spark, sf_dir):
    """What the ruleset export holds, read back from its JSON."""
    one = rl.one_per_expression(rule_table(spark)).join(rl.latest(evaluations(messages(spark, sf_dir))).drop("created_at"), "rule_id", "left")
    entries = exports.ruleset(one).join(one.select("rule_id", "pattern_id", "hits_total"), "rule_id")
    read = entries.withColumn("e", F.from_json("entry", "id string, condition string, weight double, action string"))
    return read.select("rule_id", "pattern_id", "hits_total", "e.action", F.round("e.weight", 6).alias("weight"))


@query(f"""WITH {RULE_CTES}, {EVALUATIONS}, {_DRIFT}, {_LATEST}, {RULE_TABLE}, {PATTERN_TABLE}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY created_at DESC, rule_id DESC) AS k FROM rules) WHERE k = 1)
SELECT p.pattern_id, n.rule_id, 'Write a filter rule for this pattern: ' || p.description AS prompt, n.sql_expression AS answer, round(l.precision, 6) AS precision FROM patterns p JOIN n USING (pattern_id) LEFT JOIN l ON l.rule_id = n.rule_id""")
def llm_rule_dataset(spark, sf_dir):
    return exports.training_rows(pattern_table(spark), rule_table(spark), evaluations(messages(spark, sf_dir))).select("pattern_id", "rule_id", "prompt", "answer", r6("precision"))


@query(f"WITH {MESSAGES}, t AS (SELECT max(timestamp) AS now FROM messages) SELECT id, is_spam FROM messages, t WHERE timestamp >= now - INTERVAL 1 DAY AND is_spam AND id > 100")
def scan_recent_spam(spark, sf_dir):
    m = messages(spark, sf_dir)
    return recent(m, as_of(m), 1, is_spam=True, after_id=100).select("id", "is_spam")


@query(f"WITH {MESSAGES} SELECT external_id, id FROM messages ORDER BY timestamp DESC, id DESC LIMIT 25 OFFSET 25")
def scan_page(spark, sf_dir):
    """The second page of the newest messages."""
    return messages(spark, sf_dir).orderBy(F.desc("timestamp"), F.desc("id")).offset(25).limit(25).select("external_id", "id")


@query("SELECT quality::BOOLEAN AS quality, CASE WHEN lower(trim(w)) IN ('1', 'true', 'spam', 'yes') THEN TRUE WHEN lower(trim(w)) IN ('0', 'false', 'ham', 'no') THEN FALSE END AS parsed, count(*) AS n FROM (SELECT quality, CASE WHEN toxic = 1 THEN ' Spam' WHEN quality = 0 THEN 'unsure' ELSE 'NO ' END AS w FROM labels) GROUP BY 1, 2")
def csv_label_parse(spark, sf_dir):
    from quillmesh.sources.messages import label

    word = F.when(F.col("toxic") == 1, " Spam").when(F.col("quality") == 0, "unsure").otherwise("NO ")
    return table(spark, sf_dir, "labels").select(F.col("quality").cast("boolean").alias("quality"), label(word).alias("parsed")).groupBy("quality", "parsed").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE ts END AS ts, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def ts_parse_and_meta(spark, sf_dir):
    """Times from text, broken ones replaced, and a value from JSON."""
    from quillmesh.sources.messages import timestamp

    word = F.when(F.col("event_id") % 3 == 0, "broken").otherwise(F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z")))
    at = timestamp(word, F.lit(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)))
    return table(spark, sf_dir, "events").select("event_id", at.cast("timestamp_ntz").alias("ts"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
