"""Whole rule sets over all messages, lookups, acceptance of mined rules, clusters with examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.operators import blocking, quality, signals
from quillmesh.operators import rules as rl
from quillmesh.plans.base import MESSAGES, RULE_CTES, RULES, messages, query, table
from quillmesh.plans.mining_queries import SIGNATURE_SQL
from quillmesh.sources.messages import by_external_id, by_id, latest


def _duck(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _columns(rules: dict[str, str]) -> str:
    return ", ".join(f"({p}) AS {k}" for k, p in rules.items())


@query(f"WITH {MESSAGES} SELECT id, {_columns(blocking.blocking(_duck))} FROM messages")
def blocking_rules(spark, sf_dir):
    """The six blocking rules, each a column, over all messages."""
    return messages(spark, sf_dir).select("id", *[F.expr(p).alias(k) for k, p in blocking.blocking().items()])


@query(f"WITH {MESSAGES} SELECT id, is_spam FROM messages WHERE {blocking.combined(_duck)}")
def blocking_combined(spark, sf_dir):
    return messages(spark, sf_dir).where(blocking.combined()).select("id", "is_spam")


@query(f"WITH {MESSAGES} SELECT id, {_columns(blocking.old_rules(_duck))} FROM messages")
def old_blocking_rules(spark, sf_dir):
    """The older set of seven, each a column, over all messages."""
    return messages(spark, sf_dir).select("id", *[F.expr(p).alias(k) for k, p in blocking.old_rules().items()])


@query(f"WITH {MESSAGES} SELECT id, is_spam FROM messages WHERE {blocking.old_combined(_duck)}")
def old_blocking_combined(spark, sf_dir):
    return messages(spark, sf_dir).where(blocking.old_combined()).select("id", "is_spam")


#: Whole texts with some of the words that the language rules and the score look for after them.
_WORDED = "text || CASE id % 5 WHEN 0 THEN ' buy!' WHEN 1 THEN ' sell this car!' WHEN 2 THEN ' job!' WHEN 3 THEN ' Продам!' ELSE ' набираю?' END"


@query(f"WITH {MESSAGES}, s AS (SELECT id, {_WORDED} AS text FROM messages) SELECT id, ({blocking.by_language()['ru']}) AS ru, ({blocking.by_language()['en']}) AS en FROM s")
def language_rules(spark, sf_dir):
    rows = messages(spark, sf_dir).select("id", F.expr(_WORDED).alias("text"))
    return rows.select("id", *[F.expr(p).alias(k) for k, p in blocking.by_language().items()])


_CONTACT = "text || CASE id % 6 WHEN 0 THEN ' продаю t.me/shop +7 900 123 45 67' WHEN 1 THEN ' 555-123-4567 discount' WHEN 2 THEN ' 500 руб' WHEN 3 THEN ' работа me@shop.ru' ELSE '' END"
_PRE = f"""senders AS (SELECT sender, count(*) AS message_count, min(id) AS first_id, avg(CASE WHEN is_spam THEN 0.0 ELSE 1.0 END) AS sender_reputation FROM messages WHERE sender IS NOT NULL GROUP BY sender),
pre AS (SELECT m.id, t.text, lower(replace(t.text, 'ё', 'е')) AS n, coalesce(m.id = s.first_id, FALSE) AS is_first_message, coalesce(s.message_count, 0) AS message_count, s.sender_reputation, NULL::BIGINT AS message_count_recent_5min
  FROM messages m JOIN (SELECT id, {_CONTACT} AS text FROM messages) t USING (id) LEFT JOIN senders s ON s.sender = m.sender)"""


def _pre(spark, sf_dir):
    m = messages(spark, sf_dir)
    senders = m.where("sender is not null").groupBy("sender").agg(F.count("*").alias("message_count"), F.min("id").alias("first_id"), F.avg(F.when(F.col("is_spam"), 0.0).otherwise(1.0)).alias("sender_reputation"))
    rows = m.select("id", "sender", F.expr(_CONTACT).alias("text")).join(senders, "sender", "left")
    first = F.coalesce(F.col("id") == F.col("first_id"), F.lit(False))
    return rows.select("id", "text", F.lower(F.replace(F.col("text"), F.lit("ё"), F.lit("е"))).alias("n"), first.alias("is_first_message"), F.coalesce("message_count", F.lit(0)).alias("message_count"), "sender_reputation", F.lit(None).cast("long").alias("message_count_recent_5min"))


@query(f"WITH {MESSAGES}, {_PRE} SELECT id, round(({blocking.weighted(_duck)})::DOUBLE, 6) AS spam_score FROM pre")
def weighted_scores(spark, sf_dir):
    """The whole weighted score of every message."""
    return _pre(spark, sf_dir).select("id", F.round(F.expr(blocking.weighted()).cast("double"), 6).alias("spam_score"))


@query(f"WITH {MESSAGES}, {_PRE}, s AS (SELECT id, round(({blocking.weighted(_duck)})::DOUBLE, 6) AS spam_score FROM pre WHERE {blocking.IN_CONTEXT}) SELECT id, spam_score FROM s WHERE spam_score > {blocking.WEIGHTED_GATE}")
def weighted_sql_score(spark, sf_dir):
    """Messages in context whose weighted score passes the gate."""
    s = _pre(spark, sf_dir).where(blocking.IN_CONTEXT).select("id", F.round(F.expr(blocking.weighted()).cast("double"), 6).alias("spam_score"))
    return s.where(F.col("spam_score") > blocking.WEIGHTED_GATE)


_COMPOUND = ("free|trash|http", 200, 2, 2)


@query(f"""WITH {MESSAGES}, u AS (SELECT user_id, min(ts) AS since, count(*) FILTER (event_type = 'click')::BIGINT AS contacts, count(DISTINCT event_type)::BIGINT AS threads FROM events GROUP BY user_id),
x AS (SELECT m.id, m.text, date_diff('day', u.since::DATE, m.timestamp::DATE)::BIGINT AS account_age_days, u.contacts AS external_contact_count, u.threads AS distinct_threads_24h FROM messages m LEFT JOIN u ON u.user_id = m.sender)
SELECT id, account_age_days, external_contact_count FROM x WHERE {blocking.compound(*_COMPOUND, _duck)}""")
def compound_predicate(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("since"), F.count_if(F.col("event_type") == "click").alias("external_contact_count"), F.count_distinct("event_type").alias("distinct_threads_24h"))
    rows = messages(spark, sf_dir).join(users, F.col("sender") == F.col("user_id"), "left")
    rows = rows.withColumn("account_age_days", F.date_diff(F.to_date("timestamp"), F.to_date("since")).cast("long"))
    return rows.where(blocking.compound(*_COMPOUND)).select("id", "account_age_days", "external_contact_count")


@query(f"WITH {MESSAGES} (SELECT 'latest' AS lookup, id, external_id FROM messages ORDER BY id DESC LIMIT 1) UNION ALL SELECT 'id', id, external_id FROM messages WHERE id = 7 UNION ALL SELECT 'external_id', id, external_id FROM messages WHERE external_id = 'doc_9'")
def point_lookups(spark, sf_dir):
    m = messages(spark, sf_dir)
    found = [("latest", latest(m)), ("id", by_id(m, 7)), ("external_id", by_external_id(m, "doc_9"))]
    one, *more = [rows.select(F.lit(name).alias("lookup"), "id", "external_id") for name, rows in found]
    for rows in more:
        one = one.unionByName(rows)
    return one


@query("SELECT user_id, date_diff('second', min(ts), max(ts))::BIGINT AS seconds FROM events GROUP BY user_id")
def processing_seconds(spark, sf_dir):
    """Seconds between a user's first and last event, as between a report's start and end."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", F.expr("timestampdiff(SECOND, date_trunc('second', a), date_trunc('second', b))").cast("long").alias("seconds"))


_SAMPLE = "(SELECT id, text, is_spam, row_number() OVER (PARTITION BY is_spam ORDER BY id) AS k FROM messages WHERE is_spam IS NOT NULL)"


@query(f"""WITH {RULE_CTES}, s AS (SELECT * FROM {_SAMPLE} WHERE (is_spam AND k <= 20) OR (NOT is_spam AND k <= 50)),
c AS (SELECT r.rule_id, count(*) FILTER (s.is_spam AND contains(lower(s.text), r.needle))::BIGINT AS spam_matches, count(*) FILTER (NOT s.is_spam AND contains(lower(s.text), r.needle))::BIGINT AS ham_matches, count(*) FILTER (NOT s.is_spam) AS ham FROM r, s GROUP BY r.rule_id)
SELECT rule_id, spam_matches, ham_matches, spam_matches + ham_matches > 0 AND spam_matches::DOUBLE / nullif(spam_matches + ham_matches, 0) >= 0.85 AND (ham = 0 OR ham_matches::DOUBLE / ham <= 0.05) AS accepted FROM c""")
def semantic_acceptance(spark, sf_dir):
    return rl.accepted_on_sample(messages(spark, sf_dir), RULES).select("rule_id", "spam_matches", "ham_matches", "accepted")


@query(f"WITH {RULE_CTES} SELECT rule_id, id FROM (SELECT rule_id, id, row_number() OVER (PARTITION BY rule_id ORDER BY id) AS k FROM h) WHERE k <= 10")
def rule_sample_runs(spark, sf_dir):
    """Ten matches of each rule, as a test run shows them."""
    return rl.sample_run(messages(spark, sf_dir), RULES, 10).select("rule_id", "id")


@query(f"""WITH {RULE_CTES}, c AS (SELECT rule_id, count(*) FILTER (is_spam) AS spam, count(*) FILTER (NOT is_spam) AS ham FROM h GROUP BY rule_id),
p AS (SELECT rule_id, spam, ham, CASE WHEN spam + ham > 0 THEN spam::DOUBLE / (spam + ham) ELSE 0 END AS precision, ham::DOUBLE / nullif((SELECT count(*) FROM messages WHERE NOT is_spam), 0) AS rate FROM c),
t AS (SELECT rule_id, CASE WHEN precision >= 0.98 AND spam >= 50 AND rate <= 0.01 THEN 'safe_auto' WHEN (precision >= 0.90 AND precision < 0.98 AND spam >= 20) OR (precision >= 0.95 AND rate <= 0.05) THEN 'review_only' WHEN precision < 0.90 OR rate > 0.05 THEN 'feature_only' ELSE 'review_only' END AS tier FROM p)
SELECT rule_id, tier, CASE tier WHEN 'safe_auto' THEN 'Conservative,Balanced,Aggressive' WHEN 'review_only' THEN 'Balanced,Aggressive' WHEN 'feature_only' THEN 'Aggressive' ELSE '' END AS profiles FROM t""")
def profile_impact(spark, sf_dir):
    m = messages(spark, sf_dir)
    e = rl.evaluate(m, RULES).where("hits_total > 0")
    p = F.coalesce(F.try_divide(F.col("spam_hits").cast("double"), F.col("spam_hits") + F.col("ham_hits")), F.lit(0.0))
    tier = quality.tier(p, F.col("spam_hits"), F.col("ham_hits"), F.lit(m.where("not is_spam").count()))
    return e.select("rule_id", tier.alias("tier")).withColumn("profiles", F.array_join(quality.profiles_of(F.col("tier")), ","))


@query(f"""WITH {MESSAGES}, s AS (SELECT id, substr(text, 1, 200) AS example, md5({SIGNATURE_SQL}) AS signature FROM messages WHERE is_spam)
SELECT signature, count(*) AS cnt, 'Cluster of ' || count(*) || ' messages' AS description, md5(array_to_string((list(example ORDER BY id))[1:5], '|')) AS examples FROM s GROUP BY signature HAVING count(*) >= 2""")
def cluster_examples(spark, sf_dir):
    """Clusters of at least two spam messages, described, with five examples of 200 characters."""
    c = signals.signature_clusters(messages(spark, sf_dir).where("is_spam"), 2)
    return c.select("signature", "cnt", F.format_string("Cluster of %d messages", "cnt").alias("description"), F.md5(F.array_join("examples", "|").cast("binary")).alias("examples"))


_PHONES = "text || CASE id % 4 WHEN 0 THEN ' call 555-123-40' || lpad((id % 30)::VARCHAR, 2, '0') WHEN 1 THEN ' +44 20' || (id % 10)::VARCHAR || ' or +1-555 and +7 900' ELSE '' END"


@query(f"WITH {MESSAGES}, p AS (SELECT unnest((regexp_extract_all({_PHONES}, '{tx.PHONE}'))[1:2]) AS key FROM messages WHERE is_spam) SELECT key, count(*) AS cnt FROM p GROUP BY key ORDER BY cnt DESC, key LIMIT 20")
def phone_counts_topk(spark, sf_dir):
    """The twenty most frequent phones, of the first two of each spam message; the messages get phones here."""
    rows = messages(spark, sf_dir).where("is_spam").withColumn("text", F.expr(_PHONES.replace("::VARCHAR", "::STRING")))
    return signals.top(signals.phone_counts(rows), 20).select("key", "cnt")


@query(f"WITH {MESSAGES}, p AS (SELECT id, {_PHONES} AS text FROM messages) SELECT id, len(regexp_extract_all(text, '{tx.PHONE}')) AS n, array_to_string(regexp_extract_all(text, '{tx.PHONE}'), '|') AS phones FROM p")
def phone_lists(spark, sf_dir):
    """Every phone of every message; the messages get phones here."""
    rows = messages(spark, sf_dir).withColumn("text", F.expr(_PHONES.replace("::VARCHAR", "::STRING")))
    found = tx.phones(F.col("text"))
    return rows.select("id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("phones"))
