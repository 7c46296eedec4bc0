"""Decisions over tables of rules: safety, risk, quality of the text, and compiled rules of every type."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.operators import advice, exports, quality, signals
from quillmesh.operators import evaluation as ev
from quillmesh.operators import rules as rl
from quillmesh.plans.base import MESSAGES, RULE_CTES, RULES, messages, query, table
from quillmesh.plans.mining_queries import BUCKETS
from quillmesh.plans.text_queries import SIGNATURE_SQL
from quillmesh.session import shared_dir
from quillmesh.sources.messages import training_set

# Rules of the messages' own words: of the 300 most widespread, each alone, with a second one, or as one of five alternatives.
_MINED = """k AS (SELECT key, row_number() OVER (ORDER BY count(*) DESC, key) - 1 AS i FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS key FROM messages) GROUP BY key QUALIFY i < 300),
w AS (SELECT list(key ORDER BY i) AS w, count(*) AS n FROM k),
p AS (SELECT i AS rule_id, CASE i % 3 WHEN 0 THEN [key] WHEN 1 THEN [key, w[i * 7 % n + 1]] ELSE [key, w[(i + 1) % n + 1], w[(i + 2) % n + 1], w[(i + 3) % n + 1]] END AS needles FROM k, w),
rules AS (SELECT rule_id, needles, 'SELECT id, is_spam FROM messages WHERE ' || CASE rule_id % 3 WHEN 1 THEN array_to_string(list_transform(needles, lambda x: 'lower(text) LIKE ''%' || x || '%'''), ' AND ') ELSE array_to_string(list_transform(needles, lambda x: 'lower(text) LIKE ''%' || x || '%'''), ' OR ') END AS sql_expression FROM p),
h AS (SELECT rule_id, count(*)::BIGINT AS hits_total, count(*) FILTER (is_spam)::BIGINT AS spam_hits, count(*) FILTER (NOT is_spam)::BIGINT AS ham_hits
  FROM rules JOIN (SELECT id, is_spam, lower(text) AS l FROM messages) m ON CASE WHEN rule_id % 3 = 1 THEN contains(l, needles[1]) AND contains(l, needles[2]) ELSE len(list_filter(needles, lambda x: contains(l, x))) > 0 END GROUP BY rule_id),
r AS (SELECT rules.*, coalesce(hits_total, 0) AS hits_total, coalesce(ham_hits, 0) AS ham_hits, spam_hits::DOUBLE / hits_total AS precision FROM rules LEFT JOIN h USING (rule_id))"""


def _mined(spark, sf_dir):
    """The rules as a table with their evaluations on all messages."""
    m = messages(spark, sf_dir)
    words = m.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("key"))
    w = [r.key for r in words.groupBy("key").count().orderBy(F.desc("count"), "key").limit(300).collect()]
    made = []
    for i, key in enumerate(w):
        needles = [[key], [key, w[i * 7 % len(w)]], [key, *(w[(i + k) % len(w)] for k in (1, 2, 3))]][i % 3]
        made.append((rl.Rule.literal(i, *([x] for x in needles)) if i % 3 == 1 else rl.Rule.literal(i, needles), "SELECT id, is_spam FROM messages WHERE " + (" AND " if i % 3 == 1 else " OR ").join(f"lower(text) LIKE '%{x}%'" for x in needles)))
    table = spark.createDataFrame([(r.rule_id, sql) for r, sql in made], "rule_id long, sql_expression string")
    return table.join(rl.evaluate(m, [r for r, _ in made]).select("rule_id", "precision", "hits_total", "ham_hits"), "rule_id")


_SAFE = ", ".join("'" + x.replace("'", "''") + "'" for x in quality.SAFE_LITERALS)
_STOP = ", ".join(f"'{x}'" for x in quality.STOP_WORDS)


@query(f"""WITH {MESSAGES}, {_MINED}, f AS (SELECT *, len(needles) AS n, rule_id % 3 = 1 AS joined, len(needles) - 1 AS ors, len(list_filter(needles, lambda x: len(list_filter([{_SAFE}], lambda s: contains(x, s))) = 0)) = 0 AS known FROM r),
d AS (SELECT *, CASE WHEN len(list_filter(needles, lambda x: length(x) < 3)) > 0 THEN 'short words' WHEN len(list_filter(needles, lambda x: x IN ({_STOP}))) > 0 THEN 'common words' WHEN n = 1 AND NOT known AND length(needles[1]) < 10 THEN 'one common word'
  WHEN NOT joined AND ors >= 3 THEN 'alternatives' WHEN n = 1 AND NOT known THEN 'one test' WHEN precision >= 0.95 AND hits_total >= 10 AND ham_hits / hits_total <= 0.01 THEN 'shadow runs' WHEN precision >= 0.95 AND hits_total >= 10 THEN 'false positives' WHEN known AND (joined OR n = 1) THEN 'known words' ELSE 'no review' END AS why FROM f),
e AS (SELECT *, CASE WHEN why IN ('short words', 'common words', 'one common word') THEN 'dangerous' WHEN why IN ('shadow runs', 'known words') THEN 'auto_safe' ELSE 'requires_review' END AS kind FROM d)
SELECT rule_id, kind, why, CASE kind WHEN 'auto_safe' THEN 'low' WHEN 'dangerous' THEN 'high' ELSE 'medium' END AS risk, kind = 'dangerous' OR why IN ('one test', 'alternatives') AS insight_only, 0 AS warnings FROM e""")
def rule_decisions(spark, sf_dir):
    """Safety, risk and worth of 300 mined rules with their evaluations, as columns."""
    return advice.decisions(_mined(spark, sf_dir)).select("rule_id", "kind", "why", "risk", "insight_only", "warnings")


@query(f"""WITH {MESSAGES}, {_MINED}, s AS (SELECT rule_id, needles, rule_id % 3 = 1 AS joined, len(needles) = 1 AND needles[1] IN ({", ".join(f"'{x}'" for x in quality.COMMON_ALONE)}) AS alone, len(list_filter(needles, lambda x: length(x) < 3)) > 0 AS short FROM r)
SELECT rule_id, CASE WHEN alone THEN 'low' ELSE 'medium' END AS adequacy, CASE WHEN joined THEN 'high' ELSE 'medium' END AS quality, CASE WHEN alone OR short THEN 'high' ELSE 'low' END AS fp_risk,
  concat_ws(', ', CASE WHEN alone THEN 'one common word' END, CASE WHEN short THEN 'short needle' END) AS issues FROM s""")
def rule_text_quality(spark, sf_dir):
    out = quality.static_quality(_mined(spark, sf_dir))
    return out.select("rule_id", "adequacy", "quality", "fp_risk", F.array_join("issues", ", ").alias("issues"))


_TYPES = {1: ("url", ("http://", "example.net")), 2: ("group_invite", ("the", "with")), 3: ("job_offer", ("that", "for")), 4: ("phone", ()), 5: ("excessive_caps", ()), 6: ("repeated_symbols", ()), 7: ("messenger_link", ()), 8: ("multiple_urls", ()), 9: ("keyword", ("trash", "worthless"))}


def _duck(i: int) -> str:
    name, needles = _TYPES[i]
    any_of = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in dict.fromkeys(words)) + ")"
    if name in ("group_invite", "job_offer"):
        return f"{any_of(needles)} AND {any_of([*rl.tx.COMMERCIAL_CONTEXT, *rl.EXTRA_CONTEXT[name]])}"
    return {
        "phone": r"regexp_matches(text, '\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b|\+\d{1,3}[-.\s]?\d{1,4}')", "messenger_link": r"regexp_matches(text, '(?i)(https?://)?(t\.me|messenger\.me)/[^\s]+')",
        "multiple_urls": r"regexp_matches(text, '(?i)(https?://|www\.|t\.me|bit\.ly).*(https?://|www\.|t\.me|bit\.ly)')", "excessive_caps": f"regexp_matches(text, '[A-ZА-ЯЁ]{{10,}}') AND {any_of(rl.tx.COMMERCIAL_CONTEXT)}",
        "repeated_symbols": " OR ".join(f"contains(text, '{c * 5}')" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!?-_*=# ,"),
    }.get(name) or any_of(needles)


@query(f"WITH {MESSAGES}, h AS ({' UNION ALL '.join(f'SELECT {i}::BIGINT AS rule_id, id, is_spam FROM messages WHERE {_duck(i)}' for i in _TYPES)}) SELECT rule_id, count(*) AS hits, count(*) FILTER (is_spam) AS spam_hits FROM h GROUP BY rule_id")
def compiled_rules(spark, sf_dir):
    """A rule of each mined type, compiled and replayed over all messages."""
    made = [rl.compile_rule(i, name, needles) for i, (name, needles) in _TYPES.items()]
    return rl.hits(messages(spark, sf_dir), made).groupBy("rule_id").agg(F.count("*").alias("hits"), F.count_if("is_spam").alias("spam_hits"))


# ---- profiles and samples ---------------------------------------------------------------------------------------------


@query(f"WITH {RULE_CTES}, missed AS (SELECT * FROM messages WHERE is_spam AND id NOT IN (SELECT id FROM h)), {BUCKETS.replace('@rows', 'missed')} SELECT key, count(*) AS cnt FROM k WHERE key IS NOT NULL GROUP BY key")
def missed_spam_buckets(spark, sf_dir):
    """What the spam that no rule finds is like."""
    m = messages(spark, sf_dir)
    return signals.missed_buckets(m, rl.hits(m, RULES)).select("key", "cnt")


@query(f"WITH {RULE_CTES}, e AS (SELECT rule_id, (list(id ORDER BY id))[1:10] AS ids FROM h GROUP BY rule_id) SELECT rule_id, len(ids)::BIGINT AS n, array_to_string(ids, ' ') AS ids FROM e")
def pattern_example_ids(spark, sf_dir):
    """The first ten messages of each rule."""
    firsts = signals.examples_of(rl.hits(messages(spark, sf_dir), RULES), "rule_id", "id", 10)
    ids = F.array_sort(F.collect_list("id"))
    return firsts.groupBy("rule_id").agg(F.count("*").alias("n"), F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query(f"""WITH {MESSAGES}, r AS (SELECT id, is_spam, row_number() OVER (PARTITION BY is_spam ORDER BY md5(id::VARCHAR), id) AS place FROM messages WHERE is_spam IS NOT NULL)
SELECT id, is_spam FROM r WHERE place <= CASE WHEN is_spam THEN 12 ELSE 28 END""")
def scenario_sample(spark, sf_dir):
    """Forty messages, three tenths of them spam."""
    return ev.scenario(messages(spark, sf_dir).select("id", "is_spam"), 40, 0.3).select("id", "is_spam")


@query(rf"WITH {MESSAGES}, w AS (SELECT unnest(regexp_extract_all({SIGNATURE_SQL}, '\S+')) AS key FROM messages) SELECT key, count(*) AS cnt FROM w WHERE {' OR '.join(f"contains(key, '{x}')" for x in tx.SIGNATURE_WORDS)} GROUP BY key")
def signature_key_words(spark, sf_dir):
    words = messages(spark, sf_dir).select(F.explode(tx.key_words(F.col("text"))).alias("key"))
    return words.groupBy("key").agg(F.count("*").alias("cnt"))


@query(f"WITH {MESSAGES}, {_MINED} SELECT rule_id, array_to_string(needles, ' ') AS literals, 'Matches messages that contain ' || array_to_string(needles, ' or ') AS said FROM rules")
def rule_literals(spark, sf_dir):
    """The literals that the rules' texts look for, and the rules in words."""
    rules = _mined(spark, sf_dir)
    return rules.select("rule_id", F.array_join(tx.like_literals(F.col("sql_expression")), " ").alias("literals"), advice.explanation(F.col("sql_expression")).alias("said"))


@query("SELECT source AS namespace, trim(text) AS text, toxic::VARCHAR AS label FROM documents JOIN labels USING (doc_id) WHERE trim(text) <> '' AND toxic IS NOT NULL AND source = (SELECT min(source) FROM documents)")
def training_export(spark, sf_dir):
    """Training examples of all documents exported by source, and the first source's read back from its folder alone."""
    d = table(spark, sf_dir, "documents")
    rows = training_set(d.join(table(spark, sf_dir, "labels"), "doc_id"), F.col("source"), label_column="toxic")
    folder = f"{shared_dir(spark)}/training-{uuid.uuid4().hex[:12]}"
    exports.write_training(rows, folder)
    return exports.read_training(spark, folder, d.agg(F.min("source")).first()[0])
