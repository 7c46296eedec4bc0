"""What the registered queries share: message and rule tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import rules as rl
from quillmesh.sources.messages import messages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MESSAGES = """
messages AS (
  SELECT d.doc_id AS id, 'doc_' || d.doc_id AS external_id, e.ts AS timestamp,
         CASE WHEN p.url IS NULL THEN d.text ELSE d.text || ' ' || p.url END AS text, d.lang AS language, d.source AS source, e.user_id AS sender,
         CASE WHEN l.toxic = 1 THEN TRUE WHEN l.toxic = 0 THEN FALSE END AS is_spam,
         CASE WHEN e.event_type = 'error' THEN 'blocked' ELSE 'allowed' END AS tas_action,
         e.event_type = 'purchase' AS user_complaint, e.event_type = 'signup' AS unbanned
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id)"""

NEEDLES = {1: "trash", 2: "worthless", 3: "free", 4: "http://", 5: "example.net"}
RULES = [rl.Rule(k, rl.contains(v)) for k, v in NEEDLES.items()]
RULES_SQL = "r(rule_id, needle) AS (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in NEEDLES.items()) + ")"
HITS_SQL = "h AS (SELECT r.rule_id, m.id, m.is_spam, m.timestamp FROM messages m JOIN r ON contains(lower(m.text), r.needle))"
RULE_CTES = f"{MESSAGES}, {RULES_SQL}, {HITS_SQL}"

#: rule_id, pattern_id, status, origin, day of creation.
RULE_ROWS = [(1, 10, "shadow", "pattern_mining", "2024-01-01"), (2, 10, "active", "pattern_mining", "2024-01-02"), (3, 11, "shadow", "manual", "2024-01-03"), (4, 12, "active", "llm", "2024-01-01"), (5, None, "candidate", "semantic_mining", "2024-01-04"), (6, 11, "deprecated", "manual", "2024-01-05"), (7, 12, "shadow", "manual", "2024-01-02")]
PATTERN_ROWS = [(10, "keyword", "Job offer words", 120), (11, "keyword", "Money and price words", 40), (12, "url", "URL pattern", 0), (13, "phone", "Phone numbers", 40), (14, "signature", "Repeated caps", 7), (15, "url", "URL pattern", 12)]
RULE_TABLE = "rules(rule_id, pattern_id, status, origin, created_at, sql_expression) AS (VALUES " + ", ".join(f"({a}::BIGINT, {'NULL' if b is None else b}::BIGINT, '{c}', '{d}', DATE '{e}', 'SELECT id, is_spam FROM messages WHERE lower(text) LIKE ''%{NEEDLES.get(a, 'free')}%''')" for a, b, c, d, e in RULE_ROWS) + ")"
PATTERN_TABLE = "patterns(pattern_id, pattern_type, description, matches) AS (VALUES " + ", ".join(f"({a}::BIGINT, '{b}', '{c}', {d}::BIGINT)" for a, b, c, d in PATTERN_ROWS) + ")"
EVALUATIONS = """
day_totals AS (SELECT date_trunc('day', timestamp)::TIMESTAMP AS created_at, count(*) AS n, count(*) FILTER (is_spam) AS spam FROM messages WHERE timestamp IS NOT NULL GROUP BY 1),
evaluations AS (
  SELECT h.rule_id, d.created_at, count(*)::BIGINT AS hits_total, count(*) FILTER (h.is_spam)::BIGINT AS spam_hits, count(*) FILTER (NOT h.is_spam)::BIGINT AS ham_hits,
         count(*) FILTER (h.is_spam)::DOUBLE / count(*) AS precision, CASE WHEN any_value(d.spam) = 0 THEN NULL ELSE count(*) FILTER (h.is_spam)::DOUBLE / any_value(d.spam) END AS recall, count(*)::DOUBLE / any_value(d.n) AS coverage
  FROM h JOIN day_totals d ON date_trunc('day', h.timestamp) = d.created_at GROUP BY 1, 2)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(a, b, c, d, e, f"SELECT id, is_spam FROM messages WHERE lower(text) LIKE '%{NEEDLES.get(a, 'free')}%'") for a, b, c, d, e in RULE_ROWS]
    df = spark.createDataFrame(rows, "rule_id long, pattern_id long, status string, origin string, created_at string, sql_expression string")
    return df.withColumn("created_at", F.to_date("created_at"))


def pattern_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERN_ROWS, "pattern_id long, pattern_type string, description string, matches long")


def evaluations(rows: DataFrame) -> DataFrame:
    """Evaluations of RULES for each day of messages."""
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("created_at")
    kept = rows.where("timestamp is not null")
    found = F.filter(F.array(*[F.when(r.column(), F.lit(r.rule_id).cast("long")) for r in RULES]), lambda x: x.isNotNull())
    kept = kept.select("is_spam", day, found.alias("rules"))
    totals = kept.groupBy("created_at").agg(F.count("*").alias("n"), F.count_if("is_spam").alias("spam"))
    c = kept.select("created_at", "is_spam", F.explode("rules").alias("rule_id")).groupBy("rule_id", "created_at").agg(F.count("*").alias("hits_total"), F.count_if("is_spam").alias("spam_hits"), F.count_if(~F.col("is_spam")).alias("ham_hits"))
    c = c.join(totals, "created_at")
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return c.select("rule_id", "created_at", "hits_total", "spam_hits", "ham_hits", ratio("spam_hits", "hits_total").alias("precision"), ratio("spam_hits", "spam").alias("recall"), ratio("hits_total", "n").alias("coverage"))


def as_of(rows: DataFrame, column: str = "timestamp"):
    """The latest time of the data: no query reads the clock."""
    return rows.agg(F.max(column)).first()[0]


def r6(name: str):
    return F.round(name, 6).alias(name)


__all__ = ["EVALUATIONS", "HITS_SQL", "MESSAGES", "NEEDLES", "ORACLES", "PATTERN_TABLE", "QUERIES", "RULES", "RULE_CTES", "RULE_TABLE", "as_of", "evaluations", "messages", "pattern_table", "query", "r6", "rule_table", "table"]
