"""Rules and patterns in the formats that other systems take."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_literal(sql: Column) -> Column:
    """Whether a rule's SQL looks for anything: a quoted literal of more than wildcards."""
    return F.exists(F.regexp_extract_all(sql, F.lit("'([^']*)'"), F.lit(1)), lambda x: F.translate(x, "%_ ", "") != "")


def sql_script(rules: DataFrame) -> DataFrame:
    """One row a rule, in order: its statement with a comment; rules with no literal part are commented out."""
    own = F.concat(F.col("sql_expression"), F.lit(";"))
    body = F.when(has_literal(F.col("sql_expression")), own).otherwise(F.concat(F.lit("-- "), F.replace(own, F.lit("\n"), F.lit("\n-- "))))
    text = F.concat(F.lit("-- Rule "), F.col("rule_id").cast("string"), F.lit(" ("), F.col("status"), F.lit(")\n"), body)
    return rules.select("rule_id", text.alias("statement"))


def ruleset(rules: DataFrame) -> DataFrame:
    """A row a rule as a JSON ruleset entry, weighted by its precision (0.5 where unknown)."""
    entry = F.struct(F.concat(F.lit("rule_"), F.col("rule_id").cast("string")).alias("id"), F.col("sql_expression").alias("condition"), F.coalesce("precision", F.lit(0.5)).alias("weight"), F.when(F.col("status") == "active", "block").otherwise("flag").alias("action"))
    return rules.select("rule_id", F.to_json(entry).alias("entry"))


def platform_rules(rules: DataFrame) -> DataFrame:
    """Active rules alone, as JSON for a platform."""
    return rules.where("status = 'active'").select("rule_id", F.to_json(F.struct("rule_id", F.col("sql_expression").alias("expression"), "precision", "coverage")).alias("entry"))


def training_rows(patterns: DataFrame, rules: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Pattern, rule and last evaluation as prompt and answer rows for fine-tuning."""
    from quillmesh.operators import rules as rl

    joined = rl.first_rule(patterns, rules.select("rule_id", "pattern_id", "sql_expression", "created_at")).join(rl.latest(evaluations).drop("created_at"), "rule_id", "left")
    prompt = F.concat_ws(": ", F.lit("Write a filter rule for this pattern"), F.col("description"))
    return joined.select("pattern_id", "rule_id", prompt.alias("prompt"), F.col("sql_expression").alias("answer"), "precision", "recall")


def write_training(rows: DataFrame, folder: str) -> None:
    """Accepted training examples (namespace, text, label, accepted; see sources.messages.training_set) as JSON lines, a folder
    for each namespace."""
    rows.where("accepted").select("namespace", "text", "label").write.partitionBy("namespace").json(folder)


def read_training(spark: SparkSession, folder: str, namespace: str | None = None) -> DataFrame:
    """(namespace, text, label) of an export, of one namespace if given: only its folder is read."""
    out = spark.read.schema("text string, label string, namespace string").json(folder)
    return out if namespace is None else out.where(F.col("namespace") == namespace)


def write_package(rules: DataFrame, folder: str) -> None:
    """A deployment package as text files by Spark: statements of safe rules, statements of those that look for nothing apart
    and commented out, entries as JSON lines, statements that take the rules back, and one line of metadata (rules by status).
    """
    put = lambda rows, name: rows.write.mode("overwrite").text(f"{folder}/{name}")
    safe = has_literal(F.col("sql_expression"))
    for name, own in (("rules_sql", rules.where(safe)), ("unsafe_sql", rules.where(~F.coalesce(safe, F.lit(False))))):
        put(sql_script(own).orderBy("rule_id").select(F.col("statement").alias("value")), name)
    put(ruleset(rules).select("entry"), "ruleset")
    put(rules.select(F.format_string("UPDATE rules SET status = 'deprecated' WHERE rule_id = %d;", "rule_id").alias("value")), "rollback")
    counts = rules.groupBy("status").agg(F.count("*").alias("n"))
    by_status = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    put(counts.agg(F.to_json(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("rules"), by_status.alias("by_status"))).alias("value")), "metadata")


def report(counts: dict) -> str:
    """A short Markdown report of a run's counts."""
    lines = ["# Pattern report", ""] + [f"- **{k.replace('_', ' ')}**: {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in counts.items()]
    return "\n".join(lines) + "\n"


def audit_write(entries: DataFrame, folder: str) -> None:
    """Appends audit entries (ts, action, ...) as JSON lines in a folder a day, so that retention drops whole folders."""
    entries.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(folder)


def audit_read(spark, folder: str, schema: str, since=None, action: str | None = None) -> DataFrame:
    """Audit entries from a time on and of an action; the day folders are pruned by the scan."""
    out = spark.read.schema(f"{schema}, day date").json(folder)
    if since is not None:
        out = out.where((F.col("day") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since)))
    return (out if action is None else out.where(F.col("action") == action)).drop("day")


def audit_keep(spark, folder: str, schema: str, into: str, since) -> None:
    """Retention: the entries from a time on, written as a new audit folder."""
    audit_write(audit_read(spark, folder, schema, since), into)


def discovery_rows(patterns: DataFrame, rules: DataFrame, hits: DataFrame, messages: DataFrame, most: int = 50, width: int = 500) -> DataFrame:
    """Patterns with the first messages that their rules match, for training: (pattern_id, pattern_type, description, messages).

    hits: (rule_id, id). `most` messages a pattern are kept by a rank window, so no pattern's matches are gathered."""
    from pyspark.sql import Window

    found = hits.join(rules.select("rule_id", "pattern_id"), "rule_id").select("pattern_id", "id").distinct()
    place = F.row_number().over(Window.partitionBy("pattern_id").orderBy("id"))
    few = found.withColumn("place", place).where(F.col("place") <= most)
    shown = few.join(messages.select("id", F.substring("text", 1, width).alias("text"), "external_id", "timestamp"), "id")
    one = F.struct("place", "external_id", "text", "timestamp")
    return patterns.select("pattern_id", "pattern_type", "description").join(shown.groupBy("pattern_id").agg(F.array_sort(F.collect_list(one)).alias("messages")), "pattern_id")


def explanation_rows(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with an explanation, their pattern's description or the start of their SQL: (rule_id, sql_rule, explanation)."""
    joined = rules.join(patterns.select("pattern_id", "pattern_type", "description"), "pattern_id", "left")
    own = F.format_string("Rule %d: %s...", F.col("rule_id"), F.substring("sql_expression", 1, 100))
    return joined.select("rule_id", "pattern_id", F.col("sql_expression").alias("sql_rule"), F.col("description").alias("pattern_description"), F.coalesce("description", own).alias("explanation"))


def pending(suggestions: DataFrame) -> DataFrame:
    """Suggestions (batch_at, kind, at, validated, ...) that nobody has validated, numbered by kind in the order they came."""
    from pyspark.sql import Window

    open_ = suggestions.where(~F.coalesce("validated", F.lit(False)))
    return open_.withColumn("number", F.row_number().over(Window.partitionBy("kind").orderBy("batch_at", "at")) - 1)


def validate_suggestion(suggestions: DataFrame, kind: str, number: int, validator: str, at, implemented: bool = False) -> DataFrame:
    """suggestions with the pending one of this kind and number marked; unchanged if there is none."""
    one = pending(suggestions).where((F.col("kind") == kind) & (F.col("number") == number)).select("kind", "batch_at", "at", F.lit(True).alias("_hit"))
    out = suggestions.join(one, ["kind", "batch_at", "at"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    marks = {"validated": F.lit(True), "validated_by": F.lit(validator), "validated_at": F.lit(at), "implemented": F.lit(implemented)}
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c) if c in suggestions.columns else F.lit(None)) for c, v in marks.items()}).drop("_hit")
