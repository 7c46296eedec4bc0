"""Rule lifecycle: each change is a new snapshot of the rules table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import quality
from quillmesh.operators import rules as rl

#: Allowed changes; a rule may be deprecated from any state.
NEXT = {"candidate": "shadow", "shadow": "active", "active": "deprecated"}


def transition(rules: DataFrame, changes: DataFrame, at) -> DataFrame:
    """rules with the statuses of changes(rule_id, to_status) where the lifecycle allows them; others stay as they are."""
    joined = rules.join(changes.select("rule_id", "to_status"), "rule_id", "left")
    legal = F.col("to_status") == "deprecated"
    for now, then in NEXT.items():
        legal = legal | ((F.col("status") == now) & (F.col("to_status") == then))
    moved = F.coalesce(legal & (F.col("to_status") != F.col("status")), F.lit(False))
    out = joined.withColumn("changed", moved).withColumn("status", F.when(moved, F.col("to_status")).otherwise(F.col("status")))
    if "updated_at" in rules.columns:
        out = out.withColumn("updated_at", F.when(moved, F.lit(at)).otherwise(F.col("updated_at")))
    return out.drop("to_status")


def promote(rules: DataFrame, evaluations: DataFrame, profile: quality.Profile, at) -> DataFrame:
    """Shadow rules whose last evaluation meets the profile become active."""
    e = rl.latest(evaluations)
    wins = rules.where("status = 'shadow'").select("rule_id").join(e, "rule_id").where(quality.promotable(e, profile)).select("rule_id", F.lit("active").alias("to_status"))
    return transition(rules, wins, at)


def monitor(rules: DataFrame, evaluations: DataFrame, profile: quality.Profile, at) -> DataFrame:
    """Active rules whose last evaluation is degraded are deprecated."""
    e = rl.latest(rl.drift(evaluations).drop("drift", "verdict"))
    lost = rules.where("status = 'active'").select("rule_id").join(e, "rule_id").where(quality.degraded(profile)).select("rule_id", F.lit("deprecated").alias("to_status"))
    return transition(rules, lost, at)


def mined_to_shadow(messages: DataFrame, rules: list[rl.Rule], at) -> DataFrame:
    """New candidates put into shadow and evaluated, with their safety category."""
    spark = messages.sparkSession
    results = {r.rule_id: r.asDict() for r in rl.evaluate(messages, rules).collect()}  # one row a rule
    rows = [(r.rule_id, r.sql, "shadow", *quality.rule_safety(r.sql, results[r.rule_id])) for r in rules]
    return spark.createDataFrame(rows, "rule_id long, sql_expression string, status string, safety string, reason string")


def checkpoint(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state table (stage, last_id, cnt) advanced by what was processed (stage, id)."""
    new = done.groupBy("stage").agg(F.max("id").alias("last_id"), F.count("*").alias("cnt"))
    return state.unionByName(new).groupBy("stage").agg(F.max("last_id").alias("last_id"), F.sum("cnt").alias("cnt"))


def unprocessed(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Resume: the rows (stage, id, ...) past their stage's last processed id; all of a stage without a checkpoint."""
    return rows.join(state.select("stage", "last_id"), "stage", "left").where("last_id is null or id > last_id").drop("last_id")
