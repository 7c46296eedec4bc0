"""The engine as its users call it: ingest, mine, evaluate, promote, export, analyze, classify."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import packs
from quillmesh.operators import advice, exports, lifecycle, quality, signals
from quillmesh.operators import rules as rl
from quillmesh.sources import messages as src


@dataclass
class Engine:
    """messages: the stored table (id, external_id, timestamp, text, is_spam, ...). Rules are a small table on the driver."""

    messages: DataFrame
    rules: list[rl.Rule] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch that are new; append them to the stored table."""
        return src.new_rows(batch, self.messages)

    def classify(self, rows: DataFrame) -> DataFrame:
        return packs.classify(rows)

    def mine(self, as_of, days: int = 7, min_spam: int = 10, since_id: int | None = None, most_urls: int = 10, most_tags: int = 15) -> list[rl.Rule]:
        """New candidate rules of what repeats in recent spam: URLs and commercial tags, and repeated signatures as patterns.

        Messages stay in Spark: only the best few signals, by bounded top-k, come to the driver, where rules are compiled.
        """
        recent = self.messages.where(F.col("timestamp") >= F.lit(as_of) - F.make_interval(days=F.lit(days)))
        if since_id is not None:
            recent = recent.where(F.col("id") > since_id)
        spam = recent.where("is_spam")
        total = spam.count()
        if total < min_spam:
            return []
        counts = signals.signals(spam).persist()
        urls = signals.url_candidates(counts.where("signal_type = 'url'").select("key", "cnt"), most=most_urls).collect()
        tags = signals.top(counts.where("signal_type = 'tag'").select("key", "cnt"), most_tags).collect()
        clusters = signals.top(signals.signature_clusters(spam).withColumnRenamed("signature", "key"), 10).collect()
        counts.unpersist()
        found: list[rl.Rule] = []
        patterns = {c.name: c.pattern for c in packs.COMMERCIAL}
        for kind, rows in (("url", urls), ("keyword", tags), ("signature", clusters)):
            for r in rows:
                pattern_id = len(self.patterns) + 1
                self.patterns.append({"pattern_id": pattern_id, "pattern_type": kind, "description": f"{'URL pattern' if kind == 'url' else 'Keyword' if kind == 'keyword' else 'Signature cluster'}: {r.key} found in {r.cnt} spam messages"})
                words = [r.key] if kind == "url" else advice.regex_keywords(patterns.get(r.key, ""))
                if kind != "signature" and (words or r.key in rl.REGEX_RULES):
                    rule = rl.compile_rule(len(self.rules) + len(found) + 1, "url" if kind == "url" else r.key, words, pattern_id=pattern_id)
                    if not advice.insight_only("", rule.sql):
                        found.append(rule)
        self.rules += found
        return found

    def evaluate(self, status: str | None = None) -> DataFrame:
        return rl.evaluate(self.messages, [r for r in self.rules if status in (None, r.status)])

    def promote(self, profile: str = "balanced") -> DataFrame:
        """The rules' table with shadow rules that meet the profile made active."""
        spark = self.messages.sparkSession
        table = spark.createDataFrame([(r.rule_id, r.sql, r.status) for r in self.rules], "rule_id long, sql_expression string, status string")
        return lifecycle.promote(table, self.evaluate("shadow").withColumn("created_at", F.lit(1)), quality.PROFILES[profile], None)

    def export(self, folder: str, evaluations: DataFrame) -> None:
        spark = self.messages.sparkSession
        table = spark.createDataFrame([(r.rule_id, r.sql, r.status) for r in self.rules], "rule_id long, sql_expression string, status string")
        exports.write_package(table.join(evaluations.select("rule_id", "precision", "coverage"), "rule_id", "left"), folder)

    def analyze(self, batch: DataFrame, as_of, **how) -> dict:
        """A batch mined and its rules evaluated on it; returns rules with their metrics, and the report."""
        own = Engine(batch)
        rules = own.mine(as_of, **how)
        metrics = [r.asDict() for r in own.evaluate().collect()] if rules else []  # a row a rule
        return {"patterns": own.patterns, "rules": [{"rule_id": r.rule_id, "sql": r.sql, "risk": advice.risk(r.sql)} for r in rules], "metrics": metrics, "report": exports.report({"patterns": len(own.patterns), "rules": len(rules)})}
