"""Judgements on single rules and patterns of the control table, on the driver: warnings, explanations, costs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import quality
from quillmesh.operators import rules as rl

# Words that make a short description general, and those left out of keywords.
GENERAL_WORDS = {"hello", "hi", "price", "group", "contact", "service", "message"}
NOT_KEYWORDS = {
    "text", "regex", "pattern", "match", "group", "word", "char", "the", "and", "or", "not", "like", "where", "select", "from", "lower", "upper", "case",
    "when", "then", "else", "end", "if", "for", "on", "in", "at", "to", "of", "a", "an", "ur", "sd", "ub", "en", "ру", "ен", "pm", "al",
}


def regex_keywords(pattern: str, most: int = 15) -> list[str]:
    """The words of a pattern's alternatives, in order of first appearance, lower-case; no fragments of escapes."""
    bare = re.sub(r"\\[A-Za-z]|\(\?[a-z]*:?|[\^$]", " ", pattern)
    words = (w.lower() for w in re.findall(r"[a-zA-Zа-яА-ЯёЁ\u4e00-\u9fff]{2,}", bare))
    return [w for w in dict.fromkeys(words) if w not in NOT_KEYWORDS][:most]


def insight_only(description: str, sql: str | None = None, risk: int | None = None, confidence: str | None = None) -> bool:
    """Whether a pattern is only worth a look: too risky, too unsure, too general, or a rule that is too broad."""
    said = description.split()
    if (risk or 0) > 75 or confidence == "LOW" or (len(said) <= 3 and any(w.lower() in GENERAL_WORDS for w in said)):
        return True
    return sql is not None and (quality.rule_safety(sql)[0] == "dangerous" or quality.rule_safety(sql)[1].endswith(("a single test", "alternatives without AND")))


def warnings(sql: str) -> list[str]:
    """What may go wrong with a rule: numbers that are contacts, or short messages."""
    out = []
    if re.search(r"(?i)(?:REGEXP|RLIKE|LIKE).*(?:[+\d\s()-]{10,}|\\d\{\d)", sql):
        out.append("looks for numbers, which are people's contacts too")
    short = re.search(r"(?i)(?:CHAR_)?LEN(?:GTH)?\s*\(\s*TEXT\s*\)\s*<\s*(\d+)", sql)
    if short and int(short[1]) < 20:
        out.append(f"takes in messages of fewer than {short[1]} characters whatever they say")
    return out


def risk(sql: str, evaluation: dict | None = None) -> tuple[str, list[str]]:
    """low, medium or high, with the warnings."""
    kind, reason = quality.rule_safety(sql, evaluation)
    found = warnings(sql)
    if kind == "auto_safe":
        return "low", found
    if kind == "dangerous":
        return "high", [f"DANGEROUS: {reason}", *found]
    return ("high" if len(found) >= 2 else "medium"), found


#: What the messages of a pattern have in common, by the mark in its description; {} is the word after the mark.
SHARED = (("url pattern", "one address: {}"), ("keyword", "one group of words: {}"), ("signature cluster", "their wording, apart from numbers and links"))


def similarity_reason(description: Column) -> Column:
    """What the messages of a pattern share, from its description; the description itself where it has no known mark."""
    out = None
    for mark, words in SHARED:
        before, _, after = words.partition("{}")
        said = F.concat(F.lit(before), F.regexp_extract(description, rf"(?i){mark}:?\s*(\S*)", 1), F.lit(after)) if "{}" in words else F.lit(words)
        test = F.contains(F.lower(description), F.lit(mark))
        out = F.when(test, said) if out is None else out.when(test, said)
    return out.otherwise(description)


def decisions(rules: DataFrame) -> DataFrame:
    """rules(rule_id, sql_expression, precision, hits_total, ham_hits) with what is decided on each, as columns: kind
    (dangerous, requires_review, auto_safe), why, warnings (how many), risk (low, medium, high) and insight_only.

    The same decisions as quality.rule_safety, warnings and risk take on one rule, for tables of any size; a rule without
    an evaluation has nulls there, and a null expression is dangerous.
    """
    sql = F.coalesce(F.col("sql_expression"), F.lit(""))
    numbers = F.regexp_like(sql, F.lit(r"(?i)(?:REGEXP|RLIKE|LIKE).*(?:[+\d\s()-]{10,}|\\d\{\d)"))
    length = F.regexp_extract(sql, r"(?i)(?:CHAR_)?LEN(?:GTH)?\s*\(\s*TEXT\s*\)\s*<\s*(\d+)", 1)
    short = F.coalesce(F.try_to_number(length, F.lit("999999999")) < 20, F.lit(False))
    out = quality.with_safety(rules).withColumn("warnings", numbers.cast("int") + short.cast("int"))
    risk = F.when(F.col("kind") == "auto_safe", "low").when((F.col("kind") == "dangerous") | (F.col("warnings") >= 2), "high").otherwise("medium")
    insight = (F.col("kind") == "dangerous") | F.col("why").isin("one test", "alternatives")
    return out.withColumn("risk", risk).withColumn("insight_only", insight)


def explanation(sql: Column) -> Column:
    """A rule in words: the literals it looks for."""
    found = rl.tx.like_literals(sql)
    return F.when(F.size(found) > 0, F.concat(F.lit("Matches messages that contain "), F.array_join(found, " or "))).otherwise("Matches messages by a pattern")


def costs(patterns: int, messages: int, use_llm: bool, use_semantic: bool) -> dict:
    """Calls and dollars of a mining run, roughly: a call a pattern, a hundred tokens a message."""
    dollars = 0.001 * patterns * use_llm + messages * 100 / 1000 * 0.0001 * use_semantic
    return {"llm_calls": patterns * use_llm, "embedding_calls": max(1, messages // 1000) * use_semantic, "estimated_cost_usd": dollars}


def embed(messages: DataFrame, cache: DataFrame, model) -> tuple[DataFrame, DataFrame]:
    """Vectors of messages by sha256 of the text: those in cache(key, vector) are looked up, and only distinct texts that it
    lacks go through the model (a function of a list of texts), by Arrow batches. Returns (id, vector) and the new entries."""
    import pandas as pd

    keyed = messages.select("id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("key"))

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"key": f.key, "vector": [list(map(float, v)) for v in model(f.text.tolist())]})

    fresh = keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti").select("key", "text").mapInPandas(run, "key string, vector array<double>")
    return keyed.join(cache.select("key", "vector").unionByName(fresh), "key").select("id", "vector"), fresh
