"""Filter rules as data: compiled, validated on Spark's own plan, and replayed all in one scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.operators import replay
from quillmesh.operators.validation import judged, problem, retarget  # noqa: F401  a part of rules for its users

STATUSES = ("candidate", "shadow", "active", "deprecated")


@dataclass(frozen=True)
class Rule:
    """A rule: either SQL over messages, or the predicate itself as a Spark SQL expression."""

    rule_id: int
    predicate: str
    pattern_id: int | None = None
    status: str = "candidate"
    origin: str = "pattern_mining"
    created_at: str | None = None
    extra: dict = field(default_factory=dict, compare=False)
    #: Of a rule of literals alone: parts that must all be met, each by any of its needles.
    parts: tuple[tuple[str, ...], ...] = ()

    @classmethod
    def literal(cls, rule_id: int, *parts: Iterable[str], **fields) -> Rule:
        """The rule that every part has a needle in the text."""
        held = tuple(tuple(dict.fromkeys(p)) for p in parts)
        return cls(rule_id, " AND ".join(any_keyword(p, len(p)) for p in held), parts=held, **fields)

    @property
    def sql(self) -> str:
        return f"SELECT id, is_spam FROM messages WHERE {self.predicate}"

    def column(self, lower: Column | None = None) -> Column:
        """The predicate; of literals alone by the text in lower case, where it is given as a column."""
        if lower is None or not self.parts:
            return F.expr(self.predicate)
        met = [reduce(or_, [F.contains(lower, F.lit(x.lower())) for x in needles]) for needles in self.parts]
        return reduce(and_, met)


def literal(value: str) -> str:
    """A string literal of Spark SQL, for any characters."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains(needle: str) -> str:
    """The predicate of LOWER(text) LIKE '%needle%'; needles are never patterns, so none of %, _ and \\ is special."""
    return f"contains(lower(text), {literal(needle.lower())})"


def any_keyword(needles: Sequence[str], most: int = 10) -> str:
    return "(" + " OR ".join(contains(n) for n in list(dict.fromkeys(needles))[:most]) + ")"


def matches(pattern: str, cased: bool = False) -> str:
    """The predicate of text REGEXP pattern; word ends written \\y are \\b."""
    return f"text RLIKE {literal(('(?U)' if cased else '(?iU)') + pattern.replace(chr(92) + 'y', chr(92) + 'b'))}"


#: What a mined pattern type compiles to, besides keyword lists.
REGEX_RULES = {
    "phone": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b|\+\d{1,3}[-.\s]?\d{1,4}",
    "messenger_link": r"(https?://)?(t\.me|messenger\.me)/[^\s]+",
    "multiple_urls": r"(https?://|www\.|t\.me|bit\.ly).*(https?://|www\.|t\.me|bit\.ly)",
    "excessive_emoji": tx.EMOJI + "{4,}",
    "excessive_caps": r"[A-ZА-ЯЁ]{10,}",
    "repeated_symbols": tx.REPEATED,
}
EXTRA_CONTEXT = {"group_invite": ("https", "t.me"), "job_offer": ("money", "usd", "руб", "зарплат", "деньги")}


def compile_rule(rule_id: int, name: str, keywords: Sequence[str] = (), **fields) -> Rule:
    """The rule of a mined pattern (see compile_pattern); one of literals alone can be replayed with thousands of others."""
    if name in REGEX_RULES:
        return Rule(rule_id, compile_pattern(name, keywords), **fields)
    own = list(dict.fromkeys(keywords))[:10]
    context = [tuple(dict.fromkeys([*tx.COMMERCIAL_CONTEXT, *EXTRA_CONTEXT[name]]))] if name in EXTRA_CONTEXT else []
    return Rule.literal(rule_id, own, *context, **fields)


def compile_pattern(name: str, keywords: Sequence[str] = ()) -> str:
    """The predicate of a mined pattern: a regex where one is known, else its keywords; broad ones need a second, commercial
    word besides."""
    if name == "url":
        return any_keyword(keywords)
    if name in REGEX_RULES:
        out = matches(REGEX_RULES[name], cased=name in ("excessive_caps", "repeated_symbols", "excessive_emoji"))
        return f"{out} AND {_context()}" if name == "excessive_caps" else out
    out = any_keyword(keywords)
    return f"{out} AND {_context(EXTRA_CONTEXT[name])}" if name in EXTRA_CONTEXT else out


def _context(more: Iterable[str] = ()) -> str:
    needles = dict.fromkeys([*tx.COMMERCIAL_CONTEXT, *more])
    return "(" + " OR ".join(contains(n) for n in needles) + ")"


# ---- replay -----------------------------------------------------------------------------------------------------------


#: So many rules of literals are tested one by one, in the scan's own code; more go through one automaton.
_ONE_BY_ONE = 64


def matches_of(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(id, is_spam, rule_ids) of every message, with the ids of the rules that match it. A text is put in lower case once."""
    literals = [r for r in rules if r.parts]
    if len(literals) <= _ONE_BY_ONE:
        literals = []
    messages = messages.withColumn("_lower", F.lower("text"))
    tests = [F.when(r.column(F.col("_lower")), F.lit(r.rule_id).cast("long")) for r in rules if not literals or not r.parts]
    found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<bigint>")
    return replay.matched(messages, literals, found) if literals else messages.select("id", "is_spam", found.alias("rule_ids"))


def hits(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, id, is_spam) of every match: the rules are tested side by side in one scan, and only matches come out. As an
    outer explode, since for a plain one Spark first tests all rules to see which rows have none."""
    return matches_of(messages, rules).select("id", "is_spam", F.explode_outer("rule_ids").alias("rule_id")).where("rule_id is not null")


def _counts(messages: DataFrame, rules: Sequence[Rule], batch: int = 100) -> DataFrame:
    """One row a rule: rule_id, hits_total, spam_hits, ham_hits, total, total_spam. Up to `batch` rules are one aggregate
    that is turned into rows; more are exploded matches, counted before they are shuffled."""
    if len(rules) <= batch:
        aggs = [F.count("*").alias("total"), F.count_if("is_spam").alias("total_spam")]
        for i, r in enumerate(rules):
            p = r.column()
            aggs += [F.count_if(p).alias(f"h{i}"), F.count_if(p & F.col("is_spam")).alias(f"s{i}"), F.count_if(p & ~F.col("is_spam")).alias(f"n{i}")]
        rows = F.array(*[F.struct(F.lit(r.rule_id).cast("long").alias("rule_id"), F.col(f"h{i}").alias("hits_total"), F.col(f"s{i}").alias("spam_hits"), F.col(f"n{i}").alias("ham_hits")) for i, r in enumerate(rules)])
        return messages.agg(*aggs).select(F.explode(rows).alias("r"), "total", "total_spam").select("r.*", "total", "total_spam")
    totals = messages.agg(F.count("*").alias("total"), F.count_if("is_spam").alias("total_spam"))
    every = messages.sparkSession.createDataFrame([(r.rule_id,) for r in rules], "rule_id long")
    found = hits(messages, rules).groupBy("rule_id").agg(F.count("*").alias("hits_total"), F.count_if("is_spam").alias("spam_hits"), F.count_if(~F.col("is_spam")).alias("ham_hits"))
    return every.join(found, "rule_id", "left").fillna(0).crossJoin(F.broadcast(totals))  # the totals are one row


def evaluate(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Shadow evaluation: hits, precision (unlabelled hits count against it), recall, F1 and coverage of every rule."""
    c = _counts(messages, rules)
    precision = F.try_divide(F.col("spam_hits").cast("double"), F.col("hits_total"))
    recall = F.try_divide(F.col("spam_hits").cast("double"), F.col("total_spam"))
    c = c.withColumn("precision", precision).withColumn("recall", recall).withColumn("coverage", F.try_divide(F.col("hits_total").cast("double"), F.col("total")))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(F.col("recall").isNull(), F.col("precision")).otherwise(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))
    return c.select("rule_id", "hits_total", "spam_hits", "ham_hits", "precision", "recall", F.when(F.col("precision").isNotNull(), f1).alias("f1_score"), "coverage")


def too_broad(messages: DataFrame, rules: Sequence[Rule], most: float = 0.80) -> DataFrame:
    e = evaluate(messages, rules)
    return e.select("rule_id", "coverage", (F.col("coverage") > most).alias("rejected"))


def union_metrics(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Of a set of rules: recall and ham rate of the distinct messages they match, precision of the summed matches."""
    if len(rules) > _ONE_BY_ONE:
        per = matches_of(messages, rules).select("is_spam", F.size("rule_ids").alias("n"))
    else:
        per = messages.select("is_spam", sum((F.when(r.column(), 1).otherwise(0) for r in rules), F.lit(0)).alias("n"))
    spam, ham, hit = F.coalesce(F.col("is_spam"), F.lit(False)), ~F.coalesce(F.col("is_spam"), F.lit(True)), F.col("n") > 0
    out = per.agg(
        F.count_if(spam & hit).alias("unique_spam_hits"), F.count_if(ham & hit).alias("unique_ham_hits"), F.sum(F.when(spam, F.col("n")).otherwise(0)).alias("summed_spam_hits"),
        F.sum(F.when(ham, F.col("n")).otherwise(0)).alias("summed_ham_hits"), F.count_if(spam).alias("total_spam"), F.count_if(ham).alias("total_ham"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return out.select("unique_spam_hits", "unique_ham_hits", "summed_spam_hits", "summed_ham_hits", rate("unique_spam_hits", F.col("total_spam")).alias("recall"), rate("unique_ham_hits", F.col("total_ham")).alias("ham_hit_rate"), rate("summed_spam_hits", F.col("summed_spam_hits") + F.col("summed_ham_hits")).alias("precision"))


def flat_or(messages: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct (rule_id, id, is_spam) where any needle of a rule is in the text, whatever the rule's structure.

    needles (rule_id, needle) is a control table of rules. Where it has a column kind, needles of the kind 'regexp' are regular
    expressions, tried without regard to case; all others are literals. Null needles count nowhere.
    """
    by_rule: dict[int, tuple[list[str], list[str]]] = {}
    kind = F.col("kind") if "kind" in needles.columns else F.lit("like")
    for r in needles.where("needle is not null").select("rule_id", "needle", (F.coalesce(kind, F.lit("like")) == "regexp").alias("regexp")).collect():
        by_rule.setdefault(r.rule_id, ([], []))[r.regexp].append(r.needle)
    rules = []
    for k, (likes, patterns) in sorted(by_rule.items()):
        if patterns:
            rules.append(Rule(k, "(" + " OR ".join([*map(contains, likes), *map(matches, patterns)]) + ")"))
        else:
            rules.append(Rule.literal(k, likes))
    return hits(messages, rules).select("rule_id", "id", "is_spam")


# ---- tables of rules and evaluations ----------------------------------------------------------------------------------


def latest(evaluations: DataFrame) -> DataFrame:
    """The last evaluation of each rule."""
    return evaluations.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("created_at")))).where("_n = 1").drop("_n")


def drift(evaluations: DataFrame) -> DataFrame:
    """Each evaluation with the one before: drift above 10 % of the earlier precision, improvement below -5 %."""
    before = F.lag("precision").over(Window.partitionBy("rule_id").orderBy("created_at"))
    out = evaluations.withColumn("previous_precision", before)
    out = out.withColumn("drift", F.try_divide(F.col("previous_precision") - F.col("precision"), F.col("previous_precision")))
    return out.withColumn("verdict", F.when(F.col("drift") > 0.10, "DRIFT").when(F.col("drift") < -0.05, "IMPROVED").when(F.col("drift").isNotNull(), "STABLE"))


def best_shadow(rules: DataFrame, evaluations: DataFrame, n: int) -> DataFrame:
    """The n shadow rules of best last precision; those never evaluated count as 0.5."""
    joined = rules.where("status = 'shadow'").join(latest(evaluations).select("rule_id", "precision"), "rule_id", "left")
    return joined.withColumn("rank_precision", F.coalesce("precision", F.lit(0.5))).orderBy(F.desc("rank_precision"), "rule_id").limit(n)


def one_per_expression(rules: DataFrame) -> DataFrame:
    return rules.withColumn("_n", F.row_number().over(Window.partitionBy("sql_expression").orderBy("rule_id"))).where("_n = 1").drop("_n")


def with_patterns(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    return rules.join(patterns, "pattern_id", "left")


def without_rules(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    return patterns.join(rules.select("pattern_id"), "pattern_id", "left_anti")


def first_rule(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Each pattern with its newest rule."""
    newest = rules.withColumn("_n", F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("created_at"), F.desc("rule_id")))).where("_n = 1").drop("_n")
    return patterns.join(newest, "pattern_id")


def grouped_by_pattern(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rule ids under their pattern, rules without one first."""
    joined = rules.select("rule_id", "pattern_id").join(patterns.select("pattern_id", "pattern_type"), "pattern_id", "left")
    return joined.groupBy("pattern_id", "pattern_type").agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids")).orderBy(F.asc_nulls_first("pattern_id"))


def filtered(rules: DataFrame, evaluations: DataFrame, min_precision: float | None = None, status: str | None = None) -> DataFrame:
    """Rules that have an evaluation, by precision and status."""
    out = rules.join(latest(evaluations).drop("created_at"), "rule_id")
    if min_precision is not None:
        out = out.where(F.col("precision") >= min_precision)
    return out if status is None else out.where(F.col("status") == status)


def of_kind(rules: DataFrame, patterns: DataFrame, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Rules by the type of their pattern and by the language that their text asks for: a rule that names none is for all."""
    out = rules.join(patterns.select("pattern_id", "pattern_type"), "pattern_id", "left")
    if kind is not None:
        out = out.where(F.col("pattern_type") == kind)
    if language is not None:
        asked = F.regexp_extract("sql_expression", r"(?i)language\s*=\s*'([a-z]+)'", 1)
        out = out.where((asked == "") | (F.lower(asked) == language.lower()))
    return out


def by_metric(rules: DataFrame, evaluations: DataFrame, metric: str = "coverage") -> DataFrame:
    """Rules by their last precision or coverage, best first; those never evaluated count as 0."""
    joined = rules.join(latest(evaluations).select("rule_id", metric), "rule_id", "left")
    return joined.withColumn(metric, F.coalesce(metric, F.lit(0.0))).orderBy(F.desc(metric), "rule_id")


def in_states(rules: DataFrame, states: Sequence[str] = ("candidate", "shadow", "active")) -> DataFrame:
    """The rules of some states, one state after the other."""
    place = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("status"))
    return rules.where(F.col("status").isin(*states)).withColumn("place", place)


# ---- samples ----------------------------------------------------------------------------------------------------------


def sample_run(messages: DataFrame, rules: Sequence[Rule], n: int = 10) -> DataFrame:
    """(rule_id, id, is_spam, place) of the first n matches of each rule by id; n a rule and task are shuffled."""
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy("id"))
    return hits(messages, rules).withColumn("place", place).where(F.col("place") <= n)


def accepted_on_sample(messages: DataFrame, rules: Sequence[Rule], n_spam: int = 20, n_ham: int = 50, least_precision: float = 0.85, most_ham: float = 0.05) -> DataFrame:
    """(rule_id, spam_matches, ham_matches, accepted) on the first spam and ham messages by id: a rule that matches some, with
    enough precision and few of the ham, is accepted. A sampling operator: its bounds are the feature. The larger bound is a plain
    number, of which Spark keeps the first rows a task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("is_spam").orderBy("id"))
    first = (F.col("place") <= max(n_spam, n_ham)) & (F.col("place") <= F.when(F.col("is_spam"), n_spam).otherwise(n_ham))
    rows = messages.where("is_spam is not null").withColumn("place", place).where(first)
    c = _counts(rows, rules).withColumnsRenamed({"spam_hits": "spam_matches", "ham_hits": "ham_matches"})
    ham = F.col("total") - F.col("total_spam")
    precise = F.try_divide(F.col("spam_matches").cast("double"), F.col("spam_matches") + F.col("ham_matches")) >= least_precision
    few = (ham == 0) | (F.try_divide(F.col("ham_matches").cast("double"), ham) <= most_ham)
    return c.withColumn("accepted", (F.col("spam_matches") + F.col("ham_matches") > 0) & F.coalesce(precise, F.lit(False)) & few)
