"""Tiers, promotion profiles, rule safety and other decision tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import rules as rl


@dataclass(frozen=True)
class Profile:
    min_precision: float
    max_coverage: float
    min_hits: int
    max_ham: int


# Promotion profiles and safety modes.
PROFILES = {"conservative": Profile(0.95, 0.05, 100, 5), "balanced": Profile(0.90, 0.10, 50, 10), "aggressive": Profile(0.85, 0.20, 30, 20)}
TIERS = ("safe_auto", "review_only", "feature_only")

# Words too general to be a rule, and literals that are known to be safe.
STOP_WORDS = (
    "if", "for", "on", "in", "at", "to", "of", "the", "a", "an", "ur", "sd", "ub", "en", "pm", "al", "ру", "ен", "то", "ка", "как", "что", "это",
    "для", "при", "work", "job", "home", "day", "time", "now", "here", "there", "работа", "дом", "день", "время", "сейчас", "здесь", "там",
)
SAFE_LITERALS = (
    "bit.ly", "tinyurl", "goo.gl", "ow.ly", "t.co", "cutt.ly", "rebrand.ly", "casino", "betting", "viagra", "cialis", "pharmacy", "win", "prize",
    "free-", "claim", "bonus", "earn-money", "get-rich", "work-from-home", "t.me/spam", "t.me/money", "t.me/casino", "t.me/betting", "зарплат",
    "заработок", "доход", "деньги", "money", "salary", "подработк", "part-time", "earn", "income", "profit", "usd", "eur", "руб", "dollar", "euro",
    "ruble", "account", "блокировка", "blocked", "verify", "confirm", "предлож", "offer", "sale", "buy", "sell", "investment", "invest", "crypto",
    "bitcoin", "forex", "trading", "scam", "fraud", "phishing", "fake", "verify your", "click here", "security", "проверка", "звоните", "предлагаю",
    "spam-link.com", "fake-promo.com", "phishing-link.org", "fake-gift.com", "fake-telegram-verify.com", "предложение", "аккаунт", "требуется",
)


def tier(precision: Column, spam: Column, ham: Column, total_ham: Column) -> Column:
    """safe_auto, review_only or feature_only, tested in this order."""
    rate = F.coalesce(F.try_divide(ham.cast("double"), total_ham), F.lit(0.0))
    review = ((precision >= 0.90) & (precision < 0.98) & (spam >= 20)) | ((precision >= 0.95) & (rate <= 0.05))
    return F.when((precision >= 0.98) & (spam >= 50) & (rate <= 0.01), TIERS[0]).when(review, TIERS[1]).when((precision < 0.90) | (rate > 0.05), TIERS[2]).otherwise(TIERS[1])


def profile_patterns(tiered: DataFrame, profile: str) -> DataFrame:
    """Patterns of a profile: safe ones; for balanced also those for review from a precision of 0.95, for aggressive all of them."""
    take = F.col("tier") == TIERS[0]
    if profile == "balanced":
        take = take | ((F.col("tier") == TIERS[1]) & (F.col("precision") >= 0.95))
    elif profile == "aggressive":
        take = take | (F.col("tier") == TIERS[1])
    return tiered.where(take)


def promotable(e: DataFrame, profile: Profile) -> Column:
    """A coverage of zero, or none, is not held against a rule."""
    covered = (F.coalesce(F.col("coverage"), F.lit(0.0)) == 0) | (F.col("coverage") <= profile.max_coverage)
    return F.coalesce((F.col("precision") >= profile.min_precision) & covered & (F.col("hits_total") >= profile.min_hits) & (F.col("ham_hits") <= profile.max_ham), F.lit(False))


def degraded(profile: Profile, most_drop: float = 0.10) -> Column:
    drop = F.try_divide(F.col("previous_precision") - F.col("precision"), F.col("previous_precision"))
    tests = [F.col("precision") < profile.min_precision, drop > most_drop, F.col("ham_hits") > profile.max_ham, F.col("coverage") > 2 * profile.max_coverage]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def can_auto_ban(mode: Column, tier_: Column, precision: Column) -> Column:
    """Conservative: safe patterns from 0.98 on; balanced: safe ones; aggressive: also those for review from 0.95."""
    return F.when(mode == "conservative", (tier_ == TIERS[0]) & (precision >= 0.98)).when(mode == "balanced", tier_ == TIERS[0]).when(mode == "aggressive", (tier_ == TIERS[0]) | ((tier_ == TIERS[1]) & (precision >= 0.95))).otherwise(F.lit(False))


def suggested_usage(precision: Column, coverage: Column) -> Column:
    return F.when(precision.isNull(), "not evaluated").when((precision >= 0.95) & (coverage <= 0.05), "auto-ban").when(precision >= 0.90, "ban with review").when(precision >= 0.80, "flag for moderation").otherwise("feature only")


def bot_likelihood(kind: Column, group: Column, senders: Column, sources: Column) -> Column:
    """0.7 for signatures, 0.5 for URLs and phones, else 0.3; more for large groups and many senders or sources."""
    base = F.when(kind == "signature", 0.7).when(kind.isin("url", "phone"), 0.5).otherwise(0.3)
    one = F.when(senders > 10, 0.2).when(senders > 5, 0.1).otherwise(0.0) + F.when(group > 100, 0.1).otherwise(0.0)
    score = F.least(base + one, F.lit(0.95))
    score = F.when((group > 20) & (sources > 5), F.least(score + 0.15, F.lit(0.95))).otherwise(score)
    return F.bround(score, 2)


def align_tier(tier_: Column, risk: Column, confidence: Column) -> Column:
    """A proposed tier brought in line with its risk, one step at most; low confidence is only an insight."""
    return F.when(confidence == "LOW", "INSIGHT_ONLY").when((tier_ == "SAFE_AUTO") & (risk >= 10), "REVIEW_ONLY").when((tier_ == "REVIEW_ONLY") & (risk >= 30), "DANGEROUS").when((tier_ == "DANGEROUS") & (risk > 75), "INSIGHT_ONLY").otherwise(tier_)


def family(description: Column) -> Column:
    """A pattern's family by the first group whose word its description has."""
    d = F.lower(description)
    groups = {"url": ("url", "link", "domain"), "phone": ("phone",), "job": ("job", "work", "hiring"), "money": ("money", "price", "earn"), "group": ("group", "channel"), "formatting": ("caps", "emoji", "repeated"), "contact": ("contact", "messenger"), "service": ("service",), "promotion": ("promotion", "discount", "sale")}
    out = None
    for name, needles in groups.items():
        test = F.lit(False)
        for n in needles:
            test = test | F.contains(d, F.lit(n))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def rule_safety(sql: str, evaluation: dict | None = None, llm_risk: str | None = None) -> tuple[str, str]:
    """dangerous, requires_review or auto_safe, and why; on the driver, for one rule of the control table.

    evaluation: precision, hits_total and ham_hits of its shadow run, which outweighs the known literals.
    """
    upper, needles = sql.upper(), [x.lower() for x in re.findall(r"(?i)LIKE\s+'%([^%]+)%'", sql)]
    needles += [x.lower() for x in re.findall(r"(?i)contains\(\s*lower\(text\),\s*'((?:[^'\\]|\\.)*)'\)", sql)]
    tests, both = len(needles), " AND " in upper
    known = bool(needles) and all(any(s in n for s in SAFE_LITERALS) for n in needles)
    if short := [n for n in needles if len(n) < 3]:
        return "dangerous", f"too short: {short}"
    if stop := [n for n in needles if n in STOP_WORDS]:
        return "dangerous", f"common words: {stop}"
    if tests == 1 and not both and not known and len(needles[0].split()) <= 1 and len(needles[0]) < 10 and not set(needles[0]) & set("./@:?=&"):
        return "dangerous", f"a single common word: {needles[0]}"
    if "WHERE 1=1" in upper or "WHERE TRUE" in upper:
        return "dangerous", "matches everything"
    ors = upper.count(" OR ")
    if ors >= 3 and not both:
        return "requires_review", f"{ors} alternatives without AND"
    if ors > 7:
        return "requires_review", f"{ors} alternatives"
    if tests == 1 and not both and not known:
        return "requires_review", "a single test"
    doubtful = False
    if evaluation and (evaluation.get("precision") or 0) >= 0.95 and (evaluation.get("hits_total") or 0) >= 10:
        rate = (evaluation.get("ham_hits") or 0) / evaluation["hits_total"]
        if rate <= 0.01:
            return "auto_safe", f"precision {evaluation['precision']:.2f} in shadow runs"
        doubtful = True
    if llm_risk:
        return ("auto_safe", "low risk by review model") if llm_risk == "low" else ("requires_review", f"{llm_risk} risk by review model")
    if doubtful:
        return "requires_review", "false positives above 1 %"
    if known and (both or tests == 1):
        return "auto_safe", "known literals only"
    return "requires_review", "no review model"


def with_safety(rules: DataFrame) -> DataFrame:
    """rules(rule_id, sql_expression, precision, hits_total, ham_hits) with kind and why, the decisions of rule_safety() without
    a review model, as columns."""
    sql = F.coalesce(F.col("sql_expression"), F.lit(""))
    upper = F.upper(sql)
    found = F.concat(F.regexp_extract_all(sql, F.lit(r"(?i)LIKE\s+'%([^%]+)%'"), F.lit(1)), F.regexp_extract_all(sql, F.lit(r"(?i)contains\(\s*lower\(text\),\s*'((?:[^'\\]|\\.)*)'\)"), F.lit(1)))
    n, first, both, ors = F.size("_n"), F.get("_n", F.lit(0)), F.contains(upper, F.lit(" AND ")), F.regexp_count(upper, F.lit(" OR "))
    safe = F.array(*[F.lit(x) for x in SAFE_LITERALS])
    known = (n > 0) & F.forall("_n", lambda x: F.exists(safe, lambda s: F.contains(x, s)))
    plain = (F.size(F.regexp_extract_all(first, F.lit(r"\S+"), F.lit(0))) <= 1) & (F.length(first) < 10) & ~F.regexp_like(first, F.lit("[./@:?=&]"))
    shadow = F.coalesce((F.col("precision") >= 0.95) & (F.col("hits_total") >= 10), F.lit(False))
    rate = F.try_divide(F.coalesce(F.col("ham_hits").cast("double"), F.lit(0.0)), F.col("hits_total"))
    cases = [
        (sql == "", "dangerous", "no expression"), (F.exists("_n", lambda x: F.length(x) < 3), "dangerous", "short words"), (F.exists("_n", lambda x: x.isin(*STOP_WORDS)), "dangerous", "common words"),
        ((n == 1) & ~both & ~known & plain, "dangerous", "one common word"), (F.regexp_like(upper, F.lit("WHERE (1=1|TRUE)")), "dangerous", "everything"), ((ors >= 3) & ~both, "requires_review", "alternatives"),
        (ors > 7, "requires_review", "many alternatives"), ((n == 1) & ~both & ~known, "requires_review", "one test"), (shadow & (rate <= 0.01), "auto_safe", "shadow runs"),
        (shadow, "requires_review", "false positives"), (known & (both | (n == 1)), "auto_safe", "known words"),
    ]
    kind, why = F.lit("requires_review"), F.lit("no review")
    for test, k, w in reversed(cases):
        kind, why = F.when(test, k).otherwise(kind), F.when(test, w).otherwise(why)
    return rules.withColumn("_n", F.transform(found, F.lower)).withColumn("kind", kind).withColumn("why", why).drop("_n")


# Words that a rule of alternatives is too broad with, texts that are spam alone, and words too common to be a rule.
RISKY_TEXT = (r"%\b(if|for|on|in|at|to|of|the|a|an)\b%", r"%\b(group|price|contact|service|message)\b%", r"%\b(verify|check|account|security)\b%", r"%\b(buy|sell|sale)\b%", r"%\b(job|work|salary|income)\b%")
SAFE_TEXT = (r"phishing-link\.org", r"fake-.*\.com", r"scam-.*\.net", r"spam-link\.com", r"suspended.*verify.*now", r"urgent.*verify.*account")
COMMON_ALONE = ("if", "for", "on", "in", "at", "to", "of", "the", "a", "an", "is", "are", "was", "were")
SPAM_DOMAIN = r"http[s]?://[^/\s]*(?:phishing|fake|scam|spam)"
SQL_WORD = r"\b(UPDATE|DELETE|INSERT|DROP|ALTER|CREATE)\b"


def static_quality(rules: DataFrame) -> DataFrame:
    """rules(rule_id, sql_expression, ...) with adequacy, quality (low, medium, high), fp_risk (also critical) and issues, all of the
    rule's text alone.

    The tests go in this order, later ones over earlier: alternatives of risky words without AND; known spam texts; one
    common word alone; phone patterns; needles under three characters; AND; addresses of spam; no SELECT at the start; words
    that change tables, outside quotes. A null expression is one without SELECT.
    """
    sql = F.coalesce(F.col("sql_expression"), F.lit(""))
    upper = F.upper(sql)
    has = lambda pattern: F.regexp_like(sql, F.lit("(?i)" + pattern))
    needles = F.regexp_extract_all(sql, F.lit(r"(?i)LIKE\s+'%([^%]+)%'"), F.lit(1))
    ors, both = F.regexp_count(upper, F.lit(" OR ")), F.contains(upper, F.lit(" AND "))
    risky = has("|".join(RISKY_TEXT)) & ~both
    alone = (F.size(needles) == 1) & F.lower(F.get(needles, F.lit(0))).isin(*COMMON_ALONE)
    phone = F.contains(upper, F.lit("REGEXP")) & F.contains(F.lower(sql), F.lit("phone"))
    short = F.exists(needles, lambda x: F.length(x) < 3)
    select, words = F.startswith(upper, F.lit("SELECT")), F.regexp_extract_all(upper, F.lit(SQL_WORD), F.lit(1))
    # a word between quotes anywhere excuses the statement, as one in a string literal does
    quoted = F.exists(words, lambda w: F.regexp_like(upper, F.concat(F.lit("['\"].*"), w, F.lit(".*['\"]"))))
    unsafe = (F.size(words) > 0) & ~quoted
    safe, spam = has("|".join(SAFE_TEXT)), has(SPAM_DOMAIN)
    risk = F.when(risky & (ors > 5), "high").when(risky & (ors > 3), "medium").otherwise("low")
    for test, value in ((safe, "low"), (alone, "high"), (phone, "medium")):
        risk = F.when(test, value).otherwise(risk)
    risk = F.when(short & (risk == "low"), "high").otherwise(risk)
    risk = F.when(both & (risk == "medium"), "low").otherwise(risk)
    for test, value in ((spam, "low"), (unsafe, "critical")):
        risk = F.when(test, value).otherwise(risk)
    adequacy = F.when(spam, "high").when(alone, "low").when(safe, "high").otherwise("medium")
    worth = F.when(unsafe | ~select, "low").when(spam | both | safe, "high").otherwise("medium")
    issues = [F.when(risky & (ors > 5), "alternatives"), F.when(alone, "one common word"), F.when(phone, "phone numbers"), F.when(short, "short needle"), F.when(~select, "no SELECT"), F.when(unsafe, "changes tables")]
    return rules.withColumns({"adequacy": adequacy, "quality": worth, "fp_risk": risk, "issues": F.filter(F.array(*issues), lambda x: x.isNotNull())})


def risk_distribution(rules: DataFrame) -> DataFrame:
    """(fp_risk, rules, share) of static_quality()."""
    per = static_quality(rules).groupBy("fp_risk").agg(F.count("*").alias("rules"))
    return per.withColumn("share", F.col("rules") / F.sum("rules").over(Window.partitionBy()))  # a row a risk


#: The profiles that take in rules of a tier.
PROFILES_OF = {"safe_auto": ("Conservative", "Balanced", "Aggressive"), "review_only": ("Balanced", "Aggressive"), "feature_only": ("Aggressive",)}


def profiles_of(tier: Column) -> Column:
    """The names of the profiles that use a rule of this tier; none for other tiers."""
    out = F.array().cast("array<string>")
    for name, profiles in PROFILES_OF.items():
        out = F.when(tier == name, F.array(*[F.lit(p) for p in profiles])).otherwise(out)
    return out


def profile_safety(messages: DataFrame, rules: dict[str, list[rl.Rule]], limits: dict[str, dict[str, float]]) -> DataFrame:
    """Of each profile's rules: recall and ham rate of the distinct messages, precision of the summed matches, and which of the
    profile's limits (ham_hit_rate_max, spam_recall_min, spam_recall_max, precision_min) are broken. One scan for all profiles."""
    spam, ham = F.coalesce("is_spam", F.lit(False)), F.coalesce(~F.col("is_spam"), F.lit(False))
    counted = messages.select(spam.alias("spam"), ham.alias("ham"), *[sum((F.when(r.column(), 1).otherwise(0) for r in own), F.lit(0)).alias(f"n{i}") for i, own in enumerate(rules.values())])
    aggs, rows = [F.count_if("spam").alias("ts"), F.count_if("ham").alias("th")], []
    for i, (name, own) in enumerate(rules.items()):
        for kind in ("spam", "ham"):
            aggs += [F.count_if(F.col(kind) & (F.col(f"n{i}") > 0)).alias(f"u{kind}{i}"), F.coalesce(F.sum(F.when(F.col(kind), F.col(f"n{i}"))), F.lit(0)).alias(f"s{kind}{i}")]
        bounds = [F.lit(limits.get(name, {}).get(k)).cast("double").alias(k) for k in ("ham_hit_rate_max", "spam_recall_min", "spam_recall_max", "precision_min")]
        rows.append(F.struct(F.lit(name).alias("profile"), F.lit(len(own)).cast("long").alias("patterns"), *[F.col(f"{c}{i}").alias(a) for c, a in (("uspam", "unique_spam_hits"), ("uham", "unique_ham_hits"), ("sspam", "spam_matches"), ("sham", "ham_matches"))], *bounds))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    c = F.col
    out = counted.agg(*aggs).select(F.explode(F.array(*rows)).alias("r"), "ts", "th").select("r.*", "ts", "th")
    out = out.withColumns({"spam_recall": rate(c("unique_spam_hits"), c("ts")), "ham_hit_rate": rate(c("unique_ham_hits"), c("th")), "precision": rate(c("spam_matches"), c("spam_matches") + c("ham_matches"))})
    broken = {"ham_hit_rate_max": c("ham_hit_rate") > c("ham_hit_rate_max"), "spam_recall_min": c("spam_recall") < c("spam_recall_min"), "spam_recall_max": c("spam_recall") > c("spam_recall_max"), "precision_min": c("precision") < c("precision_min")}
    found = F.filter(F.array(*[F.when(test, k) for k, test in broken.items()]), lambda x: x.isNotNull())
    return out.withColumn("violations", found).withColumn("safe", F.size(found) == 0).drop("ts", "th", *broken)


#: What a proposed pattern may say.
PROPOSED_TIERS, CONFIDENCES = ("SAFE_AUTO", "REVIEW_ONLY", "DANGEROUS", "INSIGHT_ONLY"), ("HIGH", "MEDIUM", "LOW")


def proposal_problem(p: Column) -> Column:
    """Why a proposed pattern (a struct of type, description, tier, risk_level and confidence_level) can't be used, or null:
    the first missing field, else an unknown tier, a risk outside 0 to 100, or an unknown confidence."""
    out = F.when(p.isNull(), "missing type")
    for name in ("type", "description", "tier", "risk_level", "confidence_level"):
        out = out.when(p[name].isNull(), f"missing {name}")
    return out.when(~F.upper(p["tier"]).isin(*PROPOSED_TIERS), "invalid tier").when(~p["risk_level"].between(0, 100), "risk out of range").when(~F.upper(p["confidence_level"]).isin(*CONFIDENCES), "invalid confidence")


def validated(responses: DataFrame, patterns: str = "patterns") -> DataFrame:
    """Responses with their first problem (null where valid), the place of the pattern that has it, and the share of patterns
    that are more than insights; a response without patterns is not valid."""
    each = F.transform(F.coalesce(patterns, F.array().cast(responses.schema[patterns].dataType)), lambda p, i: F.struct(i.cast("long").alias("at"), proposal_problem(p).alias("problem"), (F.upper(p["tier"]) != "INSIGHT_ONLY").alias("rule")))
    out = responses.withColumn("_each", each).withColumn("_bad", F.get(F.filter("_each", lambda x: x["problem"].isNotNull()), F.lit(0)))
    rules = F.size(F.filter("_each", lambda x: F.coalesce(x["rule"], F.lit(True))))
    problem = F.when(F.size("_each") == 0, "no patterns").otherwise(F.col("_bad.problem"))
    return out.withColumn("problem", problem).withColumn("problem_at", F.col("_bad.at")).withColumn("conversion_rate", F.coalesce(F.try_divide(rules.cast("double"), F.size("_each")), F.lit(0.0))).drop("_each", "_bad")
