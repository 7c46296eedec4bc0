"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import packs, pii
from quillmesh.functions import text as tx
from quillmesh.operators import signals
from quillmesh.plans.base import MESSAGES, messages, query, table


def _count(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))".replace("\U0001f300", r"\x{1F300}").replace("\U0001f9ff", r"\x{1F9FF}")


_TRIM = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_NORMAL = rf"regexp_replace(regexp_replace(regexp_replace({_TRIM}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n+', chr(10), 'g')"


@query(f"SELECT doc_id, md5({_NORMAL}) AS normal, length({_NORMAL})::INT AS chars FROM documents")
def text_normalize(spark, sf_dir):
    n = tx.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n.cast("binary")).alias("normal"), F.length(n).alias("chars"))


@query(f"SELECT doc_id, md5(substr({_NORMAL}, 1, 8192)) AS cleaned FROM documents")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_text(F.col("text")).cast("binary")).alias("cleaned"))


@query(f"""WITH {MESSAGES} SELECT id, {_count('(?i)' + tx.URL_MARK)}::INT AS urls, {_count(tx.PHONE_MARK)}::INT AS phones, {_count('(?i)' + tx.EMAIL)}::INT AS emails, {_count(tx.EMOJI)}::INT AS emoji_count,
round(CASE WHEN length(text) > 0 THEN {_count(chr(92) + 'p{Lu}')}::DOUBLE / length(text) ELSE 0 END, 6) AS caps_ratio, {_count('!')}::INT AS exclamation, {_count(chr(92) + '?')}::INT AS question,
{_count(chr(92) + 'S+')}::INT AS word_count, length(text)::INT AS char_count FROM messages""")
def text_features(spark, sf_dir):
    f = tx.features(F.col("text"))
    f["caps_ratio"] = F.round(f["caps_ratio"], 6)
    return messages(spark, sf_dir).select("id", *[c.cast("int").alias(n) if n != "caps_ratio" else c.alias(n) for n, c in f.items() if n != "repeated_chars"])


@query(f"WITH {MESSAGES} SELECT id, unnest(regexp_extract_all(lower(text), '{tx.URL}')) AS url FROM messages")
def url_extract(spark, sf_dir):
    return messages(spark, sf_dir).select("id", F.explode(tx.urls(F.col("text"))).alias("url"))


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{tx.PHONE}')) AS phone FROM documents")
def phone_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.phones(F.col("text"))).alias("phone"))


_DOMAIN = "split_part(split_part(CASE WHEN contains(trim(lower(url)), '://') THEN split_part(trim(lower(url)), '://', 2) ELSE trim(lower(url)) END, '/', 1), ':', 1)"
_SCORE = "least((" + " + ".join(f"contains(lower(url), '{m}')::INT" for m in tx.SPAM_MARKS) + ") / 3.0::DOUBLE, 1.0::DOUBLE)"
_SAFE = "(" + " OR ".join(f"contains({_DOMAIN}, '{d}')" for d in tx.TRUSTED_DOMAINS) + ")"


@query(f"SELECT {_DOMAIN} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(tx.domain(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, round({_SCORE}, 6) AS score, CASE WHEN {_SAFE} THEN 'whitelisted' WHEN {_SCORE} >= 0.4 THEN 'suspicious' ELSE 'legitimate' END AS reputation, round(CASE WHEN {_SAFE} THEN 1.0::DOUBLE WHEN {_SCORE} >= 0.4 THEN {_SCORE} ELSE 1.0 - {_SCORE} END, 6) AS confidence FROM pages")
def domain_class(spark, sf_dir):
    kind, sure = tx.domain_class(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.round(tx.domain_score(F.col("url")), 6).alias("score"), kind.alias("reputation"), F.round(sure, 6).alias("confidence"))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '{pii.EMAIL}', '***@\1', 'g')) AS redacted FROM documents")
def pii_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pii.redact_email(F.col("text")).cast("binary")).alias("redacted"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{pii.CARD}', '****-****-****-\1', 'g'), '{pii.ADDRESS}', '\1xxx', 'g')) AS redacted FROM documents")
def pii_card_and_address(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pii.redact_ip(pii.redact_credit_card(F.col("text"))).cast("binary")).alias("redacted"))


@query(r"""SELECT page_id, regexp_replace(url, '(https?://)([^\s<>"''{}|\\^`\[\]/?#]*)[^\s<>"''{}|\\^`\[\]]*', '\1\2/***', 'g') AS redacted FROM pages""")
def pii_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pii.redact_url(F.col("url")).alias("redacted"))


@query()
def pii_all(spark, sf_dir):
    """Look-around and per-match lengths are beyond DuckDB's regular expressions."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pii.redact_pii(F.col("text")).cast("binary")).alias("redacted"), F.md5(pii.redact_ocr(F.col("text")).cast("binary")).alias("ocr_redacted"))


_SIG = "lower(text)"
for _p, _m in ((r"https?://[^\s]+", "[URL]"), (r"www\.[^\s]+", "[URL]"), (r"t\.me/[^\s]+", "[MESSENGER]"), (tx.SIGNATURE_PHONE, "[PHONE]"), (tx.EMAIL, "[EMAIL]"), (tx.SIGNATURE_PRICE, "[PRICE]"), (r"\s+", " ")):
    _SIG = f"regexp_replace({_SIG}, '{_p}', '{_m}', 'g')"
SIGNATURE_SQL = f"trim({_SIG})"


@query(f"WITH {MESSAGES} SELECT id, md5({SIGNATURE_SQL}) AS signature, sha256({SIGNATURE_SQL}) AS signature256 FROM messages")
def signature(spark, sf_dir):
    return messages(spark, sf_dir).select("id", tx.signature(F.col("text")).alias("signature"), tx.signature(F.col("text"), "sha256").alias("signature256"))


@query(rf"""WITH {MESSAGES}, s AS (SELECT id, {SIGNATURE_SQL} AS n FROM messages), w AS (SELECT id, n, regexp_extract_all(n, '\S+') AS w FROM s)
SELECT id, (CASE WHEN len(w) < 3 THEN 1 ELSE len(w) - 2 END)::INT AS shingles, (CASE WHEN len(w) < 3 THEN 1 ELSE len(list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)])) END)::INT AS different,
md5(CASE WHEN len(w) < 3 THEN n ELSE w[1] || ' ' || w[2] || ' ' || w[3] END) AS first FROM w""")
def shingles(spark, sf_dir):
    rows = messages(spark, sf_dir).select("id", tx.shingles(tx.signature_text(F.col("text"))).alias("s"))
    return rows.select("id", F.size("s").alias("shingles"), F.size(F.array_distinct("s")).alias("different"), F.md5(F.get("s", F.lit(0)).cast("binary")).alias("first"))


@query(f"""WITH {MESSAGES} SELECT id, language AS declared, CASE WHEN {_count('[а-яА-ЯёЁ]')} > 0.3 * {_count('[a-zA-Z]')} THEN 'ru' ELSE 'en' END AS detected,
({' OR '.join(f"contains(lower(text), '{w}')" for w in tx.COMMERCIAL_CONTEXT)}) AS commercial FROM messages""")
def language_and_context(spark, sf_dir):
    return messages(spark, sf_dir).select("id", F.col("language").alias("declared"), tx.language(F.col("text")).alias("detected"), tx.has_commercial_context(F.col("text")).alias("commercial"))


@query(f"""WITH {MESSAGES} SELECT id, floor((length(text) - length(replace(text, 'http', ''))) / 4)::BIGINT AS http, floor((length(text) - length(replace(text, 'the', ''))) / 3)::BIGINT AS the_words,
({_count('(?i)https?://|www' + chr(92) + '.')} > 5 OR {_count(tx.PHONE_MARK)} > 3) AS blocked FROM messages""")
def occurrence_counts(spark, sf_dir):
    return messages(spark, sf_dir).select("id", tx.occurrences(F.col("text"), "http").cast("long").alias("http"), tx.occurrences(F.col("text"), "the").cast("long").alias("the_words"), tx.blocked_by_limits(F.col("text")).alias("blocked"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))[1:3], ' ') AS first FROM documents")
def token_sets(spark, sf_dir):
    s = tx.token_set(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("tokens"), F.array_join(F.slice(s, 1, 3), " ").alias("first"))


_WORDY = ("buy_sell", "promotion", "service_offer")
_FORMS = {"buy_sell": "buy|sell|sale|purchase|selling|forsale|for sale", "promotion": "sale|discount|promotion|limited time|special offer|free|bonus|gift", "service_offer": "service|services|offer|available"}


@query(f"""WITH {MESSAGES}, n AS (SELECT id, {', '.join(f"len(regexp_extract_all(lower(text), '(?:^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])(?:{_FORMS[k]})(?:$|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])'))::INT AS {k}" for k in _WORDY)} FROM messages)
SELECT id, buy_sell, promotion, service_offer, round(greatest(CASE WHEN buy_sell > 0 THEN least(0.7 + 0.1 * buy_sell, 0.95) ELSE 0 END, CASE WHEN promotion > 0 THEN least(0.7 + 0.1 * promotion, 0.95) ELSE 0 END, CASE WHEN service_offer > 0 THEN least(0.5 + 0.1 * service_offer, 0.85) ELSE 0 END)::DOUBLE, 6) AS best FROM n""")
def keyword_scores(spark, sf_dir):
    """Word groups with edges that both engines read alike; the whole packs are in commercial_tags."""
    edge = r"[^\p{L}\p{N}_]"
    n = {k: F.regexp_count(F.lower(F.col("text")), F.lit(f"(?:^|{edge})(?:{_FORMS[k]})(?:$|{edge})")) for k in _WORDY}
    rows = messages(spark, sf_dir).select("id", *[c.alias(k) for k, c in n.items()])
    score = lambda k, base, cap: F.when(F.col(k) > 0, F.least(base + 0.1 * F.col(k), F.lit(cap))).otherwise(0.0)
    return rows.withColumn("best", F.round(F.greatest(score("buy_sell", 0.7, 0.95), score("promotion", 0.7, 0.95), score("service_offer", 0.5, 0.85)), 6))


@query()
def commercial_tags(spark, sf_dir):
    """The whole commercial and generic packs; DuckDB lacks back-references and Unicode word edges."""
    rows = messages(spark, sf_dir).select("id", packs.commercial(F.col("text")).alias("c"), packs.generic(F.col("text")).alias("g"))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return rows.select("id", names("c").alias("commercial"), names("g").alias("generic"), F.round(packs.rule_score(F.col("c")), 6).alias("rule_score"))


@query()
def classify(spark, sf_dir):
    out = packs.classify(messages(spark, sf_dir).select("id", "text"))
    return out.select("id", "score", "is_spam", "spam", "scam", "toxic", F.array_join("reasons", "; ").alias("reasons"))


@query()
def analyzer_counts(spark, sf_dir):
    """Keys of the report analyzer over all messages, the 20 most frequent of them."""
    keys = messages(spark, sf_dir).select(F.explode(signals.analyzer_keys(F.col("text"))).alias("key")).groupBy("key").agg(F.count("*").alias("cnt"))
    return signals.top(keys, 20)
