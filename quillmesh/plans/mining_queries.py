"""Mining of signals and their gates."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.operators import runs, signals, vectors
from quillmesh.plans.base import MESSAGES, messages, query, table
from quillmesh.plans.text_queries import SIGNATURE_SQL
from quillmesh.session import shared_dir
from quillmesh.sources.messages import new_rows, read_storage

_SPAM = f"{MESSAGES}, spam AS (SELECT * FROM messages WHERE is_spam), ham AS (SELECT * FROM messages WHERE NOT is_spam)"
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


def _spam(spark, sf_dir):
    return messages(spark, sf_dir).where("is_spam")


@query(f"WITH {_SPAM}, u AS (SELECT unnest(regexp_extract_all(lower(text), '{tx.URL}')[1:3]) AS key FROM messages) SELECT key, count(*) AS cnt FROM u GROUP BY key ORDER BY cnt DESC, key LIMIT 20")
def url_counts_topk(spark, sf_dir):
    return signals.top(signals.url_counts(messages(spark, sf_dir)).select("key", "cnt"), 20)


@query(f"WITH {_SPAM}, w AS (SELECT unnest({_WORDS}) AS key FROM spam) SELECT key, count(*) AS cnt FROM w GROUP BY key ORDER BY cnt DESC, key LIMIT 30")
def keyword_counts_topk(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z]+"), F.lit(0)))
    return signals.top(signals.counted(_spam(spark, sf_dir), words, "keyword").select("key", "cnt"), 30)


@query(f"""WITH {MESSAGES}, s AS (SELECT id, substr(text, 1, 200) AS example, md5({SIGNATURE_SQL}) AS signature FROM messages)
SELECT signature, count(*) AS cnt, min(id) AS first_id, md5(array_to_string((list(example ORDER BY id))[1:5], '|')) AS examples FROM s GROUP BY signature HAVING count(*) >= 2""")
def signature_clusters(spark, sf_dir):
    c = signals.signature_clusters(messages(spark, sf_dir), 2)
    return c.select("signature", "cnt", "first_id", F.md5(F.array_join("examples", "|").cast("binary")).alias("examples"))


@query(f"""WITH {MESSAGES}, k AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS key, count(*) AS cnt FROM pages GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM messages WHERE is_spam)
SELECT key, cnt, round(cnt / n.n, 6) AS score FROM k, n ORDER BY cnt / n.n DESC, md5(key || ' url') LIMIT (SELECT greatest(1, floor(count(*) * 0.25)::BIGINT) FROM k)""")
def suspicious_patterns(spark, sf_dir):
    total = _spam(spark, sf_dir).count()
    hosts = table(spark, sf_dir, "pages").groupBy(tx.domain(F.col("url")).alias("key")).agg(F.count("*").alias("cnt")).withColumn("signal_type", F.lit("url"))
    return signals.suspicious(hosts, F.lit(total), 0.25).select("key", "cnt", F.round("score", 6).alias("score"))


@query(f"WITH {MESSAGES}, k AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS key, id FROM messages) SELECT DISTINCT id FROM k WHERE key IN ('trash', 'worthless', 'free')")
def suspicious_messages(spark, sf_dir):
    needles = spark.createDataFrame([("trash",), ("worthless",), ("free",)], "key string")
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z]+"), F.lit(0))
    return signals.messages_with(messages(spark, sf_dir), needles, words).select("id")


@query(f"WITH {_SPAM}, s AS (SELECT count(*) AS total, count(*) FILTER (contains(lower(text), 'http') OR contains(lower(text), 'trash')) AS stage2 FROM spam) SELECT total, stage2, round(stage2::DOUBLE / total, 6) AS stage2_share, round(1 - stage2::DOUBLE / total, 6) AS savings FROM s")
def stage2_summary(spark, sf_dir):
    hit = tx.any_of(F.lower(F.col("text")), ("http", "trash"))
    s = _spam(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(hit).alias("stage2"))
    share = F.try_divide(F.col("stage2").cast("double"), F.col("total"))
    return s.select("total", "stage2", F.round(share, 6).alias("stage2_share"), F.round(1 - share, 6).alias("savings"))


_COMMON = ", ".join(f"'{w}'" for w in signals.COMMON_WORDS)
_KEYWORDS = f"""k AS (SELECT unnest({_WORDS}) AS key, is_spam FROM messages WHERE is_spam IS NOT NULL),
c AS (SELECT key, count(*) FILTER (is_spam) AS spam, count(*) FILTER (NOT is_spam) AS ham FROM k GROUP BY key),
n AS (SELECT count(*) FILTER (is_spam)::DOUBLE AS ns, count(*) FILTER (NOT is_spam)::DOUBLE AS nh FROM messages)"""
_SAFE_WORD = f"NOT key IN ({_COMMON}) AND length(key) >= 3 AND (ham = 0 OR spam / ns >= 10 * (ham / nh)) AND spam / ns >= 0.05"


def _word_counts(spark, sf_dir):
    m = messages(spark, sf_dir).where("is_spam is not null")
    words = m.select("is_spam", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z]+"), F.lit(0)))).alias("key"))
    counts = words.groupBy("key").agg(F.count_if("is_spam").alias("spam"), F.count_if(~F.col("is_spam")).alias("ham"))
    n = m.agg(F.count_if("is_spam"), F.count_if(~F.col("is_spam"))).first()
    return counts, F.lit(n[0]), F.lit(n[1])


@query(f"WITH {MESSAGES}, {_KEYWORDS} SELECT key, spam, ham FROM c, n WHERE {_SAFE_WORD}")
def keyword_safety(spark, sf_dir):
    counts, ns, nh = _word_counts(spark, sf_dir)
    return counts.where(signals.keyword_safe(F.col("key"), F.col("spam"), F.col("ham"), ns, nh)).select("key", "spam", "ham")


@query(f"""WITH {MESSAGES}, w AS (SELECT is_spam, regexp_extract_all(lower(text), '[^\\s]+') AS w FROM messages WHERE is_spam IS NOT NULL),
p AS (SELECT is_spam, unnest(list_distinct([w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))])) AS key FROM w WHERE len(w) >= 2),
c AS (SELECT key, count(*) FILTER (is_spam) AS spam, count(*) FILTER (NOT is_spam) AS ham FROM p GROUP BY key), n AS (SELECT count(*) FILTER (is_spam)::DOUBLE AS ns FROM messages)
SELECT key, spam, ham FROM c, n WHERE NOT (split_part(key, ' ', 1) IN ({_COMMON}) AND split_part(key, ' ', 2) IN ({_COMMON})) AND (ham = 0 OR spam >= 5 * ham) AND spam / ns >= 0.03""")
def phrase_safety(spark, sf_dir):
    m = messages(spark, sf_dir).where("is_spam is not null")
    pairs = m.select("is_spam", F.explode(F.array_distinct(signals.bigrams(F.col("text")))).alias("key")).groupBy("key").agg(F.count_if("is_spam").alias("spam"), F.count_if(~F.col("is_spam")).alias("ham"))
    n = m.agg(F.count_if("is_spam"), F.count_if(~F.col("is_spam"))).first()
    return pairs.where(signals.phrase_safe(F.col("key"), F.col("spam"), F.col("ham"), F.lit(n[0]), F.lit(n[1]))).select("key", "spam", "ham")


_HOSTS = "SELECT split_part(split_part(p.url, '://', 2), '/', 1) AS key, count(*) FILTER (l.toxic = 1) AS spam, count(*) FILTER (l.toxic = 0) AS ham, count(*) AS cnt FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id GROUP BY 1"


@query(f"WITH c AS ({_HOSTS}) SELECT key, spam, ham, spam >= 3 AND NOT key IN ('.com', '.org', '.net', '.ru', '.io') AND (ham = 0 OR spam >= 5 * ham) AS safe FROM c")
def url_safety(spark, sf_dir):
    p = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "labels"), F.col("page_id") == F.col("doc_id"), "left")
    c = p.groupBy(tx.domain(F.col("url")).alias("key")).agg(F.count_if(F.col("toxic") == 1).alias("spam"), F.count_if(F.col("toxic") == 0).alias("ham"))
    return c.withColumn("safe", signals.url_safe(F.col("key"), F.col("spam"), F.col("ham")))


@query(f"""WITH c AS ({_HOSTS}), s AS (SELECT key, cnt, ({' + '.join(f"contains(key, '{m}')::INT" for m in tx.SPAM_MARKS)}) / 3.0::DOUBLE AS score, ({' OR '.join(f"contains(key, '{d}')" for d in tx.TRUSTED_DOMAINS)}) AS trusted FROM c)
SELECT key, cnt, CASE WHEN least(score, 1) >= 0.4 THEN 'suspicious' ELSE 'legitimate' END AS reputation FROM s WHERE NOT trusted AND (least(score, 1) >= 0.4 OR cnt >= 10) ORDER BY cnt DESC, key LIMIT 10""")
def url_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "pages").groupBy(tx.domain(F.col("url")).alias("key")).agg(F.count("*").alias("cnt"))
    return signals.url_candidates(c).select("key", "cnt", "reputation")


_PAIRS = "w AS (SELECT regexp_extract_all(lower(text), '[^\\s]+') AS w FROM spam), p AS (SELECT unnest([w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))]) AS key FROM w WHERE len(w) >= 2)"


@query(f"WITH {_SPAM}, {_PAIRS} SELECT key, count(*) AS cnt FROM p GROUP BY key HAVING count(*) >= 3 ORDER BY cnt DESC, key LIMIT 10")
def bigram_common(spark, sf_dir):
    return signals.common_bigrams(_spam(spark, sf_dir))


@query(f"""WITH {MESSAGES}, w AS (SELECT id, regexp_extract_all(lower(text), '[^\\s]+') AS w FROM messages WHERE contains(lower(text), 'trash')),
t AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w),
p AS (SELECT array_to_string(w[greatest(1, i - 1):i + 1], ' ') AS key FROM t WHERE contains(w[i], 'trash'))
SELECT key, count(*) AS cnt FROM p GROUP BY key HAVING count(*) >= 2 AND contains(key, ' ') ORDER BY cnt DESC, key LIMIT 10""")
def safer_phrase(spark, sf_dir):
    return signals.safer_phrases(messages(spark, sf_dir), "trash", 2)


#: Tags of the messages in @rows.
BUCKETS = f"""t AS (SELECT length(text) AS n, len(regexp_extract_all(text, '!')) AS e, len(regexp_extract_all(text, '(?i)https?://|www\\.|t\\.me|bit\\.ly')) AS u, len(regexp_extract_all(text, '{tx.PHONE_MARK}')) AS p, len(regexp_extract_all(text, '\\?')) AS q, len(regexp_extract_all(text, '\\p{{Lu}}'))::DOUBLE / greatest(length(text), 1) AS c FROM @rows),
k AS (SELECT unnest([CASE WHEN n < 20 THEN 'very_short' END, CASE WHEN n >= 20 AND n < 50 THEN 'short' END, CASE WHEN n > 500 THEN 'very_long' END, CASE WHEN u > 0 THEN 'urls_' || u END, CASE WHEN p > 0 THEN 'phones_' || p END, CASE WHEN c > 0.3 THEN 'high_caps' END, CASE WHEN e > 2 THEN 'many_exclamations' END, CASE WHEN q > 2 THEN 'many_questions' END]) AS key FROM t)"""


@query(f"WITH {MESSAGES}, {BUCKETS.replace('@rows', 'messages')} SELECT key, count(*) AS cnt FROM k WHERE key IS NOT NULL GROUP BY key")
def message_buckets(spark, sf_dir):
    return signals.counted(messages(spark, sf_dir), signals.bucket_tags(F.col("text")), "bucket").select("key", "cnt")


@query(f"WITH {MESSAGES}, k AS (SELECT unnest({_WORDS}) AS key, id FROM messages) SELECT key, count(*) AS cnt, (SELECT count(*) FROM messages) AS processed, 'completed' AS status FROM k GROUP BY key HAVING count(*) >= 5")
def mining_resumed(spark, sf_dir):
    """Words of all messages counted by a run in batches of ids that stops after the first and is resumed from its stored state."""
    m = messages(spark, sf_dir).select("id", "text")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    stored = runs.Runs(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex[:12]}")
    run, batch = stored.start("full"), -(-m.count() // 3)
    runs.mine(stored, run, m, words, batch, most=1)
    state = runs.mine(stored, run, m, words, batch)
    return stored.counts(state).where("cnt >= 5").select("key", "cnt", F.lit(state["processed"]).cast("long").alias("processed"), F.lit(state["status"]).alias("status"))


def _letters(texts):
    return [[len(t), t.count("e"), t.count(" ")] for t in texts]


@query("SELECT conv_id * 1000 + turn AS id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks, 0::BIGINT AS embedded_again FROM conversations WHERE text IS NOT NULL")
def stored_vectors(spark, sf_dir):
    """Vectors of all conversations by a stored cache: half of them are embedded first, then the rest, then none."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex[:12]}"
    vectors.embedded(rows.where("id % 2 = 0"), folder, _letters)
    vectors.embedded(rows, folder, _letters)
    found, again = vectors.embedded(rows, folder, _letters)
    return found.select("id", *[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(("chars", "e", "blanks"))], F.lit(again).cast("long").alias("embedded_again"))


@query("SELECT conv_id::VARCHAR || '-' || turn AS external_id, text, role = 'user' AS is_spam, CASE WHEN turn % 2 = 0 THEN 'json' ELSE 'csv' END AS form, turn::VARCHAR AS turn FROM conversations WHERE trim(text) <> ''")
def storage_scan(spark, sf_dir):
    """All conversations written as files of two forms into one folder, and read back by what each file holds."""
    c = table(spark, sf_dir, "conversations").withColumn("message_id", F.concat_ws("-", "conv_id", "turn"))
    folder = f"{shared_dir(spark)}/storage-{uuid.uuid4().hex[:12]}"
    label = F.when(F.col("role") == "user", "spam").otherwise("ham")
    c.where("turn % 2 = 0").select("message_id", F.col("text").alias("content"), label.alias("label"), F.lit("json").alias("form"), "turn").write.mode("append").json(folder)
    c.where("turn % 2 <> 0").select("turn", F.lit("csv").alias("form"), "message_id", label.alias("spam"), "text").write.mode("append").option("header", True).option("escape", '"').csv(folder)
    rows = read_storage(spark, folder, dt.datetime(2024, 1, 1))
    return rows.select("external_id", "text", "is_spam", F.col("meta")["form"].alias("form"), F.col("meta")["turn"].alias("turn"))


@query(f"WITH {MESSAGES} SELECT external_id, id FROM messages WHERE id % 2 <> 0")
def ingest_dedupe_antijoin(spark, sf_dir):
    """All messages arrive where those of even ids are stored; what is new goes in."""
    m = messages(spark, sf_dir).select("external_id", "id")
    return new_rows(m, m.where("id % 2 = 0"))
