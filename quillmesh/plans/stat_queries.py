"""Evaluation analytics, similarity and operational statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.operators import evaluation as ev
from quillmesh.operators import ops, quality, similarity
from quillmesh.operators import rules as rl
from quillmesh.plans.base import MESSAGES, PATTERN_TABLE, RULE_CTES, RULES, as_of, messages, pattern_table, query, r6, rule_table, table

_HITS = " + ".join(f"contains(lower(text), '{w}')::INT" for w in ("trash", "worthless", "free"))
_SCORED = f"s AS (SELECT id, is_spam AS label, (30 * ({_HITS}) + length(text) % 30) / 100.0::DOUBLE AS score FROM messages)"
_GRID = [round(0.20 + 0.05 * i, 2) for i in range(9)]
_GRID_SQL = "g AS (SELECT unnest([" + ", ".join(map(str, _GRID)) + "])::DOUBLE AS threshold)"
_CONFUSION = """c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label) AS tp, count(*) FILTER (score >= threshold AND NOT label) AS fp, count(*) FILTER (score < threshold AND NOT label) AS tn, count(*) FILTER (score < threshold AND label) AS fn FROM g, s WHERE label IS NOT NULL GROUP BY threshold),
k AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS fpr, coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0) AS fnr, coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0) AS accuracy FROM c),
m AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM k)"""


def _scored(spark, sf_dir):
    n = sum((F.contains(F.lower(F.col("text")), F.lit(w)).cast("int") for w in ("trash", "worthless", "free")), F.lit(0))
    return messages(spark, sf_dir).select("id", F.col("is_spam").alias("label"), ((30 * n + F.length(F.col("text")) % 30) / F.lit(100.0)).alias("score"))


@query(f"WITH {MESSAGES}, {_SCORED}, {_GRID_SQL}, {_CONFUSION} SELECT threshold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(accuracy, 6) AS accuracy FROM m")
def threshold_sweep(spark, sf_dir):
    s = ev.confusion_at(_scored(spark, sf_dir), _GRID)
    return s.select("threshold", "tp", "fp", "tn", "fn", *[r6(c) for c in ("precision", "recall", "f1", "fpr", "fnr", "accuracy")])


@query(f"WITH {MESSAGES}, {_SCORED}, {_GRID_SQL}, {_CONFUSION} SELECT threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1(spark, sf_dir):
    return ev.best_f1(ev.confusion_at(_scored(spark, sf_dir), _GRID)).select("threshold", r6("f1"), r6("precision"), r6("recall"))


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM n WHERE k <= 1000)
SELECT event_type, max(CASE WHEN r = floor(n * 0.5) THEN value END) AS p50, max(CASE WHEN r = floor(n * 0.95) THEN value END) AS p95, max(CASE WHEN r = floor(n * 0.99) THEN value END) AS p99, round(avg(value), 6) AS mean, max(value) AS max, count(*) AS n FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ev.index_percentiles(e, ["event_type"], "value", [F.desc("ts"), F.desc("event_id")], 1000, (0.5, 0.95, 0.99)).withColumn("mean", F.round("mean", 6))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT *, least(greatest(floor((n + 1) * 0.95), 1), n - 1) AS lo, (n + 1) * 0.95 - least(greatest(floor((n + 1) * 0.95), 1), n - 1) AS part FROM r)
SELECT event_type, round(max(CASE WHEN r = lo THEN value END) + (max(CASE WHEN r = lo + 1 THEN value END) - max(CASE WHEN r = lo THEN value END)) * max(part), 6)::DOUBLE AS p95 FROM p WHERE n > 1 GROUP BY event_type""")
def quantiles_exclusive(spark, sf_dir):
    return ev.exclusive_quantile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, "p95").withColumn("p95", F.round("p95", 6))


@query(f"WITH {MESSAGES}, r AS (SELECT id, is_spam, row_number() OVER (PARTITION BY is_spam ORDER BY md5(id::VARCHAR), id) AS place FROM messages WHERE is_spam IS NOT NULL) SELECT id, is_spam, place FROM r WHERE place <= 30")
def stratified_sample(spark, sf_dir):
    return ev.stratified(messages(spark, sf_dir).where("is_spam is not null").select("id", "is_spam"), "is_spam", 30)


@query("WITH c AS (SELECT quantile_disc(ts, 0.6) AS a, quantile_disc(ts, 0.8) AS b FROM events) SELECT event_id, CASE WHEN ts <= a THEN 'train' WHEN ts <= b THEN 'validation' ELSE 'test' END AS split FROM events, c")
def chrono_split(spark, sf_dir):
    return ev.chronological(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"]).select("event_id", "split")


@query(f"""WITH {RULE_CTES}, c AS (SELECT r.rule_id, CASE WHEN r.rule_id <= 3 THEN 'keyword' ELSE 'url' END AS pattern_type, count(h.id) AS hits, count(*) FILTER (h.is_spam)::DOUBLE / nullif(count(h.id), 0) AS p, count(h.id)::DOUBLE / (SELECT count(*) FROM messages) AS v FROM r LEFT JOIN h ON h.rule_id = r.rule_id GROUP BY 1, 2)
SELECT coalesce(pattern_type, 'overall') AS pattern_type, count(*) AS rules, round(avg(p), 6) AS avg_precision, round(avg(v), 6) AS avg_coverage, sum(hits)::BIGINT AS hits FROM c GROUP BY ROLLUP (pattern_type)""")
def harness_metrics_rollup(spark, sf_dir):
    e = rl.evaluate(messages(spark, sf_dir), RULES).withColumn("pattern_type", F.when(F.col("rule_id") <= 3, "keyword").otherwise("url"))
    return ev.harness(e).select("pattern_type", "rules", r6("avg_precision"), r6("avg_coverage"), "hits")


@query(f"""WITH {RULE_CTES}, c AS (SELECT CASE WHEN r.rule_id = 3 THEN 'money' WHEN r.rule_id >= 4 THEN 'url' ELSE 'other' END AS family, h.id, h.is_spam FROM r JOIN h USING (rule_id)), t AS (SELECT count(*) FILTER (is_spam)::DOUBLE AS ts, count(*) FILTER (NOT is_spam)::DOUBLE AS th FROM messages)
SELECT family, count(DISTINCT id) FILTER (is_spam) AS spam, count(DISTINCT id) FILTER (NOT is_spam) AS ham, round(count(DISTINCT id) FILTER (is_spam) / any_value(ts), 6) AS recall, round(count(DISTINCT id) FILTER (NOT is_spam) / any_value(th), 6) AS ham_rate, count(DISTINCT id) FILTER (NOT is_spam) / any_value(th) > 0.05 AS too_broad FROM c, t GROUP BY family""")
def honest_report(spark, sf_dir):
    """Union recall and ham rate by family of patterns."""
    m = messages(spark, sf_dir)
    said = F.create_map(*[x for k, v in {1: "Trash talk", 2: "Worthless talk", 3: "Free money", 4: "URL start", 5: "Link host"}.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    h = rl.hits(m, RULES).withColumn("family", quality.family(said[F.col("rule_id")]))
    n = m.agg(F.count_if("is_spam"), F.count_if(~F.col("is_spam"))).first()
    per = h.groupBy("family", "id").agg(F.max("is_spam").alias("is_spam")).groupBy("family").agg(F.count_if("is_spam").alias("spam"), F.count_if(~F.col("is_spam")).alias("ham"))
    return per.select("family", "spam", "ham", F.round(F.col("spam") / n[0], 6).alias("recall"), F.round(F.col("ham") / n[1], 6).alias("ham_rate"), (F.col("ham") / n[1] > 0.05).alias("too_broad"))


# ---- similarity -------------------------------------------------------------------------------------------------------

_COSINE = "p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


@query(f"WITH {_COSINE} SELECT a, b, round(c, 5) AS cosine FROM p WHERE c >= 0.35")
def cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.35).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(f"""WITH RECURSIVE {_COSINE}, e AS (SELECT a, b FROM p WHERE c >= 0.4 UNION ALL SELECT b, a FROM p WHERE c >= 0.4), cores AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) + 1 >= 3),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)), reach AS (SELECT id, id AS root FROM cores UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id), l AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)
SELECT id, cluster, TRUE AS core FROM l UNION ALL SELECT e.a, min(l.cluster), FALSE FROM e JOIN l ON l.id = e.b WHERE e.a NOT IN (SELECT id FROM cores) GROUP BY e.a""")
def dbscan_clusters(spark, sf_dir):
    return similarity.dbscan_vectors(table(spark, sf_dir, "embeddings"), 0.4)


@query("WITH p AS (SELECT x.label AS cluster, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) SELECT cluster::BIGINT AS cluster, round(avg(c), 5) AS avg_cosine, avg(c) >= 0.3 AS good FROM p GROUP BY cluster")
def cluster_quality(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = similarity.cluster_quality(v.select(F.col("label").cast("long").alias("cluster"), F.col("vec_id").alias("id")), v)
    return q.select("cluster", F.round("avg_cosine", 5).alias("avg_cosine"), (F.col("avg_cosine") >= 0.3).alias("good"))


@query()
def centroid_clusters(spark, sf_dir):
    """Order-dependent clustering, block by block of labels; sequential, so beyond SQL."""
    return similarity.centroid_clusters(table(spark, sf_dir, "embeddings"), F.col("label"), 0.75)


_SETS = r"""w AS (SELECT doc_id AS id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS n FROM documents), u AS (SELECT n, min(id) AS id FROM w GROUP BY n), t AS (SELECT id, n, string_split(n, ' ') AS w FROM u),
s AS (SELECT id, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [n] ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)] END)) AS item FROM t), z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2), j AS (SELECT a, b, shared::DOUBLE / (za.n + zb.n - shared) AS similarity FROM p JOIN z za ON za.id = a JOIN z zb ON zb.id = b)"""


def _sets(spark, sf_dir):
    """(id, shingles) of the first document of each normalised text, shingles as hashes; texts meet by digest, and move only where
    neither the first ones nor the others are few."""
    n = F.trim(F.regexp_replace(F.lower(F.col("text")), r"\s+", " "))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), n.alias("n")).where("id is not null")
    firsts = similarity.kept(rows.groupBy(F.sha2(F.col("n").cast("binary"), 256)).agg(F.min("id").alias("id")).select("id"), "first-texts")
    others = similarity.kept(rows.select("id").join(firsts, "id", "left_anti"), "other-texts")
    own = rows.join(F.broadcast(others), "id", "left_anti") if similarity.few(others) else rows.join(F.broadcast(firsts) if similarity.few(firsts) else firsts, "id", "left_semi")
    return own.select("id", F.transform(tx.shingles(F.col("n")), lambda x: F.xxhash64(x)).alias("shingles"))


@query(f"WITH {_SETS} SELECT a, b, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.7")
def jaccard_pairs(spark, sf_dir):
    """Pairs of distinct texts of all documents whose word shingles agree."""
    return similarity.jaccard_pairs(_sets(spark, sf_dir), 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def leader_clusters(spark, sf_dir):
    """Each distinct text joins the first leader it is like; a walk in order of ids."""
    return similarity.leader_clusters(_sets(spark, sf_dir), 0.7)


@query(f"""WITH {MESSAGES}, t AS (SELECT id, is_spam, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM messages WHERE is_spam IS NOT NULL), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
p AS (SELECT h.id, s.id AS other, count(*) AS c FROM t h JOIN t s ON h.t = s.t WHERE NOT h.is_spam AND s.is_spam GROUP BY 1, 2) SELECT p.id, round(max(c::DOUBLE / (a.n + b.n - c)), 6) AS similarity FROM p JOIN n a ON a.id = p.id JOIN n b ON b.id = p.other GROUP BY p.id ORDER BY max(c::DOUBLE / (a.n + b.n - c)) DESC, p.id LIMIT 3""")
def nearest_counterexample(spark, sf_dir):
    m = messages(spark, sf_dir)
    return similarity.nearest(m.where("not is_spam"), m.where("is_spam")).select("id", r6("similarity"))


# ---- operations -------------------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT max(ts) AS now FROM events) SELECT count(*) AS requests, round(avg(value), 6) AS avg_latency, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate FROM events, t WHERE ts >= now - INTERVAL 24 HOUR")
def request_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select("ts", F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"))
    return ops.request_stats(r, as_of(e, "ts")).select("requests", r6("avg_latency"), r6("error_rate"))


@query("SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS period, event_type, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2, 3")
def usage_by_period(spark, sf_dir):
    return ops.usage(table(spark, sf_dir, "events"), "week").withColumn("cost", F.round("cost", 4))


@query("SELECT coalesce(event_type, 'all') AS event_type, count(*) AS calls, round(sum(value), 3) AS cost FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-02' GROUP BY ROLLUP (event_type)")
def usage_report(spark, sf_dir):
    import datetime as dt

    return ops.usage_report(table(spark, sf_dir, "events"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)).withColumn("cost", F.round("cost", 3))


@query("""WITH s AS (SELECT event_id, sum(greatest(value, 0)) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)
SELECT event_id, round(spent, 4) AS spent, CASE WHEN spent >= 100 THEN 'exceeded' WHEN spent >= 80 THEN 'warning' ELSE 'ok' END AS state FROM s""")
def budget_alerts(spark, sf_dir):
    return ops.budgets(table(spark, sf_dir, "events"), 100.0).select("event_id", F.round("spent", 4).alias("spent"), "state")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) > 1 AS denied FROM events")
def rate_limit_1s(spark, sf_dir):
    return ops.rate_limit(table(spark, sf_dir, "events"), 1).select("event_id", "recent", "denied")


@query("WITH e AS (SELECT * FROM events WHERE event_type IN ('error', 'click')) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM e")
def burst_counts(spark, sf_dir):
    return ops.bursts(table(spark, sf_dir, "events"), F.col("event_type").isin("error", "click"), 10, 3600).select("event_id", "recent")


@query("WITH k AS (SELECT event_id, ts, sha256(user_id || ':' || event_type) AS request_key FROM events) SELECT event_id, request_key, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY request_key ORDER BY ts, event_id)) < 3600000000, FALSE) AS repeated FROM k")
def idempotency_ttl(spark, sf_dir):
    e = ops.idempotent(table(spark, sf_dir, "events"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return e.select("event_id", "request_key", "repeated")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_ratio FROM events GROUP BY 1")
def error_ratio_5m(spark, sf_dir):
    return ops.windowed(table(spark, sf_dir, "events"), "5 minutes").withColumn("error_ratio", F.round("error_ratio", 6))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) > 0.05 AS breach FROM events GROUP BY 1)
SELECT start, breach, sum(breach::INT) OVER (ORDER BY start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS firing FROM w""")
def alert_firing_1h(spark, sf_dir):
    w = ops.windowed(table(spark, sf_dir, "events"), "1 hour")
    return ops.firing(w, F.col("error_ratio") > 0.05, 2).select("start", "breach", "firing")


@query("""WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0])::DOUBLE AS le UNION ALL SELECT NULL) SELECT event_type, le, count(*) FILTER (le IS NULL OR value <= le) AS n FROM events, b GROUP BY event_type, le""")
def histogram_buckets(spark, sf_dir):
    return ops.histogram(table(spark, sf_dir, "events"), [1.0, 5.0, 10.0, 50.0, 100.0]).select("event_type", "le", "n")


@query("WITH l AS (SELECT coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000, FALSE) AS hit FROM events) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS hit_rate FROM l")
def cache_hit_rate(spark, sf_dir):
    return ops.cache_stats(table(spark, sf_dir, "events"), "user_id", 7_200_000_000).withColumn("hit_rate", F.round("hit_rate", 6))


@query("""WITH e AS (SELECT event_id, ts, user_id, row_number() OVER (ORDER BY ts, event_id) AS p FROM events), l AS (SELECT *, lag(p) OVER w AS q, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY p)),
h AS (SELECT l.event_id, l.gap < 7200000000 AND (SELECT count(DISTINCT r.user_id) FROM e r WHERE r.p > l.q AND r.p < l.p) < 20 AS hit FROM l)
SELECT event_id, coalesce(hit, FALSE) AS hit FROM h""")
def cache_of_twenty(spark, sf_dir):
    """Lookups of users in a cache that holds the twenty last ones for two hours."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return ops.cache_hits(e, "user_id", 7_200_000_000, 20).select("event_id", "hit")


@query("WITH t AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, t WHERE ts < now - INTERVAL 2 DAY")
def retention_cleanup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ops.older_than(e, as_of(e, "ts"), 2).select("event_id")


@query("SELECT source AS namespace, toxic::BIGINT AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def training_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("namespace"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("namespace", F.col("toxic").cast("long").alias("label")).agg(F.count("*").alias("n"))
