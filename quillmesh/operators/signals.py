"""Signals of labelled messages: what repeats in spam, and which of it is safe to make rules of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import packs
from quillmesh.functions import text as tx
from quillmesh.operators.evaluation import _around
from quillmesh.session import kept

# Words too common to be patterns alone.
COMMON_WORDS = (
    "now", "buy", "sell", "click", "here", "the", "a", "an", "is", "are", "was", "were", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "can", "may", "might", "must", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "work", "job", "money", "earn", "free", "offer", "deal", "sale", "discount", "price", "cost", "pay", "paid", "payment", "card", "bank",
    "call", "contact", "visit", "website", "link", "download", "open", "see", "view", "read", "check", "look", "watch", "show", "get",
    "take", "give", "make", "find", "use", "try", "start", "stop", "go", "come", "know", "think", "want", "need", "like", "time", "day",
    "week", "month", "year", "today", "tomorrow", "good", "bad", "new", "old", "big", "small", "high", "low", "first", "last", "next",
    "previous", "more", "less", "many", "few",
)
# Endings that are no domain of their own.
BARE_DOMAINS = (".com", ".org", ".net", ".ru", ".io")


def top(counts: DataFrame, k: int, key: str = "key", count: str = "cnt") -> DataFrame:
    """The k most counted keys; ties by key."""
    return counts.orderBy(F.desc(count), F.asc(key)).limit(k)


def counted(rows: DataFrame, keys: Column, kind: str, per_message: int | None = None) -> DataFrame:
    """(signal_type, key, cnt) of an array of keys per message, the first per_message of each."""
    some = keys if per_message is None else F.slice(keys, 1, per_message)
    return rows.select(F.explode(some).alias("key")).groupBy("key").agg(F.count("*").alias("cnt")).select(F.lit(kind).alias("signal_type"), "key", "cnt")


def url_counts(spam: DataFrame) -> DataFrame:
    return counted(spam, tx.urls(F.col("text")), "url", 3)


def phone_counts(spam: DataFrame) -> DataFrame:
    return counted(spam, tx.phones(F.col("text")), "phone", 2)


def tag_counts(spam: DataFrame) -> DataFrame:
    """Messages by name of what the commercial pack finds in them."""
    return counted(spam, F.transform(packs.commercial(F.col("text")), lambda x: x["name"]), "tag")


def signals(spam: DataFrame) -> DataFrame:
    """All of the above in one pass over the messages."""
    text = F.col("text")
    one = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("signal_type"), k.alias("key")))
    every = F.concat(one("url", F.slice(tx.urls(text), 1, 3)), one("phone", F.slice(tx.phones(text), 1, 2)), one("tag", F.transform(packs.commercial(text), lambda x: x["name"])))
    return spam.select(F.explode(every).alias("s")).groupBy("s.signal_type", "s.key").agg(F.count("*").alias("cnt"))


def signature_clusters(spam: DataFrame, least: int = 5, examples: int = 5) -> DataFrame:
    """Messages with one signature, from `least` on: signature, cnt and the texts (of 200 characters) of the first ids.

    Signatures are made once and written, with the texts' beginnings. Each row has its place among those of its signature, of
    which Spark keeps the first few a task before it shuffles; sizes are counted on the map side. No group is gathered.
    """
    rows = kept(spam.select("id", F.substring("text", 1, 200).alias("example"), tx.signature(F.col("text")).alias("signature")), "signatures")
    counts = rows.groupBy("signature").agg(F.count("*").alias("cnt"), F.min("id").alias("first_id")).where(F.col("cnt") >= least)
    firsts = examples_of(rows, "signature", "id", examples).groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("place", "example"))).alias("e"))
    return counts.join(firsts.select("signature", F.col("e.example").alias("examples")), "signature")


def suspicious(counts: DataFrame, total_spam: Column, threshold: float, minimum: int = 1) -> DataFrame:
    """Signals by share of spam messages, the best threshold part of them (one at least), with their score; equal shares by the
    md5 of the key, then of its type.

    The cut is found from counts of counts, and among equals from the digests around it, so no task sorts all signals.
    """
    digest = F.md5(F.concat_ws(" ", "key", "signal_type").cast("binary"))
    scored = kept(counts.withColumn("score", F.try_divide(F.col("cnt").cast("double"), total_spam)).withColumn("_at", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")), "signals")
    take = max(minimum, int(scored.count() * threshold))
    sizes = scored.groupBy("cnt").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("cnt"))) - F.col("n")  # a row a distinct count
    cut = sizes.withColumn("above", above).where(F.col("above") < take).orderBy("cnt").limit(1).first()
    if cut is None:
        return scored.drop("_at")
    equal, left = scored.where(F.col("cnt") == cut.cnt), take - cut.above
    out = scored.where(F.col("cnt") > cut.cnt)
    if left >= cut.n:
        out = out.unionByName(equal)
    else:
        last = _around(equal, [], "_at", left / cut.n).where((F.col("_after") < left) & (F.col("_upto") >= left)).first()
        out = out.unionByName(equal.where(F.col("_at") <= last._v))
    return out.drop("_at")


def messages_with(messages: DataFrame, needles: DataFrame, keys: Column, tags: Column | None = None) -> DataFrame:
    """Messages that carry a key of needles(key): keys are exploded and met by equality, not by a scan for each pattern."""
    every = keys if tags is None else F.concat(keys, tags)
    found = messages.select("id", F.explode(F.array_distinct(every)).alias("key")).join(needles.select("key"), "key", "left_semi").select("id").distinct()
    return messages.join(found, "id", "left_semi")


def bucket_tags(text: Column) -> Column:
    """Tags of a missed message: its length and what it carries."""
    n, f = F.length(text), tx.features(text)
    tests = [
        F.when(n < 20, "very_short"), F.when((n >= 20) & (n < 50), "short"), F.when(n > 500, "very_long"), F.when(f["urls"] > 0, F.concat(F.lit("urls_"), f["urls"].cast("string"))),
        F.when(f["phones"] > 0, F.concat(F.lit("phones_"), f["phones"].cast("string"))), F.when(f["emoji_count"] > 3, "many_emoji"), F.when(f["caps_ratio"] > 0.3, "high_caps"),
        F.when(f["exclamation"] > 2, "many_exclamations"), F.when(f["question"] > 2, "many_questions"),
    ]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def missed_buckets(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Tags of the spam that no rule has found, with how many messages have them: found(id) are the messages that one has."""
    missed = messages.where("is_spam").join(found.select("id").distinct(), "id", "left_anti")
    return counted(missed, bucket_tags(F.col("text")), "bucket")


def analyzer_keys(text: Column) -> Column:
    """Keys of the report analyzer: each pattern found and each nonzero count."""
    keys = lambda f: F.concat(F.transform(f["reasons"], lambda x: F.concat(F.lit("rule:"), x)), F.transform(f["marks"], lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))))
    return tx.let(packs.reasons_and_marks(text), keys)


def bigrams(text: Column) -> Column:
    pairs = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return tx.let(tx.words(F.lower(text)), pairs)


def common_bigrams(messages: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    pairs = messages.select(F.explode(bigrams(F.col("text"))).alias("key")).groupBy("key").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    return top(pairs, most)


def safer_phrases(spam: DataFrame, keyword: str, least: int = 3) -> DataFrame:
    """Phrases of the words around a keyword, most common first."""

    def around(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: F.contains(s["w"], F.lit(keyword)))
        return F.transform(at, lambda s: F.array_join(F.slice(w, F.greatest(F.lit(1), s["i"]), F.when(s["i"] == 0, 2).otherwise(3)), " "))

    rows = spam.where(F.contains(F.lower("text"), F.lit(keyword))).select(F.explode(tx.let(tx.words(F.lower(F.col("text"))), around)).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("cnt")).where((F.col("cnt") >= least) & (F.size(tx.words(F.col("key"))) >= 2))
    return top(counts, 10)


def keyword_safe(keyword: Column, spam: Column, ham: Column, total_spam: Column, total_ham: Column) -> Column:
    """Not a common word, three letters at least; ten times as frequent in spam as in ham; in 5 % of spam."""
    share, other = F.try_divide(spam.cast("double"), total_spam), F.try_divide(ham.cast("double"), total_ham)
    return ~F.lower(keyword).isin(*COMMON_WORDS) & (F.length(keyword) >= 3) & ((ham == 0) | (share >= 10 * other)) & (share >= 0.05)


def url_safe(url: Column, spam: Column, ham: Column) -> Column:
    """Seen three times, not a bare domain ending, and five times as often in spam as in ham."""
    return (spam >= 3) & ~F.lower(url).isin(*BARE_DOMAINS) & ((ham == 0) | (spam >= 5 * ham))


def phrase_safe(phrase: Column, spam: Column, ham: Column, total_spam: Column, total_ham: Column) -> Column:
    """Of two words, not all of them common; five times as often in spam as in ham; in 3 % of spam. One word: keyword_safe."""
    w = F.split(F.lower(phrase), " ")
    many = ~F.forall(w, lambda x: x.isin(*COMMON_WORDS)) & ((ham == 0) | (spam >= 5 * ham)) & (F.try_divide(spam.cast("double"), total_spam) >= 0.03)
    return F.when(F.size(w) < 2, keyword_safe(phrase, spam, ham, total_spam, total_ham)).otherwise(many)


def url_candidates(counts: DataFrame, threshold: float = 0.4, most: int = 10) -> DataFrame:
    """URLs worth a rule: not of trusted domains; suspicious ones, or others seen ten times."""
    kind, confidence = tx.domain_class(F.col("key"), threshold)
    rows = counts.withColumn("reputation", kind).withColumn("confidence", confidence)
    return top(rows.where((F.col("reputation") == "suspicious") | ((F.col("reputation") == "legitimate") & (F.col("cnt") >= 10))), most)


def examples_of(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group and task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= n)
