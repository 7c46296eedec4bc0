"""Mixing sources to target weights by nested hash thresholds found in histograms, without a sort of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm import common

HASH_BITS = 60
STEP_BITS = 12


def _hash(doc_id: str = "doc_id") -> Column:
    """60 bits of the md5 of the id's digits (of the empty text for a null id)."""
    digits = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(digits.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _source_key() -> Column:
    """Sorts like the source by code point, null last; never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(skey, source_size, target) of sizes(skey, size): weights repeat over the sources in order; each target is
    level * weight, or limit * source_size where that is less, at the level whose targets sum to share * all sizes.

    The level is found in one pass over the sources in the order of limit * size / weight, those that stop first first. That
    is one task over one row a source, after their sizes have been summed: right for sources that a person can weigh, some
    hundred thousand at the most.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # Up to the first source that its level leaves below its stop, every source stops.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "skey", "level"))).over(every)["level"]
    target = F.least(F.coalesce(level * F.col("weight"), F.col("most")), F.col("most"))
    return per.select("skey", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """(skey, source_size, target, copies, threshold) of sized(skey, size, h): a document is taken `copies` times, once
    more if its hash is at most the threshold.

    What is left of a target after whole copies is a budget. Tokens are summed by source and hash bucket; buckets are
    taken whole until one passes the budget; only that one is split into finer buckets, until it has one hash, which is
    taken if at least half of it fits. Documents of one hash (repeated ids) are taken together.
    """
    source = targets(sized, weights, share, limit)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    source = source.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    source = common.saved(source, "mix-sources")
    open_ = source.select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    closed = None
    for done in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        bucket = F.shiftright("h", HASH_BITS - done)
        inside = sized.join(open_, "skey").where(F.shiftright("h", HASH_BITS - done + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy("skey", "budget", "before", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"), F.min("h").alias("low"), F.max("h").alias("high"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("skey").orderBy("bucket")))
        crossing = sums.where(F.col("upto") > F.col("budget"))
        crossing = crossing.groupBy("skey", "budget").agg(F.min(F.struct("bucket", "upto", "tokens", "low", "high")).alias("b")).select("skey", "budget", "b.*")
        crossing = common.saved(crossing.withColumn("before", F.col("upto") - F.col("tokens")), "mix-crossing")
        fits = F.col("before") + F.col("tokens") / F.lit(2.0) <= F.col("budget")
        found = crossing.where("low = high").select("skey", F.when(fits, F.col("high")).otherwise(F.col("low") - 1).alias("threshold"))
        closed = found if closed is None else closed.unionByName(found)
        open_ = crossing.where("low < high").select("skey", "budget", F.col("bucket").alias("prefix"), "before")
        if open_.isEmpty():
            break
    # Nothing is left of a target that whole copies reach: not even documents without words are taken once more.
    threshold = F.when((F.col("copies") > 0) & (F.col("budget") <= 0), F.lit(-1)).otherwise(F.coalesce("threshold", F.lit((1 << HASH_BITS) - 1)))
    out = source.join(closed, "skey", "left").select("skey", "source_size", "target", "copies", threshold.alias("threshold"))
    return common.saved(out, "mix-thresholds")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long")
    return docs.select("doc_id", _source_key().alias("skey"), size.alias("size"), _hash().alias("h"))


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs(doc_id, text, source).

    size: words; null texts have 0. A null source is a source of its own, the last. taken = size * copies. An empty table
    gives no rows, a source without words the target 0. Repeated rows each count and are taken alike.
    """
    sized = common.saved(_sized(docs), "mix-sizes")
    joined = sized.join(thresholds(sized, weights, share, limit), "skey")
    copies = F.col("copies") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) that the mix takes, each as often as it is taken, with the columns of docs.

    A row comes out `limit` times at the most. Null and empty texts have no words: they are taken as often as the whole of
    their source, once if it has no word at all. A null source is the last; null ids share one hash; repeated rows are
    taken alike; an empty table gives none.
    """
    skey, copies, threshold, copy = (common.free(docs.columns, x) for x in ("_skey", "_copies", "_threshold", "_copy"))
    chosen = thresholds(common.saved(_sized(docs), "mix-sizes"), weights, share, limit).select(F.col("skey").alias(skey), F.col("copies").alias(copies), F.col("threshold").alias(threshold))
    rows = docs.withColumn(skey, _source_key()).join(chosen, skey)
    times = (F.col(copies) + F.when(_hash() <= F.col(threshold), 1).otherwise(0)).cast("int")
    return rows.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op3_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, size, source_size, target, taken, copies."""
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT skey, source_size, ((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM per),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.0::DOUBLE - coalesce(sum(most) OVER o, 0.0::DOUBLE))
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0.0::DOUBLE)) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT level AS lv FROM l WHERE level * weight <= most ORDER BY most / weight, skey LIMIT 1),
t AS (
  SELECT skey, source_size, least(coalesce((SELECT lv FROM one) * weight, most), most) AS target FROM l),
c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS n FROM t),
s AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.n, c.target - c.n * c.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.skey, d.h) AS tied
  FROM d JOIN c USING (skey))
SELECT doc_id, size, source_size, target,
       (size * (n + CASE WHEN n > 0 AND budget <= 0 THEN 0 WHEN upto <= budget OR (upto - tied) + tied / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken,
       (n + CASE WHEN n > 0 AND budget <= 0 THEN 0 WHEN upto <= budget OR (upto - tied) + tied / 2.0 <= budget THEN 1 ELSE 0 END)::BIGINT AS copies
FROM s
"""
