"""Exact duplicates: fuse filters of an immutable snapshot screen a new batch; positives meet exact buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common, fuse

SPACES = r"[\x20\x09-\x0D]+"
_FILTERS = "bucket int, seed long, segment long, segments long, prints binary, buckets int, n_keys long"
_FEW = 100_000  # digests that are broadcast, some 10 MB at the most


def normal():
    """The text without the characters \\x20 and \\x09-\\x0D; null is empty."""
    return F.regexp_replace(common.text_or_empty(), SPACES, "")


def _key():
    """64 bits of a digest, for filters."""
    return F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")


def _bucket(buckets: int):
    return F.pmod(F.conv(F.substring("sha", 57, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def build_filters(digests: DataFrame, folder: str | None = None, bucket_keys: int = 500_000, least: int = 256) -> DataFrame:
    """A snapshot's filters, one a bucket of about bucket_keys digests(sha), written once to folder (a new one if None)."""
    buckets = max(least, -(-digests.count() // bucket_keys))

    def make(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        seed, segment, segments, data = fuse.build(keys)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "seed": [seed], "segment": [segment], "segments": [segments], "prints": pa.array([data], pa.binary()), "buckets": pa.array([buckets], pa.int32()), "n_keys": [len(keys)]})

    keyed = digests.select(_bucket(buckets).alias("bucket"), _key().alias("key"))
    made = keyed.groupBy("bucket").applyInArrow(make, _FILTERS)
    if folder is None:
        return common.saved(made, "dedup-filters")
    made.write.parquet(folder)
    return open_filters(digests.sparkSession, folder)


def open_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The filters that build_filters() wrote to folder, for another batch against the same snapshot."""
    return spark.read.schema(_FILTERS).parquet(folder)


def screen(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of digests(sha, ...) that the snapshot may hold: all that it holds, and about 1 in 256 others."""
    fields, buckets = digests.columns, filters.agg(F.max("buckets")).first()[0] or 1

    def pick(rows: pa.Table, made: pa.Table) -> pa.Table:
        if not made.num_rows or not rows.num_rows:
            return rows.select(fields).slice(0, 0)
        one = made.slice(0, 1).to_pylist()[0]
        keep = fuse.contains((one["seed"], one["segment"], one["segments"], one["prints"]), rows.column("key").to_numpy())
        return rows.select(fields).filter(pa.array(keep))

    keyed = digests.withColumn("bucket", _bucket(buckets)).withColumn("key", _key())
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(pick, digests.schema)


def _groups(rows: DataFrame) -> DataFrame:
    """(sha, size, best) of rows: best is the row that stays: most code points, then smallest id, then first row."""
    best = F.max(F.struct("length", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))
    return rows.groupBy("sha").agg(F.count("*").alias("size"), best.alias("best"))


def _collisions(texts: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Digests that stand for different normalised texts in texts(sha, normal): a comparison by bytes of every row whose
    digest is in doubtful(sha).

    Equal texts are made one inside each task first, so that no group of copies meets whole. Few digests are broadcast;
    beyond that all texts take part, for a join by digest would move as much.
    """
    if doubtful.limit(_FEW + 1).count() <= _FEW:
        texts = texts.join(F.broadcast(doubtful), "sha", "left_semi")
    return texts.groupBy("sha", "normal").count().groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")


def duplicates(snapshot: DataFrame, batch: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """One row for every row of both, of (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, in_snapshot.

    Texts are equal when identical without white space; null counts as empty. Digests of the snapshot go into static
    filters, or are in those of an earlier batch: filters, from open_filters(). The batch's duplicates are grouped by
    themselves, and each distinct digest of the batch is screened by the filters; those that pass join the snapshot's exact
    groups. Texts of every digest that stands for more than one row are then compared byte by byte; if digests ever
    collided, grouping would be done by the texts themselves. Exactly one row of a group is kept, of repeated rows the
    first; a null id stays only if all of its group's longest texts have null ids. Empty tables give no rows; other columns
    are ignored. Filters of another snapshot raise ValueError where the numbers of digests differ.
    """
    sides = snapshot.select("doc_id", "text", F.lit(True).alias("old")).unionByName(batch.select("doc_id", "text", F.lit(False).alias("old")))
    texts = sides.withColumn("normal", normal()).withColumn("sha", F.sha2(F.col("normal").cast("binary"), 256))
    row = F.monotonically_increasing_id()
    rows = common.saved(texts.select("doc_id", "sha", F.length(common.text_or_empty()).alias("length"), "old", row.alias("row")), "dedup-rows")
    old, new = common.saved(_groups(rows.where("old")), "dedup-old"), common.saved(_groups(rows.where("not old")), "dedup-new")
    if filters is None:
        filters = build_filters(old.select("sha"))
    elif (held := filters.agg(F.sum("n_keys")).first()[0] or 0) != (n := old.count()):
        raise ValueError(f"the filters hold {held} digests, the snapshot has {n}")
    passed = common.saved(screen(new.select("sha"), filters), "dedup-passed")
    other = old.select("sha", F.col("size").alias("old_size"), F.col("best").alias("old_best"))
    met = common.saved(new.join(passed, "sha", "left_semi").join(other, "sha"), "dedup-met")
    merged = met.select("sha", (F.col("size") + F.col("old_size")).alias("size"), F.greatest("best", "old_best").alias("best"))
    alone = old.unionByName(new).join(met.select("sha"), "sha", "left_anti")
    groups = common.saved(alone.unionByName(merged), "dedup-groups")
    key = "sha"
    if not _collisions(texts.select("sha", "normal"), groups.where("size > 1").select("sha")).isEmpty():
        rows = common.saved(texts.select("doc_id", "sha", "normal", F.length(common.text_or_empty()).alias("length"), "old", row.alias("row")), "dedup-by-text")
        own = rows.select(F.col("normal").alias("sha"), "doc_id", "length", "row")
        groups, key = common.saved(_groups(own).withColumnRenamed("sha", "normal"), "dedup-groups"), "normal"
    best = groups.select(key, F.col("size").alias("group_size"), F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"))
    joined = common.join_groups(rows, best, key, "group_size", ["row"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("old").alias("in_snapshot"))


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as a snapshot and a later batch, about half of the rows each; together they are all rows."""
    first = F.coalesce(F.xxhash64("doc_id").bitwiseAND(1), F.lit(0)) == 0
    return docs.where(first), docs.where(~first)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of equal texts.

    Ids whose rows all go are taken out by an anti-join, so documents are shuffled only if those are many. Only where an id
    has both kinds of rows (repeated rows) are texts' digests compared too. Null texts are empty; null ids are one id.
    """
    key, sha = common.free(docs.columns, "_id"), common.free(docs.columns, "_sha")
    found = duplicates(*halves(docs.select("doc_id", "text"))).select("doc_id", "text_sha256", "kept")
    pairs = common.saved(found.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("any"), F.bool_and("kept").alias("all")), "dedup-pairs")
    ids = common.saved(pairs.groupBy(F.col("doc_id").alias(key)).agg(F.bool_or("any").alias("any"), F.bool_and("all").alias("all")), "dedup-ids")
    dropped = common.saved(ids.where("not any").select(key), "dedup-gone")  # written alone, so that the planner knows its size
    out = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")
    if not ids.where("any and not all").isEmpty():
        gone = pairs.where("not any").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha + "_gone"))
        out = out.withColumn(sha, F.sha2(normal().cast("binary"), 256))
        same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(sha + "_gone"))
        out = out.join(gone, same, "left_anti").dropDuplicates(["doc_id", sha])
    return out.select(*docs.columns)


def op2_fuse_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, one half as the snapshot and one as the batch: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return duplicates(*halves(docs)).drop("in_snapshot")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
