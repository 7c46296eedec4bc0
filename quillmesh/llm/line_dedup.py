"""Repeated lines: two Bloom filters find the keys that may repeat; only those are shuffled, counted and taken out."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = common.SPACE_CHARS.encode()
_PROBES = 4
_BITS_A_KEY = 16
_SHARD_KEYS = 500_000
_MOST_BYTES = 64 << 20  # of all twice-seen filters together, which every task holds
_NO_ID = -(1 << 63)


def keys_of(text: bytes, least_chars: int) -> set[bytes]:
    """The distinct keys of a text in UTF-8: lines stripped of white space, A-Z in lower case, of at least so many code points."""
    out = set()
    for line in set(text.split(b"\n")):
        key = line.strip(_SPACES).lower()
        if len(key) >= 4 * least_chars or len(key) >= least_chars and len(key.decode()) >= least_chars:
            out.add(key)
    return out


def key_of(line):
    """The same key as a column."""
    return F.translate(F.btrim(line, F.lit(common.SPACE_CHARS)), UPPER, LOWER)


def places(hashes: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The bits of each hash in a filter of `bits` bits, a power of two; folded filters keep them."""
    first = hashes.astype(np.uint64)
    step = (first >> np.uint64(32)) | np.uint64(1)
    mask = np.asarray(bits, np.uint64) - np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)) & np.atleast_1d(mask)[:, None]).astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


class SeenTwice:
    """A once-seen and a twice-seen Bloom filter of one shard's hashes; what the first may hold already goes into the second."""

    def __init__(self, keys: int):
        self.bits = 1 << max(10, int(keys * _BITS_A_KEY - 1).bit_length())
        self.once, self.twice = np.zeros(self.bits, bool), np.zeros(self.bits, bool)
        self.held = 0

    def add(self, hashes: np.ndarray, repeated: np.ndarray) -> None:
        hashes, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
        again = np.bincount(inverse, weights=repeated, minlength=len(hashes)) + n > 1
        at = places(hashes, self.bits)
        again |= self.once[at].all(axis=1)
        self.once[at] = True
        self.twice[at[again]] = True
        self.held += int(again.sum())

    def packed(self, most_bytes: int, least_bits: int = 128) -> bytes:
        """The twice-seen filter, folded in halves as long as that leaves enough bits for each key that it holds, and to
        at most most_bytes."""
        twice = self.twice
        while len(twice) // 2 >= max(least_bits, self.held * _BITS_A_KEY) or len(twice) > max(least_bits, 8 * most_bytes):
            twice = twice[: len(twice) // 2] | twice[len(twice) // 2 :]
        return np.packbits(twice, bitorder="little").tobytes()


def _hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """(hash, repeated) of the keys of docs, once for each batch; repeated where two documents of the batch hold it."""
    from xxhash import xxh64_intdigest

    def run(batches):
        for batch in batches:
            own = [np.fromiter(map(xxh64_intdigest, keys), np.uint64) for x in batch.column("text") if (keys := keys_of(x.as_py().encode(), least_chars))]
            found, n = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": found.view(np.int64), "repeated": n > 1})

    return common.map_texts(docs.select("text"), run, "hash long, repeated boolean")


def twice_seen(hashes: DataFrame, most_bytes: int = 64 << 20) -> list[bytes]:
    """The twice-seen filters of hashes(hash, repeated) by shard, of at most `most_bytes` together.

    Hashes go to shards of about half a million; a task streams its shards one after the other, and once-seen filters never
    leave it. A filter above its shard's part of the bound is folded further: it then suspects more keys, and misses none.
    """
    total = hashes.count()
    shards = min(1 << 20, max(64, -(-total // _SHARD_KEYS)))
    keys = -(-total // shards)

    def mark(batches):
        for batch in batches:
            own = shard_of(batch.column("hash").to_numpy(), shards)
            yield pa.RecordBatch.from_pydict({"shard": own, "hash": batch.column("hash"), "repeated": batch.column("repeated")})

    def build(batches):
        at, now = -1, None
        for batch in batches:
            shard, h, again = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "hash", "repeated"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and shard[a] != at:
                    if now:
                        yield done(at, now)
                    at, now = int(shard[a]), SeenTwice(keys)
                if b > a:
                    now.add(h[a:b], again[a:b])
        if now:
            yield done(at, now)

    def done(shard, filters):
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "bits": pa.array([filters.packed(most_bytes // shards)], pa.binary())})

    dealt = hashes.mapInArrow(mark, "shard int, hash long, repeated boolean").repartition("shard").sortWithinPartitions("shard")
    out = [bytes(16)] * shards
    for row in common.saved(dealt.mapInArrow(build, "shard int, bits binary"), "lines-filters").toLocalIterator():
        out[row.shard] = bytes(row.bits)
    return out


class Screen:
    """All shards' filters in one array of bits; tells which hashes may have been seen twice."""

    def __init__(self, filters: list[bytes]):
        sizes = np.array([len(x) for x in filters], np.int64)
        self.starts, self.bits, self.shards = np.cumsum(sizes) - sizes, sizes * 8, len(filters)
        self.all = np.frombuffer(b"".join(filters), np.uint8)

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        shard = shard_of(hashes, self.shards)
        at = places(hashes, self.bits[shard])
        return ((self.all[self.starts[shard][:, None] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _suspects(docs: DataFrame, filters: list[bytes], least_chars: int) -> DataFrame:
    """(id, digest) of the keys of docs(id, text) that may be in several documents; digest is the key's SHA-256, cut to 16 bytes."""
    from xxhash import xxh64_intdigest

    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        screen = Screen(held.value)
        for batch in batches:
            ids, digests = [], []
            for id_, x in zip(batch.column("id").to_pylist(), batch.column("text")):
                keys = list(keys_of(x.as_py().encode(), least_chars))
                if keys:
                    again = screen.may_repeat(np.fromiter(map(xxh64_intdigest, keys), np.uint64, len(keys)))
                    found = [sha256(keys[i]).digest()[:16] for i in np.flatnonzero(again).tolist()]
                    ids += [id_] * len(found)
                    digests += found
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary())})

    return common.map_texts(docs, run, "id long, digest binary")


def repeated_keys(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, most_bytes: int = 64 << 20) -> DataFrame:
    """(id, digests) of every document of docs(doc_id, text) that loses lines, with the keys that it loses.

    A key of at least so many code points that at least so many documents hold stays in the one of the largest id. Rows of
    one id are one document; a null id is one document too, smaller than all others (id is the least long for it).
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), common.text_or_empty().alias("text"))
    filters = twice_seen(common.saved(_hashes(texts, least_chars), "lines-hashes"), most_bytes)
    pairs = _suspects(texts, filters, least_chars).groupBy("digest", "id").agg(F.lit(1).alias("one")).select("digest", "id")
    pairs = common.saved(pairs, "lines-suspects")
    groups = common.saved(pairs.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= least_docs), "lines-groups")
    lost = common.join_groups(pairs.withColumn("key", F.hex("digest")), groups.select(F.hex("digest").alias("key"), "n", "keep"), "key", "n", ["id", "digest"])
    return common.saved(lost.where("id <> keep").groupBy("id").agg(F.collect_list("digest").alias("digests")), "lines-lost")


def without_repeats(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """The rows of docs, all columns, their text without the lines that repeat elsewhere (see repeated_keys), and with n_lines,
    the lines before, and n_dropped, those taken out, under free names.

    Lines end at \\n alone; null and empty texts are one empty line and come out as empty. A text that loses all its lines is
    empty. Repeated rows are treated alike and come out repeated; an empty table gives no rows.
    """
    own, lost, lines, kept = (common.free(docs.columns, x) for x in ("_id", "_lost", "_lines", "_kept"))
    n_lines, n_dropped = (common.free(docs.columns, x) for x in ("n_lines", "n_dropped"))
    found = repeated_keys(docs.select("doc_id", "text"), least_chars, least_docs).select(F.col("id").alias(own), F.col("digests").alias(lost))
    joined = docs.join(found, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col(own), "left")

    def stays(line):
        key = key_of(line)
        return (F.length(key) < least_chars) | ~F.array_contains(lost, F.substring(F.unhex(F.sha2(key.cast("binary"), 256)), 1, 16))

    split = F.split(common.text_or_empty(), "\n", -1)
    out = joined.withColumn(lines, F.size(split).cast("long")).withColumn(kept, F.when(F.col(lost).isNotNull(), F.filter(split, stays)))
    text = F.when(F.col(lost).isNull(), common.text_or_empty()).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.col(lines) - F.size(kept)).cast("long")
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col(lines).alias(n_lines), dropped.alias(n_dropped))


def op11_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
k AS (SELECT r, doc_id, line, i, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM e),
g AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keep IS NOT NULL AND keep <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep IS NULL OR keep = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g ON g.key = k.key GROUP BY k.r, k.doc_id
"""
