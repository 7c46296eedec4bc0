"""SimHash near-duplicates: fingerprints, exact Hamming links through pigeonhole blocks, and their components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmesh.llm import common
from quillmesh.llm.components import components


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text in UTF-8: majority bits of XXH64 over its word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # on bytes: A-Z, and white space of \x20 and \x09-\x0D alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(parts))
    n = len(parts) - width + 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65_280):
        spans = zip(starts[at : min(n, at + 65_280)].tolist(), ends[at + width - 1 : min(n, at + 65_280) + width - 1].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text), fp a signed long; null texts are empty, whose fingerprint is 0."""

    def run(batches):
        for batch in batches:
            coded = batch.column("text").cast(pa.large_binary()).dictionary_encode()  # a text that repeats is hashed once
            own = np.fromiter((fingerprint(x.as_py(), words) for x in coded.dictionary), np.uint64, len(coded.dictionary))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": own.view(np.int64)[coded.indices.to_numpy()]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return common.map_texts(texts, run, "doc_id long, fp long")


def _masks(distance: int, blocks: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks - distance blocks: a close pair agrees on at least one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(x) for x in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(root, member) edges that connect distinct values wherever a chain of close pairs does."""
    out, rest = [], values
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= distance
            if near.any():
                found = rest[near].tolist()
                out += [(int(root), x) for x in found]
                front += [np.int64(x) for x in found]
                rest = rest[~near]
    return out


def _bucket_links(distance: int, most: int):
    """A pass over rows (unit, key, fp), sorted: edges of each (unit, key) bucket; a bucket above `most` comes out as its rows."""

    def passed(unit, key, fp):
        return pa.RecordBatch.from_pydict({"a": key, "b": fp, "unit": unit.astype(np.int32)})

    def bucket(unit, key, fp):
        same = (unit[1:] == unit[:-1]) & (key[1:] == key[:-1])
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        two = starts[sizes == 2]
        two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance]
        pairs: list[tuple[int, int]] = []
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if n <= most:
                pairs += _forest(np.unique(fp[s : s + n]), distance)
            else:
                yield passed(unit[s : s + n], key[s : s + n], fp[s : s + n])
        more = np.array(pairs, np.int64).reshape(-1, 2)
        ends = np.concatenate([np.stack([fp[two], fp[two + 1]], axis=1), more])
        yield pa.RecordBatch.from_pydict({"a": ends[:, 0].copy(), "b": ends[:, 1].copy(), "unit": np.full(len(ends), -1, np.int32)})

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        big = None  # the bucket that is being passed on
        for batch in batches:
            rows = [np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False)]) for old, c in zip(held, ("unit", "key", "fp"))]
            if big is not None:
                own = int(((rows[0] == big[0]) & (rows[1] == big[1])).sum())
                yield passed(*(x[:own] for x in rows))
                rows = [x[own:] for x in rows]
            if len(rows[0]):
                big = None
                last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
                cut = len(last) - int(last.sum())
                if cut:
                    yield from bucket(*(x[:cut] for x in rows))
                rows = [x[cut:] for x in rows]
                if len(rows[0]) > most:
                    big = (rows[0][0], rows[1][0])
                    yield passed(*rows)
                    rows = [x[:0] for x in rows]
            held = rows
        if len(held[0]):
            yield from bucket(*held)

    return run


def links(prints: DataFrame, distance: int = 4, blocks: int = 7, most: int = 4096) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of prints(fp) that connect what pairs of at most `distance`
    differing bits connect; no pair is lost and no bucket's pairs are all emitted.

    Fingerprints are split into `blocks`; a close pair agrees on some blocks - distance of them, so each fingerprint is
    keyed by every such choice. Buckets of up to `most` rows are linked in one task. Larger ones are dealt into chunks of
    half that, and each pair of chunks is its own task's work.
    """
    one_by_one = F.explode(F.array(*[F.struct(F.lit(i).alias("unit"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(distance, blocks))]))
    keyed = prints.select("fp", one_by_one.alias("k")).select("k.unit", "k.key", "fp")
    schema = "a long, b long, unit int"
    found = keyed.repartition("unit", "key").sortWithinPartitions("unit", "key").mapInArrow(_bucket_links(distance, most), schema)
    found = common.saved(found, "simhash-links")
    large = found.where("unit >= 0")
    edges = found.where("unit < 0").select("a", "b")
    if not large.isEmpty():
        sizes = common.saved(large.groupBy("unit", "a").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("chunks")), "simhash-large")
        mine = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")
        dealt = large.join(sizes, ["unit", "a"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        unit = F.xxhash64("unit", "a", F.least("mine", "other"), F.greatest("mine", "other"))
        dealt = dealt.select(F.lit(0).alias("unit"), unit.alias("key"), F.col("b").alias("fp")).repartition("key").sortWithinPartitions("key")
        more = dealt.mapInArrow(_bucket_links(distance, 1 << 40), schema)
        edges = edges.unionByName(more.where("unit < 0").select("a", "b"))
    return edges


def _components(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(fp, n, component_id, root) of every distinct fingerprint of prints(doc_id, fp): rows with it, the least id of its
    component (null if all are), and the component itself."""
    distinct = common.saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    member = common.saved(components(links(distinct.select("fp"), distance, blocks), "simhash-star"), "simhash-members")
    joined = common.saved(member.join(distinct, member.node == distinct.fp).select("node", "root", "rep"), "simhash-joined")
    named = joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    linked = common.join_groups(joined, common.saved(named, "simhash-named"), "root", "size", ["node"]).select(F.col("node").alias("fp"), "component_id", "root")
    every = distinct.join(linked, "fp", "left").select("fp", "n", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return common.saved(every, "simhash-every")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    component_id: the smallest doc_id reachable over links of at most `distance` differing bits, itself included.
    Texts without words have fingerprint zero and link like others. Null ids take part but never name a component unless
    all of its ids are null. Repeated rows come out repeated; an empty table gives no rows; other columns are ignored.
    """
    prints = common.saved(fingerprints(docs, words), "simhash-prints")
    out = common.join_groups(prints, _components(prints, distance, blocks), "fp", "n", ["doc_id"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the least of its component; ids are taken as unique. Rows are taken
    out by an anti-join on the ids that go, so documents are shuffled only if those are many.

    Rows of a null id go where their component has an id; of a component of null ids alone one row stays.
    """
    key = common.free(docs.columns, "_id")
    prints = common.saved(fingerprints(docs.select("doc_id", "text")), "simhash-prints")
    every = _components(prints, 4, 7)
    found = common.join_groups(prints.where("doc_id is not null"), every, "fp", "n", ["doc_id"])
    gone = common.saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "simhash-gone")
    out = docs.where("doc_id is not null").join(gone, F.col("doc_id") == F.col(key), "left_anti")
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return out
    fp, root = common.free(docs.columns, "_fp"), common.free(docs.columns, "_root")

    def run(batches):
        for batch in batches:
            own = [fingerprint((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield batch.append_column(fp, pa.array(np.array(own, np.uint64).view(np.int64)))

    known = every.where("component_id is null").select(F.col("fp").alias(fp), F.col("root").alias(root))
    rows = common.map_texts(nameless, run, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    return out.unionByName(rows.join(known, fp).dropDuplicates([root]).select(*docs.columns))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, fingerprint, component_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
