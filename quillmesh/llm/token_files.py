"""Token ids of a corpus as Re-Pair grammar files in ascending document order, and their reading."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm import common, repair, tokens

_FILES = "part long, shard long, n_docs long, n_tokens long, n_bytes long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_tokens: int = 2_000_000, known_words: int = 160_000) -> DataFrame:
    """Writes grammar shards of docs(doc_id, text) below folder; returns one row a file: part, shard, n_docs, n_tokens, n_bytes.

    Null texts are empty and give the end id alone; null ids come first; repeated rows are written each; other columns
    are ignored. tokenizer: an installed file's name, or a path; any BPE file of at most 50,400 ids. Files are named by part and shard in document order, so a repeated task replaces its own files. A
    document longer than shard_tokens makes a longer shard: memory is bounded by the longest document. known_words: words
    whose ids a worker keeps.
    """
    place = tokens.installed(tokenizer) if "/" not in tokenizer else tokenizer

    def encode(batches):
        memo, files, part = tokens.memo(place, known_words), common.TaskFiles(folder), TaskContext.get().partitionId()
        held: list[tuple] = []
        shard = tokens_held = 0

        def flush():
            nonlocal shard, tokens_held
            doc_ids, ids, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            tokens_held = 0
            data = repair.pack(part, shard, doc_ids, ids, counts)
            files.put(f"{part:06d}-{shard:06d}.repair", data)
            shard += 1
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard - 1], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)], "n_bytes": [len(data)]})

        for batch in batches:
            for a, b in common.slices(batch, "text", 4 << 20):
                rows = batch.slice(a, b - a)
                ids, counts = memo.ids(rows.column("text"))
                ends = np.cumsum(counts)
                held.append((rows.column("doc_id").fill_null(repair.NULL_ID).to_numpy(zero_copy_only=False), np.insert(ids, ends, end_id), counts + 1))
                tokens_held += len(held[-1][1])
                if tokens_held >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.saved(common.map_texts(ordered, encode, _FILES), "token-files")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row a document from the files themselves: doc_id, start (tokens of all documents before), n_tokens, ids_crc32,
    n_symbols (of the compressed form). files: what write() returned; an empty table gives no rows."""
    schema = "part long, shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long, n_symbols long"
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")

    def decode(batches):
        for batch in batches:
            for data in batch.column("content"):
                s = repair.Shard(data.as_py())
                ids, ends = s.all().astype("<u4"), np.cumsum(s.counts)
                starts = ends - s.counts
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(s.counts)
                yield pa.RecordBatch.from_pydict({"part": np.full(n, s.part), "shard": np.full(n, s.shard), "doc_id": pa.array(s.doc_ids, mask=s.doc_ids == repair.NULL_ID), "local_start": starts, "n_tokens": s.counts, "ids_crc32": pa.array(crc, pa.int64()), "n_symbols": np.diff(s.starts)})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.repair").load(folder).select("content").mapInArrow(decode, schema)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("part_start"))
    bases = files.join(parts, "part").select("part", "shard", (F.col("part_start") + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("base"))
    return rows.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")


def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, encoded, written as grammar files and read back: doc_id, start, n_tokens, ids_crc32, n_symbols."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.new_folder(spark, "repair")
    return read(spark, folder, write(docs, folder, "byte_bpe_50k.json"))
