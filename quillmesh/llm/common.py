"""Shared folders, tables written between jobs, and files written by tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract here, and the words between them.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may leave the setting out (as tests do); a folder is then made for the session.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.sparkContext.setCheckpointDir(place)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], name: str) -> str:
    """A column name that none of columns has in any case: name, with underscores before it as needed."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, by: list[str], most: int = 1000) -> DataFrame:
    """rows with the columns of groups(key, size, ...) beside them, null where there is no group: a left join in which no key
    is hot. groups has one row a key; size is the key's number of rows.

    Fewer than `most` keys can hold more than a `most`-th of all grouped rows each: the groups of those alone are broadcast.
    Their rows then take part in the join of the others under keys that match nothing, dealt by a hash of the columns `by`.
    """
    others = [c for c in groups.columns if c != key]
    hot, cold, own = (free([*rows.columns, *others], x) for x in ("_hot", "_cold", "_own"))
    total = groups.agg(F.sum(size)).first()[0] or 0
    frequent = groups.where(F.col(size) * most > total).select(key, F.struct(*others).alias(hot))
    rare = groups.where(F.col(size) * most <= total).select(F.col(key).cast("string").alias(own), F.struct(*others).alias(cold))
    out = rows.join(F.broadcast(frequent), key, "left")
    spread = F.concat(F.lit("#"), F.xxhash64(*by).cast("string"))
    out = out.withColumn(own, F.when(F.col(hot).isNull(), F.col(key).cast("string")).otherwise(spread)).join(rare, own, "left")
    group = F.coalesce(hot, cold)
    return out.select(*rows.columns, *[group[c].alias(c) for c in others])


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with Arrow batches of at most some 8 MB: a task then holds a few batches beside its longest row,
    whatever the rows' sizes. The session's setting is lowered to that, never raised."""
    conf = df.sparkSession.conf
    if _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")) > 8 << 20:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    owner = uuid.uuid4().hex

    def bounded(batches):
        claim(owner)
        yield from run(batches)
        trim()

    return df.mapInArrow(bounded, schema)


#: What this worker process keeps between tasks, and the call of map_texts whose tasks have put it here.
KEPT: dict = {}
_OWNER: list[str] = []


def claim(owner: str) -> None:
    """Workers are used again, by later stages too: drops what another stage's tasks have kept."""
    if _OWNER != [owner]:
        KEPT.clear()
        _OWNER[:] = [owner]
        trim()


def trim() -> None:
    """Gives free memory back to the system, where the C library can: a worker may idle long between stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def _bytes(size: str) -> int:
    """Bytes of a setting such as 64m, 1gb or 4096."""
    digits = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    return int(digits.rstrip("kmgt")) << unit


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal digits; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


class TaskFiles:
    """Writes whole files from a task into a shared folder, each by a rename, so a repeated task replaces its own."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.path, recursive=True)

    def put(self, name: str, data) -> None:
        part = f"{self.path}/.{name}.{os.getpid()}.{uuid.uuid4().hex[:8]}"
        with self.fs.open_output_stream(part, compression=None) as out:
            out.write(data)
        self.fs.move(part, f"{self.path}/{name}")

    def get(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            f.seek(start)
            return f.read(length) if length is not None else f.read()


def slices(batch, column: str, most_bytes: int = 4 << 20):
    """Row ranges of an Arrow batch with about most_bytes of text each (a longer text alone)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most_bytes, side="right")))
        yield at, to
        at = to
