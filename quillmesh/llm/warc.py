"""WARC archives: written by tasks, and read in byte ranges with boundary chains that are verified by pointer jumping.

A task that reads a range can't know whether a magic string in it starts a record or lies inside a payload. It emits every
candidate with the offset where the next record would start. Only candidates on the chain from the file's start are records:
inside a range each candidate is followed to where its chain leaves the range, and these hops are doubled over the ranges.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common

LEAST_REVISIT = 100
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = re.compile(rb"\x1f\x8b\x08")
_FILES = "file string, n_records long, n_bytes long"
_CANDIDATES = "file string, first long, offset long, next long, leaves long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers: bool, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record: a response, or a revisit of refers_to, whose block has the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers else b"response"), b"WARC-Record-ID: " + _name(page_id).encode(), b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    if refers:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _name(refers_to).encode()]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def decide(pages: DataFrame) -> DataFrame:
    """pages with payload, digest, revisit and refers_to: of equal payloads of at least LEAST_REVISIT bytes the smallest
    page_id is stored and the others revisit it. Repeated rows of that page_id are stored each. Rows with a null page_id
    revisit if any row of their group has an id. Only groups with copies are joined, so pages are shuffled only where
    those are many, and a payload that is on many pages is no hot key."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_ = F.octet_length("payload") >= LEAST_REVISIT
    groups = rows.where(long_).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    rows = common.join_groups(rows, common.saved(groups, "warc-copies"), "digest", "n", ["page_id", "url"])
    revisit = long_ & F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return rows.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("least")).alias("refers_to"))


def write(pages: DataFrame, folder: str, gzip: bool = True, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes pages(page_id, url, html) as archives below folder, one or more a task; a row a file: file, n_records, n_bytes.

    Null html is an empty payload, a null url has no header, a null page_id no number; repeated rows are written each; an
    empty table writes no file; other columns are ignored. A task holds one file of file_bytes and its longest page.
    """

    def run(batches):
        files, part = common.TaskFiles(folder), TaskContext.get().partitionId()
        held, size, n = [], 0, 0

        def flush():
            nonlocal held, size, n
            name = f"pages-{part:06d}-{n:05d}.warc{'.gz' if gzip else ''}"
            files.put(name, b"".join(held))
            out = pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(held)], "n_bytes": [size]})
            held, size, n = [], 0, n + 1
            return out

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "revisit", "refers_to"))):
                data = record(*x)
                if gzip:
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = pack.compress(data) + pack.flush()
                held.append(data)
                size += len(data)
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return common.saved(common.map_texts(decide(pages), run, _FILES), "warc-files")


class _Window:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, files: common.TaskFiles, name: str, start: int, length: int):
        self.files, self.name, self.start = files, name, start
        self.data = files.get(name, start, length)
        self.more = True

    def upto(self, end: int) -> None:
        while self.more and len(self.data) < end:
            part = self.files.get(self.name, self.start + len(self.data), max(1 << 20, end - len(self.data)))
            self.more = bool(part)
            self.data += part

    def upto_blank(self, at: int) -> None:
        """Until the blank line after `at` is in, however far it is."""
        self.upto(at + 65536)
        seen = at
        while self.data.find(b"\r\n\r\n", max(at, seen - 3)) < 0 and self.more:
            seen = len(self.data)
            self.upto(seen + max(1 << 20, seen - at))


def _parse(data: bytes, at: int = 0):
    """Fields and the end of the record that would start at `at`; the end is None if there is none."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or not _MAGIC.match(data, at):
        return {}, None, None
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return {}, None, None
        fields[key.strip().lower()] = value.strip()
    try:
        length = int(fields[b"content-length"])
    except (KeyError, ValueError):
        return {}, None, None
    return (fields, stop + 4, stop + 4 + length) if length >= 0 else ({}, None, None)


def _number(name: bytes | None):
    m = re.fullmatch(rb"<urn:x-page:(-?\d+)>", name or b"")
    return int(m[1]) if m else None


def _row(fields: dict, block: bytes, payloads: bool) -> dict:
    """A candidate's columns, from its headers and block. Payloads of revisits are null; their size is in the HTTP headers."""
    kind = fields.get(b"warc-type", b"").decode("latin-1")
    http, blank, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length: *(\d+)", http)
    own = kind != "revisit"
    return {
        "page_id": _number(fields.get(b"warc-record-id")), "url": fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None, "record_type": kind,
        "payload_bytes": len(payload) if own else int(m[1]) if m else None, "payload_digest": hashlib.sha256(payload).hexdigest() if own else fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:"),
        "refers_to": _number(fields.get(b"warc-refers-to")), "payload": payload if own and payloads and blank else None,
    }


def candidates(data: _Window, length: int, gzip: bool, payloads: bool = False):
    """(offset, next offset, columns) of everything that could be a record and starts in the window's first bytes."""
    at = 0
    while at < length:
        m = (_GZIP if gzip else _MAGIC).search(data.data, at, length + (2 if gzip else 9))
        if not m:
            return
        at = m.start()
        if at >= length:
            return
        if gzip:
            unzip, place, parts = zlib.decompressobj(31), at, []
            try:
                while not unzip.eof:
                    data.upto(place + 65536)
                    part = data.data[place : place + 65536]
                    if not part:
                        break
                    parts.append(unzip.decompress(part))
                    place += len(part)
                    if sum(map(len, parts[:1])) >= 10 and not _MAGIC.match(parts[0][:10]):
                        break
            except zlib.error:
                parts = []
            whole = b"".join(parts) if unzip.eof else b""
            fields, block, end = _parse(whole)
            if end is not None and len(whole) == end + 4:
                yield data.start + at, data.start + place - len(unzip.unused_data), _row(fields, whole[block:end], payloads)
        elif b"\r\n\r\n".endswith(data.data[max(0, at - 4) : at]):  # a record ends before it; so no header is searched twice
            data.upto_blank(at)
            fields, block, end = _parse(data.data, at)
            if end is not None:
                data.upto(end + 4)
                if data.data[end : end + 4] == b"\r\n\r\n":
                    yield data.start + at, data.start + end + 4, _row(fields, data.data[block:end], payloads)
        at += 1


def read(spark: SparkSession, folder: str, files: DataFrame, gzip: bool = True, range_bytes: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """The records of archives in folder; files: (file, n_bytes). One row a record: file, offset, page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload (null unless payloads).

    Memory of a task is bounded by its range and the longest record. No files give no rows. Bytes after a break in a file's
    chain are not reached: what follows a damaged record is left out, and where files have n_records, a file with another
    number of records raises ValueError.
    """

    def scan(batches):
        at = common.TaskFiles(folder)
        for batch in batches:
            for name, first, size in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "size"))):
                length = min(range_bytes, size - first)
                found = list(candidates(_Window(at, name, first, length + 65536), length, gzip, payloads))
                leaves: dict[int, int] = {}
                for offset, after, _ in reversed(found):  # where each chain leaves the range; -1: at no candidate in it
                    leaves[offset] = after if after >= first + length else leaves.get(after, -1)
                rows = [{"file": name, "first": first, "offset": o, "next": n, "leaves": leaves[o]} | x for o, n, x in found]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in shape.fields]))

    shape = spark.createDataFrame([], _CANDIDATES).schema
    ranges = files.select("file", F.col("n_bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n_bytes") - 1), F.lit(range_bytes).cast("long"))).alias("first"))
    tasks = files.agg(F.sum(F.ceil(F.col("n_bytes") / range_bytes))).first()[0] or 1  # a task a range: their rows are too few for AQE to tell
    found = common.saved(ranges.repartition(min(int(tasks), 100_000), "file", "first").mapInArrow(scan, shape), "warc-candidates", "zstd")
    entries = _reached(files, found, range_bytes)

    def walk(own: pa.Table, entry: pa.Table) -> pa.Table:
        """The places in one range that its reached entries lead to, step by step."""
        place = {o: i for i, o in enumerate(own.column("offset").to_pylist())}
        after = own.column("next").to_pylist()
        keep = []
        for at in entry.column("offset").to_pylist():
            while at in place:
                keep.append(place[at])
                at = after[place[at]]
        return own.take(pa.array(sorted(set(keep)), pa.int64())).select(["file", "offset"])

    ranged = entries.select("file", (F.col("offset") - F.col("offset") % range_bytes).alias("first"), "offset")
    narrow = found.select("file", "first", "offset", "next")
    records = common.saved(narrow.groupBy("file", "first").cogroup(ranged.groupBy("file", "first")).applyInArrow(walk, "file string, offset long"), "warc-records")
    if "n_records" in files.columns:
        counts = files.join(records.groupBy("file").agg(F.count("*").alias("n_read")), "file", "left")
        if short := counts.where("n_records <> coalesce(n_read, 0)").select("file", "n_records", "n_read").first():
            raise ValueError(f"{short.file} has {short.n_records} records, {short.n_read or 0} of them could be read")
    return found.join(records, ["file", "offset"], "left_semi").select(*[f.name for f in shape.fields if f.name not in ("first", "next", "leaves")])


def _reached(files: DataFrame, found: DataFrame, range_bytes: int) -> DataFrame:
    """(file, offset) of the candidates where a chain from a file's start enters a range, by doubling the hops."""
    most = files.agg(F.max("n_bytes")).first()[0] or 0
    into = found.select("file", F.col("leaves").alias("offset")).where("leaves >= 0").distinct()
    starts = files.select("file", F.lit(0).cast("long").alias("offset"))
    hops = found.select("file", "offset", "leaves").join(into.unionByName(starts).distinct(), ["file", "offset"], "left_semi")
    hops = common.saved(hops.select("file", "offset", F.col("leaves").alias("to")), "warc-hops")
    reached = starts
    for _ in range(max(0, -(-most // range_bytes) - 1).bit_length()):
        step = reached.join(hops, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = common.saved(reached.unionByName(step).distinct(), "warc-reached")
        twice = hops.withColumnRenamed("to", "mid").join(hops.select("file", F.col("offset").alias("mid"), "to"), ["file", "mid"])
        hops = common.saved(twice.select("file", "offset", "to"), "warc-hops")
    return reached


def op1_warc_boundary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = common.new_folder(spark, "warc")
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM m
"""
