"""Media columns: magic bytes found by Aho-Corasick, formats confirmed by their structure, embedded media carved."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common

UNKNOWN = "application/octet-stream"


def _wav(data: bytes, at: int, seen: Seen) -> int | None:
    if data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    place, seen = at + 12, set()
    while place + 8 <= end <= len(data):
        name, size = struct.unpack_from("<4sI", data, place)
        seen.add(name)
        place += 8 + size + size % 2
    return end - at if place == end and {b"fmt ", b"data"} <= seen else None


def _png(data: bytes, at: int, seen: Seen) -> int | None:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, place)
        if first and name != b"IHDR" or place + 12 + size > len(data):
            return None
        if zlib.crc32(data[place + 4 : place + 8 + size]) != struct.unpack_from(">I", data, place + 8 + size)[0]:
            return None
        place, first = place + 12 + size, False
        if name == b"IEND":
            return place - at
    return None


class Seen:
    """What the checks of one payload have learnt: places of marks, found once, and where chains of sub-blocks end. So many
    magic bytes in a payload cost one search of it, not one each."""

    def __init__(self, data: bytes):
        self.data, self.places, self.ends = data, {}, {}

    def first(self, mark: bytes, at: int) -> int:
        """The first place of mark from `at` on; -1 if there is none."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        found = self.places[mark]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def chain(self, at: int) -> int:
        """The place after the empty sub-block that ends the chain from `at` on."""
        way = []
        while at < len(self.data) and self.data[at] and at not in self.ends:
            way.append(at)
            at += self.data[at] + 1
        end = self.ends.get(at, at + 1)
        self.ends.update(dict.fromkeys(way, end))
        return end


def _gif(data: bytes, at: int, seen: Seen) -> int | None:
    if at + 13 > len(data):
        return None
    place = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    images = 0
    while place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return place + 1 - at if images else None
        if kind == 0x21:
            place = seen.chain(place + 2)
        elif kind == 0x2C and place + 10 < len(data):
            flags = data[place + 9]
            place = seen.chain(place + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
            images += 1
        else:
            return None
    return None


def _jpeg(data: bytes, at: int, seen: Seen) -> int | None:
    place = at + 2
    while place + 4 <= len(data):
        if data[place] != 0xFF or data[place + 1] < 0xC0:
            return None
        kind, size = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        place += 2 + size
        if kind == 0xDA:  # after a scan's header comes coded data: up to a marker that is neither stuffing nor a restart
            while (place := data.find(b"\xff", place)) >= 0 and place + 1 < len(data):
                if data[place + 1] == 0xD9:
                    return place + 2 - at
                if data[place + 1] == 0 or 0xD0 <= data[place + 1] <= 0xD7:
                    place += 2
                else:
                    break
            if place < 0:
                return None
    return None


def _bmp(data: bytes, at: int, seen: Seen) -> int | None:
    if at + 26 > len(data):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", data, at + 2)
    return size if zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(data) - at else None


def _gzip(data: bytes, at: int, seen: Seen) -> int | None:
    unzip = zlib.decompressobj(31)
    place = at
    try:
        while not unzip.eof:
            part = data[place : place + 65536]
            if not part:
                return None
            unzip.decompress(part)
            place += len(part)
    except zlib.error:
        return None
    return place - len(unzip.unused_data) - at


def _pdf(data: bytes, at: int, seen: Seen) -> int | None:
    if not data[at + 5 : at + 6].isdigit():
        return None
    end, start = seen.first(b"%%EOF", at), seen.first(b"startxref", at)
    return end + 5 - at if end > 0 and 0 <= start <= end - 9 else None


#: The formats' magic bytes and registered media types, each with its check of structure and length.
FORMATS: dict[bytes, tuple[str, Callable[[bytes, int, Seen], int | None]]] = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"%PDF-": ("application/pdf", _pdf),
}


class Sniffer:
    """find(data): the confirmed media in data, outermost first: (type, offset, length)."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic in FORMATS:
            self.automaton.add_word(magic.decode("latin-1"), magic)
        self.automaton.make_automaton()

    def find(self, data: bytes) -> list[tuple[str, int, int]]:
        out, seen = [], Seen(data)
        for last, magic in self.automaton.iter(data.decode("latin-1")):
            at = last + 1 - len(magic)
            kind, check = FORMATS[magic]
            try:
                length = check(data, at, seen)
            except (struct.error, IndexError):
                length = None
            if length:
                out.append((kind, at, length))
        return sorted(out, key=lambda x: (x[1], -x[2]))

    def sniff(self, data: bytes | None, declared: str | None) -> dict:
        """media_type: of the media that fills data from its start, else the declared type if no format here claims it, else
        UNKNOWN. corrected: whether that differs from the declared type. trailing: bytes after it. embedded: other media."""
        found = self.find(data or b"")
        own = found[0] if found and found[0][1] == 0 else None
        known = {x for x, _ in FORMATS.values()}
        kind = own[0] if own else declared if declared and declared not in known else UNKNOWN
        return {"media_type": kind, "confirmed": own is not None, "corrected": kind != (declared or UNKNOWN), "trailing": len(data or b"") - own[2] if own else 0, "embedded": [{"type": k, "offset": a, "length": n} for k, a, n in found[1 if own else 0 :]]}


SNIFFED = "media_type string, confirmed boolean, corrected boolean, trailing long, embedded array<struct<type: string, offset: long, length: long>>"
_SNIFFERS: list[Sniffer] = []


def sniffer() -> Sniffer:
    if not _SNIFFERS:
        _SNIFFERS.append(Sniffer())
    return _SNIFFERS[0]


def sniff(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """df with the columns of SNIFFED for each row's media and declared type; null media are empty and of unknown type.

    Columns of df with those names are replaced.
    """

    @F.pandas_udf(SNIFFED)
    def run(blobs, types):  # noqa: ANN001
        import pandas as pd

        rows = [sniffer().sniff(b, t) for b, t in zip(blobs, types)]
        return pd.DataFrame(rows, columns=["media_type", "confirmed", "corrected", "trailing", "embedded"])

    names = ("media_type", "confirmed", "corrected", "trailing", "embedded")
    seen = common.free(df.columns, "_sniffed")
    out = df.withColumn(seen, run(F.col(media), F.col(declared).cast("string")))
    return out.withColumns({n: F.col(seen)[n] for n in names}).drop(seen)


def carve(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, type, offset, media) of every medium embedded in the media of df, cut out; overlapping ones each."""
    found = sniff(df.select(key, F.col(media).alias("media"), F.lit(None).cast("string").alias("declared")))
    one = found.select(key, "media", F.explode("embedded").alias("e"))
    return one.select(key, "e.type", "e.offset", F.substring("media", F.col("e.offset").cast("int") + 1, F.col("e.length").cast("int")).alias("media"))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples in a WAV file."""
    pad = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def wav_samples(data: bytes) -> bytes:
    """The samples of a confirmed WAV file."""
    place = 12
    while data[place : place + 4] != b"data":
        size = struct.unpack_from("<I", data, place + 4)[0]
        place += 8 + size + size % 2
    size = struct.unpack_from("<I", data, place + 4)[0]
    return data[place + 8 : place + 8 + size]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media) of docs(doc_id, text), written to the shared folder and read back: each text's
    UTF-8, with zero bytes up to a positive multiple of 64, as 8-bit samples. Null texts are empty; other columns are
    ignored. The type is declared as unknown, as a crawl would."""

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch, "text", 8 << 20):
                part = batch.slice(a, b - a)
                raw = part.column("text").cast(pa.large_binary()).to_pylist()
                media = [to_wav(x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))) for x in raw]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(map(len, raw), pa.int64()), "declared": [UNKNOWN] * len(raw), "media": pa.array(media, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return common.saved(common.map_texts(rows, run, "doc_id long, n_bytes long, declared string, media binary"), "media", "zstd")


_FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_embedded long"


def describe(stored: DataFrame) -> DataFrame:
    """What the stored bytes of store() hold, from the bytes themselves; see _FIELDS. The samples lie where the sniffer
    confirmed the WAV structure; feature gives the corrected type, samples, peak, crossings of the middle and embedded media."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, declared, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "media"))):
                seen = sniffer().sniff(media, declared)
                if seen["media_type"] != "audio/wav":
                    raise ValueError(f"stored media of document {doc_id} are damaged")
                payload = wav_samples(media)
                wave = np.frombuffer(payload, np.uint8)
                side = wave >= 128
                feature = f"{seen['media_type']};samples={len(wave)};peak={int(wave.max())};mean={wave.mean():.3f};crossings={int((side[1:] != side[:-1]).sum())};embedded={','.join(x['type'] for x in seen['embedded'])}"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, seen["media_type"], seen["corrected"], len(seen["embedded"])))
            names = [x.strip().split(" ")[0] for x in _FIELDS.split(",")]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.bool_() if n == "corrected" else pa.string() if n in ("payload_sha256", "media_sha256", "feature", "media_type") else pa.int64()) for i, n in enumerate(names)})

    return common.map_texts(stored, run, _FIELDS)


def op6_signature_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, stored as 8-bit samples and read back: see _FIELDS."""
    return describe(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
