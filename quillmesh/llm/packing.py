"""Cost-balanced packing of token pieces into sequences."""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common, tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double, row long"


def plan(sizes: np.ndarray, width: int, last: bool, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Pieces (document, start, length, sequence, offset, cost) of documents of these sizes, and what is left over: the
    documents with the place from which each is.

    A piece of n tokens costs linear * n + quadratic * n * n: attention stays inside a piece. Documents of a width and
    more first fill whole sequences. Of the rest, longest first, each goes to the lowest-cost sequence of those open whose
    remaining capacity holds it; where none has room, it is cut at the roomiest. Sequences are opened to hold the total
    rounded down to whole widths, so all are full at the end. What is over, the shortest documents and the end of one
    more, waits for the next call; or, if last, it goes into sequences whose lengths are descending powers of two.
    """
    out: list[tuple] = []
    n_seq = 0
    price = lambda n: linear * n + quadratic * n * n
    rest: list[tuple[int, int, int]] = []
    for d, size in enumerate(sizes.tolist()):
        whole = size // width
        for k in range(whole):
            out.append((d, k * width, width, n_seq + k, 0, price(width)))
        n_seq += whole
        if size % width:
            rest.append((size - whole * width, d, whole * width))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    left: list[tuple[int, int]] = []
    over = 0 if last else total % width
    total -= over
    while over:
        size, d, start = rest.pop()
        if size > over:  # its end waits; what stays is packed in its place by size
            bisect.insort(rest, (size - over, d, start), key=lambda x: (-x[0], x[1]))
            start += size - over
            size = over
        left.append((d, start))
        over -= size
    room = [width] * (total // width)
    tail = total % width
    while tail:
        room.append(1 << (tail.bit_length() - 1))
        tail -= room[-1]
    used, cost = [0] * len(room), [0.0] * len(room)
    # One heap by cost; sequences without room for a document are set aside until a shorter one comes.
    heap = [(0.0, s) for s in range(len(room))]
    aside: list[tuple[int, float, int]] = []
    for size, d, start in rest:
        while aside and -aside[0][0] >= size:
            _, c, s = heapq.heappop(aside)
            heapq.heappush(heap, (c, s))
        while heap and room[heap[0][1]] < size:
            c, s = heapq.heappop(heap)
            if room[s]:
                heapq.heappush(aside, (-room[s], c, s))
        pieces = []
        if heap:
            pieces.append((heapq.heappop(heap)[1], size))
        else:
            need = size
            while need:
                _, _, s = heapq.heappop(aside)
                pieces.append((s, min(need, room[s])))
                need -= pieces[-1][1]
        for s, n in pieces:
            out.append((d, start, n, n_seq + s, used[s], price(n)))
            start += n
            used[s] += n
            room[s] -= n
            cost[s] += price(n)
            if room[s]:
                heapq.heappush(heap, (cost[s], s))
    return out, left


_LEFT = PIECES + ", rest binary"


class _Block:
    """Documents, or what is left of them, that wait in a task; packed together when there are enough."""

    def __init__(self, width: int, base: int):
        self.width, self.next, self.size = width, base, 0
        self.meta: list[tuple] = []  # doc_id, place of the first id here, doc_tokens, row
        self.ids: list[np.ndarray] = []

    def add(self, meta: list[tuple], ids: list[np.ndarray]) -> None:
        self.meta += meta
        self.ids += ids
        self.size += sum(map(len, ids))

    def pack(self, last: bool) -> pa.RecordBatch:
        """The pieces of full sequences, of all if last; what is over stays here."""
        pieces, left = plan(np.fromiter(map(len, self.ids), np.int64, len(self.ids)), self.width, last)
        doc, start, length, seq, offset, cost = (list(x) for x in zip(*pieces)) if pieces else ([],) * 6
        views = [memoryview(x).cast("B") for x in self.ids]
        crc = [zlib.crc32(views[d][4 * a : 4 * (a + n)]) for d, a, n in zip(doc, start, length)]
        doc_id, first, whole, row = (list(x) for x in zip(*[self.meta[d] for d in doc])) if doc else ([],) * 4
        out = self._batch(doc_id, np.array(first, np.int64) + np.array(start, np.int64), length, crc, whole, np.array(seq, np.int64) + self.next, offset, cost, row, [None] * len(doc))
        self.next += max(seq, default=-1) + 1
        self.meta, self.ids = [(i, f + a, w, r) for (i, f, w, r), a in ((self.meta[d], a) for d, a in left)], [self.ids[d][a:].copy() for d, a in left]
        self.size = sum(map(len, self.ids))
        return out

    def rest(self) -> pa.RecordBatch:
        """What waits, as rows with their ids."""
        n = len(self.ids)
        doc_id, first, whole, row = (list(x) for x in zip(*self.meta)) if n else ([],) * 4
        return self._batch(doc_id, first, list(map(len, self.ids)), [0] * n, whole, [-1] * n, [0] * n, [0.0] * n, row, [x.tobytes() for x in self.ids])

    @staticmethod
    def _batch(doc_id, start, length, crc, whole, seq, offset, cost, row, rest) -> pa.RecordBatch:
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_pydict({"doc_id": long(doc_id), "start": long(start), "length": long(length), "ids_crc32": long(crc), "doc_tokens": long(whole), "sequence_id": long(seq), "offset": long(offset), "cost": pa.array(cost, pa.float64()), "row": long(row), "rest": pa.array(rest, pa.binary())})


def pack(docs: DataFrame, tokenizer: str, end_id: int, width: int = 4096, block_tokens: int = 1_500_000) -> DataFrame:
    """One row a piece of docs(doc_id, text): see PIECES; sequence_id is unique over the table, and so is row for each row
    of docs, so that pieces of repeated rows can be told apart.

    Each task tokenizes its documents and packs them block by block into full sequences. What a task has left, less than one
    sequence, is written with its ids, and about block_tokens of it at a time are packed together in a second pass, which
    alone has sequences of power-of-two lengths at its end: no sequence is padded. Texts are never shuffled. Null texts are
    empty and give the end id alone; null ids and repeated rows are packed like others; an empty table gives no pieces;
    other columns are ignored.
    """
    place = tokens.installed(tokenizer) if "/" not in tokenizer else tokenizer

    def first(batches):
        memo, part = tokens.memo(place), TaskContext.get().partitionId()
        block, rows = _Block(width, part << 36), part << 36
        for batch in batches:
            for a, b in common.slices(batch, "text", 3 << 20):
                own = batch.slice(a, b - a)
                ids, counts = memo.ids(own.column("text"))
                ends = np.cumsum(counts)
                each = np.split(np.insert(ids, ends, end_id).astype("<u4"), (ends + np.arange(1, len(ends) + 1))[:-1])
                block.add([(i, 0, len(x), rows + k) for k, (i, x) in enumerate(zip(own.column("doc_id").to_pylist(), each))], each)
                rows += len(each)
                if block.size >= block_tokens:
                    yield block.pack(False)
        yield block.pack(False)
        yield block.rest()

    def second(batches):
        block = _Block(width, TaskContext.get().partitionId() + (1 << 26) << 36)
        for batch in batches:
            block.add(list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "row")))), [np.frombuffer(x, "<u4") for x in batch.column("rest").to_pylist()])
            if block.size >= block_tokens:
                yield block.pack(False).drop_columns("rest")
        yield block.pack(True).drop_columns("rest")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    done = common.saved(common.map_texts(texts, first, _LEFT), "packed")
    left = done.where("rest is not null")
    buckets = max(1, (left.agg(F.sum("length")).first()[0] or 0) // block_tokens)
    tail = left.select("doc_id", "start", "doc_tokens", "row", "rest").repartition(buckets, "row").sortWithinPartitions("row")
    return done.where("rest is null").drop("rest").unionByName(common.map_texts(tail, second, PIECES))


def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents in sequences of at most 4096 tokens: a row a piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json", 2)
