"""Ranked lexical search: item tiles times document impact tiles as dense matrices, exact in float64, and the best k of each item."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm import common

#: Bytes of UTF-8 that are part of a term (A-Z in lower case), all others blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EXACT = 1 << 53  # below this, float64 holds every integer
_ITEMS, _COLUMNS, _DOCS = 256, 2048, 512  # sides of the tiles
_LAST = (1 << 63) - 1  # stands for a null id: after all others


def terms(text: str) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case."""
    return text.encode().translate(_TERMS).split()


def passes(items: DataFrame, most: int = 2000, most_bytes: int = 8 << 20) -> Iterator[list[tuple[int | None, str]]]:
    """The rows of items(item_id, text) in lists of so many rows and bytes at the most (a longer text alone): what is
    broadcast in one pass over the documents."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), common.text_or_empty()).toLocalIterator():
        n = len(row[1].encode())
        if held and (len(held) == most or size + n > most_bytes):
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield held


def profiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of docs(doc_id, text): the number of terms, and those of the vocabulary with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = held.value
        for batch in batches:
            sizes, ids, tfs, ends = [], [], [], [0]
            for x in batch.column("text"):
                words = terms(x.as_py())
                count = Counter(words)
                found = sorted((known[w], count[w]) for w in count.keys() & known.keys()) if len(count) < len(known) else sorted((i, count[w]) for w, i in known.items() if w in count)
                sizes.append(len(words))
                ids += [i for i, _ in found]
                tfs += [c for _, c in found]
                ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "ids": pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), "tfs": pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return common.map_texts(texts, run, "doc_id long, n long, ids array<int>, tfs array<int>")


def blocks(counts: list[dict[int, int]], weights: np.ndarray, limit: int = _EXACT) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Vocabulary tiles of a tile of items: (term ids, entries (item, column, count)).

    Columns hold a term each, at most 2,048 a tile, and as few that no item's sum over a tile can reach `limit`: an impact is
    below 1,000,000 times its term's weight. A term that occurs too often in an item for one tile is in several.
    """
    by_term: dict[int, list[tuple[int, int]]] = {}
    for item, own in enumerate(counts):
        for term, n in own.items():
            by_term.setdefault(term, []).append((item, n))
    out: list[tuple[np.ndarray, list[tuple[int, int, int]]]] = []
    columns, entries, room = [], [], [limit - 1] * len(counts)
    for term in sorted(by_term):
        each = max(1, 1_000_000 * int(weights[term]))
        left = by_term[term]
        while left:
            if len(columns) == _COLUMNS or any(room[item] < min(n, (limit - 1) // each) * each for item, n in left):
                out.append((np.array(columns), entries))
                columns, entries, room = [], [], [limit - 1] * len(counts)
            rest = []
            for item, n in left:
                now = min(n, room[item] // each)
                room[item] -= now * each
                entries.append((item, len(columns), now))
                if n > now:
                    rest.append((item, n - now))
            columns.append(term)
            left = rest
    return [*out, (np.array(columns), entries)] if columns else out


def impacts(tfs: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) in 64-bit integers."""
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


class Best:
    """The k best (score, id) of each item so far; equal scores by ascending id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[item - first, document]; what ties with the k-th stays until ids decide."""
        least = self.least[first : first + len(scores)]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        item, score, id_ = (np.concatenate(x) for x in ((self.item, item + first), (self.score, scores[item, doc]), (self.id, ids[doc])))
        order = np.lexsort((id_, -score, item))
        item, score, id_ = item[order], score[order], id_[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        place = np.arange(len(item)) - np.repeat(starts, np.diff([*starts, len(item)]))
        self.item, self.score, self.id = (x[place < self.k] for x in (item, score, id_))
        kth = place == self.k - 1
        self.least[item[kth]] = score[kth]


def _scores(sparse: DataFrame, counts: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item in each task."""
    tiles = [(at, len(part := counts[at : at + _ITEMS]), blocks(part, weights)) for at in range(0, len(counts), _ITEMS)]
    held = sparse.sparkSession.sparkContext.broadcast((tiles, weights, len(counts)))

    def run(batches):
        tiles, weights, n_items = held.value
        best = Best(n_items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS):
                part = batch.slice(at, _DOCS)
                doc = pc.fill_null(part.column("doc_id"), _LAST).to_numpy()
                m = np.array([25 + 75 * n * n_docs // n_terms for n in part.column("n").to_pylist()], np.int64)
                row = np.repeat(np.arange(len(doc)), pc.list_value_length(part.column("ids")).to_numpy())
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("ids", "tfs"))
                value = impacts(tf, weights[term], m[row])
                for first, size, own in tiles:
                    total = np.zeros((size, len(doc)), np.int64)
                    for columns, entries in own:
                        place = np.full(len(weights), -1, np.int64)
                        place[columns] = np.arange(len(columns))
                        mine = place[term] >= 0
                        if not mine.any():
                            continue
                        d = np.zeros((len(columns), len(doc)))
                        d[place[term[mine]], row[mine]] = value[mine]
                        q = np.zeros((size, len(columns)))
                        i, c, n = np.array(entries).T
                        q[i, c] = n
                        total += (q @ d).astype(np.int64)
                    best.add(first, total, doc)
        yield pa.RecordBatch.from_pydict({"item": best.item, "doc_id": pa.array(best.id, mask=best.id == _LAST), "score": best.score})

    return sparse.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): of all docs(doc_id, text), the k best for each of items(item_id, text), ranked from 1;
    equal scores by ascending doc_id. See the README for the score.

    Items are a query set: each pass over the documents takes some 2,000. Tasks read their documents once, keep the counts of
    the items' terms, and later multiply them in tiles; each hands on k rows an item at the most. Null texts have no
    terms, and documents without terms count nowhere; null ids come last among equal scores. Repeated rows are documents, and
    repeated items items, of their own. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    for own in passes(items):
        texts = [Counter(terms(text)) for _, text in own]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*texts)))}
        counts = [{vocabulary[w]: n for w, n in x.items()} for x in texts]
        sparse = common.saved(profiles(docs, vocabulary).where("n > 0"), "rank-profiles")
        n_docs, n_terms = sparse.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = sparse.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect()  # one row a term of the vocabulary
        weights = np.zeros(len(vocabulary), np.int64)
        for id_, df in held:
            weights[id_] = floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))
        rows = _scores(sparse, counts, weights, n_docs, n_terms, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = rows.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(own)], "item long, item_id long")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_blocked_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for every benchmark item: item_id, rank, doc_id, score."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_SQL_TERMS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, {_SQL_TERMS} AS term FROM d),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM s),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term),
i AS (SELECT item_id, item, term, count(*) AS q FROM (SELECT item_id, row_number() OVER () AS item, text FROM benchmark) b, LATERAL (SELECT {_SQL_TERMS} AS term) GROUP BY ALL),
p AS (
  SELECT item, item_id, f.r, f.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN s ON s.r = f.r, a GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
