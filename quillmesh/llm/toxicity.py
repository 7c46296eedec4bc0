"""Toxicity scores by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common, labelled

CUT = 0.3
ROW_BITS = 17
HALF = 6
STEM = 5
WIDTHS = (1, 2, 3)
FILTERS = 6
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…“”’"


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (n, 2) of all words of the texts, one text after another, and where each text starts.

    Words are lower-case, without punctuation at their ends. The first row hashes the word, the second its first STEM
    letters, so that words meet in both rows only if they are alike.
    """
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    bounds = (words.offsets.to_numpy() - words.offsets[0].as_py()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    bare = [w.strip(_EDGE) for w in coded.dictionary.to_pylist()]
    mask = (1 << ROW_BITS) - 1
    rows = [[zlib.crc32(w.encode()) & mask for w in bare], [zlib.crc32(w[:STEM].encode()) & mask for w in bare]]
    return np.array(rows, np.int32).reshape(2, -1).T[coded.indices.to_numpy()], bounds


@dataclass
class Network:
    """Embeddings, filters by width, and the output layer; score() cuts at CUT where validation found it best."""

    table: np.ndarray  # (2, rows, HALF)
    kernels: dict[int, np.ndarray] = field(default_factory=dict)  # width: (width, 2 * HALF, FILTERS)
    biases: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray = None
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, bounds: np.ndarray, where: bool = False):
        """Max-pooled filter outputs of each text, and with `where` the places of the maxima."""
        n = len(bounds) - 1
        x = np.concatenate([self.table[0][rows[:, 0]], self.table[1][rows[:, 1]]], axis=1)
        x = np.concatenate([x, np.zeros((max(WIDTHS), x.shape[1]), np.float32)])
        own = np.repeat(np.arange(n), np.diff(bounds))
        values, places = [], []
        filled = np.flatnonzero(np.diff(bounds))
        for k in WIDTHS:
            y = x[: len(own)] @ self.kernels[k][0]
            for j in range(1, k):  # a window that reaches beyond its text's end sees nothing there
                inside = np.zeros(len(own), bool)
                inside[: len(own) - j] = own[j:] == own[: len(own) - j]
                y += (x[j : len(own) + j] * inside[:, None]) @ self.kernels[k][j]
            v = np.zeros((n, FILTERS), np.float32)
            if len(filled):
                v[filled] = np.maximum.reduceat(y, bounds[:-1][filled])
            values.append(v)
            if where:
                p = np.zeros((n, FILTERS), np.int64)
                for d in filled:
                    p[d] = bounds[d] + y[bounds[d] : bounds[d + 1]].argmax(0)
                places.append(p)
        pre = np.concatenate(values, axis=1) + np.concatenate([self.biases[k] for k in WIDTHS])
        return (pre, x, places) if where else pre

    def logits(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, bounds), 0) @ self.out[:-1] + self.out[-1]

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(*word_rows(texts)).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(docs: list[np.ndarray], y: np.ndarray) -> Network:
    """Embeddings whose first value is the smoothed log-odds of a row among toxic documents; the rest small and random."""
    rng = np.random.default_rng(5)
    table = (rng.standard_normal((2, 1 << ROW_BITS, HALF)) * 0.02).astype(np.float32)
    for half in range(2):
        seen = np.zeros((2, 1 << ROW_BITS))
        for rows, label in zip(docs, y):
            seen[label, np.unique(rows[:, half])] += 1
        odds = np.log((seen[1] + 0.5) / (seen[0] + 0.5)) - math.log(max(1.0, (y == 1).sum()) / max(1.0, (y == 0).sum()))
        sure = np.minimum(1.0, seen.sum(0) / 8)
        table[half, :, 0] = np.clip(odds * sure, -3, 3)
    net = Network(table)
    for k in WIDTHS:
        kernel = rng.standard_normal((k, 2 * HALF, FILTERS)).astype(np.float32) * 0.2
        kernel[0, 0, ::2] = kernel[0, HALF, ::2] = 0.7
        net.kernels[k] = kernel
        net.biases[k] = np.where(np.arange(FILTERS) % 2 == 0, -1.0, 0.0).astype(np.float32)
    net.out = np.concatenate([np.full(FILTERS * len(WIDTHS), 0.2, np.float32), [-1.0]]).astype(np.float32)
    return net


def fit(docs: list[np.ndarray], y: np.ndarray, prior: float, epochs: int = 8, batch: int = 32, rate: float = 0.02) -> Network:
    """A network trained on docs (rows of their words), by Adagrad on the log loss weighted to `prior`.

    One class alone gives a constant. Cuts are chosen by calibrate(), on other documents.
    """
    net = _start(docs, y)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out[-1] = 4 if len(y) and y[0] else -4
        return net
    rng = np.random.default_rng(11)
    learn = np.arange(len(docs))
    share = y.mean()
    weight = np.where(y == 1, max(prior, 0.15) / share, (1 - max(prior, 0.15)) / (1 - share))
    memory = {"table": np.full(net.table.shape[:2], 1e-2, np.float32), "out": np.full_like(net.out, 1e-2)}
    memory |= {("k", k): np.full_like(net.kernels[k], 1e-2) for k in WIDTHS} | {("b", k): np.full_like(net.biases[k], 1e-2) for k in WIDTHS}

    def step(key, value, grad):
        memory[key] += grad * grad
        value -= rate * grad / np.sqrt(memory[key])

    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            part = learn[at : at + batch]
            rows, bounds = _joined([docs[i] for i in part])
            pre, x, places = net.pooled(rows, bounds, where=True)
            act = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.out[:-1] + net.out[-1], -30, 30)))
            g = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
            back = g[:, None] * net.out[:-1] * (pre > 0)
            step("out", net.out, np.concatenate([act.T @ g, [g.sum()]]).astype(np.float32))
            ends = np.repeat(bounds[1:], FILTERS)
            touched, slopes = [], []
            for i, k in enumerate(WIDTHS):
                b = back[:, i * FILTERS : (i + 1) * FILTERS]
                step(("b", k), net.biases[k], b.sum(0))
                where, flat, f = places[i].ravel(), b.ravel(), np.tile(np.arange(FILTERS), len(part))
                grad = np.zeros_like(net.kernels[k])
                for j in range(k):
                    ok = (flat != 0) & (where + j < ends)
                    np.add.at(grad[j].T, f[ok], x[where[ok] + j] * flat[ok, None])
                    touched.append(where[ok] + j)
                    slopes.append(net.kernels[k][j].T[f[ok]] * flat[ok, None])
                step(("k", k), net.kernels[k], grad)
            touched, slopes = np.concatenate(touched), np.concatenate(slopes)
            for half in range(2):
                row, inverse = np.unique(rows[touched, half], return_inverse=True)
                grad = np.zeros((len(row), HALF), np.float32)
                np.add.at(grad, inverse, slopes[:, half * HALF : (half + 1) * HALF])
                memory["table"][half, row] += (grad * grad).sum(1)
                net.table[half, row] -= rate * grad / np.sqrt(memory["table"][half, row])[:, None]
    return net


STEP = 0.05  # width of a bin of logits


def calibrate(net: Network, seen: list[tuple], prior: float, least: int = 20) -> None:
    """The shift that makes CUT the score of best F1, and each language's own threshold of best F1.

    seen: (lang, label, bin, n) of documents that were not trained on, n of them with logits in STEP times [bin, bin + 1).
    prior: the share of label 1 among all. A language with fewer than `least` documents of either label has no own threshold:
    CUT counts there. Without both labels nothing is moved.
    """
    total = {k: sum(n for _, label, _, n in seen if label == k) for k in (0, 1)}
    if not total[0] or not total[1]:
        return
    weight = {1: prior / total[1], 0: (1 - prior) / total[0]}

    def best(rows: list[tuple]) -> float:
        z = np.array([STEP * (b + 0.5) for _, _, b, _ in rows])
        y = np.array([label for _, label, _, _ in rows], np.float64)
        return _best_cut(z, y, np.array([n * weight[label] for _, label, _, n in rows]))

    net.shift = math.log(CUT / (1 - CUT)) - best(seen)
    for lang in sorted({x[0] for x in seen if x[0] is not None}):
        own = [x for x in seen if x[0] == lang]
        if all(sum(n for _, label, _, n in own if label == k) >= least for k in (0, 1)):
            net.thresholds[lang] = float(1 / (1 + math.exp(-(best(own) + net.shift))))


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])


def _best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The middle of the cuts whose weighted F1 is within 0.01 of the best."""
    order = np.argsort(-z)
    z, y, w = z[order], y[order], w[order]
    ends = np.flatnonzero(np.append(z[1:] != z[:-1], True))
    hit, all_ = np.cumsum(y * w)[ends], np.cumsum(w)[ends]
    f1 = 2 * hit / (all_ + (y * w).sum())
    good = np.flatnonzero(f1 >= f1.max() - 0.01)
    return float((z[ends[good[0]]] + z[ends[min(good[-1] + 1, len(ends) - 1)]]) / 2)


def held_out():
    return F.pmod(common.crc_of_id(), F.lit(4)) == 2


def train(docs: DataFrame, known: DataFrame, per_class: int = 5000, most_words: int = 2500) -> tuple[Network, Column, float]:
    """A network from at most about per_class documents of each label of known(doc_id, label), of up to most_words words: at
    most 2 * per_class * most_words * 8 bytes of word rows, 200 MB, reach the driver. A fifth of all ids is never trained on.

    Also the condition on (doc_id, label) of what was trained on, and the share of label 1, 0.15 at least.
    """
    counts = labelled.class_counts(known)
    prior = max(0.15, counts.get(1, 0) / max(1, sum(counts.values())))
    trained = labelled.chosen(counts, per_class) & ~labelled.checked()
    rows = docs.select("doc_id", "text").join(F.broadcast(known.where(trained)), "doc_id")

    def words(batches):
        for batch in batches:
            for a, b in common.slices(batch, "text", 8 << 20):
                part = batch.slice(a, b - a)
                r, bounds = word_rows(part.column("text"))
                packed, short = r.astype("<i4").tobytes(), np.diff(bounds) <= most_words
                yield pa.RecordBatch.from_pydict({"label": part.column("label").filter(pa.array(short)), "rows": pa.array([packed[8 * i : 8 * j] for i, j, s in zip(bounds[:-1], bounds[1:], short) if s], pa.binary())})

    got = common.map_texts(rows.select("label", "text"), words, "label int, rows binary").toPandas()
    return fit([np.frombuffer(x, "<i4").reshape(-1, 2) for x in got.rows], got.label.to_numpy().astype(np.int64), prior), trained, prior


def logits(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang, logit) of every row of docs(doc_id, text[, lang])."""

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch, "text", 4 << 20):
                part = batch.slice(a, b - a)
                z = net.logits(*word_rows(part.column("text"))).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang": part.column("lang"), "logit": z})

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    return common.map_texts(texts, run, "doc_id long, lang string, logit double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) for every row of docs(doc_id, text[, lang]).

    predicted is score >= CUT; flagged is score >= threshold, the one calibrated for the row's language (CUT for others).
    Labels of documents whose crc32 of the id leaves 2 by 4 are never learned from. The network is trained on a bounded
    sample; the cuts come from all other usable labels, as counts by language, label and bin of the logit. Null texts score
    as empty ones, repeated rows alike; whole texts are scored. Without usable labels nothing is predicted toxic; an empty
    table gives no rows; other columns are ignored.
    """
    known = labelled.usable_labels(labels, "toxic", ~held_out())
    net, trained, prior = train(docs, known)
    rows = common.saved(logits(docs, net), "toxicity-logits")
    others = rows.select("doc_id", "lang", F.floor(F.col("logit") / STEP).alias("bin")).join(known.where(~trained), "doc_id")
    calibrate(net, [tuple(r) for r in others.groupBy("lang", "label", "bin").count().collect()], prior)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") + net.shift))))
    own = F.create_map(*[F.lit(x) for pair in net.thresholds.items() for x in pair])[F.col("lang")] if net.thresholds else F.lit(None)
    rows = rows.select("doc_id", held_out().alias("held_out"), score.alias("score"), F.coalesce(own, F.lit(CUT)).alias("threshold"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def op5_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, held_out, score, predicted, threshold, flagged."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
