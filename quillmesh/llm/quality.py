"""Quality scores learned from preference pairs by a Bradley-Terry model, with a threshold at a score quantile."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common, labelled

CUT = 0.3
RATES = ("bars", "shouts", "symbols", "capitals", "digits", "repeats", "old_lines", "stops", "word_length", "log_words")
WORDS = GRAMS = 256  # buckets of hashed words, and of hashed runs of three bytes
WIDTH = len(RATES) + WORDS + GRAMS
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~+=<>\\_{}[]", np.uint8))


def features(texts: pa.Array) -> np.ndarray:
    """WIDTH features of each whole text: RATES, then the square roots of the shares of its words (in lower case) and of its
    runs of three bytes by hash bucket. A row of zeros for an empty or null text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    distinct = words.flatten().dictionary_encode()
    coded = distinct.indices.to_numpy()
    again = np.concatenate([[False], coded[1:] == coded[:-1]]) if len(coded) else np.zeros(0, bool)
    out = np.zeros((len(texts), WIDTH), np.float32)
    bucket = np.fromiter((zlib.crc32(w.lower().encode()) % WORDS for w in distinct.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(distinct.dictionary))[coded]
    for i, x in enumerate(texts):
        raw = np.frombuffer(x.as_buffer(), np.uint8)
        if not len(raw):
            continue
        n = np.bincount(raw, minlength=256)
        a, b = bounds[i], bounds[i + 1]
        count = max(1, b - a)
        letters = max(1, n[65:91].sum() + n[97:123].sum())
        lines = x.as_py().split("\n")
        out[i, : len(RATES)] = (
            math.sqrt(n[124] / count), math.sqrt(n[33] / count), math.sqrt(n[_SYMBOLS].sum() / count), math.sqrt(n[65:91].sum() / letters),
            math.sqrt(n[48:58].sum() / len(raw)), math.sqrt(again[a + 1 : b].sum() / count), math.sqrt(1 - len(set(lines)) / len(lines)),
            math.sqrt((n[46] + n[44]) / count), min(4.0, len(raw) / count / 8), math.log1p(b - a) / 8,
        )
        out[i, len(RATES) : len(RATES) + WORDS] = np.sqrt(np.bincount(bucket[a:b], minlength=WORDS) / count)
        if len(raw) > 2:
            run = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)
            out[i, -GRAMS:] = np.sqrt(np.bincount((run >> np.uint32(24)).astype(np.int64), minlength=GRAMS) / len(run))
    return out


@dataclass
class Ranking:
    """score(features): sigmoid of the strength above the threshold, moved so that the threshold scores CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold + math.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, checked: np.ndarray, share: float, pairs: int = 40_000, rounds: int = 12, batch: int = 500, decay: float = 1e-3) -> Ranking:
    """Weights that maximise the likelihood of good documents beating bad ones over `pairs` random pairs, by Adagrad.

    checked: documents that are in no pair; they choose the threshold, if there are some of both labels. share: of good
    documents among all, which weigh the classes. The threshold is the score quantile, of the weighted documents, that parts
    good from bad with the least error; of a run of equally good quantiles the middle. With one class only, or none, all
    weights are zero: every document then scores above CUT if any was good, or if there was no label.
    """
    if not len(x):
        x = np.zeros((1, WIDTH), np.float32)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    scale[len(RATES) :] *= 6  # hashed features are many: each alone counts for less
    good, bad = np.flatnonzero((y == 1) & ~checked), np.flatnonzero((y == 0) & ~checked)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranking(mean, scale, weights, 1.0 if (y == 0).any() else -1.0)
    rng = np.random.default_rng(7)
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse, memory = rng.choice(good, pairs), rng.choice(bad, pairs), np.full_like(weights, 1e-2)
    for _ in range(rounds):
        for at in range(0, pairs, batch):
            d = z[better[at : at + batch]] - z[worse[at : at + batch]]
            lost = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
            step = (d * lost[:, None]).mean(0) - decay * weights
            memory += step * step
            weights += 0.05 * step / np.sqrt(memory)
    held = checked if 0 < y[checked].sum() < checked.sum() else ~checked
    s, y = z[held] @ weights, y[held]
    w = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    order = np.argsort(s)
    s, w, y = s[order], w[order], y[order]
    quantile = np.cumsum(w)
    cuts = np.interp(np.linspace(0, quantile[-1], 801), quantile, s)
    wrong = np.array([w[(s >= c) != (y == 1)].sum() for c in cuts])
    best = cuts[wrong <= wrong.min() + 1e-12]
    return Ranking(mean, scale, weights, float((best.min() + best.max()) / 2))


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = 4000) -> Ranking:
    """A ranking from at most about per_class labelled documents of each class; only their features, 2 kB each, reach the
    driver: 17 MB. A fifth of them is in no pair and chooses the threshold."""
    rows, counts = labelled.sample(docs.select("doc_id", "text"), labels, "quality", usable, per_class)
    rows = rows.select("label", labelled.checked().alias("checked"), "text")

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch, "text", 8 << 20):
                part = batch.slice(a, b - a)
                x = pa.array([r.tobytes() for r in features(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_pydict({"label": part.column("label"), "checked": part.column("checked"), "x": x})

    got = common.map_texts(rows, run, "label int, checked boolean, x binary").toPandas()
    x = np.frombuffer(b"".join(got.x), np.float32).reshape(len(got), WIDTH)
    return fit(x, got.label.to_numpy(np.int64), got.checked.to_numpy(bool), counts.get(1, 0) / max(1, sum(counts.values())))


def held_out():
    return F.pmod(common.crc_of_id(), F.lit(5)) == 0


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch, "text", 8 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": model.score(features(part.column("text")))})

    return common.map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Labels of documents whose crc32 of the id leaves 0 by 5 are never learned from. Null texts score as empty ones,
    repeated rows alike; a null id counts as the empty text there. Without usable labels every document is predicted good; an empty
    table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the model predicts good; scored where they are, without a shuffle."""
    model = train(docs, labels, ~held_out())

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch, "text", 8 << 20):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(features(part.column("text"))) >= CUT))

    return common.map_texts(docs, run, docs.schema)


def op8_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, held_out, score, predicted."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
