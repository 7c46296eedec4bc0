"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 31


def usable_labels(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(doc_id, label) of labels that may be learned from: 0 or 1; a document with several takes the greatest; null labels and
    ids are left out."""
    rows = labels.where(usable & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.where("label in (0, 1)")


def checked() -> Column:
    """A fifth of all ids, by hash: these are never trained on, but used to choose cuts."""
    return F.pmod(F.shiftright(F.xxhash64("doc_id"), 33), F.lit(5)) == 0


def chosen(counts: dict[int, int], per_class: int) -> Column:
    """A condition on (doc_id, label): about per_class rows of each label, by a hash of the id below a threshold."""
    most = F.lit(0).cast("long")
    for k, n in counts.items():
        most = F.when(F.col("label") == k, F.lit(_SPAN if n <= per_class else int(_SPAN * per_class / n))).otherwise(most)
    return F.xxhash64("doc_id").bitwiseAND(_SPAN - 1) < most


def class_counts(known: DataFrame) -> dict[int, int]:
    return {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """About per_class rows of docs for each of the labels 0 and 1, with the label as `label`; and how many each label has.

    usable: a condition on doc_id; other labels are never read. The sample is the same in every run, and its ids, a few
    thousand at most, are broadcast: docs are read once and not shuffled.
    """
    known = usable_labels(labels, label, usable)
    counts = class_counts(known)
    return docs.drop("label").join(F.broadcast(known.where(chosen(counts, per_class))), "doc_id"), counts
