"""Scores against labels: confusion matrices, sweeps, percentiles, samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "accuracy": ratio(tp + tn, tp + fp + tn + fn)}


def confusion_at(scored: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, tp, fp, tn, fn, and the metrics) for each threshold, all in one scan without multiplying rows."""
    yes, no = F.col(label), ~F.col(label)
    aggs, rows = [], []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [F.count_if(hit & yes).alias(f"tp{i}"), F.count_if(hit & no).alias(f"fp{i}"), F.count_if(~hit & no).alias(f"tn{i}"), F.count_if(~hit & yes).alias(f"fn{i}")]
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")]))
    out = scored.where(yes.isNotNull()).agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumns(metrics(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))


def best_f1(sweep: DataFrame) -> DataFrame:
    """The lowest of the thresholds of best F1."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("t"), "precision", "recall")).alias("b")
    return sweep.agg(best).select((-F.col("b.t")).alias("threshold"), "b.f1", "b.precision", "b.recall")


def index_percentiles(rows: DataFrame, group: Sequence[str], value: str, order: Sequence[Column], last: int, points: Sequence[float]) -> DataFrame:
    """sorted[int(n * q)] over each group's last rows, its mean and maximum: ranks by window, no array of a group."""
    newest = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= last)
    w = Window.partitionBy(*group)
    ranked = newest.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    at = lambda q: F.max(F.when(F.col("_r") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(value)))
    return ranked.groupBy(*group).agg(*[at(q).alias(f"p{round(q * 100)}") for q in points], F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))


def _around(rows: DataFrame, group: Sequence[str], value: str, q: float, accuracy: int = 20_000) -> DataFrame:
    """Runs of equal values around the quantile q of each group: (group, _n, _v, _after, _upto), for the values that hold the
    places from _after + 1 to _upto of the _n sorted ones. Values must not be null.

    Spark's percentile sketch is off by at most n / accuracy places, so the quantile lies between the sketch's values a little
    below and above q; only distinct values between them are ranked by a window, and what lies below is counted. Groups of
    fewer than ten times accuracy rows are ranked whole.
    """
    at = lambda p: F.percentile_approx(value, F.lit(min(max(p, 0.0), 1.0)), F.lit(accuracy))
    small = F.count("*") < 10 * accuracy
    ends = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.when(small, F.min(value)).otherwise(at(q - 2 / accuracy)).alias("_lo"), F.when(small, F.max(value)).otherwise(at(q + 2 / accuracy)).alias("_hi"))
    near = rows.select(*group, F.col(value).alias("_v"))
    if group:
        ends = ends.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)})
        same = F.lit(True)
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        near = near.join(ends, same)
    else:
        near = near.crossJoin(F.broadcast(ends))  # one row
    runs = near.where("_v <= _hi").groupBy(*group, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("_v")))
    return runs.select(*group, "_n", "_v", (upto - F.col("_c")).alias("_after"), upto.alias("_upto"))


def exclusive_quantile(rows: DataFrame, group: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """The quantile at place (n + 1) q of the sorted values, between neighbours, within the ends; nulls don't count, and groups
    of one value have none."""
    runs = _around(rows.where(F.col(value).isNotNull()), group, value, q)
    place = (F.col("_n") + 1) * F.lit(q)
    low = F.least(F.greatest(F.floor(place), F.lit(1)), F.col("_n") - 1)
    runs = runs.withColumn("_low", low).withColumn("_part", place - low)
    at = lambda k: F.max(F.when((F.col("_after") < k) & (k <= F.col("_upto")), F.col("_v")))
    out = runs.where("_n > 1").groupBy(*group).agg(at(F.col("_low")).alias("_a"), at(F.col("_low") + 1).alias("_b"), F.max("_part").alias("_p"))
    return out.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_p")).alias(name))


def stratified(rows: DataFrame, stratum: str, per_class: int, key: str = "id") -> DataFrame:
    """per_class rows of each stratum, by the order of a hash of the key: the same in every run."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    return rows.withColumn("place", place).where(F.col("place") <= per_class)


def scenario(rows: DataFrame, n: int, spam_share: float) -> DataFrame:
    """n messages with a fixed share of spam."""
    spam = stratified(rows.where("is_spam"), "is_spam", int(n * spam_share))
    return spam.unionByName(stratified(rows.where("not is_spam"), "is_spam", n - int(n * spam_share)))


def chronological(rows: DataFrame, order: Sequence[str], parts: Sequence[tuple[str, float]] = (("train", 0.6), ("validation", 0.2), ("test", 0.2))) -> DataFrame:
    """Rows with their split by time. The cuts are exact values of the order column at its shares; see _around for how they are
    found without all values in one task. A null time is in the last part."""
    first = order[0]
    kind = dict(rows.dtypes)[first]
    key = f"unix_micros(cast({first} as timestamp))" if kind.startswith("timestamp") else first
    done, out = 0.0, rows
    keys = rows.select(F.expr(key).alias("_k")).where("_k is not null")
    for i, (_, share) in enumerate(parts[:-1]):
        done += share
        place = F.greatest(F.ceil(F.col("_n") * F.lit(done) - 1e-9), F.lit(1))
        cut = _around(keys, (), "_k", done).agg(F.max(F.when((F.col("_after") < place) & (place <= F.col("_upto")), F.col("_v"))).alias(f"_c{i}"))
        out = out.crossJoin(F.broadcast(cut))  # one row
    split = None
    for i, (name, _) in enumerate(parts[:-1]):
        test = F.expr(key) <= F.col(f"_c{i}")
        split = F.when(test, name) if split is None else split.when(test, name)
    return out.withColumn("split", split.otherwise(parts[-1][0])).drop(*[f"_c{i}" for i in range(len(parts) - 1)])


def harness(per_rule: DataFrame) -> DataFrame:
    """By pattern type and overall: rules, mean precision and coverage, hits."""
    return per_rule.rollup("pattern_type").agg(F.count("*").alias("rules"), F.avg("precision").alias("avg_precision"), F.avg("coverage").alias("avg_coverage"), F.sum("hits_total").alias("hits")).withColumn("pattern_type", F.coalesce("pattern_type", F.lit("overall")))


def extended(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: the confusion and its metrics at a threshold, with latencies and languages, of rows (score, label, latency_ms,
    language). The 95th percentile is the exclusive one from 20 rows on, below that the mean."""
    at = confusion_at(scored, [threshold])
    known = scored.where("latency_ms is not null")
    counts = scored.agg(F.count("*").alias("processed"), F.count_if(F.col("latency_ms") > 200).alias("_slow"), F.count_if(F.coalesce(F.col("language"), F.lit("unknown")) == "unknown").alias("unknown_languages"), F.avg("latency_ms").alias("avg_latency_ms"), F.count("latency_ms").alias("_timed"))
    out = at.crossJoin(F.broadcast(counts))  # one row each
    for q, name in ((0.5, "_p50"), (0.95, "_p95")):
        out = out.join(F.broadcast(exclusive_quantile(known, (), "latency_ms", q, name)), F.lit(True), "left")  # at most one row
    p95 = F.when(F.col("_timed") >= 20, F.col("_p95")).otherwise(F.col("avg_latency_ms"))
    share = lambda c: ratio(F.col(c), F.col("processed"))
    return out.select(*at.columns, "processed", "avg_latency_ms", F.coalesce("_p50", "avg_latency_ms").alias("p50_latency_ms"), p95.alias("p95_latency_ms"), (100 * share("_slow")).alias("pct_over_200ms"), "unknown_languages", share("unknown_languages").alias("unknown_lang_rate"))


def error_samples(scored: DataFrame, threshold: float, most: int = 50, width: int = 500) -> DataFrame:
    """(kind, place, id, example): the first false positives and false negatives by id, texts cut for show."""
    hit, yes = F.col("score") >= threshold, F.col("label")
    wrong = scored.where(yes.isNotNull() & (hit != yes)).select(F.when(hit, "fp").otherwise("fn").alias("kind"), "id", F.substring("text", 1, width).alias("example"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    return wrong.withColumn("place", place).where(F.col("place") <= most)
