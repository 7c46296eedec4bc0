"""Operational statistics over events: rates, budgets, windows and alerts in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def request_stats(requests: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Of the last hours: requests, mean latency, share of failures."""
    r = requests.where(F.col("ts") >= F.lit(as_of) - F.make_interval(hours=F.lit(hours)))
    failed = F.count_if("failed")
    return r.agg(F.count("*").alias("requests"), F.avg("latency").alias("avg_latency"), F.coalesce(F.try_divide(failed.cast("double"), F.count("*")), F.lit(0.0)).alias("error_rate"))


def usage(events: DataFrame, period: str) -> DataFrame:
    """Cost and calls by key, period (day, week or month, weeks from Monday) and kind."""
    return events.groupBy("user_id", F.date_trunc(period, "ts").cast("timestamp_ntz").alias("period"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("cost"))


def usage_report(events: DataFrame, start, end) -> DataFrame:
    """By kind and in all, of a closed range of dates."""
    e = events.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return e.rollup("event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("cost")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


#: Width of the time slices into which the events of a key are cut, so that a hot key is many tasks' work.
SLICE = 3_600_000_000


def sliced(events: DataFrame, reach: int, width: int = SLICE) -> tuple[DataFrame, str, str]:
    """events by slices of time, for windows that look back `reach` microseconds: (rows, slice column, own column).

    Each event is in the slice of its own time and, as a guest (own is false), in the next one if that may look back to it.
    Slices are `width` wide, or `reach` if that is more, so no event is more than twice there.
    """
    width = max(width, reach)
    at, own, place = (_free(events.columns, x) for x in ("_slice", "_own", "_place"))
    t = _micros(F.col("ts"))
    here = F.floor(t / width)
    guest = F.when(t >= (here + 1) * width - reach, F.struct((here + 1).alias("at"), F.lit(False).alias("own")))
    places = F.filter(F.array(F.struct(here.alias("at"), F.lit(True).alias("own")), guest), lambda x: x.isNotNull())
    out = events.withColumn(place, F.explode(places))
    return out.withColumn(at, F.col(place)["at"]).withColumn(own, F.col(place)["own"]).drop(place), at, own


def _free(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def budgets(events: DataFrame, limit: float, period: str = "day", warn: float = 0.8, width: int = SLICE) -> DataFrame:
    """Each event with the running cost of its key and period, and its state; once exceeded, a period stays so.

    Costs run within slices of time; what the period's earlier slices have cost comes from their sums, a row a slice. Doubles
    added in another order differ in their last digits, which decides where a sum is just the limit. So the slices of a period up
    to the one that exceeds the limit run as one, added in the order of time; later ones are above it in any order.
    """
    at, before, start, run = (_free(events.columns, x) for x in ("_slice", "_before", "_period", "_run"))
    cost = F.greatest(F.col("value"), F.lit(0.0))
    rows = events.withColumn(start, F.date_trunc(period, "ts")).withColumn(at, F.floor(_micros(F.col("ts")) / width))
    sums = rows.groupBy("user_id", start, at).agg(F.sum(cost).alias(before))
    earlier = Window.partitionBy("user_id", start).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0.0)))
    names = {c: _free([*rows.columns, before], f"_of_{c}") for c in ("user_id", start, at)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = rows.join(sums.withColumnsRenamed(names), same, "left").drop(*names.values())
    above = F.col(before) > limit + 1e-6 * abs(limit)
    joined = joined.withColumn(run, F.when(above, F.col(at)))
    within = Window.partitionBy("user_id", start, run).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn("spent", F.sum(cost).over(within) + F.when(above, F.col(before)).otherwise(0.0)).drop(start, at, before, run)
    return out.withColumn("state", F.when(F.col("spent") >= limit, "exceeded").when(F.col("spent") >= warn * limit, "warning").otherwise("ok"))


def recent_count(events: DataFrame, key: str, micros: int, name: str = "recent", width: int = SLICE) -> DataFrame:
    """Each event with how many of its key fall into the time up to it, itself included. Events without a time count together."""
    rows, at, own = sliced(events, micros, width)
    w = Window.partitionBy(key, at).orderBy(_micros(F.col("ts"))).rangeBetween(-micros, 0)
    return rows.withColumn(name, F.count("*").over(w)).where(own).drop(at, own)


def _since_last(events: DataFrame, key: str, micros: int, name: str, width: int) -> DataFrame:
    """Each event with whether one of its key came less than so long before it (or at its time, with a smaller id)."""
    rows, at, own = sliced(events, micros, width)
    before = F.lag("ts").over(Window.partitionBy(key, at).orderBy("ts", "event_id"))
    return rows.withColumn(name, F.coalesce(_micros(F.col("ts")) - _micros(before) < micros, F.lit(False))).where(own).drop(at, own)


def rate_limit(events: DataFrame, most: int, micros: int = 1_000_000) -> DataFrame:
    """Each event with the decision of a sliding window that also counts denied events: denied above `most`."""
    return recent_count(events, "user_id", micros).withColumn("denied", F.col("recent") > most)


def bursts(events: DataFrame, suspicious: Column, most: int = 10, seconds: int = 60) -> DataFrame:
    return recent_count(events.where(suspicious), "user_id", seconds * 1_000_000).withColumn("denied", F.col("recent") > most)


def idempotent(events: DataFrame, key: Column, seconds: int = 3600, width: int = SLICE) -> DataFrame:
    """Each event with its hashed key and whether one with that key came within the time before."""
    return _since_last(events.withColumn("request_key", F.sha2(key.cast("binary"), 256)), "request_key", seconds * 1_000_000, "repeated", width)


def windowed(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """By window: events, failures and their share."""
    w = F.window(F.col("ts").cast("timestamp"), width, slide) if slide else F.window(F.col("ts").cast("timestamp"), width)
    out = events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_ratio"))


def firing(windows: DataFrame, condition: Column, hold: int) -> DataFrame:
    """Windows with whether the condition has held in the last `hold` of them: windows are few, a row a window."""
    w = Window.orderBy("start").rowsBetween(-(hold - 1), 0)
    flagged = windows.withColumn("breach", condition)
    return flagged.withColumn("firing", (F.sum(F.col("breach").cast("int")).over(w) == hold))


def histogram(events: DataFrame, bounds: list[float], value: str = "value") -> DataFrame:
    """Cumulative counts up to each bound, and all, by kind."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return events.groupBy("event_type").agg(F.count("*").alias("total"), F.sum(value).alias("sum"), *aggs).select("event_type", "sum", F.explode(rows).alias("r")).select("event_type", "sum", "r.le", "r.n")


def cache_hits(lookups: DataFrame, key: str, micros: int, capacity: int | None = None, width: int = SLICE) -> DataFrame:
    """Each lookup (ts, event_id, key) with whether a cache hits that keeps an entry for a time after its last lookup, and of
    all entries the `capacity` last looked up.

    Each lookup renews its entry, so one hits if the key's last lookup is recent enough and fewer than `capacity` other keys
    have been looked up since. Without a capacity keys are told apart by windows. With one, each slice of time is a
    task that walks its lookups and those of the time before it in order: what is older can't be hit, nor take up room.
    """
    if capacity is None:
        return _since_last(lookups, key, micros, "hit", width)
    import pandas as pd

    rows, at, own = sliced(lookups, micros, width)
    t = _free(rows.columns, "_t")
    fields = rows.drop(at, own).schema.add("hit", "boolean")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import OrderedDict

        held: OrderedDict = OrderedDict()  # key: its last lookup, the oldest first
        hits = []
        pdf = pdf.sort_values([t, "event_id"])
        for k, now in zip(pdf[key].tolist(), pdf[t].tolist()):
            while held and now - next(iter(held.values())) >= micros:
                held.popitem(last=False)
            hits.append(held.pop(k, None) is not None)
            held[k] = now
            if len(held) > capacity:
                held.popitem(last=False)
        return pdf.assign(hit=hits)[pdf[own]].drop(columns=[t, at, own])

    timed = rows.where(F.col("ts").isNotNull()).withColumn(t, _micros(F.col("ts")))
    return timed.groupBy(at).applyInPandas(walk, fields)


def cache_stats(lookups: DataFrame, key: str, micros: int, capacity: int | None = None) -> DataFrame:
    """Hits, misses and rate of the cache of cache_hits()."""
    out = cache_hits(lookups, key, micros, capacity)
    return out.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), (F.count_if("hit") / F.count("*")).alias("hit_rate"))


def older_than(rows: DataFrame, as_of, days: int, column: str = "ts") -> DataFrame:
    """Rows that retention takes away."""
    return rows.where(F.col(column) < F.lit(as_of) - F.make_interval(days=F.lit(days)))


def zombies(patterns: DataFrame) -> DataFrame:
    """Patterns without matches, and all but the most matched of those with one description."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("description").orderBy(F.desc("matches"), "pattern_id"))
    out = patterns.withColumn("place", place)
    return out.select("pattern_id", F.when(F.col("matches") == 0, "zombie").when(F.col("place") > 1, "duplicate").otherwise("keep").alias("verdict"))


def usage_cube(events: DataFrame, start, end, provider: Column, model: Column) -> DataFrame:
    """Calls and cost of a closed range of dates, by provider, by model, and in all: (provider, model, calls, cost), null for all."""
    e = events.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).select(provider.alias("provider"), model.alias("model"), "value")
    return e.groupingSets([["provider"], ["model"], []], "provider", "model").agg(F.count("*").alias("calls"), F.sum("value").alias("cost"))


def bucket_quantile(windows: DataFrame, bounds: list[float], q: float, name: str) -> DataFrame:
    """windows (with cumulative counts b0, b1, ... up to each bound and the total n) and their quantile, between the ends of the
    first bucket that reaches it by straight line, from 0 for the first; what lies above the last bound counts as that."""
    place, out = F.lit(q) * F.col("n"), None
    for i, hi in enumerate(bounds):
        lo, below = (bounds[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        value = F.lit(lo) + F.lit(hi - lo) * F.try_divide(place - below, (F.col(f"b{i}") - below).cast("double"))
        test = F.col(f"b{i}") >= place
        out = F.when(test, value) if out is None else out.when(test, value)
    return windows.withColumn(name, F.when(F.col("n") > 0, out.otherwise(F.lit(float(bounds[-1])))))


def alert_windows(events: DataFrame, width: str, bounds: list[float], hit: Column) -> DataFrame:
    """By window: events, failures (their increase), the 95th percentile from a histogram, and the percent of cache hits."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    counts = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    out = events.groupBy(w.alias("w")).agg(F.count("value").alias("n"), F.count_if(F.col("event_type") == "error").alias("increase"), (100.0 * F.count_if(hit) / F.count("*")).alias("hit_rate"), *counts)
    out = bucket_quantile(out, bounds, 0.95, "p95").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "increase", "p95", "hit_rate")
    return out
