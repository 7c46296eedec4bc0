"""Structured Streaming twins of the batch statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import rules as rl
from quillmesh.operators import signals


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """New Parquet files of a folder as a stream, with an event-time column."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events, failures and their share by window; state goes once the watermark has passed a window."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("w.start").alias("start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_ratio"))


def first_seen(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Idempotency: a key passes once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def confusion(stream: DataFrame, threshold: float) -> DataFrame:
    """Running tp, fp, tn, fn of a stream of (score, label); for output mode complete or update."""
    hit, yes = F.col("score") >= threshold, F.col("label")
    return stream.where(yes.isNotNull()).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(~hit & yes).alias("fn"))


def replay(stream: DataFrame, rules: list[rl.Rule]) -> DataFrame:
    """Matches of rules on arriving messages."""
    return rl.hits(stream, rules)


def mine_into(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps signal counts of each batch, once a batch id, for signal_totals()."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        signals.signals(batch.where("is_spam")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return sink


def signal_totals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("signal_type", "key").agg(F.sum("cnt").alias("cnt"))


def limiter(stream: DataFrame, most: int, seconds: float = 1.0, late: str = "10 seconds") -> DataFrame:
    """An exact sliding window for each key in which denied events don't count: admission depends on earlier admissions,
    so the admitted times of the last window are the key's state.

    Time is the events' own: the state ends when the watermark, `late` behind the latest event, has passed the window, however
    long the stream pauses; events behind the watermark are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(rows.event_id, rows.ts):
            now = ts.value / 1e9
            times = [t for t in times if t > now - seconds]
            denied = len(times) >= most
            if not denied:
                times.append(now)
            out.append((event_id, key[0], denied))
        state.update((times,))
        state.setTimeoutTimestamp(max(int((max(times) + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "denied"])

    return stream.withWatermark("ts", late).select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, denied boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
