"""Runs that can be stopped and resumed: a stored table of their states, and counts that take each batch in once."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "run_id string, version long, mode string, status string, last_id long, batch_id long, processed long, snapshot string, updated_at string"


@dataclass
class Runs:
    """The states of runs in a folder that driver and executors share: a small file for each version of each run.

    A version is written under a name of its own and takes effect by one rename, which fails if another writer was first. A
    stopped writer leaves nothing that counts.
    """

    spark: SparkSession
    folder: str

    def __post_init__(self):
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def table(self) -> DataFrame:
        """Every version of every run."""
        return self.spark.read.schema(STATE).option("pathGlobFilter", "*.json").json(self.folder)

    def latest(self) -> DataFrame:
        """Each run's last version."""
        last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("version")))
        return self.table().withColumn("_n", last).where("_n = 1").drop("_n")

    def running(self) -> DataFrame:
        return self.latest().where("status = 'running'")

    def recent(self, n: int = 10) -> DataFrame:
        return self.latest().orderBy(F.desc("updated_at"), "run_id").limit(n)

    def state(self, run_id: str) -> dict | None:
        row = self.table().where(F.col("run_id") == run_id).orderBy(F.desc("version")).limit(1).first()
        return row.asDict() if row else None

    def start(self, mode: str = "mining", run_id: str | None = None) -> str:
        run_id = run_id or uuid.uuid4().hex
        self._put({"run_id": run_id, "version": 0, "mode": mode, "status": "running", "last_id": None, "batch_id": -1, "processed": 0, "snapshot": None})
        return run_id

    def update(self, state: dict, **changes) -> dict:
        """The state after these changes, as its run's next version; FileExistsError if that is there already."""
        new = state | changes | {"version": state["version"] + 1}
        self._put(new)
        return new

    def _put(self, state: dict) -> None:
        now = dt.datetime.now(dt.timezone.utc).isoformat()
        part = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        final = self._path(f"{self.folder}/{state['run_id']}-{state['version']:010d}.json")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(state | {"updated_at": now}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise FileExistsError(f"run {state['run_id']} has a version {state['version']} already")

    def _merged(self, state: dict, counts: DataFrame) -> str:
        """A new snapshot of a run's counts(key, cnt) with these added; it counts once an update names it."""
        path = f"{self.folder}/counts-{state['run_id']}-{uuid.uuid4().hex[:12]}"
        before = self.counts(state)
        (counts if before is None else before.unionByName(counts)).groupBy("key").agg(F.sum("cnt").alias("cnt")).write.parquet(path)
        return path

    def counts(self, state: dict | None) -> DataFrame | None:
        return self.spark.read.parquet(state["snapshot"]) if state and state["snapshot"] else None

    def _taken(self, state: dict, counts: DataFrame, **changes) -> dict:
        """The state with counts merged in; the snapshot before is deleted when the new version stands."""
        new = self.update(state, snapshot=self._merged(state, counts), **changes)
        if state["snapshot"]:
            self._fs.delete(self._path(state["snapshot"]), True)
        return new


def mine(runs: Runs, run_id: str, messages: DataFrame, keys: Column, batch: int, most: int | None = None) -> dict:
    """Counts of an array of keys over messages by ascending id, `batch` ids at a time, from where the run stands; at most
    `most` batches now. A batch and how far it goes are committed together, so one that was stopped is counted again, not
    twice. The run is completed when no id is left. Ids are not null.
    """
    state = runs.state(run_id)
    if state is None:
        raise ValueError(f"no run {run_id}")
    while state["status"] == "running" and (most is None or most > 0):
        rest = messages if state["last_id"] is None else messages.where(F.col("id") > state["last_id"])
        upto, n = rest.select("id").orderBy("id").limit(batch).agg(F.max("id"), F.count("*")).first()
        if not n:
            return runs.update(state, status="completed")
        part = rest.where(F.col("id") <= upto)
        counts = part.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("cnt"))
        state = runs._taken(state, counts, last_id=upto, processed=state["processed"] + part.count())
        most = None if most is None else most - 1
    return state


def counting_sink(runs: Runs, run_id: str, keys: Column) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds each batch's keys to the run's counts once: a batch that comes again is left out."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        state = runs.state(run_id)
        if state["status"] == "running" and batch_id > state["batch_id"]:
            batch = batch.persist()
            counts = batch.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("cnt"))
            runs._taken(state, counts, batch_id=batch_id, processed=state["processed"] + batch.count())
            batch.unpersist()

    return sink
