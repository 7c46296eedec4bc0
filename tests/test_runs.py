"""Runs that are stopped and resumed count everything once; the stored cache of vectors embeds nothing twice."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import runs as rn
from quillmesh.operators import vectors

def keys():
    return F.split("text", " ")


def messages(spark, n=50):
    return spark.range(n).select((F.col("id") * 3).alias("id"), F.concat_ws(" ", F.concat(F.lit("k"), (F.col("id") % 7).cast("string")), F.lit("all")).alias("text"))


def totals(df):
    return {r.key: r.cnt for r in df.collect()}


def want(n=50):
    return {"all": n} | {f"k{i}": len(range(i, n, 7)) for i in range(7)}


def test_a_stopped_run_is_resumed(spark, tmp_path):
    runs = rn.Runs(spark, f"file://{tmp_path}/runs")
    run = runs.start("full")
    assert rn.mine(runs, run, messages(spark), keys(), 20, most=1)["last_id"] == 57
    assert [(r.run_id, r.processed) for r in runs.running().collect()] == [(run, 20)]
    before = runs._merged(runs.state(run), spark.createDataFrame([("lost", 1)], "key string, cnt long"))  # a snapshot that no version names
    again = rn.Runs(spark, f"file://{tmp_path}/runs")
    state = rn.mine(again, run, messages(spark), keys(), 20)
    assert (state["status"], state["processed"], state["last_id"]) == ("completed", 50, 147) and before != state["snapshot"]
    assert totals(again.counts(state)) == want() and again.running().isEmpty()
    assert rn.mine(again, run, messages(spark, 90), keys(), 20) == state | {"updated_at": again.state(run)["updated_at"]}
    with pytest.raises(ValueError, match="no run"):
        rn.mine(runs, "other", messages(spark), keys(), 20)


def test_of_two_writers_one_is_first(spark, tmp_path):
    runs = rn.Runs(spark, f"file://{tmp_path}/runs")
    state = runs.state(runs.start(run_id="a"))
    runs.update(state, processed=1)
    with pytest.raises(FileExistsError):
        runs.update(state, processed=2)
    runs.start(run_id="b")
    assert [(r.run_id, r.processed) for r in runs.recent().collect()] == [("b", 0), ("a", 1)] and runs.table().count() == 3


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    runs = rn.Runs(spark, f"file://{tmp_path}/runs")
    run = runs.start("stream")
    sink = rn.counting_sink(runs, run, keys())
    for batch_id in (0, 1, 1, 0, 2):
        sink(messages(spark).where((F.col("id") % 9).between(batch_id * 3, batch_id * 3 + 2)), batch_id)
    state = runs.state(run)
    assert totals(runs.counts(state)) == want() and (state["batch_id"], state["processed"]) == (2, 50)


def test_vectors_are_embedded_once(spark, tmp_path):
    folder, model = f"file://{tmp_path}/cache", lambda texts: [[len(t), t.count("a")] for t in texts]
    rows = spark.createDataFrame([(1, "banana"), (2, "a"), (3, "banana"), (4, None)], "id long, text string")
    got, n = vectors.embedded(rows, folder, model)
    assert n == 2 and {r.id: r.vector for r in got.collect()} == {1: [6, 3], 2: [1, 1], 3: [6, 3]}

    def broken(texts):
        raise AssertionError(texts)

    got, n = vectors.embedded(rows, folder, broken)
    assert n == 0 and got.count() == 3
    got, n = vectors.embedded(rows.unionByName(spark.createDataFrame([(9, "new")], "id long, text string")), folder, model)
    assert n == 1 and got.count() == 4
    vectors.stored(spark, folder).write.mode("append").partitionBy("prefix").parquet(folder)  # another writer's copies
    assert vectors.stored(spark, folder).count() == 3
    assert vectors.embedded(rows.where("id > 5"), folder, broken)[1] == 0
