"""Quantiles from sketches, nearest rows, streaming twins, audit logs and empty inputs against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import evaluation as ev
from quillmesh.operators import exports, ops, quality, similarity
from quillmesh.sources import messages as src
from quillmesh.streaming import live


def test_runs_around_a_quantile_hold_its_place(spark):
    """Groups far above the sketch's accuracy, with ties and a heavy tail."""
    rng = random.Random(5)
    rows = [(k, float(int(rng.paretovariate(0.5)) if k else rng.randrange(40))) for k in (0, 1, None) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        runs = ev._around(df, ["g"], "v", q, accuracy=50).collect()
        for g in (0, 1, None):
            values = sorted(v for k, v in rows if k == g)
            at = {p: r["_v"] for r in runs if r.g == g and r["_v"] is not None for p in range(r["_after"] + 1, r["_upto"] + 1)}
            place = min(max(int((len(values) + 1) * q), 1), len(values))
            assert at[place] == values[place - 1]


def test_chronological_cuts_and_null_times(spark):
    df = spark.range(10).select("id", F.when(F.col("id") < 8, F.timestamp_seconds(F.col("id"))).alias("ts"))
    got = {r.id: r.split for r in ev.chronological(df, ["ts"]).collect()}
    assert [got[i] for i in range(10)] == ["train"] * 5 + ["validation"] * 2 + ["test"] * 3


@pytest.mark.parametrize("alike", [True, False])
def test_nearest_is_exact_at_every_step(spark, alike):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12 if alike else 400)]
    text = lambda: " ".join(rng.sample(words, rng.randint(1, 8)))
    a, b = [(i, text()) for i in range(40)] + [(40, ""), (41, None)], [(i, text()) for i in range(40)]
    sets = lambda t: set((t or "").split())
    best = {i: max(len(sets(x) & sets(y)) / len(sets(x) | sets(y)) for _, y in b) for i, x in a if sets(x)}
    want = sorted(((-s, i) for i, s in best.items() if s), key=lambda p: p)[:3]
    got = similarity.nearest(spark.createDataFrame(a, "id long, text string"), spark.createDataFrame(b, "id long, text string")).collect()
    assert [(r.id, round(r.similarity, 9)) for r in got] == [(i, round(-s, 9)) for s, i in want]


def test_extended_evaluation_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, score double, label boolean, latency_ms double, language string, text string")
    r = ev.extended(df, 0.5).first()
    assert (r.processed, r.tp, r.p95_latency_ms, r.pct_over_200ms) == (0, 0, None, 0.0)
    assert ev.error_samples(df, 0.5).count() == 0


def test_proposals(spark):
    kind = "id long, patterns array<struct<type:string,description:string,tier:string,risk_level:double,confidence_level:string>>"
    ok = ("url", "d", "safe_auto", 5.0, "high")
    rows = [(1, [ok]), (2, []), (3, None), (4, [ok, ("url", "d", "safe", 5.0, "high")]), (5, [("url", None, "SAFE_AUTO", 5.0, "HIGH")]), (6, [ok[:3] + (101.0, "LOW")]), (7, [ok[:4] + ("sure",), ok]), (8, [None])]
    got = {r.id: (r.problem, r.problem_at) for r in quality.validated(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (None, None), 2: ("no patterns", None), 3: ("no patterns", None), 4: ("invalid tier", 1), 5: ("missing description", 0), 6: ("risk out of range", 0), 7: ("invalid confidence", 0), 8: ("missing type", 0)}


def test_audit_log(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d), a, d) for d, a in ((1, "ingest"), (2, "mine"), (3, "ingest"))]
    kind = "ts timestamp, action string, n long"
    exports.audit_write(spark.createDataFrame(rows, kind), f"{tmp_path}/a")
    assert {r.n for r in exports.audit_read(spark, f"{tmp_path}/a", kind, dt.datetime(2024, 1, 2)).collect()} == {2, 3}
    exports.audit_keep(spark, f"{tmp_path}/a", kind, f"{tmp_path}/b", dt.datetime(2024, 1, 3))
    assert [r.action for r in exports.audit_read(spark, f"{tmp_path}/b", kind).collect()] == ["ingest"]


def test_storage_without_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no .json"):
        src.read_storage(spark, str(tmp_path), dt.datetime(2024, 1, 1))


def test_training_set_needs_its_columns(spark):
    df = spark.createDataFrame([(" a ", "spam"), ("", "ham"), ("b", None)], "body string, label string")
    assert [r.accepted for r in src.training_set(df, F.lit("n")).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        src.training_set(df.drop("label"), F.lit("n"))


def test_bucket_quantile_ends(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 10, 10), (0, 0, 10)], "b0 long, b1 long, n long")
    assert [r.p for r in ops.bucket_quantile(df, [1.0, 3.0], 0.5, "p").collect()] == [None, 2.0, 3.0]


@pytest.fixture
def stream(spark, tmp_path):
    """A folder of event files, a stream of it, and a function that runs a query over it to the end."""
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(7)
    rows = [(i, i % 3, base + dt.timedelta(milliseconds=250 * i + rng.randrange(200)), rng.random(), rng.random() < 0.5, f"k{i % 20}") for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, score double, label boolean, key string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(query, name, mode="append"):
        query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination(120)
        return spark.table(name).collect()

    return rows, live.events(spark, f"{tmp_path}/in", df.schema), run


def test_stream_confusion_is_the_batch_one(spark, stream):
    rows, s, run = stream
    got = run(live.confusion(s, 0.5), "confusion_out", "complete")[-1]
    assert (got.tp, got.fp) == (sum(r[3] >= 0.5 and r[4] for r in rows), sum(r[3] >= 0.5 and not r[4] for r in rows))


def test_stream_first_seen(spark, stream):
    _, s, run = stream
    assert len(run(live.first_seen(s, ["key"]).select("key"), "first_out")) == 20


def test_stream_limiter_is_a_plain_walk(spark, stream):
    rows, s, run = stream
    kept, want = {}, {}
    for i, user, ts, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [t for t in kept.get(user, []) if (ts - t).total_seconds() < 2.0]
        want[i] = len(own) >= 2
        kept[user] = own if want[i] else [*own, ts]
    assert {r.event_id: r.denied for r in run(live.limiter(s, 2, 2.0), "limiter_out")} == want
