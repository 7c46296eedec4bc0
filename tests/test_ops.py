"""Windows, budgets and caches in slices of time against plain walks, with half of all events on one user."""

import datetime as dt
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import ops

START = dt.datetime(2024, 3, 1, 23, 45)
SECOND = 1_000_000


def events(n=600):
    rng = random.Random(17)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 300_000, SECOND, 3 * SECOND, 40 * SECOND])
        rows.append((i, START + dt.timedelta(microseconds=t), 0 if i % 2 else rng.randrange(1, 30), rng.choice([-1.0, 0.5, 2.0])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").withColumns({"_slice": F.lit("own"), "_own": F.lit("own")}).repartition(3)


def micros(t):
    return int((t - START).total_seconds() * SECOND + 0.5)


@pytest.mark.parametrize("reach,width", [(SECOND, 5 * SECOND), (60 * SECOND, 7 * SECOND), (90 * SECOND, ops.SLICE)])
def test_counts_and_repeats(spark, reach, width):
    rows = events()
    got = {r.event_id: r for r in ops.recent_count(frame(spark, rows), "user_id", reach, width=width).collect()}
    seen = {r.event_id: r.hit for r in ops.cache_hits(frame(spark, rows), "user_id", reach, width=width).collect()}
    assert len(got) == len(seen) == len(rows) and got[0]._slice == got[0]._own == "own" and "_place" not in got[0]
    for i, t, u, _ in rows:
        assert got[i].recent == sum(v == u and 0 <= micros(t) - micros(s) <= reach for _, s, v, _ in rows)
        assert seen[i] == any(v == u and (s, j) < (t, i) and micros(t) - micros(s) < reach for j, s, v, _ in rows)


@pytest.mark.parametrize("width", [10 * SECOND, ops.SLICE])
def test_budgets(spark, width):
    rows = events()
    got = {r.event_id: (r.spent, r.state) for r in ops.budgets(frame(spark, rows), 20.0, width=width).collect()}
    spent = {}
    for i, t, u, v in sorted(rows, key=lambda r: (r[1], r[0])):
        spent[u, t.date()] = now = spent.get((u, t.date()), 0.0) + max(v, 0.0)
        assert got[i] == (now, "exceeded" if now >= 20 else "warning" if now >= 16 else "ok")
    assert len(got) == len(rows) and len({d for _, d in spent}) > 1


def test_budgets_at_the_limit(spark):
    """Sums of doubles depend on their order: at the limit it is that of time, whatever the slices; above it slices run apart."""
    values = [0.1, 0.2, 0.3, 0.7, 0.3, 0.2, 0.1]
    rows = [(i, START + dt.timedelta(seconds=(0, 5, 7, 12, 14, 21, 22)[i]), 1, v) for i, v in enumerate(values)]
    limit = 0.1 + 0.2 + 0.3
    assert limit > 0.1 + (0.2 + 0.3)
    got = {r.event_id: (r.spent, r.state) for r in ops.budgets(frame(spark, rows), limit, warn=0.9, width=5 * SECOND).collect()}
    assert [got[i][1] for i in range(7)] == ["ok", "ok", *["exceeded"] * 5] and got[2][0] == limit
    assert all(abs(got[i][0] - sum(values[: i + 1])) < 1e-9 for i in range(7))


@pytest.mark.parametrize("capacity", [2, 3, 10, 1000])
def test_cache_of_a_capacity(spark, capacity):
    """Slices give what one cache over all lookups gives."""
    rows = events()
    got = {r.event_id: r.hit for r in ops.cache_hits(frame(spark, rows), "user_id", 90 * SECOND, capacity, 100 * SECOND).collect()}
    held, want = OrderedDict(), {}
    for i, t, u, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = u in held and micros(t) - held[u] < 90 * SECOND
        held.pop(u, None)
        held[u] = micros(t)
        while len(held) > capacity:
            held.popitem(last=False)
    assert got == want and 0 < sum(want.values()) < len(rows)


def test_a_hot_key_is_many_tasks_work(spark):
    """Half of all events are one user's; no slice of it holds more than a small part of them."""
    rows, at, own = ops.sliced(frame(spark, events()), 10 * SECOND, 60 * SECOND)
    sizes = [r["count"] for r in rows.where("user_id = 0").groupBy(at).count().collect()]
    assert sum(sizes) < 2 * 300 and max(sizes) < 60
