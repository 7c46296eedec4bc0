"""Vectors and sets that are alike: pivots' cells, blocks, guests, and pairs that are computed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import similarity


def clustered(n=900, groups=30, spread=0.02, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 24))
    return [(i, (centres[i % groups] + spread * rng.normal(size=24)).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def brute(rows, least):
    m = np.array([v for _, v in rows])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    s = m @ m.T
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if s[i, j] >= least}


@pytest.mark.parametrize("cell_rows,guest_rows", [(2000, 200_000), (20, 50), (7, 3)])
def test_cosine_pairs_by_cells(spark, cell_rows, guest_rows):
    rows = [*clustered(300, 12, 0.3), (900, [0.0] * 24), (901, [1.0] * 24), (902, [1.0] * 24)]
    got = [(r.a, r.b) for r in similarity.cosine_pairs(frame(spark, [*rows, (903, None)]), 0.8, cell_rows, guest_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.8) and len(got) > 100


def test_cosine_pairs_below_zero(spark):
    rows = [*clustered(40, 5, 1.0), (900, [0.0] * 24)]
    got = [(r.a, r.b) for r in similarity.cosine_pairs(frame(spark, rows), -0.1, 10, 15).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, -0.1)


def test_cells_prune(spark):
    """Clustered vectors meet few others: the pairs that cells compare are a small part of all."""
    rows = clustered()
    dealt = similarity.cells(frame(spark, rows), 0.95, cell_rows=30).groupBy("cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests"))
    compared = sum(r.own * (r.own - 1) // 2 + r.own * r.guests for r in dealt.collect())
    assert compared < len(rows) * (len(rows) - 1) / 2 / 5
    assert {(r.a, r.b) for r in similarity.cosine_pairs(frame(spark, rows), 0.95, 30).collect()} == brute(rows, 0.95)


def test_cosine_pairs_of_nothing(spark):
    assert similarity.cosine_pairs(frame(spark, []), 0.5).collect() == []


def test_dbscan_computes_its_pairs_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (8, 9)]
    pairs = spark.createDataFrame(edges, "a long, b long").mapInArrow(counted, "a long, b long")
    assert len(similarity.dbscan(pairs, spark.range(10)).collect()) == 4 and calls.value == len(edges)
    before = calls.value
    assert len(similarity.leaders(pairs, spark.range(10)).collect()) == 10 and calls.value == before + len(edges)


def test_jaccard_of_frequent_items(spark, monkeypatch):
    """Frequent items come last in the common order; hot ones in every set don't matter, empty and null sets are like none."""
    import random

    monkeypatch.setattr(similarity, "_FREQUENT", 1 / 40)
    rng = random.Random(9)
    sets = [(i, ["every", "most"[: rng.randrange(5)] or "x", *{f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(12))}]) for i in range(150)] + [(900, []), (901, None), (902, ["alone"]), (903, ["alone"])]
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}
    got = {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(spark.createDataFrame(sets, "id long, shingles array<string>"), 0.6).collect()}
    assert got == want and (902, 903) in got and len(got) > 20


def test_sketches_leave_few_sets_to_move(spark, monkeypatch):
    """Candidates by a common prefix item that are far apart fall by their sketches; none that reaches the threshold does."""
    import random

    rng = random.Random(6)
    sets = [(i, ["hot", *{f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 20, 90]))}]) for i in range(120)]
    sets += [(1000 + i, [x for x in s if rng.random() < 0.9] + [f"n{i}"]) for i, s in sets[:60]]
    written, keep = {}, similarity.kept
    monkeypatch.setattr(similarity, "kept", lambda df, name="kept": written.setdefault(name, []).append(keep(df, name)) or written[name][-1])
    monkeypatch.setattr(similarity, "dropped", lambda *frames: None)
    got = {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(spark.createDataFrame(sets, "id long, shingles array<string>"), 0.6).collect()}
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == {(a, b): jac(x, y) for a, x in sets for b, y in sets if a < b and jac(x, y) >= 0.6} and len(got) > 30
    assert len(got) <= written["jaccard-near"][0].count() < 1.3 * len(got) < 0.5 * written["jaccard-candidates"][0].count()


def test_nearest_goes_below_its_steps(spark):
    """Where too few rows are alike, the limit is halved until enough are found or none is left."""
    rows = spark.createDataFrame([(i, " ".join(f"a{i}x{j}" for j in range(30)) + " shared") for i in range(5)] + [(9, "nothing in common")], "id long, text string")
    others = spark.createDataFrame([(1, "shared " + " ".join(f"b{j}" for j in range(40)))], "id long, text string")
    got = similarity.nearest(rows, others).collect()
    assert [r.id for r in got] == [0, 1, 2] and all(abs(r.similarity - 1 / 71) < 1e-9 for r in got)
    assert [r.id for r in similarity.nearest(rows.where("id > 3"), others).collect()] == [4]


def test_nearest_moves_few_sets(spark, monkeypatch):
    """The nearest by brute force, with copies, near ones and ids on both sides; only near candidates have their sets moved."""
    import random

    rng = random.Random(8)
    words = lambda n: [f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(n)]
    others = [(i, " ".join(words(40))) for i in range(60)]
    rows = [(i, " ".join(words(40))) for i in range(80)] + [(100 + i, " ".join([x for x in others[i % 3][1].split() if rng.random() < 0.9] + ["new"])) for i in range(4)]
    rows += [(99, rows[-1][1]), (98, None), (97, "")]
    sizes, keep = {}, similarity.kept
    monkeypatch.setattr(similarity, "kept", lambda df, name="kept": (out := keep(df, name), sizes.setdefault(name, []).append(out.count()))[0])
    make = lambda x: spark.createDataFrame(x, "id long, text string").repartition(3)
    got = [(r.id, round(r.similarity, 9)) for r in similarity.nearest(make(rows), make(others)).collect()]
    sim = lambda x, y: len(x & y) / len(x | y)
    best = {i: max(sim(set(t.split()), set(u.split())) for _, u in others) for i, t in rows if t}
    assert got == [(i, round(v, 9)) for i, v in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]]
    assert 0 < sum(sizes["jaccard-near"]) < 0.2 * sum(sizes["jaccard-candidates"])


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_leader_clusters_in_ranges(spark, parts):
    """Ranges of ids give what one walk gives; groups of copies, near ones, and chains; ids out of order."""
    import random

    rng = random.Random(12)
    base = [[f"g{g}w{j}" for j in range(12)] for g in range(6)]
    sets = [(rng.randrange(10**9) * 300 + i, [x for x in rng.choice(base) if rng.random() < 0.93] + [f"o{rng.randrange(4)}"]) for i in range(260)] + [(-5, []), (-4, None), (-3, ["alone"])]
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want, led = {}, []
    for i, x in sorted(sets, key=lambda r: r[0]):
        near = [j for j, y in led if x and y and jac(x, y) >= 0.7]
        want[i] = near[0] if near else i
        led += [] if near else [(i, x)]
    got = similarity.leader_clusters(spark.createDataFrame(sets, "id long, shingles array<string>").repartition(3), 0.7, parts=parts).collect()
    assert len(got) == len(sets) and {r.id: r.leader for r in got} == want and len(led) < 60


@pytest.mark.parametrize("neighbours,cell_rows,guest_rows", [(3, 2000, 200_000), (4, 9, 20), (1, 15, 7)])
def test_dbscan_without_pairs(spark, neighbours, cell_rows, guest_rows):
    """The clusters of the pairs, from meetings alone."""
    rows = [*clustered(150, 9, 0.42), *clustered(30, 30, 0.1, seed=8)[:30], (900, [0.0] * 24)]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    pairs = spark.createDataFrame(sorted(brute(rows, 0.85)), "a long, b long")
    want = {tuple(r) for r in similarity.dbscan(pairs, spark.range(len(rows)), neighbours).collect()}
    got = [tuple(r) for r in similarity.dbscan_vectors(frame(spark, rows), 0.85, neighbours, cell_rows, guest_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({c for _, c, _ in want}) > 3 and (neighbours == 1 or any(not core for *_, core in want))


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_means_walked_in_chunks(chunk):
    """The walk one by one, whatever the chunks; copies, vectors of length zero, and more means than are first made room for."""
    rng = np.random.default_rng(3)
    rows = np.concatenate([np.array([v for _, v in clustered(400, 9, 0.5)]), rng.normal(size=(1100, 24)), np.zeros((3, 24))])
    rows = np.concatenate([rows, rows[:40]])[rng.permutation(len(rows) + 40)]
    means, sizes, want = [], [], []
    for v in rows:
        sims = [float(v @ m / (np.linalg.norm(v) * np.linalg.norm(m) or 1.0)) for m in means]
        k = int(np.argmax(sims)) if sims else 0
        if sims and sims[k] >= 0.75:
            means[k], sizes[k] = (means[k] * sizes[k] + v) / (sizes[k] + 1), sizes[k] + 1
        else:
            k = len(means)
            means.append(v)
            sizes.append(1)
        want.append(k)
    assert similarity._walked_means(rows, 0.75, chunk) == want and len(means) > 1024 and max(sizes) > 9


def test_cells_that_rule_out_little_are_few(spark):
    """Vectors that point everywhere, ten times as many: rows grow as they do, by cells and by units; the pairs are all there."""
    per = []
    for n in (200, 2000):
        rows = clustered(n, n, 1.0, seed=4)
        dealt = similarity.cells(frame(spark, rows), 0.2, cell_rows=10)
        units = similarity._units(dealt, similarity._block_rows(dealt, 10), 1_000)
        per.append((dealt.count() / n, units.count() / n))
    assert all(b <= 1.5 * a for a, b in zip(*per)) and max(per[1]) <= 20
    got = [(r.a, r.b) for r in similarity.cosine_pairs(frame(spark, rows), 0.45, 10, 300).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.45)


def test_only_what_may_be_similar_meets(spark, monkeypatch):
    """Rare items decide who meets, however many there are: candidates are nearly the pairs themselves, and much alike sets meet a few times, not
    once an item; what only one set holds is not dealt out. Pairs are those of all with all, also where items share their places."""
    import random

    rng = random.Random(14)
    sets = [(i, [f"c{min(rng.randrange(400), rng.randrange(400))}" for _ in range(20)] + [f"u{i}x{j}" for j in range(20)]) for i in range(1500)]
    sets += [(5000 + 100 * g + i, [x for x in sets[g][1] if rng.random() < 0.95] + [f"n{g}x{i}"]) for g in range(4) for i in range(30)]
    df = spark.createDataFrame(sets, "id long, shingles array<string>").repartition(3)
    jac = lambda x, y: len(x & y) / len(x | y)
    sets = [(i, set(x)) for i, x in sets]
    want = {(a, b): jac(x, y) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) > 19 and jac(x, y) >= 0.7}
    written, keep = {}, similarity.kept
    monkeypatch.setattr(similarity, "kept", lambda df, name="kept": written.setdefault(name, []).append(keep(df, name)) or written[name][-1])
    monkeypatch.setattr(similarity, "dropped", lambda *frames: None)
    assert {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(df, 0.7).collect()} == want and len(want) > 1000
    assert len(want) <= written["jaccard-candidates"][0].count() < 2 * len(want)
    hashed = written["jaccard-sets"][0]
    ready = similarity._prefixes(hashed, 0.7, similarity._counted(hashed)).toPandas()
    assert len(ready) < 0.4 * sum(len(x) - -(-7 * len(x) // 10) + 1 for _, x in sets)
    meetings = ready.merge(ready, on="item").query("id_x < id_y")
    for i in range(1, 4):
        for j in range(1, 4):
            meetings = meetings[meetings[f"e{i}_x"].isna() | (meetings[f"e{i}_x"] != meetings[f"e{j}_y"])]
    assert len(want) <= len(meetings) < 3 * len(want)
    counted = similarity._counted

    def crowded(hashed):  # as if every place held an item that occurs twice, at some level
        bits, levels = counted(hashed).value
        return spark.sparkContext.broadcast((bits | 255, levels * 0 + (np.arange(len(levels)) % 3).astype(np.uint8)))

    monkeypatch.setattr(similarity, "_counted", crowded)
    assert {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(df, 0.7).collect()} == want


@pytest.mark.parametrize("few_pairs", [0, 50_000])
def test_leaders_take_few_tables(spark, monkeypatch, few_pairs):
    """Prefixes are made once, not once a range; few pairs need no sketches and no rounds. The leaders are those of the walk by brute force."""
    import random

    rng = random.Random(21)
    base = [[f"g{g}w{j}" for j in range(15)] for g in range(20)]
    sets = [(i, [x for x in rng.choice(base) if rng.random() < 0.9] + [f"o{rng.randrange(9)}"]) for i in range(300)]
    jac = lambda x, y: len(x & y) / len(x | y)
    want, led = {}, []
    for i, x in [(i, set(x)) for i, x in sets]:
        want[i] = next((j for j, y in led if jac(x, y) >= 0.7), i)
        led += [(i, x)] if want[i] == i else []
    names, keep = [], similarity.kept
    monkeypatch.setattr(similarity, "_FEW_PAIRS", few_pairs)
    monkeypatch.setattr(similarity, "kept", lambda df, name="kept": names.append(name) or keep(df, name))
    got = similarity.leader_clusters(spark.createDataFrame(sets, "id long, shingles array<string>").repartition(3), 0.7, parts=3).collect()
    assert len(got) == len(sets) and {r.id: r.leader for r in got} == want and 20 < len(led) < 150
    assert names.count("jaccard-sketches") == (not few_pairs) and len(names) < (70 if not few_pairs else 45)


def test_leaders_of_wrong_pairs(spark):
    for pairs in ([(2, 1)], [(1, 9)]):
        with pytest.raises(ValueError):
            similarity.leaders(spark.createDataFrame(pairs, "a long, b long"), spark.range(4))
