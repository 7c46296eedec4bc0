"""Line dedup, spelling variants and ranked search against brute force, with nulls, ties, hot keys and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import line_dedup, ranking, spellings

SPACES = " \t\n\x0b\x0c\r"
CLASHING = ["_id", "_lost", "_lines", "_kept", "n_lines", "n_dropped", "id", "digest", "digests", "hash", "word", "n", "item", "rank", "score", "ids"]
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "\n\n"), (None, "a line that is long enough to count\nx"), (5, "é" * 20), (5, "é" * 20), (6, "É" * 20), (7, "x " * 60_000 + "\n" + "long " * 9_000)]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(parts)


# ---- lines ------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(line_dedup._NO_ID if i is None else i)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keep.get(key(x), i) == i]
        out.append((str(i), len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    rng = random.Random(11)
    pool = [f"Line number {i} of the pool that repeats" for i in range(30)] + ["too short to count"] * 3 + ["", "ünïcödé " * 3, "Ünïcödé " * 3]
    rows = [(i, "\n".join(rng.choice([" ", "", "\t"]) + (x.upper() if rng.random() < 0.2 else x) for x in rng.choices(pool, k=rng.randrange(6)) + [f"only here {i} and nowhere else at all"])) for i in range(200)]
    return rows + [(1000 + i, "One hot line that a third of all documents hold\nown %d" % i) for i in range(120)] + ODD


def test_line_dedup(spark):
    rows = line_rows()
    got = line_dedup.without_repeats(frame(spark, rows)).collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASHING) and {"_n_lines", "_n_dropped"} <= set(got[0].asDict())
    assert sorted((str(r.doc_id), r._n_lines, r._n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == brute_lines(rows)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_filters_miss_no_repeat(spark, bound):
    """Whatever their size, the filters pass every hash seen twice; large enough, they pass few others."""
    rng = np.random.default_rng(3)
    once, twice = rng.integers(-(1 << 63), 1 << 63, (2, 20_000), np.int64)
    rows = [(int(h), False) for h in [*once, *twice, *twice]] + [(7, True)]
    filters = line_dedup.twice_seen(spark.createDataFrame(rows, "hash long, repeated boolean").repartition(5), bound)
    screen = line_dedup.Screen(filters)
    assert screen.may_repeat(np.append(twice, 7)).all()
    assert bound == 0 and sum(map(len, filters)) == 64 * 16 or screen.may_repeat(once).mean() < 0.02


def test_lines_of_saturated_filters(spark):
    """Filters that suspect everything change no row."""
    docs = frame(spark, line_rows()).select("doc_id", "text")
    small, large = (sorted((r.id, sorted(map(bytes, r.digests))) for r in line_dedup.repeated_keys(docs, most_bytes=b).collect()) for b in (0, 64 << 20))
    assert small == large and small


def test_line_dedup_empty(spark):
    assert line_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- spellings --------------------------------------------------------------------------------------------------------


def brute_words(rows, one_in=199, least=5):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, factor=5):
    out = {}
    for w, n in words.items():
        near = [o for o in words if one_edit(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        out[w] = (n, len(near), best if best and words[best] >= factor * n else None)
    rows = []
    for w, (n, near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, n, near, form, words[form] if form else None, root))
    return sorted(rows, key=str)


def test_spellings(spark):
    rng = random.Random(5)
    stems = ["running", "rünning", "manager", "aaaaaa", "aaaaaaa", "abababab", "straße", "señorita", "naïveté", "x" * 300]
    pool = [*stems] + [s[:i] + rng.choice("abé") + s[i + rng.randrange(2) :] for s in stems for i in rng.sample(range(len(s)), 5)]
    rows = [(i, " ".join(rng.choice([str.upper, str])(w) for w in rng.choices(pool, weights=[30] * 10 + [1] * 50, k=80)) + " 日本ABCDEFG日 don÷tstop x×y") for i in range(150)]
    rows += [(i, t) for i, t in ODD]
    words = spellings.word_counts(frame(spark, rows).select("doc_id", "text"), one_in=7)
    want = brute_words(rows, one_in=7)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 60
    got = sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spellings.variants(words.withColumn("root", F.lit(1))).collect()), key=str)
    assert got == brute_variants(want) and any(r[5] != (r[3] or r[0]) for r in got)


def test_spellings_of_hot_keys(spark, monkeypatch):
    """Keys above a block's size are compared block by block: the same rows."""
    monkeypatch.setattr(spellings, "_BLOCK", 16)
    monkeypatch.setattr(spellings, "_TILE", 8)
    rng = random.Random(6)
    words = {"common" + "".join(rng.choices("ab", k=rng.randrange(1, 8))): rng.randrange(5, 400) for _ in range(250)} | {"日本語日本語": 9, "日本語日本": 60, "日本語日本人": 9}
    got = spellings.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got), key=str) == brute_variants(words)


def test_common_prefixes():
    words = ["abc", "abcd", "xbc", "é", "", "abc" * 100]
    got = spellings.common_prefixes(words)
    assert all(got[i, j] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for i, a in enumerate(words) for j, b in enumerate(words))


def test_spellings_empty(spark):
    assert spellings.variants(spellings.word_counts(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


# ---- ranking ----------------------------------------------------------------------------------------------------------


def brute_search(rows, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    docs = [(i, c) for i, t in rows if (c := Counter(terms(t)))]
    n_docs, n_terms, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(w for _, c in docs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, t in items:
        found = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(t) if w in c)
            if score > 0:
                found.append((-score, 1 << 63 if i is None else i, i))
        out += [(item, p, i, -s) for p, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sides", [(256, 2048, 512), (3, 5, 7)])
def test_search(spark, monkeypatch, sides):
    for name, value in zip(("_ITEMS", "_COLUMNS", "_DOCS"), sides):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(13)
    pool = ["alpha", "Beta", "gamma", "délta", "日本", "42", "x9", "a_b", "É", "é", "the", "THE"]
    rows = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(pool, k=rng.randrange(30)))) for i in range(150)] + [(500 + i, "alpha beta the copies") for i in range(60)] + ODD + [(None, "alpha beta the copies")]
    items = [(0, "alpha beta BETA"), (1, "the the the 日本 a_b"), (2, "nowhere"), (3, None), (3, "É é x9"), (None, "copies " * 300), (4, " ".join(pool))]
    got = ranking.search(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)))
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == brute_search(rows, items)


def test_search_in_passes(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha w{i}") for i in range(7)], "item_id long, text string")
    rows = [(i, f"w{i} alpha" + " beta" * i) for i in range(30)]
    monkeypatch.setattr(ranking.passes, "__defaults__", (3, 8 << 20))
    got = ranking.search(frame(spark, rows), items).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute_search(rows, [(i, f"alpha w{i}") for i in range(7)])


def test_tiles_stay_exact():
    """Sums over a tile stay below the limit, whatever the items; all counts are there once."""
    rng = random.Random(1)
    counts = [{t: rng.choice([1, 2, 500]) for t in rng.sample(range(50), 20)} for _ in range(9)]
    weights = np.array([rng.randrange(3000) for _ in range(50)])
    made = ranking.blocks(counts, weights, limit=10**11)
    total = [Counter() for _ in counts]
    for columns, entries in made:
        load = Counter()
        for item, column, n in entries:
            total[item][columns[column]] += n
            load[item] += 1_000_000 * int(weights[columns[column]]) * n
        assert max(load.values()) < 10**11 and len(columns) == len(set(columns))
    assert total == [Counter(c) for c in counts] and len(made) > 1


def test_search_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string, item_id long"), spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, item_id long")
    assert ranking.search(none, some).collect() == ranking.search(some, none).collect() == ranking.search(none, none).collect() == []


# ---- media, packing order of their own -------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [b"%PDF-1 ", b"GIF89aabcdefg,", b"%PDF-1 %%EOF ", b"%PDF-1 startxref "])
def test_many_magic_bytes_cost_one_search(piece):
    """A payload of magic bytes alone is checked in time that grows with its length."""
    import time

    from quillmesh.llm import media

    began = time.perf_counter()
    assert media.sniffer().find(piece * 60_000 + b"\0" * 64) == []
    assert time.perf_counter() - began < 8


def test_pdf_marks():
    from quillmesh.llm import media

    find = media.sniffer().find
    assert find(b"x%PDF-1.4 startxref 9 %%EOF y %PDF-x startxref %%EOF %PDF-2 %%EOF startxref %PDF-3 startxref%%EOF") == [("application/pdf", 1, 26), ("application/pdf", 76, 21)]
