"""The ten training-data operators: brute force, round trips, edge cases and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import common, exact_dedup, fuse, labelled, licences, media, mixing, packing, quality, repair, simhash, token_files, tokens, toxicity, warc
from quillmesh.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Hello  wörld\n"), (5, "Hello wörld"), (5, "Hello wörld"), (None, "a b c"), (7, "x " * 5000), (8, "日本語 テキスト 'quote' 12,34 <|endoftext|>")]

CLASHING = ["_id", "_sha", "_skey", "_copies", "_threshold", "_times", "_copy", "_fp", "_root", "_hot", "_cold", "_own", "_sniffed", "size", "n", "row", "key", "lines", "checked", "rows", "media", "logit", "bucket"]


def whole(rows):
    """Every clashing column still has the user's value."""
    return all(r[c] == f"own {c}" for r in rows for c in CLASHING)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns whose names the operators use inside."""
    rows = [(i, t, None if i == 2 else "s", "en", k, "z") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, label int, sha string").withColumns({c: F.lit(f"own {c}") for c in CLASHING})


# ---- 1 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_round_trip(spark, gzip):
    bait = "before WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nafter " + "y" * 90
    pages = [(i, f"http://a/{i} b", "page %d " % (i % 7) * 40) for i in range(60)] + [(60, None, bait), (61, "u", None), (62, "u", ""), (3, "again", "page 3 " * 40), (None, "n", "page 4 " * 40), (63, "u", "short"), (64, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    folder = common.new_folder(spark, "warc-test")
    files = warc.write(df, folder, gzip=gzip, file_bytes=3000)
    got = warc.read(spark, folder, files, gzip=gzip, range_bytes=700, payloads=True).collect()
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h in first and i != first[h] else "response", str(first[h]) if h in first and i != first[h] else "") for i, _, h in pages)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to) if r.refers_to is not None else "") for r in got) == want
    assert {r.payload.decode() for r in got if r.page_id == 60} == {bait}


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_long_url(spark, gzip):
    pages = [(0, "http://a/0", "first"), (1, "data:," + "x" * 200_000, "long"), (2, "http://a/" + "\x01" * 70_000, "tripled"), (3, "http://a/3", "third"), (4, "http://a/4", "last")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    folder = common.new_folder(spark, "warc-test")
    files = warc.write(df, folder, gzip=gzip)
    got = warc.read(spark, folder, files, gzip=gzip, range_bytes=50_000).collect()
    assert {(r.page_id, r.url) for r in got} == {(i, u.replace("\x01", "%01")) for i, u, _ in pages} and len(got) == 5


def test_warc_missing_records(spark):
    """An archive that gives fewer records than were written is an error."""
    folder = common.new_folder(spark, "warc-test")
    files = warc.write(spark.createDataFrame([(0, "u", "a"), (1, "u", "b")], "page_id long, url string, html string").coalesce(1), folder)
    with pytest.raises(ValueError, match="has 3 records, 2 of them"):
        warc.read(spark, folder, files.withColumn("n_records", F.col("n_records") + 1))


def test_warc_empty(spark):
    folder = common.new_folder(spark, "warc-test")
    files = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder, files).count() == 0


# ---- 2 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    made = fuse.build(keys)
    assert fuse.contains(made, keys).all()
    assert fuse.contains(made, rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.02


def test_exact_duplicates(spark, odd):
    rng = random.Random(1)
    more = [(100 + i, rng.choice(["aa b", "a ab", "c", "aab ", "d\te", " de"])) for i in range(60)]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "q") for i, t in more], "doc_id long, text string, sha string").withColumns({c: F.lit(f"own {c}") for c in CLASHING}), allowMissingColumns=True)
    groups = defaultdict(list)
    for i, t in [*ODD, *more]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), 1 << 62 if i is None else i))
    got = exact_dedup.duplicates(*exact_dedup.halves(docs)).collect()
    assert len(got) == len(ODD) + len(more) and sum(r.kept for r in got) == len(groups)
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        rows = by[r.text_sha256]
        best = min(rows)[1]
        assert (r.group_size, r.keep_id) == (len(rows), None if best == 1 << 62 else best)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and whole(kept.collect())
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------------------------------


def fill(sizes, weights=(1, 2, 3), limit=3.0):
    """Targets by repeated sharing, one source stopping at a time."""
    names, total, target, open_ = sorted(sizes, key=lambda s: (s is None, (s or "").encode())), sum(sizes.values()), {}, None
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_ = set(names)
    while open_:
        share = {s: total * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = limit * sizes[s]
            total -= target[s]
        open_ -= over
    return target


def test_mixing(spark, odd):
    rng = random.Random(2)
    rows = [(1000 + i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "b", "b", "b", "é", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit("x")).unionByName(odd.select("doc_id", "text", "source", F.lit("x").alias("h")))
    got = mixing.plan(docs).collect()
    assert len(got) == 3000 + len(ODD)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.taken == r.size * r.copies <= 3 * r.size
    every = [*rows, *[(i, t, None if i == 2 else "s") for i, t in ODD]]
    for i, t, s in every:
        sizes[s] += len(WORDS.findall(t or ""))
    want = fill(sizes)
    of = {i: s for i, t, s in every}
    for r in got:
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 5000
    again = mixing.plan(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    again = mixing.mix(odd)
    assert again.columns == odd.columns and whole(again.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_takes_no_document_too_often(spark):
    """A capped source whose first documents have no words: three copies of each, never four."""
    rows = [(i, "" if i < 40 else "w w", "small") for i in range(60)] + [(100 + i, "w " * 50, "zlarge") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = defaultdict(int)
    for r in mixing.mix(docs).collect():
        times[r.doc_id] += 1
    assert {times[i] for i in range(60)} == {3} and max(times.values()) <= 3
    assert {r.copies for r in mixing.plan(docs).where("doc_id < 100").collect()} == {3}


# ---- 4 ----------------------------------------------------------------------------------------------------------------

TRICKY = ["", " ", "  ", "a  b", "foo\n  bar", " lead", "trail ", "\n", "x   y\t z", "<|endoftext|> a <|startoftext|>b", "it's 'll don't,'x", "a\n\nb c\n\n\nd e.\nF", "a1b, 12,34", "\x1c a\x1cb", "ΑΣ é É ß.", "é ́x", None, "word, " * 300, "a \x01 b\x01 c", "<|ENDOFTEXT|> K Å", "x\x85y z\x85 w", "end.,! end... ß? 1. a| x%%%"]
BITS = [" ", " ", "  ", "\n", "a", "B", "é", "'s", "'", "1", ".", "!!", "|", "<|endoftext|>", "\x01", "\xa0", "ß", "\u0301", "日", "Σ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("most", [160_000, 40])
def test_word_memo_is_exact(name, most):
    memo = tokens.WordMemo(tokens.installed(name), most)
    assert memo.kind in ("marked", "dropped")
    rng = random.Random(3)
    fuzz = ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for texts in (TRICKY, TRICKY[::-1], TRICKY[3:4], [], [None], fuzz, fuzz[::-1]):
        ids, counts = memo.ids(pa.array(texts, pa.string()))
        want = [e.ids for e in memo.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == list(itertools.chain.from_iterable(want))
    assert len(memo.place) <= most


def test_other_rules_are_encoded_whole(tmp_path):
    """A file whose pattern isn't one of the two known ones: no word is taken out of its text."""
    import json
    from pathlib import Path

    rules = json.loads(Path(tokens.installed("byte_bpe_50k.json")).read_text())
    rules["pre_tokenizer"]["use_regex"] = False  # tokens may cross spaces
    (tmp_path / "t.json").write_text(json.dumps(rules))
    memo = tokens.WordMemo(str(tmp_path / "t.json"))
    assert memo.kind == "whole"
    ids, counts = memo.ids(pa.array(TRICKY, pa.string()))
    want = [e.ids for e in memo.tok.encode_batch([t or "" for t in TRICKY], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == list(itertools.chain.from_iterable(want))


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 400, 50)
    ids = rng.zipf(1.5, counts.sum()) % 300
    shard = repair.Shard(repair.pack(2, 3, np.arange(50), ids, counts))
    assert (shard.part, shard.shard) == (2, 3) and (shard.all() == ids).all() and len(shard.symbols) < len(ids) and len(shard.rules)
    ends = np.cumsum(counts)
    for k in range(50):
        own = ids[ends[k] - counts[k] : ends[k]]
        assert (shard.tokens(k) == own).all() and (shard.tokens(k, 5, 60) == own[5:60]).all()
    ones = repair.Shard(repair.pack(0, 0, np.array([1, 2]), np.zeros(301, int), np.array([300, 1])))
    assert (ones.all() == 0).all() and len(ones.symbols) < 80
    assert len(repair.Shard(repair.pack(0, 0, np.array([1]), np.zeros(0, int), np.array([0]))).all()) == 0


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(0, 50_000, 64), 4000), rng.integers(0, 50_000, 300_000)])
    counts = np.array([64 * 4000, 300_000])
    seq, starts, rules, lengths = repair.compress(ids, counts)
    assert starts[1] < 80  # 64 ids repeated 4,000 times; the rounds of pairs don't stop early
    pairs = [p for a, b in zip(starts[:-1], starts[1:]) for p in zip(seq[a:b][:-1].tolist(), seq[a:b][1:].tolist())]
    assert max(np.unique(pairs, axis=0, return_counts=True)[1]) < 6
    wide = repair.Shard(repair.pack(0, 0, np.arange(2), np.concatenate([ids, np.repeat(rng.integers(0, 50_000, (40_000, 2)), 6, axis=0).ravel()]), np.array([64 * 4000, 300_000 + 480_000])))
    assert wide.symbols.dtype == np.uint32 and len(wide.rules) > 16_000 and wide.counts.sum() == len(wide.all())


def test_token_files(spark, odd):
    folder = common.new_folder(spark, "repair-test")
    files = token_files.write(odd, folder, "byte_bpe_50k.json", shard_tokens=1000)
    got = token_files.read(spark, folder, files).orderBy("start").collect()
    tok = tokens.WordMemo(tokens.installed("byte_bpe_50k.json")).tok
    at = 0
    for r, (i, t) in zip(got, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = common.new_folder(spark, "repair-test")
    assert token_files.read(spark, empty, token_files.write(odd.limit(0), empty, "byte_bpe_50k.json")).count() == 0


# ---- 5, 8 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("module, label, remainder, kind", [(toxicity, "toxic", 2, 4), (quality, "quality", 0, 5)])
def test_held_out(spark, module, label, remainder, kind):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % kind == remainder for i in rows.doc_id)
    yes, no = rows[rows[label] == 1], rows[rows[label] == 0]
    assert (yes.predicted.mean(), no.predicted.mean()) >= (0.75, 0) and no.predicted.mean() <= 0.05
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all() and rows.score.between(0, 1).all()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_edges(spark, odd, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    some = spark.createDataFrame([(4, 1), (5, 0), (5, None), (7, 1), (None, 1), (1, 0)], f"doc_id long, {label} int")
    for labels in (none, some, some.where(f"{label} = 1")):
        rows = module.classify(odd, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(odd.limit(0), labels).count() == 0
    kept = quality.keep_good(odd, none) if module is quality else odd
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_toxicity_scores_by_brute_force(spark, sf):
    """Scores against a forward pass of one document at a time, window by window, in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labelled.usable_labels(labels, "toxic", ~toxicity.held_out())
    net, trained, _ = toxicity.train(docs, known)
    assert known.where(trained).where(toxicity.held_out() | labelled.checked()).isEmpty()
    sample = [*docs.limit(40).collect(), *spark.createDataFrame([(None, "", None), (None, "one", None), (None, "a b", None)], "doc_id long, text string, lang string").collect()]
    got = toxicity.logits(spark.createDataFrame([(i, r.text) for i, r in enumerate(sample)], "doc_id long, text string"), net).collect()
    for r in got:
        rows, _ = toxicity.word_rows(pa.array([sample[r.doc_id].text]))
        x = [np.concatenate([net.table[0][a], net.table[1][b]]).astype(float) for a, b in rows]
        hidden = []
        for k in toxicity.WIDTHS:
            best = np.zeros(toxicity.FILTERS)
            if x:
                best = np.max([sum(x[i + j] @ net.kernels[k][j] for j in range(k) if i + j < len(x)) for i in range(len(x))], axis=0)
            hidden += list(np.maximum(best + net.biases[k], 0))
        assert r.logit == pytest.approx(float(np.dot(hidden, net.out[:-1]) + net.out[-1]), abs=1e-3)


def test_quality_scores_by_brute_force(spark, sf):
    """Scores against features counted word by word and byte by byte, and a plain sum."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, ~quality.held_out())
    texts = {i: r.text for i, r in enumerate(docs.limit(40).collect())} | {900: "", 901: None, 902: "One", 903: "a\na\nb | b B!"}
    got = quality.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        raw, words, x = t.encode(), t.split(), [0.0] * quality.WIDTH
        if raw:
            n, count = len(raw), max(1, len(words))
            letters = max(1, len(re.findall("[A-Za-z]", t)))
            lines = t.split("\n")
            rate = lambda chars, of: math.sqrt(sum(t.count(c) for c in chars) / of)
            x[:10] = [rate("|", count), rate("!", count), rate("#$%&*@^~+=<>\\_{}[]", count), math.sqrt(len(re.findall("[A-Z]", t)) / letters), math.sqrt(len(re.findall("[0-9]", t)) / n), math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / count), math.sqrt(1 - len(set(lines)) / len(lines)), rate(".,", count), min(4.0, n / count / 8), math.log1p(len(words)) / 8]
            for w in words:
                x[10 + zlib.crc32(w.lower().encode()) % quality.WORDS] += 1 / count
            for a, b, c in zip(raw, raw[1:], raw[2:]):
                x[10 + quality.WORDS + ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % (1 << 32) >> 24)] += 1 / (n - 2)
            x[10:] = [math.sqrt(v) for v in x[10:]]
        strength = sum(min(8, max(-8, (v - m) / s)) * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(strength - model.threshold + math.log(0.3 / 0.7)))), abs=1e-4)


# ---- 6 ----------------------------------------------------------------------------------------------------------------


def samples():
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b"\x2c" + bytes(8) + b"\0\2\2\x44\1\0\x3b"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(40)
    pack = zlib.compressobj(wbits=31)
    return {"image/png": png, "image/gif": gif, "image/bmp": bmp, "application/gzip": pack.compress(b"hi" * 99) + pack.flush(), "audio/wav": media.to_wav(b"abc"), "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab1234\xff\0\xff\xd9", "application/pdf": b"%PDF-1.4 x startxref 9 %%EOF"}


@pytest.mark.parametrize("kind", samples())
def test_formats(kind):
    data, s = samples()[kind], media.sniffer()
    assert s.find(data) and s.find(data)[0] == (kind, 0, len(data))
    assert (kind, 5, len(data)) in s.find(b"junk " + data + b" tail")
    assert not [x for x in s.find(data[:-3]) if x[0] == kind and x[1] == 0]
    seen = s.sniff(data + b"??", "image/tiff" if kind != "image/tiff" else "x")
    assert (seen["media_type"], seen["corrected"], seen["trailing"]) == (kind, True, 2)


def test_media(spark, odd):
    got = sorted(media.describe(media.store(odd)).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    for r, (i, t) in zip(got, sorted(ODD, key=lambda x: (x[0] or 0, len((x[1] or "").encode())))):
        raw = (t or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = media.to_wav(raw)
        assert (r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (i, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
    df = spark.createDataFrame([(1, b"x" + samples()["image/png"]), (2, None)], "k int, media binary")
    assert [(r.k, r.type, bytes(r.media)) for r in media.carve(df, "k").collect()] == [(1, "image/png", samples()["image/png"])]


# ---- 7 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, distance=4):
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= distance:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark, odd, sf):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = simhash.near_duplicates(docs).collect()
    texts = docs.collect()
    assert sorted(r.fingerprint for r in rows) == sorted("%016x" % plain_fingerprint(t.text) for t in texts)
    prints = [int(r.fingerprint, 16) for r in rows]
    groups = defaultdict(list)
    for r, g in zip(rows, roots(prints)):
        groups[g].append(r)
    for own in groups.values():
        assert {r.component_id for r in own} == {min((r.doc_id for r in own if r.doc_id is not None), default=None)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and whole(kept.collect())
    assert {r.doc_id for r in kept.collect()} == {1, 4, None, 7, 8}
    nameless = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "f g h i j k"), (5, "f g h i j k"), (6, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(nameless).collect()) == [("5", "f g h i j k"), ("6", None), ("None", "a b c d e")]


def test_join_groups_splits_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "row long, key string")
    groups = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("row").alias("first")).where("size > 1 or key < 'k2'")
    got = common.join_groups(rows, groups, "key", "size", ["row"], most=10).collect()
    want = {r.key: r for r in groups.collect()}
    assert len(got) == 3000 and all((r.size, r.first) == ((want[r.key].size, want[r.key].first) if r.key in want else (None, None)) for r in got)


def test_filters_are_kept_for_the_next_batch(spark, tmp_path):
    snapshot, batch = (spark.createDataFrame([(i, f"text {i % n}") for i in range(a, a + 40)], "doc_id long, text string") for a, n in ((0, 30), (100, 50)))
    digests = snapshot.select(F.sha2(exact_dedup.normal().cast("binary"), 256).alias("sha")).distinct()
    exact_dedup.build_filters(digests, f"file://{tmp_path}/filters")
    kept = exact_dedup.open_filters(spark, f"file://{tmp_path}/filters")
    assert sorted(map(str, exact_dedup.duplicates(snapshot, batch, kept).collect())) == sorted(map(str, exact_dedup.duplicates(snapshot, batch).collect()))
    with pytest.raises(ValueError, match="the filters hold"):
        exact_dedup.duplicates(batch, snapshot, kept)


@pytest.mark.parametrize("most", [4096, 16])
def test_links_lose_nothing(spark, most):
    """Dense balls, with buckets above and below the size that one task takes."""
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(150)}
    for c in [rng.getrandbits(64) for _ in range(3)]:
        values |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(150)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), most=most), "t").collect()
    root = {r.node: r.root for r in found}
    want = roots([v & (1 << 64) - 1 for v in values])
    assert [root.get(v, v) for v in values] == [values[g] for g in want]


# ---- 9 ----------------------------------------------------------------------------------------------------------------


def test_packing(spark, odd, sf):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    tok = tokens.WordMemo(tokens.installed("word_bpe_49k.json")).tok
    texts = docs.collect()
    rows = packing.pack(docs, "word_bpe_49k.json", 2, block_tokens=20_000).collect()
    lines, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        lines[r.sequence_id].append(r)
        pieces[r.row].append(r)
    for own in lines.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert sum(r.length for r in own) in {1 << k for k in range(13)}
    assert sum(sum(r.length for r in own) < 4096 for own in lines.values()) <= 12 * (1 + sum(r.length for r in rows) // 20_000)
    # Every row's pieces cover its ids once, and their crc32 is that of the library's ids.
    got, want = [], []
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert {r.doc_tokens for r in own} == {sum(r.length for r in own)} and len({r.doc_id for r in own}) == 1
        got.append((str(own[0].doc_id), tuple((r.start, r.length, r.ids_crc32) for r in own)))
    by = defaultdict(list)
    for i, spans in got:
        by[i].append(spans)
    for t in texts:
        ids = np.array(tok.encode(t.text or "", add_special_tokens=False).ids + [2], "<u4")
        fits = [s for s in by[str(t.doc_id)] if s[-1][0] + s[-1][1] == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in s)]
        assert fits
        by[str(t.doc_id)].remove(fits[0])
        want.append(t)
    assert len(got) == len(want) == len(texts)
    assert packing.pack(docs.limit(0), "word_bpe_49k.json", 2).count() == 0


def test_plan_balances_cost():
    rng = np.random.default_rng(1)
    pieces, left = packing.plan(rng.integers(1, 900, 4000), 4096, True)
    assert not left
    used, cost = defaultdict(int), defaultdict(float)
    for _, _, n, s, _, c in pieces:
        used[s] += n
        cost[s] += c
    full = [cost[s] for s in used if used[s] == 4096]
    assert len(full) > 400 and np.std(full) / np.mean(full) < 0.02


# ---- 10 ---------------------------------------------------------------------------------------------------------------


def test_licences(spark, odd):
    texts = dict(licences.known_texts()[: len(licences.known_texts()) - len(licences.NOTICES)])
    plain = {i: t for i, t in reversed(licences.known_texts()) if (i, t) not in licences.NOTICES}
    assert {"Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "CC0-1.0", "Unlicense"} <= set(texts)
    mit, isc = plain["MIT"], plain["ISC"]
    rows = [(1, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper()), (2, isc.replace(",", " ;")), (3, mit[:-9]), (4, "Prose here.\nReleased under the MIT Licence!\nMore."), (5, None), (6, ""), (7, mit), (7, mit), (8, "MIT License\n\nCopyright Jane Q. Doe\n\n" + mit), (9, plain["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 The Authors").replace("License", "Licence"))]
    rows += [(100 + k, re.sub(r"[ \t]+", " \t", t).replace("\n", "\r\n").upper()) for k, t in enumerate(plain.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("lines", F.lit(1))
    got = sorted(licences.scan(docs, licences.known_licences(spark)).collect(), key=lambda r: r.doc_id)
    assert [r.license_id for r in got[:10]] == ["MIT", "ISC", None, None, None, None, "MIT", "MIT", "MIT", "Apache-2.0"]
    assert [r.license_id for r in got[10:]] == list(plain)
    assert got[3].notices == "MIT" and got[2].notices is None or got[2].notices == ""
    assert got[0].text_digest == got[6].text_digest and got[4].text_digest == got[5].text_digest
    assert licences.scan(docs.limit(0), licences.known_licences(spark)).count() == 0


def test_words_of_letters_by_the_model_itself():
    """The same ids as of whole texts, while the library's encoding is called for other words only."""
    memo = tokens.WordMemo(tokens.installed("byte_bpe_50k.json"))
    rng = np.random.default_rng(6)
    syllables = ["con", "Qué", "ß", "ñó", "ÿ", "th", "ing", "È", "s", "t", "re", "×", "don't", "ſ", "4", ".\n", ".\n\n", "$$$", "***", "&&&", ".###", "<|endoftext|>", "x<|endoftext|>$", "l'", "ll"]
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40)) for _ in range(400)]
    called, whole = [], memo._called
    memo._called = lambda words: (called.extend(words), whole(words))[1]
    ids, counts = memo.ids(pa.array(texts))
    want = [e.ids for e in memo.tok.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert called and not any(w.isalpha() and w.isascii() or w == "con.\nth" for w in called)
