"""Packs, classification and redaction against Python's re: over a whole table, and over texts made of the packs' own words."""

import random
import re
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import packs, pii
from quillmesh.functions import text as tx


def found(checks, text):
    out = []
    for c in checks:
        flags = re.M | (0 if c.cased else re.I)
        n = len(re.findall(c.pattern, text, flags))
        if n:
            of = len(re.findall(c.count, text)) if c.count else n
            out.append((c.name, min(c.base + c.step * of, c.cap) if c.step else c.base))
    return out


def brute(text):
    words, keyed = len(text.split()), len(text) <= 200 and any(w in text.lower() for w in packs.SHORT_WORDS)
    commercial = found(packs.COMMERCIAL, text)
    commercial += [("very_short_commercial", 0.5)] * (keyed and len(text) <= 15) + [("few_words_commercial", 0.5)] * (keyed and words < 5)
    emoji = len(re.findall(tx.EMOJI, text))
    generic = found(packs.GENERIC, text) + [("very_short_message", 0.5)] * (len(text) <= 10) + [("few_words_message", 0.5)] * (words < 5) + [("many_emoji", min(0.2 + 0.05 * emoji, 0.8))] * (emoji >= 4)
    return [(n, round(s, 9)) for n, s in commercial], [(n, round(s, 9)) for n, s in generic]


def made(n=1500):
    """Texts of the packs' own words, whole and cut, with what surrounds them in messages."""
    rng = random.Random(21)
    pool = [w for c in (*packs.COMMERCIAL, *packs.GENERIC) for w in re.sub(r"\\[bsdw]|[()\[\]?:*+]|\{.*?\}", "", c.pattern).split("|") if 1 < len(w) < 30]
    pool += [*packs.SHORT_WORDS, "http://a.b/c", "www.x.org", "t.me/abc", "https://", "+1 234 567 8901", "555-123-4567", "12 руб", "$50", "x@y.zz", "😀", "😀😀😀😀", "AAAAAAAAAAA", "aaaaa", "!!!", "0x" + "aB" * 20, "ſale", "ПРОДАМ", "İ", "٣٤٥"]
    cut = lambda w: w[rng.randrange(2) : len(w) - rng.randrange(2)] if rng.random() < 0.3 else w
    return ["".join(rng.choice([str.upper, str.lower, str])(cut(w)) + rng.choice([" ", "", "\n", ", ", "."]) for w in rng.choices(pool, k=rng.randrange(9))) for _ in range(n)]


def texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return table.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(made())], "id long, text string")).repartition(4)


def test_packs_find_what_python_finds(spark):
    rows = texts(spark).select("text", packs.commercial(F.col("text")).alias("c"), packs.generic(F.col("text")).alias("g")).collect()
    seen = set()
    for r in rows:
        got = tuple([(x["name"], round(x["score"], 9)) for x in found_] for found_ in (r.c, r.g))
        assert got == brute(r.text), r.text[:300]
        seen |= {n for part in got for n, _ in part}
    assert len(rows) == 2500 and len(seen) >= 32


def test_classify_is_what_its_scores_say(spark):
    """Rounded half to even, with the first three reasons; null texts score nothing."""
    reason = {c.name: c.reason for c in packs.COMMERCIAL} | {"very_short_commercial": "Very short message with commercial intent", "few_words_commercial": "Very few words with commercial intent"}
    rows = packs.classify(texts(spark).withColumn("clean", tx.clean_text(F.col("text")))).collect()
    for r in rows:
        names = brute(r.clean)[0]
        score = float(Decimal(min(sum(s for _, s in names) / len(names), 0.95) if names else 0.0).quantize(Decimal("0.001"), ROUND_HALF_EVEN))
        assert abs(r.score - score) <= 0.001 + 1e-9 and (r.is_spam, r.spam, r.scam, r.toxic) == (r.score >= 0.40, r.score >= 0.35, r.score >= 0.7, r.score >= 0.5)
        assert r.reasons == [reason[n] for n, _ in names][:3]
    assert sum(r.is_spam for r in rows) > 300
    assert packs.classify(spark.createDataFrame([(None,)], "text string")).first().is_spam in (None, False)


@pytest.mark.parametrize("value,want", [(0.0005, 0.0), (0.0015, 0.002), (0.0025, 0.002)])
def test_half_even(spark, value, want):
    assert spark.range(1).select(F.bround(F.lit(value), 3).alias("x")).first().x == want


def python_redacted(text):
    out = re.sub(pii.EMAIL, r"***@\1", text)
    first, second, third = pii.PHONES
    out = re.sub(first, r"***\1", out)
    out = re.sub(second, lambda m: "***" + (m[0][-4:] if len(m[0]) > 4 else ""), out)
    out = re.sub(third, r"***\1", out)
    out = re.sub(pii.CARD, r"****-****-****-\1", out)
    out = re.sub(pii.ADDRESS, r"\1xxx", out)
    out = re.sub(pii.WEB, lambda m: f"{m[1]}{m[2]}/***" if m[2] else f"{m[1]}***", out)
    ocr = re.sub(pii.SSN, "***-**-****", out)
    for p in pii.PASSPORTS:
        ocr = re.sub(p, "***PASSPORT***", ocr)
    return out, re.sub(pii.ACCOUNT, "***ACCOUNT***", re.sub(pii.LICENCE, "***DL***", ocr))


def test_redaction_is_what_python_does(spark):
    rng = random.Random(3)
    pool = ["a.b@c.org", "555-123-4567", "+7 912 345 67 89", "+123", "1234567890", "12345678901234", "4111 1111 1111 1111", "10.0.0.12", "http://a.b/c?d", "https://", "123-45-6789", "AB123456", "123456789", "AB12CD34EF", "word", "x", "€", "1", "+12 3"]
    own = [rng.choice(["", " "]).join(rng.choices(pool, k=rng.randrange(8))) for _ in range(1000)] + [" ".join(rng.choices(pool, k=6)) for _ in range(1000)]
    rows = texts(spark).unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(own)], "id long, text string"))
    changed = 0
    for r in rows.select("text", pii.redact_pii(F.col("text")).alias("p"), pii.redact_ocr(F.col("text")).alias("o")).collect():
        assert (r.p, r.o) == python_redacted(r.text), r.text[:300]
        changed += r.p != r.text
    assert changed > 1000


def test_redact_struct(spark):
    kind = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("n", T.LongType())]))), T.StructField("m", T.MapType(T.StringType(), T.StringType()))])
    df = spark.createDataFrame([(("me@x.org", [("10.0.0.1", 5), (None, None)], {"k": "http://a.b/c", "n": None}),), ((None, None, None),)], T.StructType([T.StructField("s", kind)]))
    got = [r.x.asDict(True) for r in df.select(pii.redact_struct(F.col("s"), kind).alias("x")).collect()]
    assert got == [{"a": "***@x.org", "b": [{"c": "10.0.0.xxx", "n": 5}, {"c": None, "n": None}], "m": {"k": "http://a.b/***", "n": None}}, {"a": None, "b": None, "m": None}]


def test_lists_of_words_by_first_letter(spark):
    """Words tried by their first letter match as Python's list of them does: order, edges, cases, marks, and longer words."""
    import re

    checks = [c for c in (*packs.COMMERCIAL, *packs.GENERIC) if c.listed()]
    words = [re.sub(r"\\.\??|\[.*\]\??", " ", w) for c in checks for w in c.pattern[5:-3].split("|")]
    texts = [f"{a}{x}{b}" for x in words for a, b in ((" ", " "), ("x", ""), ("", "x"), ("-", "\u0301"), ("\u2764", "."), ("", " " + x.upper()))]
    texts += [" ".join(words), " ".join(words).upper(), "for sale forsale saleforsale", "PIN pin pIn", "дистанционн работа, онлайн и работ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: list(r[2:]) for r in rows.select("i", "t", *[c._matches(F.col("t")).alias(f"c{k}") for k, c in enumerate(checks)]).collect()}
    want = {i: [sum(1 for _ in re.finditer(c.pattern, t, re.I | re.M)) for c in checks] for i, t in enumerate(texts)}
    assert got == want and len(checks) >= 12


def test_five_words(spark):
    texts = [None, "", " ", "a b c d", " a\u00a0b\u2003c\td\ne ", "a b c d ", "x" * 50_000, " a b\u200bc d\n\n", "\x0b1 2 3 4 5 6", "a " * 900]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select((F.size(tx.words(F.col("t"))) >= 5).alias("want"), F.col("t").isNull().alias("null"), packs._five_words(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [None if r.null else r.want for r in rows] and {r.want for r in rows} >= {True, False}


def test_gates_leave_out_what_cannot_match(spark):
    """One link is not two, texts without emoji aren't tried for them; what remains is found as before."""
    places = {c.name: i for i, c in enumerate(packs.COMMERCIAL)}
    texts = ["see http://a.b/c", "http://a.b www.c.d", "http://a.b\nwww.c.d", "T.ME/x, Bit.Ly", "plain", "é", "😀 😀 a 😀 😀", "😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.g for r in rows.select("i", packs._gate(packs.COMMERCIAL)(F.lower("t")).alias("g")).orderBy("i").collect()]
    bit = lambda name: [bool(g >> places[name] & 1) for g in got]
    assert bit("multiple_urls") == [False, True, True, True, False, False, False, False]
    assert bit("excessive_emoji") == [False] * 6 + [True] * 2
    names = [[x["name"] for x in r.c] for r in rows.select("i", packs.commercial(F.col("t")).alias("c")).orderBy("i").collect()]
    assert ["multiple_urls" in n for n in names] == [False, True, False, True] + [False] * 4 and ["excessive_emoji" in n for n in names] == [False] * 6 + [True, False]


def test_signatures_are_made_once_and_whole(spark):
    """Placeholders as of the plain chain of patterns, and no pattern in the plan of the clusters."""
    from quillmesh.operators import signals

    t = F.col("text")
    plain = F.lower(t)
    for pattern, mark in ((r"https?://[^\s]+", "[URL]"), (r"www\.[^\s]+", "[URL]"), (r"t\.me/[^\s]+", "[MESSENGER]"), (tx.SIGNATURE_PHONE, "[PHONE]"), (tx.EMAIL, "[EMAIL]"), (tx.SIGNATURE_PRICE, "[PRICE]"), (r"(?U)\s+", " ")):
        plain = F.regexp_replace(plain, pattern, mark)
    odd = [None, "", "  \t a b \n\nc ", "5 $ 7$ $8 9 РУБ 3 usd 4\neur", "+1 2 3 a.b@c.de www.x http:// t.me/ T.ME/q", "$", "rub 5rub"]
    rows = texts(spark).unionByName(spark.createDataFrame([(-9000 - i, x) for i, x in enumerate(odd)], "id long, text string"))
    assert rows.where(~tx.signature_text(t).eqNullSafe(F.trim(plain))).count() == 0
    old = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"^\s+|\s+$", ""), r"[ \t]+", " ")
    old = F.regexp_replace(F.regexp_replace(old, r" *\n *", "\n"), r"\n+", "\n")
    more = spark.createDataFrame([(x,) for x in [*odd, "a \r\n \r b\r", "\n \n \n", "a\t\n \t\nb  c\td", " \n\n a \n b\n "]], "text string")
    assert rows.select("text").unionByName(more).where(~tx.normalize_text(t).eqNullSafe(old)).count() == 0
    plan = signals.signature_clusters(rows, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_features_count_as_their_plain_patterns(spark):
    """Counts of the analyzer's keys: e-mails are looked for only where there is an @, links and phones at their first characters."""
    t = F.col("text")
    odd = [None, "", "a@b.cd x@y", "HTTP://a www.b T.me bit.LY http", "+1 +12 555-123-4567 1234567890 12345678901", "!?!! ??", "@"]
    rows = texts(spark).select("text").unionByName(spark.createDataFrame([(x,) for x in odd], "text string"))
    f = tx.features(t)
    plain = {"urls": f"(?i){tx.URL_MARK}", "phones": tx.PHONE_MARK, "emails": f"(?i){tx.EMAIL}", "exclamation": "!", "question": r"\?"}
    both = rows.select(*[f[k].alias(f"a_{k}") for k in plain], *[F.regexp_count(t, F.lit(p)).alias(f"b_{k}") for k, p in plain.items()])
    assert both.where(" or ".join(f"not (a_{k} <=> b_{k})" for k in plain)).count() == 0
    assert "contains" in str(f["emails"]).lower()


def test_hints_leave_out_no_match(spark):
    """Every pattern of the commercial pack and every count of the analyzer has a hint, and what hints let through is what the patterns
    find untried by them: other forms of letters, edges, blanks, digits and runs of any alphabet."""
    import re

    from quillmesh.operators import signals

    words = {re.sub(r"\\.\??|\[.*\]\??", " ", w) for c in (*packs.COMMERCIAL, *packs.GENERIC) if c.listed() for w in c.pattern[5:-3].split("|")}
    forms = str.maketrans({"i": "ı", "s": "ſ", "k": "\u212a", "в": "\u1c80", "д": "\u1c81", "о": "\u1c82", "с": "\u1c83", "т": "\u1c84", "ъ": "\u1c86"})
    odd = [f"{a}{x}{b}" for w in words for x in (w, w.upper(), w.translate(forms), w.replace("i", "İ")) for a, b in (("", ""), ("é", ""), ("_", "!"), ("\n", "\n"), ("-", "\u0301"), ("x", "x"))]
    odd += [f"{a}{d}{b}" for d in ("7", "\u0667", "\U0001d7d5", "\uff17") for a, b in (("$", ""), ("", " $x"), ("", "\u2003РУБ"), ("", "\u0085u\u017fd"), ("от\u00a0", ""), ("", "\x0b€a"), ("", "за"), ("(" + d * 2 + ") " + d * 3 + "-" + d * 2, d * 2))]
    odd += [a + x * n + b for x in ("a", " ", "\n", "\r", "\x00", "é", "я", "😀", "赚", "A", "Ё", "!") for n in (3, 4, 5, 10) for a, b in (("", ""), ("b", "c"), ("я", "я"))]
    odd += [None, "", "abababababab", "http://a\nwww.b", "HTTPS://a T.ME b", "messenger.me/x", "a@b.cd", "+1", "555 123 4567", "555\n123-4567", "(555)1234567", "?!?"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string").repartition(4)
    t, f = F.col("t"), tx.features(F.col("t"))
    for pack, checks in ((packs.commercial, packs.COMMERCIAL), (packs.generic, packs.GENERIC)):
        want = F.filter(F.array(*[F.when(c._matches(t) > 0, F.lit(c.name)) for c in checks]), lambda x: x.isNotNull())
        got = F.filter(F.transform(pack(t), lambda x: x["name"]), lambda x: x.isin(*[c.name for c in checks]))
        assert rows.select("i", "t", want.alias("want"), got.alias("got")).where("not (want <=> got)").collect() == []
    want = F.concat(F.transform(packs.commercial(t), lambda x: F.concat(F.lit("rule:"), x["reason"])), *[F.when(f[c.name] > 0, F.array(F.concat(F.lit(f"{c.name}:"), f[c.name].cast("string")))).otherwise(F.array().cast("array<string>")) for c in packs.MARKS])
    assert rows.select("t", want.alias("want"), signals.analyzer_keys(t).alias("got")).where("not (want <=> got)").collect() == []
    assert all(c.gated for c in (*packs.COMMERCIAL, *packs.MARKS)) and len(odd) > 4000
