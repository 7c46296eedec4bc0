"""Text functions, packs and redaction against known cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import packs, pii
from quillmesh.functions import text as tx


def one(spark, expr, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r.x for r in df.select("id", expr.alias("x")).orderBy("id").collect()]


def test_normalize(spark):
    assert one(spark, tx.normalize_text(F.col("text")), "  a\t b \r\n\r\n  c  ", "", "x") == ["a b\nc", "", "x"]


def test_features(spark):
    got = one(spark, F.struct(*[c.alias(n) for n, c in tx.features(F.col("text")).items()]), "HI http://a.b www.c.d +12 x@y.zz 😀 aaaaa!?", "")
    assert (got[0].urls, got[0].phones, got[0].emails, got[0].emoji_count, got[0].exclamation, got[0].question, got[0].repeated_chars) == (2, 1, 1, 1, 1, 1, True)
    assert got[0].word_count == 7 and abs(got[0].caps_ratio - 2 / got[0].char_count) < 1e-9
    assert got[1].caps_ratio == 0 and got[1].word_count == 0


def test_signature(spark):
    norm = one(spark, tx.signature_text(F.col("text")), "Call +1 234 567 8901 or me@x.org, 50 USD at HTTPS://A.b/c  now", "t.me/abc Привет")
    assert norm == ["call [PHONE] or [EMAIL], [PRICE] at [URL] now", "[MESSENGER] привет"]
    assert one(spark, tx.signature(F.col("text")), "A  b", "a b") == [hashlib.md5(b"a b").hexdigest()] * 2


def test_shingles(spark):
    assert one(spark, tx.shingles(F.col("text")), "a b c d", "a b", "") == [["a b c", "b c d"], ["a b"], [""]]


def test_domains(spark):
    assert one(spark, tx.domain(F.col("text")), "HTTP://A.com:80/x", "b.org/y", "c.net") == ["a.com", "b.org", "c.net"]
    kind, sure = tx.domain_class(F.col("text"))
    assert one(spark, kind, "https://github.com/x", "http://casino-prize.tk", "http://plain.net") == ["whitelisted", "suspicious", "legitimate"]
    assert one(spark, sure, "http://casino-prize.tk") == [1.0]


def test_language(spark):
    assert one(spark, tx.language(F.col("text")), "привет мир", "hello мир there everyone", "") == ["ru", "en", "en"]


CASES = {
    "buy_sell": ("Срочно КУПЛЮ дом", "совокупность"), "group_invite": ("вот наш Канал", "канализация"), "job_offer": ("есть работа", "jobless"), "promotion": ("big DISCOUNT", "discounted"),
    "service_offer": ("наши услуги", "услугами"), "contact_info": ("write us", "written"), "price_mention": ("цена ниже", "ценами"), "multiple_urls": ("http://a www.b", "http://a"),
    "messenger_link": ("t.me/abc", "t.me"), "excessive_emoji": ("😀😀 a 😀😀", "😀😀😀"), "excessive_caps": ("ABCDEFGHIJ", "ABCDEFGHI"), "repeated_symbols": ("ааааа", "аааа"), "phishing_urgent": ("act now", "fact nowhere"),
    "phishing_verification": ("Verify it", "verified"), "phishing_account_issue": ("account locked", "account is locked"), "phishing_payment_request": ("payment failed", "payment fails"), "phishing_credentials": ("your Пароль", "паролями"),
    "phishing_suspicious_link": ("click here: http://x", "click here"), "short_commercial": ("пиши!!", "пиши мне"), "very_short_commercial": ("buy it", "bay it"), "few_words_commercial": ("we do sell", "one two three"),
}


@pytest.mark.parametrize("name", CASES)
def test_commercial(spark, name):
    yes, no = one(spark, F.transform(packs.commercial(F.col("text")), lambda x: x["name"]), *CASES[name])
    assert name in yes and name not in no


def test_scores(spark):
    buy = one(spark, F.filter(packs.commercial(F.col("text")), lambda x: x["name"] == "buy_sell")[0]["score"], "buy", "buy or sell", "buy sell sale buy sell")
    assert buy == pytest.approx([0.8, 0.9, 0.95])
    emoji = one(spark, F.filter(packs.generic(F.col("text")), lambda x: x["name"] == "many_emoji")[0]["score"], "😀" * 4, "😀" * 20)
    assert emoji == pytest.approx([0.4, 0.8])


def test_classify(spark):
    df = spark.createDataFrame([(1, "Buy now, sale"), (2, "a letter to my aunt about the garden"), (3, "")], "id long, text string")
    got = {r.id: r for r in packs.classify(df).collect()}
    assert got[1].is_spam and got[1].reasons[0] == "Buy/sell offer" and not got[2].is_spam and got[2].score == 0.0 and got[3].score == 0.0


@pytest.mark.parametrize(
    "function, text, want",
    [
        (pii.redact_email, "Mail me.x@a.org now", "Mail ***@a.org now"), (pii.redact_phone, "555-123-4567", "***4567"), (pii.redact_phone, "+7 912 345 6789", "+7 ***6789"), (pii.redact_phone, "+44 20 7946 0958", "***0958"), (pii.redact_phone, "123456789012", "***9012"),
        (pii.redact_phone, "none", "none"), (pii.redact_credit_card, "1234-5678-9012-3456", "****-****-****-3456"), (pii.redact_ip, "192.168.1.77", "192.168.1.xxx"),
        (pii.redact_url, "see https://a.org/p?q=1.", "see https://a.org/***"), (pii.redact_ssn, "123-45-6789", "***-**-****"), (pii.redact_bank_account, "1234567890 123456789", "1234567890 ***ACCOUNT***"), (pii.redact_driver_license, "AB1234567", "***DL***"),
    ],
)
def test_redaction(spark, function, text, want):
    assert one(spark, function(F.col("text")), text) == [want]


def test_redact_struct(spark):
    df = spark.createDataFrame([(("a@b.org", ["1.2.3.4"], {"k": "c@d.org"}, 5),)], "x struct<m: string, l: array<string>, d: map<string, string>, n: int>")
    got = df.select(pii.redact_struct(F.col("x"), df.schema["x"].dataType).alias("x")).first().x
    assert (got.m, got.l, got.d, got.n) == ("***@b.org", ["1.2.3.xxx"], {"k": "***@d.org"}, 5)
