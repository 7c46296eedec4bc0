"""Packs of named message patterns with scores, compiled to one array expression per pack."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as tx

_PHONE = r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})|(?:\+\d{1,3}[-.\s]?)?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
_TWO_URLS = r"(?:https?://|www\.|t\.me|bit\.ly).*(?:https?://|www\.|t\.me|bit\.ly)"
_WORD = r"\p{L}\p{N}_"
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_URL_PIECES = ("http://", "https://", "www.", "t.me", "bit.ly")
# Hints are patterns of Arrow's (RE2), whose tables may be older than Java's: digits beyond them, marks of other planes too.
_DIGIT, _BLANK = r"[\p{Nd}\x{10000}-\x{10FFFF}]", r"[\s\x0b\x85\p{Z}]"


def _bounded(words: str) -> str:
    """Words with no ASCII letter or digit beside them: looser than the edges of words."""
    return rf"(?:^|[^0-9A-Za-z_])(?:{words})(?:$|[^0-9A-Za-z_])"


def _run(n: int) -> str:
    """One character n times, or n that aren't ASCII; RE2 has no back-references."""
    return "|".join(rf"\x{c:02x}{{{n}}}" for c in range(128) if c != 10) + rf"|[^\x00-\x7f]{{{n}}}"


def _literal(word: str) -> str:
    """A word as a hint: both dotted and undotted i are one for Java, other forms of letters for RE2 as well."""
    return re.escape(word).replace("i", "[iıİ]")


@dataclass(frozen=True)
class Check:
    """A pattern: score is base + step * matches, at most cap. cased patterns tell upper from lower case."""

    name: str
    reason: str
    pattern: str
    base: float
    step: float = 0.0
    cap: float = 1.0
    cased: bool = False
    count: str | None = None  # counts matches of this instead
    pieces: tuple[str, ...] = ()  # each match contains one of these, in lower case,
    digits: bool = False  # or a digit
    twice: bool = False  # two pieces at least
    emoji: bool = False  # or an emoji
    starts: str = ""  # characters that a match begins with, as those of a class
    hint: str = ""  # or what this finds

    @property
    def listed_hint(self) -> str:
        """Words or pieces one of which is in every text that matches; empty where no such pieces are known.

        For a plain list of words: the words, or the longest literal piece of one that has more than letters; of some patterns
        the pieces are given beside it.
        """
        if self.pieces:
            return "|".join(map(_literal, sorted(self.pieces)))
        m = re.fullmatch(r"\\b\(\?:((?:[^()\[\]{}+]|\.\*)*)\)\\b", self.pattern)
        words = dict.fromkeys(m[1].lower().split("|")) if m else {}
        pieces = {x: max(re.split(r"[^\w ]", re.sub(r"\w\\?\?", " ", x)), key=len).strip() for x in words}
        if not all(pieces.values()):
            return ""
        whole, parts = [_literal(x) for x in words if pieces[x] == x], [_literal(pieces[x]) for x in words if pieces[x] != x]
        return "|".join([*([_bounded("|".join(whole))] if whole else []), *parts])

    @property
    def wanted(self) -> str:
        """The hint of every text that matches, whatever it comes from."""
        some = self.listed_hint
        some = f"(?s:(?:{some}).*(?:{some}))" if self.twice else some
        return "|".join(x for x in (some, self.hint, self.digits and _DIGIT, self.emoji and tx.EMOJI) if x)

    @property
    def gated(self) -> bool:
        return bool(self.wanted)

    def matches(self, text: Column, may: Column) -> Column:
        """Matches, of which one is enough where no score depends on their number; not tried where `may` says that there can be none."""
        return self.where(may, self._matches(text))

    def found(self, text: Column, may: Column) -> Column:
        """1 where there is a match, else 0."""
        return self.where(may, self._matches(text, False))

    def where(self, may: Column, n: Column) -> Column:
        return F.when(may, n).otherwise(0) if self.gated else n

    def _matches(self, text: Column, counted: bool = True) -> Column:
        """Marks, such as those of emoji, are no part of words here, unlike in Java's own \\b and \\w."""
        pattern = self.listed() or self.pattern.replace(r"\b", _EDGE).replace(r"\w", _WORD)
        if self.starts:
            pattern = f"(?=[{self.starts}])(?:{pattern})"
        pattern = F.lit(("(?dmU)" if self.cased else "(?diuUm)") + pattern)
        return F.regexp_count(text, pattern) if counted and self.step and not self.count else F.regexp_like(text, pattern).cast("int")

    def listed(self) -> str | None:
        """The pattern of a plain list of words in Java's form, None for other patterns. The next character is looked at before the
        edge, which takes longer, and words are tried by their first letter, in their order, so matches are the same."""
        m = re.fullmatch(r"\\b\(\?:([^()]*)\)\\b", self.pattern)
        words = m[1].split("|") if m and not re.search(r"\[[^\]]*\|", m[1]) else []
        if not words or self.cased or not all(x[:1].isalpha() and x[1:2] not in ("?", "*", "+", "{") for x in words):
            return None
        rests: dict[str, list[str]] = {}
        for x in dict.fromkeys(words):
            rests.setdefault(x[0].lower(), []).append(x[1:])
        tries = "|".join(f"{c}(?:{'|'.join(own)})" for c, own in rests.items())
        return f"(?=[{''.join(rests)}])(?<![{_WORD}])(?:{tries}){_EDGE}"

    def score(self, text: Column, matches: Column) -> Column:
        if not self.step:
            return F.lit(self.base)
        n = F.regexp_count(text, F.lit(self.count)) if self.count else matches
        return F.least(F.lit(self.base) + F.lit(self.step) * n, F.lit(self.cap))


# Names, reasons, patterns and weights of the commercial pack.
COMMERCIAL = (
    Check("buy_sell", "Buy/sell offer", r"\b(?:купить|продать|продам|куплю|продаю|продажа|покупка|buy|sell|sale|purchase|selling|selling|forsale|for sale|продается|покупаю|продаём|покупаем|продаю|продаётся|покупаем|продаём)\b", 0.7, 0.1, 0.95),
    Check("group_invite", "Group/channel invitation (commercial context)", r"\b(?:group|групп|channel|канал|加入|进群|adding|interested|message me|пиши|напиши|присоединяйся|join|подписывайся)\b", 0.5, 0.1, 0.85),
    Check("job_offer", "Job offer or work solicitation", r"\b(?:работа|вакансия|job|work|vacancy|hiring|recruitment|набираю|команду|команда|на работу|подработка|заработок|заработка|earn|income|make money|quick cash|remote work|work from home|дистанционн|онлайн.*работ|инвестиции|сотрудничество|partnership|фасовк|упаковк|цпаковк|фасовк|найм|найду|требуются|требуется|ищу|ищем|набор|зарплат|зарплата|плачу|плат|заработок|деньги|money|赚|赚钱|工作|招聘|招人|赚钱|赚钱|老板|福利|福利|徒弟|跟着|赚|厉害|几万|福利|进群|group|интерес|interested|adding|new group)\b", 0.7, 0.1, 0.95),
    Check("promotion", "Commercial promotion", r"\b(?:акция|скидка|распродажа|sale|discount|promotion|limited time|special offer|предложение|специальное|бесплатно|free|bonus|gift|подарок|бонус)\b", 0.7, 0.1, 0.95),
    Check("service_offer", "Service offer", r"\b(?:услуги|услуга|service|services|предлагаю|offer|предложение|available|доступно|оказываю|выполню|сделаю|делаю)\b", 0.5, 0.1, 0.85),
    Check("contact_info", "Contact request (commercial context)", r"\b(?:пиши|write|dm|pm|contact|связь|связаться|звоните|позвони|call|whatsapp|messenger|тг|т\.?м\.?е\.?)\b", 0.5, 0.1, 0.85),
    Check("price_mention", "Price or money mention", r"\b(?:\$\d+|\d+\s*\$|\d+\s*(?:руб|rub|usd|eur|€|₽)|цена|стоимость|price|cost|стоит|от\s*\d+|\d+\s*за)\b", 0.5, 0.1, 0.85, starts=r"$\dцсоpc",
          hint=rf"\${_DIGIT}|{_DIGIT}{_BLANK}*(?:\$|руб|rub|usd|eur|€|₽|за)|от{_BLANK}*{_DIGIT}|" + _bounded("|".join(map(_literal, ("цена", "стоимость", "price", "cost", "стоит"))))),
    Check("multiple_urls", "Multiple URLs (commercial spam indicator)", _TWO_URLS, 0.5, 0.15, 0.9, pieces=_URL_PIECES, twice=True, starts="hwtb"),
    Check("messenger_link", "Telegram link (commercial spam indicator)", r"(?:https?://)?(?:t\.me|messenger\.me)/[^\s]+", 0.5, 0.15, 0.9, pieces=("t.me/", "messenger.me/")),
    Check("excessive_emoji", "Excessive emojis (commercial spam pattern)", ".*".join([tx.EMOJI] * 4), 0.4, 0.03, 0.85, True, tx.EMOJI, emoji=True),
    Check("excessive_caps", "Excessive capitalization", r"[A-ZА-ЯЁ]{10,}", 0.55, cased=True, hint="[A-ZА-ЯЁ]{10}"),
    Check("repeated_symbols", "Repeated characters/symbols", tx.REPEATED, 0.55, cased=True, hint=_run(5)),
    Check("phishing_urgent", "Phishing: Urgent action required", r"\b(?:urgent|срочно|немедленно|immediate|act now|verify now|confirm now|требуется подтверждение|нужна верификация|account suspended|аккаунт заблокирован|account locked|блокировка|suspended|заблокирован)\b", 0.75, 0.1, 0.95),
    Check("phishing_verification", "Phishing: Verification request", r"\b(?:verify|верифицировать|подтвердить|confirm|validate|проверить|verify account|подтвердить аккаунт|verify email|подтвердить email|verify identity|подтвердить личность|security check|проверка безопасности)\b", 0.75, 0.1, 0.95),
    Check("phishing_account_issue", "Phishing: Account issue threat", r"\b(?:account suspended|аккаунт заблокирован|account locked|account has been locked|блокировка аккаунта|account deactivated|аккаунт деактивирован|account problem|проблема с аккаунтом|account closure|закрытие аккаунта|unauthorized access|несанкционированный доступ|unlock your account|разблокировать аккаунт)\b", 0.75, 0.1, 0.95),
    Check("phishing_payment_request", "Phishing: Payment request", r"\b(?:payment required|требуется оплата|payment overdue|просрочен платеж|payment failed|платеж не прошел|update payment|обновить платеж|payment information|платежная информация|billing information|платежные данные)\b", 0.75, 0.1, 0.95),
    Check("phishing_credentials", "Phishing: Credentials request", r"\b(?:password|пароль|login|логин|username|имя пользователя|credentials|учетные данные|security code|код безопасности|verification code|код подтверждения|PIN|пин-код|enter your|введите ваш|your password|ваш пароль)\b", 0.65, 0.1, 0.9),
    Check("phishing_suspicious_link", "Phishing: Suspicious link request", r"(?:click here|нажмите здесь|click link|перейдите по ссылке|follow link|follow this link|open link|откройте ссылку).*(?:http|https|www\.|bit\.ly|t\.me|goo\.gl|tinyurl)", 0.65, 0.1, 0.9, pieces=("click here", "нажмите здесь", "click link", "перейдите по ссылке", "follow link", "follow this link", "open link", "откройте ссылку")),
    Check("phone", "Phone number (commercial context)", _PHONE, 0.6, digits=True, starts=r"+(\d"),
    Check("short_commercial", "Short commercial phrase", r"^(?:пиши|готов|интересно|write|dm|pm|купить|продать|продам|куплю)\s*[!?]*\s*$", 0.5, pieces=("пиши", "готов", "интересно", "write", "dm", "pm", "купить", "продать", "продам", "куплю")),
)

# Words without which short messages are not commercial.
SHORT_WORDS = (
    "продам", "купить", "продать", "buy", "sell", "sale", "работа", "вакансия", "job", "work", "hiring", "набираю", "команду", "заработок",
    "акция", "скидка", "discount", "promotion", "услуги", "service", "пиши", "write", "dm", "pm", "赚", "赚钱", "工作", "招聘", "招人", "老板",
    "福利", "徒弟", "跟着", "进群", "group", "interested", "adding", "new group", "ищу", "ищем", "набор", "требуются", "фасовк", "цпаковк",
    "партнeр", "прoeкт", "продавцы", "точки", "срочно люди", "нужны люди", "фасовка", "упаковка", "подарков", "набор партнеров",
    "дистанционн", "дневная вырyчкa",
)

# Names, reasons, patterns and weights of the generic pack.
GENERIC = (
    Check("url", "Contains URL", r"\b(?:https?://|www\.)[\w\-]+(\.[\w\-]+)+(?:/[\w\-._~:/?#\[\]@!$&'()*+,;=%]*)?", 0.0, 0.35, 0.9, pieces=("http://", "https://", "www.")),
    Check("phone", "Contains phone number", _PHONE, 0.0, 0.35, 0.9, digits=True, starts=r"+(\d"),
    Check("email", "Contains email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.0, 0.35, 0.9, pieces=("@",)),
    Check("crypto_wallet", "Contains cryptocurrency wallet", r"\b(?:0x[a-fA-F0-9]{40}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{39,59})\b", 0.0, 0.35, 0.9, digits=True),
    Check("scam_phrase", "Contains scam phrase", r"\b(?:click here|urgent|limited time|act now|free money|guaranteed|no risk|congratulations|winner|prize|claim now|click below|verify account|suspended|locked|expire|immediate action)\b", 0.0, 0.35, 0.9),
    Check("excessive_caps", "Excessive capitalization", r"[A-Z]{5,}", 0.0, 0.35, 0.9, True, hint="[A-Z]{5}"),
    Check("excessive_punctuation", "Excessive punctuation", r"[!?.]{3,}", 0.0, 0.35, 0.9, hint="[!?.]{3}"),
    Check("repeated_chars", "Repeated characters", tx.REPEATED, 0.0, 0.35, 0.9, True, hint=_run(5)),
    Check("job_offer", "Job offer or work solicitation", r"\b(?:job|work|vacancy|employment|part[- ]?time|temporary|hiring|recruitment|заработок|работа|вакансия|подработка|удалённ|remote work|work from home|earn \$|make money|quick cash|набираю|на работу|команду|команда|дистанционн|онлайн.*работ|заработок|инвестиции|сотрудничество)\b", 0.0, 0.35, 0.9),
    Check("adult_service", "Adult service indicator", r"\b(?:meet up|meet now|встречусь|available|свободна|скучно|пиши|работаю❤️|men should message|впишусь|впишу|ready vcs|open vcs|escort|adult|content available|cp|tn|gv|tf|sl|id|svc)\b", 0.0, 0.35, 0.9),
    Check("repetitive_emoji", "Repetitive emoji or symbol pattern", r"(.)\1{3,}", 0.0, 0.35, 0.9, True, hint=_run(4)),
    Check("sale_promotion", "Sale or promotion", r"\b(?:sale|discount|promotion|limited time|special offer|акция|скидка|распродажа|предложение|специальное)\b", 0.0, 0.35, 0.9),
    Check("short_spam_phrase", "Short spam phrase", r"^(?:пиши|готов|интересно|write|dm|pm)\s*[!?]*\s*$", 0.0, 0.35, 0.9, pieces=("пиши", "готов", "интересно", "write", "dm", "pm")),
    Check("multiple_urls", "Multiple URLs detected", _TWO_URLS, 0.0, 0.4, 0.9, pieces=_URL_PIECES, twice=True, starts="hwtb"),
)


# Where counts of tx.features can be other than 0.
MARKS = (
    Check("urls", "", tx.URL_MARK, 0.0, pieces=_URL_PIECES),
    Check("phones", "", tx.PHONE_MARK, 0.0, hint=r"(?s:[0-9]{3}.?[0-9]{3}.?[0-9]{4})|\+[0-9]"),
    Check("emails", "", tx.EMAIL, 0.0, hint="@"),
    Check("emoji_count", "", tx.EMOJI, 0.0, emoji=True),
    Check("exclamation", "", "!", 0.0, hint="!"),
    Check("question", "", r"\?", 0.0, hint=r"\?"),
)


def _found(name: str, reason: str, score: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(reason).alias("reason"), score.cast("double").alias("score"))


def _gate(checks):
    """A column function of the text: bit i says that check i may match. Arrow looks for the hints of a whole batch, for all
    lists of words at once and then for each of them in the texts that have any. Checks without hints, and null texts, have no bits."""
    lists = {i: c.wanted for i, c in enumerate(checks) if c.listed_hint and c.wanted == c.listed_hint and not set(c.pieces) & set(_URL_PIECES)}
    others = {i: (c.wanted, c.cased) for i, c in enumerate(checks) if c.gated and i not in lists}
    every = "|".join(dict.fromkeys(lists.values()))

    @F.arrow_udf("long")
    def may(texts: pa.Array) -> pa.Array:
        def found(rows: pa.Array, hint: str, cased: bool = False) -> np.ndarray:
            return pc.fill_null(pc.match_substring_regex(rows, hint, ignore_case=not cased), False).to_numpy(zero_copy_only=False)

        bits = np.zeros(len(texts), np.int64)
        for i, (hint, cased) in others.items():
            bits[found(texts, hint, cased)] |= 1 << i
        some = np.flatnonzero(found(texts, every)) if every else []
        if len(some):
            few = texts.take(pa.array(some))
            for i, hint in lists.items():
                bits[some[found(few, hint)]] |= 1 << i
        return pa.array(bits)

    return may


def gated(text: Column, checks, f) -> Column:
    """f(text, may), where may(i) is whether check i may match; the text is looked at once for all checks."""
    both = F.struct(text.alias("t"), _gate(checks)(text).alias("g"))
    return tx.let(both, lambda b: f(b["t"], lambda i: b["g"].bitwiseAND(F.lit(1 << i)) != 0))


def _pack(text: Column, checks, more) -> Column:
    """Array of (name, reason, score) of what matches, in the order of the pack."""

    def run(t: Column, may) -> Column:
        def test(i: int, c: Check) -> Column:
            return tx.let(c.matches(t, may(i)), lambda n: F.when(n > 0, _found(c.name, c.reason, c.score(t, n))))

        tests = [test(i, c) for i, c in enumerate(checks)]
        return F.filter(F.array(*tests, *more), lambda x: x.isNotNull())

    return gated(text, checks, run)


def _five_words(text: Column) -> Column:
    """Whether a text has five words or more, of those of tx.words(); nothing is read after them."""
    return F.regexp_like(text, F.lit(r"(?U)\A\s*+\S++(?:\s++\S++){4}"))


def _short(text: Column) -> tuple[tuple[str, str, Column], ...]:
    """Name, reason and test of short messages. They count only with a commercial word, at up to 15 characters or under 5
    words; texts over 200 characters are never short."""
    keyed = (F.length(text) <= 200) & tx.any_of(F.lower(text), SHORT_WORDS)
    return (
        ("very_short_commercial", "Very short message with commercial intent", keyed & (F.length(text) <= 15)),
        ("few_words_commercial", "Very few words with commercial intent", keyed & (~_five_words(text))),
    )


def commercial(text: Column) -> Column:
    """What the commercial pack finds, short messages with a commercial word among it."""
    return _pack(text, COMMERCIAL, [F.when(test, _found(name, reason, F.lit(0.5))) for name, reason, test in _short(text)])


def reasons_and_marks(text: Column) -> Column:
    """(reasons, marks): the reasons of what the commercial pack finds, and the counts of MARKS as (name, n), those of 0 left out. Nothing is
    scored, so one match is enough for a reason; both come from one look at the text."""

    def run(t: Column, may) -> Column:
        found = [F.when(c.found(t, may(i)) > 0, F.lit(c.reason)) for i, c in enumerate(COMMERCIAL)]
        found += [F.when(test, F.lit(reason)) for _, reason, test in _short(t)]
        counts = tx.features(t)
        marks = [F.struct(F.lit(c.name).alias("name"), c.where(may(i), counts[c.name]).alias("n")) for i, c in enumerate(MARKS, len(COMMERCIAL))]
        return F.struct(F.filter(F.array(*found), lambda x: x.isNotNull()).alias("reasons"), F.filter(F.array(*marks), lambda x: x["n"] > 0).alias("marks"))

    return gated(text, (*COMMERCIAL, *MARKS), run)


def generic(text: Column) -> Column:
    """What the generic pack finds; short messages count without a word too, many emoji from four on."""
    emoji = F.regexp_count(text, F.lit(tx.EMOJI))
    return _pack(text, GENERIC, [
        F.when(F.length(text) <= 10, _found("very_short_message", "Very short message (< 10 chars)", F.lit(0.5))),
        F.when(~_five_words(text), _found("few_words_message", "Very few words (< 5 words)", F.lit(0.5))),
        F.when(emoji >= 4, _found("many_emoji", "Many emojis (4+)", F.least(0.2 + 0.05 * emoji, F.lit(0.8)))),
    ])


def rule_score(found: Column) -> Column:
    """The mean score of what a pack found, at most 0.95; 0 for nothing."""
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x["score"])
    return F.least(F.coalesce(F.try_divide(total, F.size(found)), F.lit(0.0)), F.lit(0.95))


def classify(rows: DataFrame, text: str = "text", model_score: str | None = None, rules_only: bool = False) -> DataFrame:
    """rows with score, is_spam, spam, scam, toxic and the first three reasons: the rules alone where they are sure (0.8 and
    more, 0.2 and less) or no model is given, else four fifths rules and one fifth the model's column."""
    out = rows.withColumn("_clean", tx.clean_text(F.col(text))).withColumn("_found", commercial(F.col("_clean"))).withColumn("_rules", rule_score(F.col("_found")))
    rules = F.col("_rules")
    mixed = F.least(rules, F.lit(0.99)) if model_score is None else 0.80 * rules + 0.20 * F.col(model_score)
    score = rules if rules_only else F.when((rules >= 0.8) | (rules <= 0.2), rules).otherwise(mixed)
    out = out.withColumn("score", F.bround(score, 3)).withColumn("reasons", F.slice(F.transform("_found", lambda x: x["reason"]), 1, 3))
    return out.withColumns({"is_spam": F.col("score") >= 0.40, "spam": F.col("score") >= 0.35, "scam": F.col("score") >= 0.7, "toxic": F.col("score") >= 0.5}).drop("_clean", "_found", "_rules")
