"""Whole rule sets as SQL predicates: the blocking set, the older set of seven, language rules and the weighted score.

Predicates are plain SQL over columns of messages. Regular expressions go through a function of (column, pattern), so that
the same set can be written for another engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from quillmesh.operators import rules as rl

Regex = Callable[[str, str], str]


def spark_regex(column: str, pattern: str) -> str:
    return f"regexp_like({column}, {rl.literal(pattern)})"


def _has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _times(needle: str, column: str = "text") -> str:
    """How often a needle occurs."""
    return f"((length({column}) - length(replace({column}, '{needle}', ''))) / {len(needle)}.0)"


def any_of(predicates: Iterable[str]) -> str:
    return "(" + " OR ".join(f"({p})" for p in predicates) + ")"


#: Keywords, patterns, limits and weights of the rule sets.
PHONE = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
LINKS = ("http", "www.", "t.me")
TRADE = ("продам", "купить", "продать", "buy", "sell", "sale")
JOBS = ("работа", "вакансия", "job", "work", "hiring", "набираю", "заработок")
PROMOTIONS = ("акция", "скидка", "sale", "discount", "promotion")
SHORT_WORDS = ("продам", "купить", "пиши", "write")
COMBINED_TRADE = ("продам", "купить", "buy", "sell")
COMBINED_JOBS = ("работа", "вакансия", "job", "hiring", "набираю", "заработок")
COMBINED_PROMOTIONS = ("акция", "скидка", "discount")
COMBINED_SHORT = ("продам", "купить", "пиши")
OLD_JOBS = "(job|work|vacancy|hiring|recruitment|заработок|работа|вакансия|набираю|команду|дистанционн|онлайн.*работ|инвестиции|сотрудничество)"
OLD_ADULT = "(meet up|meet now|available|escort|adult|встречусь|свободна|скучно|ready vcs|open vcs)"
OLD_SALES = "(sale|discount|promotion|limited time|special offer|акция|скидка|распродажа|бесплатно|free)"
OLD_EMOJI = r"[\x{1F300}-\x{1F9FF}].*[\x{1F300}-\x{1F9FF}].*[\x{1F300}-\x{1F9FF}].*[\x{1F300}-\x{1F9FF}]"
OLD_COMBINED = ("(job|work|vacancy|заработок|работа|вакансия|набираю|команду)", "(meet up|available|escort|adult|встречусь|свободна)", "(sale|discount|акция|скидка|бесплатно|free)")


def _phone(rx: Regex) -> str:
    return f"{rx('text', PHONE)} OR (contains(text, '+') AND {rx('text', r'\+\d{1,3}')})"


def _links() -> str:
    return " OR ".join(f"{_times(x)} >= 2" for x in LINKS)


def blocking(rx: Regex = spark_regex) -> dict[str, str]:
    """The six blocking rules by name."""
    low = "lower(text)"
    return {"urls": _links(), "phone": _phone(rx), "trade": _has(low, *TRADE), "job": _has(low, *JOBS), "promotion": _has(low, *PROMOTIONS), "short_text": f"length(text) < 15 AND {_has(low, *SHORT_WORDS)}"}


def combined(rx: Regex = spark_regex) -> str:
    """The one recommended blocking predicate: narrower keyword lists than the rules apart."""
    low = "lower(text)"
    return any_of([_links(), _phone(rx), _has(low, *COMBINED_TRADE), _has(low, *COMBINED_JOBS), _has(low, *COMBINED_PROMOTIONS), f"length(text) < 15 AND {_has(low, *COMBINED_SHORT)}"])


def _few_words() -> str:
    return f"length(text) < 10 OR {_times(' ')} < 5"


def old_rules(rx: Regex = spark_regex) -> dict[str, str]:
    """The older set of seven rules by name."""
    return {"urls": _links(), "phone": f"{rx('text', PHONE)} OR {rx('text', r'\+\d{1,3}')}", "very_short": _few_words(), "job": rx("lower(text)", OLD_JOBS), "adult": rx("lower(text)", OLD_ADULT), "emoji": rx("text", OLD_EMOJI), "sale": rx("lower(text)", OLD_SALES)}


def old_combined(rx: Regex = spark_regex) -> str:
    return any_of([_links(), old_rules(rx)["phone"], _few_words(), *[rx("lower(text)", p) for p in OLD_COMBINED]])


def by_language() -> dict[str, str]:
    """Stricter rules for Russian and English: several signs at once."""
    low, short, mark = "lower(text)", "length(text) < {}", "contains(text, '!')"
    absent = lambda *words: " AND ".join(f"NOT contains(text, '{w}')" for w in words)
    ru = [f"contains({low}, 'продам') AND {short.format(80)} AND {mark}", f"contains({low}, 'набираю') AND {short.format(100)} AND ({mark} OR contains(text, '?'))", f"contains({low}, 'заработок') AND {short.format(100)} AND {mark}"]
    en = [f"contains({low}, '{w}') AND {short.format(60)} AND {mark} AND {absent(*no)}" for w, no in (("buy", ("lunch", "groceries")), ("sell", ("car", "house")), ("job", ("work", "working")))]
    return {"ru": f"length(text) >= 30 AND {any_of(ru)}", "en": f"length(text) >= 35 AND {any_of(en)}"}


def _case(*arms: tuple[str, float]) -> str:
    return "(CASE " + " ".join(f"WHEN {p} THEN {w}" for p, w in arms) + " ELSE 0 END)"


def weighted(rx: Regex = spark_regex) -> str:
    """The spam score of messages with n (lower case, ё as е), text, is_first_message, sender_reputation and
    message_count_recent_5min: of each block the first arm that holds counts."""
    n, size = "n", "length(n) < {}"
    stems = _has(n, "прода", "куп", "работ")
    money, digits = r"[$€₽]|\bруб\b|\busd\b|\beur\b", r"\b\d{7,}\b"
    harmless = f"({_has(n, 'ужин', 'обед', 'закуп', 'продукт', 'для друга', 'шутка', 'анекдот', 'обсудить', 'вопрос')} OR (contains(n, 'продам аккаунт') AND NOT {rx(n, money)} AND NOT {rx(n, digits)}))"
    url = _has(n, "http://", "https://", "www.", "t.me/", "wa.me/")
    phone = rx(n, PHONE)
    numbers = rx(n, r"\+?\d{1}[\s.-]?\d{3}[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}")
    russian = rx(n, r"\+7[\s.-]?\d{3}[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}")
    spaced = f"({rx(n, r'\d{1}[\s.]+\d{3}[\s.]+\d{3}[\s.]+\d{2}[\s.]+\d{2}')} OR {rx(n, r'\+[\s.]+7[\s.]+\d{3}[\s.]+\d{3}[\s.]+\d{2}[\s.]+\d{2}')})"
    trade = _case((f"{_has(n, 'прода', 'куп', 'ваканси', 'работ', 'buy', 'sell')} AND length(text) < 100 AND NOT {harmless}", 0.25), (f"contains(n, 'работ') AND {size.format(80)}", 0.25))
    jobs = _case((f"contains(n, 'работ') AND {size.format(60)}", 0.3), (f"contains(n, 'заработ') AND {size.format(80)}", 0.35), ("contains(n, 'набираю')", 0.4), (f"contains(n, 'job') AND {size.format(50)}", 0.25), (f"contains(n, 'hiring') AND {size.format(50)}", 0.3))
    links = _case(
        (f"{_times('http', n)} >= 3", 0.5), (url, 0.2), (f"({_has(n, 'avito.', 'olx.', 't.me', 'wa.me')} OR {rx(n, r'\b(avito|olx)[\s.]+[a-z0-9]')})", 0.3),
        (f"({rx(n, r'h[\s.]+t[\s.]+t[\s.]+p')} OR {rx(n, r'w[\s.]+w[\s.]+w')})", 0.25), (f"{rx(n, '@[a-z0-9_]{5,}')} AND {stems}", 0.35),
        (f"{url} AND {_has(n, 'прода', 'куп', 'работ', 'sale', 'discount')}", 0.4), (f"{_has(n, 'avito.', 'olx.', 't.me')} AND {stems}", 0.45),
    )
    contact = _case((f"({phone} OR {numbers} OR ({russian} AND {_has(n, 'прода', 'куп', 'продаю', 'работ')}))", 0.4), (spaced, 0.3), (f"{phone} AND {size.format(50)}", 0.2), (rx(n, r"([0-9]{2,}[\s.,]?[0-9]{0,3})[\s]*(руб|rur|eur|usd|€|\$)"), 0.25), (f"{rx(n, r'[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')} AND {stems}", 0.3))
    promotions = _case((f"contains(n, 'акция') AND {size.format(80)}", 0.3), (f"contains(n, 'скидк') AND {size.format(80)}", 0.3), (f"contains(n, 'discount') AND {size.format(60)}", 0.25))
    context = [("is_first_message", 0.15), ("sender_reputation < 0.3", 0.15), ("message_count_recent_5min >= 5", 0.1), ("length(text) > 300", -0.1), ("sender_reputation >= 0.8", -0.2)]
    return " + ".join([trade, jobs, links, contact, promotions, *[_case(x) for x in context]])


#: Messages that the weighted score looks at.
IN_CONTEXT = "(sender_reputation IS NULL OR sender_reputation < 0.8) AND (is_first_message OR message_count < 10) AND length(n) >= 30 AND length(n) < 800"
WEIGHTED_GATE = 0.7


def compound(pattern: str, oldest_days: float, least_contacts: int, least_threads: int, rx: Regex = spark_regex) -> str:
    """A text pattern, in any case, of young accounts that write to many: account_age_days, external_contact_count and
    distinct_threads_24h are columns; a null one fails."""
    return f"{rx('text', '(?i)' + pattern)} AND account_age_days <= {oldest_days} AND external_contact_count >= {least_contacts} AND distinct_threads_24h >= {least_threads}"
