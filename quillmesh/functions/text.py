"""Text features as column expressions: all stay in the JVM, inside generated code where Spark can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must equal the known ones.
URL = r"https?://[^\s]+|www\.[^\s]+|t\.me/[^\s]+"
URL_MARK = r"https?://|www\.|t\.me|bit\.ly"
PHONE = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b|\+\d{1,3}[\s.-]?\d+"
PHONE_MARK = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b|\+\d{1,3}"
EMAIL = r"\b[\w\.-]+@[\w\.-]+\.\w{2,}\b"
EMOJI = "[\U0001f300-\U0001f9ff]"
REPEATED = r"(.)\1{4,}"
SIGNATURE_PHONE = r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
SIGNATURE_PRICE = r"\$\d+|\d+\s*\$|\d+\s*(?:руб|rub|usd|eur)"

# Words that mark commercial context, and those kept as key words of a signature.
COMMERCIAL_CONTEXT = (
    "заработок", "доход", "руб", "usd", "деньги", "money", "зарплат", "salary", "подработк", "part-time", "акция", "скидка", "discount",
    "promotion", "продам", "купить", "продать", "buy", "sell", "sale", "https", "t.me", "messenger", "групп", "канал", "group", "channel",
    "вакансия", "job", "work", "hiring", "набор", "требуются",
)
SIGNATURE_WORDS = (
    "продам", "купить", "продать", "buy", "sell", "sale", "работа", "вакансия", "job", "work", "hiring", "акция", "скидка", "discount",
    "promotion", "услуги", "service", "предлагаю", "offer",
)

# Trusted domains and marks of spam in URLs.
TRUSTED_DOMAINS = (
    "google.com", "youtube.com", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "telegram.org", "t.me", "discord.com",
    "reddit.com", "github.com", "gitlab.com", "stackoverflow.com", "zoom.us", "meet.google.com", "docs.google.com", "drive.google.com",
    "dropbox.com", "notion.so", "figma.com", "slack.com", "teams.microsoft.com", "office.com", "wikipedia.org", "medium.com", "arxiv.org",
    "scholar.google.com", "docker.com", "kubernetes.io", "aws.amazon.com", "azure.microsoft.com", "vercel.com", "netlify.com", "heroku.com",
)
SPAM_MARKS = (
    "bit.ly", "tinyurl", "goo.gl", "ow.ly", "t.co", "casino", "betting", "viagra", "cialis", "pharmacy", "win", "prize", "free-", "claim",
    "bonus", "earn-money", ".tk", ".ml", ".ga", ".cf", ".gq", ".pw", "-promo", "-offer", "-deal", "get-free", "buy-cheap",
)


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it, inside of lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(text: Column, needles) -> Column:
    """Whether the text contains any needle, as a chain of substring tests of a text that is computed once."""

    def chain(t: Column) -> Column:
        found = F.lit(False)
        for needle in needles:
            found = found | F.contains(t, F.lit(needle))
        return found

    return let(text, chain) if len(needles) > 3 else chain(text)


def count_of(text: Column, needles) -> Column:
    """How many of the needles the text contains."""
    total = F.lit(0)
    for needle in needles:
        total = total + F.contains(text, F.lit(needle)).cast("int")
    return total


def normalize_text(text: Column) -> Column:
    """Line breaks as \\n, runs of blanks as one, no blanks around breaks or at the ends, no empty lines."""
    out = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    out = F.regexp_replace(F.regexp_replace(out, r"^\s+|\s+$", ""), r"[ \t]{2,}|\t", " ")  # one blank is left as it stands
    return F.regexp_replace(F.regexp_replace(out, r" \n ?|\n ", "\n"), r"\n{2,}", "\n")


def clean_text(text: Column, most: int = 8192) -> Column:
    return F.substring(normalize_text(text), 1, most)


def words(text: Column) -> Column:
    """The words of a text; none of an empty one."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(URL), F.lit(0))


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def features(text: Column) -> dict[str, Column]:
    """The counts and rates of one message."""
    length = F.length(text)
    return {
        "urls": F.regexp_count(text, F.lit(f"(?i)(?=[hwtb])(?:{URL_MARK})")),
        "phones": F.regexp_count(text, F.lit(f"(?=[\\d+])(?:{PHONE_MARK})")),
        "emails": F.when(F.contains(text, F.lit("@")), F.regexp_count(text, F.lit(f"(?i){EMAIL}"))).when(text.isNotNull(), 0),
        "emoji_count": F.regexp_count(text, F.lit(EMOJI)),
        "caps_ratio": F.when(length > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / length).otherwise(F.lit(0.0)),
        "exclamation": occurrences(text, "!").cast("int"),
        "question": occurrences(text, "?").cast("int"),
        "word_count": F.size(words(text)),
        "char_count": length,
        "repeated_chars": F.regexp_like(text, F.lit(REPEATED)),
    }


def has_commercial_context(text: Column) -> Column:
    return any_of(F.lower(text), COMMERCIAL_CONTEXT)


def signature_text(text: Column) -> Column:
    """Lower case with placeholders for links, phones, e-mails and prices, in this order, and single spaces."""
    def marked(out: Column, pattern: str, mark: str, needles) -> Column:
        return let(out, lambda t: F.when(any_of(t, needles), F.regexp_replace(t, pattern, mark)).otherwise(t))

    out = F.lower(text)
    steps = (
        (r"https?://[^\s]+", "[URL]", ("://",)), (r"www\.[^\s]+", "[URL]", ("www.",)), (r"t\.me/[^\s]+", "[MESSENGER]", ("t.me/",)), (SIGNATURE_PHONE, "[PHONE]", ("+",)),
        (EMAIL, "[EMAIL]", ("@",)), (rf"(?=[$\d])(?:{SIGNATURE_PRICE})", "[PRICE]", ("$", "руб", "rub", "usd", "eur")),
    )
    for step in steps:  # a pattern is tried where a piece of it is
        out = marked(out, *step)
    out = F.regexp_replace(out, r"(?U)\s{2,}|[\s&&[^ ]]", " ")  # one blank is left as it stands
    return F.trim(out)


def signature(text: Column, method: str = "md5") -> Column:
    one = signature_text(text).cast("binary")
    return {"md5": F.md5(one), "sha256": F.sha2(one, 256)}[method]


def shingles(text: Column, n: int = 3) -> Column:
    """Word n-grams of an already normalised text; a shorter text is its only shingle."""
    def cut(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))
        return F.when(F.size(w) < n, F.array(text)).otherwise(F.transform(places, lambda i: F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(n)])))

    return let(words(text), cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def key_words(text: Column) -> Column:
    return F.filter(words(signature_text(text)), lambda w: any_of(w, SIGNATURE_WORDS))


def language(text: Column) -> Column:
    """ru where Cyrillic letters are more than 0.3 of Latin ones, else en."""
    return F.when(F.regexp_count(text, F.lit("[а-яА-ЯёЁ]")) > 0.3 * F.regexp_count(text, F.lit("[a-zA-Z]")), "ru").otherwise("en")


def domain(url: Column) -> Column:
    """The host of a URL: without scheme, path and port."""
    out = F.trim(F.lower(url))
    out = F.when(F.contains(out, F.lit("://")), F.split_part(out, F.lit("://"), F.lit(2))).otherwise(out)
    return F.split_part(F.split_part(out, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))


def domain_score(url: Column) -> Column:
    """Marks of spam in a URL, three or more counting as 1."""
    return F.least(count_of(F.lower(url), SPAM_MARKS) / F.lit(3.0), F.lit(1.0))


def domain_class(url: Column, threshold: float = 0.4, trusted=TRUSTED_DOMAINS) -> tuple[Column, Column]:
    """Reputation and confidence; a trusted domain counts wherever it is part of the host."""
    safe, score = any_of(domain(url), trusted), domain_score(url)
    kind = F.when(safe, "whitelisted").when(score >= threshold, "suspicious").otherwise("legitimate")
    return kind, F.when(safe, F.lit(1.0)).when(score >= threshold, score).otherwise(1.0 - score)


def occurrences(text: Column, needle: str) -> Column:
    """Of a substring, by the length that its removal takes away."""
    return F.expr("0") + F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle))


def blocked_by_limits(text: Column, most_urls: int = 5, most_phones: int = 3) -> Column:
    """More URLs or phones than a request may carry."""
    return (F.regexp_count(text, F.lit(r"(?i)https?://|www\.")) > most_urls) | (F.regexp_count(text, F.lit(PHONE_MARK)) > most_phones)


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))))


def like_literals(sql: Column) -> Column:
    """The needles of LIKE '%needle%' in rule text, lower-case."""
    return F.regexp_extract_all(F.lower(sql), F.lit(r"like\s+'%([^%]+)%'"), F.lit(1))
