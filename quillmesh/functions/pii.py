"""Redaction of personal data as column expressions, in the order e-mail, phone, card, address, URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import text as tx

# Patterns of personal data.
EMAIL = r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"
PHONES = (r"\b\d{3}[-.\s]?\d{3}[-.\s]?(\d{4})\b", r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"\b\d{6,}(\d{4})\b")
CARD = r"\b(?:\d{4}[-\s]?){3}(\d{4})\b"
ADDRESS = r"\b((?:\d{1,3}\.){3})\d{1,3}\b"
WEB = r"(https?://)([^\s<>\"'{}|\\^`\[\]/?#]*)[^\s<>\"'{}|\\^`\[\]]*"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PASSPORTS = (r"\b[A-Z]{1,2}\d{6,9}\b", r"\b\d{9}\b")
LICENCE = r"\b[A-Z0-9]{8,12}\b"
ACCOUNT = r"\b(?!\d{10}\b)\d{8,17}\b"


def redact_email(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "***@$1")


def redact_phone(text: Column) -> Column:
    """Keeps the last four characters of each number; of one of up to four characters nothing."""
    first, second, third = PHONES
    out = _keep_four(F.regexp_replace(text, first, "***$1"), second)
    return F.regexp_replace(out, third, "***$1")


def _keep_four(text: Column, pattern: str) -> Column:
    """Each match becomes *** and its last four characters (*** alone for one of up to four)."""

    def weave(masked: Column) -> Column:
        return tx.let(F.split(text, pattern, -1), lambda between: F.array_join(F.transform(F.sequence(F.lit(1), F.size(between)), lambda i: F.concat(F.element_at(between, i), F.coalesce(F.get(masked, i - 1), F.lit("")))), ""))

    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return tx.let(F.transform(parts, lambda p: F.when(F.length(p) > 4, F.concat(F.lit("***"), F.right(p, F.lit(4)))).otherwise("***")), weave)


def redact_credit_card(text: Column) -> Column:
    return F.regexp_replace(text, CARD, "****-****-****-$1")


def redact_ip(text: Column) -> Column:
    return F.regexp_replace(text, ADDRESS, "$1xxx")


def redact_url(text: Column) -> Column:
    """Keeps scheme and host."""
    out = F.regexp_replace(text, WEB, "$1$2/***")
    return F.regexp_replace(out, r"(https?):///\*\*\*", "$1://***")


def redact_pii(text: Column) -> Column:
    return redact_url(redact_ip(redact_credit_card(redact_phone(redact_email(text)))))


def redact_ssn(text: Column) -> Column:
    return F.regexp_replace(text, SSN, "***-**-****")


def redact_passport(text: Column) -> Column:
    for pattern in PASSPORTS:
        text = F.regexp_replace(text, pattern, "***PASSPORT***")
    return text


def redact_driver_license(text: Column) -> Column:
    return F.regexp_replace(text, LICENCE, "***DL***")


def redact_bank_account(text: Column) -> Column:
    """8 to 17 digits, but not exactly 10, which are a phone."""
    return F.regexp_replace(text, ACCOUNT, "***ACCOUNT***")


def redact_ocr(text: Column) -> Column:
    """Everything of scanned documents: what redact_pii takes, then the documents' numbers."""
    return redact_bank_account(redact_driver_license(redact_passport(redact_ssn(redact_pii(text)))))


def redact_struct(column: Column, kind: T.DataType) -> Column:
    """Strings anywhere inside structs, maps and arrays redacted; other values as they are."""
    if isinstance(kind, T.StringType):
        return redact_pii(column)
    if isinstance(kind, T.StructType):
        return F.struct(*[redact_struct(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: redact_struct(v, kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda v: redact_struct(v, kind.elementType))
    return column
