"""Licence scans by canonical digests: whole texts, and their single lines, joined to digests of known licence texts.

Only DataFrame functions: canonical text by replacements, SHA-256, and a hash join.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common

#: Notices that name a licence, by SPDX identifier. Whole texts are files of licence_texts.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]

#: Titles that stand above these texts; both forms are known.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
}

#: Spellings that count as the same, applied to whole canonical words.
SPELLINGS = (("licences?|licenses|licence", "license"), ("licenced", "licensed"), ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("http", "https"))
#: Lines that give a year, a sign or a placeholder after the word, or the word and capitalised names alone.
_COPYRIGHT = r"(?m)^[^\S\n]*(?:(?i:(?:copyright|\(c\)|©)[^\n]*(?:\d{4}|\(c\)|©|[\[<{](?:yyyy|year)|all rights reserved)[^\n]*|all rights reserved\.?[^\S\n]*)|Copyright(?: by)?(?:[^\S\n]+[A-Z][\w.,&-]*){1,6}[^\S\n]*)$"
_RARE = "(?:" + "|".join(f"(?:{variant})" for variant, _ in SPELLINGS) + ")"


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the registry: the files of licence_texts, with and without their titles, and NOTICES."""
    texts = [(p.name.removesuffix(".txt"), p.read_text()) for p in sorted(resources.files("quillmesh.llm").joinpath("licence_texts").iterdir(), key=lambda p: p.name)]
    titled = [(i, f"{title}\n\n{t}") for i, t in texts for title in TITLES.get(i, ())]
    return texts + titled + NOTICES


def _plain(text: Column) -> Column:
    out = F.lower(F.regexp_replace(text, F.lit(_COPYRIGHT), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), r" *\n[ \n]*", "\n"), F.lit(" \n"))


def canonical(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """rows with the canonical lines of a text as column `name`: lower case, without copyright lines, runs of punctuation and
    space as one space, equivalent spellings made one. Lines stay apart; empty ones go.

    The spellings are replaced only in texts that hold one.
    """
    out = F.col(name)
    for variant, one in SPELLINGS:
        out = F.regexp_replace(out, rf"\b(?:{variant})\b", one)
    return rows.withColumn(name, _plain(text)).withColumn(name, F.when(F.col(name).rlike(_RARE), out).otherwise(F.col(name)))


def digest(lines: Column) -> Column:
    """The digest of canonical lines taken as one text; line breaks don't matter."""
    return F.sha2(F.translate(lines, "\n", " "), 256)


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of known(license_id, text); of licences with one digest the least id counts."""
    lines = canonical(known.select("license_id", "text"), F.col("text"), "text")
    return lines.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_digest, license_id, notices) for every row of docs(doc_id, text).

    license_id: the known licence that the whole text is, else null. notices: the sorted ids of known texts that are a line
    of it. Null and empty texts have the digest of the empty text and no licence. Repeated rows come out repeated; other
    columns are ignored. known: (license_id, text), a registry; Spark broadcasts its digests only while they are small.
    """
    table = common.saved(digests(known), "licence-digests")
    empty = digest(F.lit(""))
    lines = canonical(docs.select("doc_id", common.text_or_empty().alias("lines")), F.col("lines"), "lines")
    every = lines.select("doc_id", digest(F.col("lines")).alias("text_digest"), F.array_distinct(F.transform(F.split("lines", "\n"), lambda x: F.unhex(digest(x)))).alias("line_digests"))
    every = common.saved(every.withColumn("row", F.monotonically_increasing_id()), "licence-lines", "zstd")
    lines = every.select("row", F.explode("line_digests").alias("one")).select("row", F.lower(F.hex("one")).alias("digest"))
    hits = lines.where(F.col("digest") != empty).join(table, "digest")
    hits = common.saved(hits.groupBy("row").agg(F.array_sort(F.collect_set("license_id")).alias("notices")), "licence-notices")
    whole = every.select("row", "doc_id", "text_digest").join(table.where(F.col("digest") != empty), F.col("text_digest") == F.col("digest"), "left")
    return whole.join(hits, "row", "left").select("doc_id", "text_digest", "license_id", F.array_join("notices", ",").alias("notices"))


def op10_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, text_digest, license_id, notices (ids, comma-separated; null for none)."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licences(spark))


def _sql() -> str:
    quoted = ", ".join(f"""('{i}', '{t.replace("'", "''")}')""" for i, t in known_texts())
    text = f"""lower(regexp_replace(coalesce(text, ''), '{_COPYRIGHT}', '', 'g'))"""
    text = rf"regexp_replace({text}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    text = f"trim(regexp_replace({text}, ' *\n[ \n]*', '\n', 'g'), ' \n')"
    for variant, one in SPELLINGS:
        text = rf"regexp_replace({text}, '\b(?:{variant})\b', '{one}', 'g')"
    return f"""
WITH known(license_id, text) AS (VALUES {quoted}),
k AS (SELECT sha256(replace({text}, '\n', ' ')) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS rn, {text} AS lines FROM documents),
l AS (SELECT rn, unnest(list_distinct(string_split(lines, '\n'))) AS line FROM d),
n AS (SELECT rn, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN k ON sha256(line) = digest WHERE line <> '' GROUP BY rn)
SELECT doc_id, sha256(replace(lines, '\n', ' ')) AS text_digest, CASE WHEN lines <> '' THEN license_id END AS license_id, notices
FROM d LEFT JOIN n USING (rn) LEFT JOIN k ON sha256(replace(lines, '\n', ' ')) = k.digest
"""


OP10_SQL = _sql()
