"""Message files of any of their forms, each file read by what it holds; batch and stream share the code."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "path string, entry map<string,string>"
#: Where an object holds its rows; the first that is there and not empty counts.
WRAPPERS = ("logs", "data", "messages")
#: Forms by file ending: whole files, and files of lines that can be read in ranges.
WHOLE, LINES = {".json": "json", ".csv": "csv"}, {".jsonl": "jsonl", ".ndjson": "jsonl"}


def _plain(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _entries(data) -> Iterator[dict]:
    """Rows of parsed JSON: of an array, of an object that wraps one, or the object itself; other values are no rows."""
    if isinstance(data, dict):
        wrapped = next((data[k] for k in WRAPPERS if data.get(k)), None)
        data = wrapped if isinstance(wrapped, list) else [] if any(k in data for k in WRAPPERS) else [data]
    for row in data if isinstance(data, list) else ():
        if isinstance(row, dict):
            yield {k: _plain(v) for k, v in row.items()}


def json_lines(text: str) -> Iterator[dict]:
    """Rows of lines of JSON; lines that are none are skipped."""
    for line in text.split("\n"):
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict):
            yield {k: _plain(v) for k, v in row.items()}


def json_file(text: str) -> Iterator[dict]:
    """Rows of a file that is one JSON value, however it is wrapped and laid out, else of its lines."""
    try:
        data = json.loads(text.lstrip("\ufeff"))
    except ValueError:
        yield from json_lines(text)
    else:
        yield from _entries(data)


def csv_file(text: str) -> Iterator[dict]:
    """Rows of a CSV under its own header; fields beyond the header are left out, missing ones null."""
    for row in csv.DictReader(io.StringIO(text.lstrip("\ufeff"), newline="")):
        yield {k: v for k, v in row.items() if k is not None}


_PARSERS: dict[str, Callable[[str], Iterator[dict]]] = {"json": json_file, "jsonl": json_lines, "csv": csv_file}


def _parsed(rows: DataFrame, form: str) -> DataFrame:
    import pyarrow as pa

    kind = pa.map_(pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("value")):
                found = [list(x.items()) for x in _PARSERS[form](text.as_py() or "")]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(part), pa.string()), "entry": pa.array(part, kind)})

    return rows.mapInArrow(run, ENTRY)


def _source(spark: SparkSession, path: str, form: str, ending: str | None, stream: bool) -> DataFrame:
    """(path, value) of the files at path, whole or by lines; only those of the ending, if one is given."""
    reader = (spark.readStream if stream else spark.read).format("text").option("wholetext", form != "jsonl")
    if ending:
        reader = reader.option("pathGlobFilter", f"*{ending}")
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_file(spark: SparkSession, path: str, form: str | None = None, stream: bool = False) -> DataFrame:
    """(path, entry) of the rows of one file, or of a folder's files of one form: json, jsonl or csv (by the path's ending if
    None). An entry maps its fields to text; numbers and nested values are JSON."""
    ending = next((e for e in (*WHOLE, *LINES) if path.lower().endswith(e)), None)
    form = form or (WHOLE | LINES).get(ending)
    if form not in _PARSERS:
        raise ValueError(f"{path} is neither of {', '.join((*WHOLE, *LINES))} nor is its form given")
    return _parsed(_source(spark, path, form, None, stream), form)


def read_folder(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """(path, entry) of all .json, .jsonl, .ndjson and .csv files of a folder, each read by what it holds: arrays, wrapped
    arrays, single objects or lines of JSON beside each other, CSVs each under its own header. Other files are left alone.

    A .json or .csv file is a row of its own while it is parsed (2 GB at the most); files of lines are read in ranges.
    """
    out = None
    for ending, form in (WHOLE | LINES).items():
        part = _parsed(_source(spark, folder, form, ending, stream), form)
        out = part if out is None else out.unionByName(part)
    return out


def columns_of(entries: DataFrame, *names: str) -> DataFrame:
    """Fields of entries as columns of text, null where a row lacks them."""
    return entries.select(*[F.col("entry")[n].alias(n) for n in names])


def schema_of(entries: DataFrame) -> T.StructType:
    """The fields that any of the entries has, in order of their names: one pass over them."""
    names = entries.select(F.explode(F.map_keys("entry")).alias("k")).distinct().orderBy("k").collect()  # a row a field
    return T.StructType([T.StructField(r.k, T.StringType()) for r in names])
