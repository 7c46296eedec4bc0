"""The message table and its readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources import files

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The names under which a field may come, the first present one counting.
ALIASES = {
    "external_id": ("id", "message_id", "external_id"),
    "text": ("text", "message", "content"),
    "timestamp": ("timestamp", "created_at", "time", "date"),
    "tas_action": ("tas_action", "action"),
    "is_spam": ("is_spam", "label", "spam"),
    "user_complaint": ("user_complaint",),
    "unbanned": ("unbanned",),
}
TRUE_WORDS, FALSE_WORDS = ("1", "true", "spam", "yes"), ("0", "false", "ham", "no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label, event and page as labelled messages."""
    d, lab, e, p = (table(spark, sf_dir, n) for n in ("documents", "labels", "events", "pages"))
    joined = d.join(lab, "doc_id", "left").join(e, F.col("doc_id") == F.col("event_id"), "left").join(p, F.col("doc_id") == F.col("page_id"), "left")
    return joined.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("external_id"), F.col("ts").alias("timestamp"),
        F.when(F.col("url").isNull(), F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" "), F.col("url"))).alias("text"), F.col("lang").alias("language"), "source", F.col("user_id").alias("sender"),
        F.when(F.col("toxic") == 1, True).when(F.col("toxic") == 0, False).alias("is_spam"),
        F.when(F.col("event_type") == "error", "blocked").otherwise("allowed").alias("tas_action"),
        (F.col("event_type") == "purchase").alias("user_complaint"), (F.col("event_type") == "signup").alias("unbanned"),
    )


def label(value: Column) -> Column:
    """True, false or null of a label in words."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def timestamp(value: Column, as_of: Column) -> Column:
    """Of ISO text (Z or offset; without one UTC) or epoch seconds; what is neither counts as as_of."""
    word = F.trim(value.cast("string"))
    seconds = F.when(F.regexp_like(word, F.lit(r"^\d+(\.\d+)?$")), F.timestamp_seconds(F.try_to_number(word, F.lit("999999999999.999999"))))
    return F.coalesce(seconds, F.try_to_timestamp(word), as_of.cast("timestamp"))


def first_of(df: DataFrame, names) -> Column:
    """The first non-null of the columns that df has, as text; null if it has none."""
    have = {c.lower(): c for c in df.columns}
    return F.coalesce(*[F.col(have[n]).cast("string") for n in names if n in have], F.lit(None).cast("string"))


def normalised(rows: DataFrame, as_of, since=None) -> DataFrame:
    """Raw records under any of the ALIASES as message rows; the other columns go into meta without nulls.

    Rows without text are left out, as are those before `since`.
    """
    meta = [c for c in rows.columns if c.lower() not in _USED and c not in ("raw_entry", "row_data")]
    pairs = [x for c in meta for x in (F.lit(c), F.col(c).cast("string"))]
    packed = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return _messages(rows, lambda names: first_of(rows, names), packed, as_of, since)


def normalised_entries(entries: DataFrame, as_of, since=None) -> DataFrame:
    """Entries of files (see sources.files) as message rows: as normalised(), with the fields that each entry has."""
    value = lambda names: F.coalesce(*[F.col("entry")[n] for n in names])
    packed = F.map_filter("entry", lambda k, v: v.isNotNull() & ~F.lower(k).isin(*sorted(_USED), "raw_entry", "row_data"))
    return _messages(entries, value, packed, as_of, since)


_USED = {n for names in ALIASES.values() for n in names}


def _messages(rows: DataFrame, value, meta: Column, as_of, since) -> DataFrame:
    out = rows.select(
        value(ALIASES["external_id"]).alias("external_id"), timestamp(value(ALIASES["timestamp"]), F.lit(as_of)).alias("timestamp"),
        value(ALIASES["text"]).alias("text"), label(value(ALIASES["is_spam"])).alias("is_spam"), value(ALIASES["tas_action"]).alias("tas_action"),
        F.coalesce(label(value(ALIASES["user_complaint"])), F.lit(False)).alias("user_complaint"), F.coalesce(label(value(ALIASES["unbanned"])), F.lit(False)).alias("unbanned"), meta.alias("meta"),
    ).where("text is not null and trim(text) <> ''")
    return out if since is None else out.where(F.col("timestamp") >= F.lit(since))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_storage(spark: SparkSession, path: str, as_of, since=None, stream: bool = False) -> DataFrame:
    """A file, or all .json, .jsonl and .csv files of a folder, as message rows; each file is read by what it holds. As a
    stream, files that come to the folder later are read too."""
    if any(path.lower().endswith(e) for e in (*files.WHOLE, *files.LINES)):
        return normalised_entries(files.read_file(spark, path, stream=stream), as_of, since)
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*.{" + ",".join(e[1:] for e in (*files.WHOLE, *files.LINES)) + "}")
    if not stream and not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        raise ValueError(f"no .json, .jsonl or .csv files in {path}")
    return normalised_entries(files.read_folder(spark, path, stream), as_of, since)


def read_reports(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Moderators' reports, CSV files: (report_id, text, is_spam); rows without text or label are left out. As a stream, each
    file that comes to the folder is read once."""
    rows = files.columns_of(files.read_file(spark, path, "csv", stream), "Report ID", "Message Content", "Is Spam")
    out = rows.select(F.col("Report ID").alias("report_id"), F.trim("Message Content").alias("text"), label(F.col("Is Spam")).alias("is_spam"))
    return out.where("text <> '' and is_spam is not null")


def csv_messages(rows: DataFrame, timestamp_column: str, text_column: str, label_column: str, as_of) -> DataFrame:
    """Rows of a CSV with these columns as (timestamp, text, is_spam); rows without text are left out."""
    out = rows.select(timestamp(F.col(timestamp_column), F.lit(as_of)).alias("timestamp"), F.col(text_column).alias("text"), label(F.col(label_column)).alias("is_spam"))
    return out.where("text is not null and text <> ''")


def platform_messages(records: DataFrame, as_of) -> DataFrame:
    """Platform logs as message rows: those without an id are left out, a missing label is ham, and of several label fields
    is_spam comes before spam_flag, label_spam, not label_not_spam, and a moderator's word."""
    have = set(records.columns)

    def flag(name):
        return label(F.col(name)) if name in have else F.lit(None).cast("boolean")

    spam = F.coalesce(flag("is_spam"), flag("spam_flag"), flag("label_spam"), ~flag("label_not_spam"), flag("moderator_label"), flag("label"), F.lit(False))
    ids = first_of(records, ("message_id", "id", "msg_id"))
    meta = [c for c in ("chat_id", "channel_id", "user_id", "sender_id", "language", "country", "message_type", "has_media") if c in have]
    pairs = [x for c in meta for x in (F.lit(c), F.col(c).cast("string"))]
    packed = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    at = timestamp(first_of(records, ("timestamp", "created_at", "date", "time")), F.lit(as_of))
    return records.select(ids.alias("external_id"), at.alias("timestamp"), F.coalesce(first_of(records, ("text", "message", "content", "body")), F.lit("")).alias("text"), spam.alias("is_spam"), packed.alias("meta")).where("external_id is not null")


def recent(rows: DataFrame, as_of, days: int, limit: int | None = None, is_spam: bool | None = None, after_id: int | None = None) -> DataFrame:
    """Messages of the last days; the filters reach the scan. With a limit those that are newest, in that order."""
    out = rows.where(F.col("timestamp") >= F.lit(as_of) - F.make_interval(days=F.lit(days)))
    if is_spam is not None:
        out = out.where(F.col("is_spam") == is_spam)
    if after_id is not None:
        out = out.where(F.col("id") > after_id)
    return out if limit is None else out.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def latest(rows: DataFrame) -> DataFrame:
    """The row of the greatest id."""
    return rows.orderBy(F.desc("id")).limit(1)


def by_id(rows: DataFrame, id_: int) -> DataFrame:
    return rows.where(F.col("id") == id_)


def by_external_id(rows: DataFrame, external_id: str) -> DataFrame:
    return rows.where(F.col("external_id") == external_id)


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "external_id") -> DataFrame:
    """The rows of a batch that the stored table lacks, one for each key (rows without a key all)."""
    keyed = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return keyed.unionByName(batch.where(F.col(key).isNull()))


def training_set(rows: DataFrame, namespace: Column, text_columns=("text", "message", "content", "body"), label_column: str = "label") -> DataFrame:
    """Rows as training examples (namespace, text, label, accepted), trimmed; those without a text or a label aren't accepted."""
    names = [c for c in text_columns if c in rows.columns][:1]
    if not names or label_column not in rows.columns:
        raise ValueError(f"no text or label column among {rows.columns}")
    text, word = F.trim(F.col(names[0])), F.trim(F.col(label_column).cast("string"))
    filled = (F.coalesce(text, F.lit("")) != "") & (F.coalesce(word, F.lit("")) != "")
    return rows.select(namespace.alias("namespace"), text.alias("text"), word.alias("label"), filled.alias("accepted"))
