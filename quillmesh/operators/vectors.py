"""A stored cache of vectors by the sha256 of the text, in partitions by the key's first digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.operators import advice
from quillmesh.session import dropped, kept

ENTRIES = "key string, vector array<double>, prefix string"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(key, vector, prefix) of the cache in a folder; of an entry that was written twice, one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ENTRIES)
    one = F.row_number().over(Window.partitionBy("prefix", "key").orderBy(F.monotonically_increasing_id()))
    return spark.read.schema(ENTRIES).parquet(folder).withColumn("_n", one).where("_n = 1").drop("_n")


def embedded(messages: DataFrame, folder: str, model: Callable[[list[str]], list]) -> tuple[DataFrame, int]:
    """(id, vector) of messages(id, text), and how many texts went through the model: those that the cache in the folder lacks,
    each once; their vectors are added to it. Null texts have no vector.

    Of the cache only the partitions of the keys' first two digits are read. A run that is stopped before its entries are
    written embeds them again; two runs at once may both write an entry, of which one is read.
    """
    spark = messages.sparkSession
    rows = messages.where("text is not null").select("id", "text")
    prefix = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 2)
    needed = [r.p for r in rows.select(prefix.alias("p")).distinct().collect()]  # 256 at the most
    known = stored(spark, folder).where(F.col("prefix").isin(*needed)) if needed else stored(spark, folder)
    _, fresh = advice.embed(rows, known.select("key", "vector"), model)
    fresh = kept(fresh.withColumn("prefix", F.substring("key", 1, 2)), "vectors-new")
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("prefix").parquet(folder)
    dropped(fresh)
    entries = stored(spark, folder).where(F.col("prefix").isin(*needed)) if needed else stored(spark, folder)
    keyed = rows.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return keyed.join(entries.select("key", "vector"), "key").select("id", "vector"), n
