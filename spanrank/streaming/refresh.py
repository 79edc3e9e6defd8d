"""Index refresh as a stream: changed files replace their postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, index


def latest(files: DataFrame) -> DataFrame:
    """The newest version (by mtime) of each file of files(file, text, mtime)."""
    newest = Window.partitionBy("file").orderBy(F.desc("mtime"), F.desc(F.xxhash64("text")))
    return files.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def refresh(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends versioned postings of every arriving file to ``path``/postings.

    Each batch is written under its number, so a repeated batch replaces itself.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = latest(batch)
        built = index.build_index(blocks.blocks(newest.select("file", "text")), X.semantic_tokens(F.col("code")))
        out = built.postings.join(newest.select("file", "mtime"), "file")
        out.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, path: str) -> index.TermIndex:
    """The index over the newest version of every file."""
    postings = spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings")
    newest = postings.groupBy("file").agg(F.max("mtime").alias("mtime"))
    now = postings.join(newest, ["file", "mtime"]).select("term", "file", "lo", "hi", "tf", "dl").distinct()
    sized = now.select("file", "lo", "hi", "dl").distinct()
    return index.TermIndex(sized, now, now.groupBy("term").agg(F.count("*").alias("df")), sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def event_activity(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and window of a stream or table, late rows up to ``late`` included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
