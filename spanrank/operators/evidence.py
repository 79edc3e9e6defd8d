"""What was not found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..functions.patterns import Matcher


def pattern_absences(files: DataFrame, chunks: DataFrame, matcher: Matcher) -> DataFrame:
    """(position, pattern, state) of patterns without a chunk: outside (a file has it) or absent."""
    spark = files.sparkSession
    asked = spark.createDataFrame(list(enumerate(matcher.patterns)), "position int, pattern string")
    seen = lambda df, c: df.select(F.explode(F.array_distinct(F.flatten(matcher.flags(F.array(F.coalesce(F.col(c), F.lit("")))))))  .alias("position")).distinct()
    left = asked.join(seen(chunks, "code"), "position", "left_anti")
    there = seen(files, "text").withColumn("there", F.lit(True))
    return left.join(there, "position", "left").select("position", "pattern", F.when(F.col("there"), "outside").otherwise("absent").alias("state"))


def undefined_symbols(chunks: DataFrame) -> DataFrame:
    """Symbols of chunks that no chunk of the same symbol defines."""
    lines = F.transform(X.line_array(F.col("code")), X.bare)
    defines = F.exists(lines, lambda x: x.contains(F.col("symbol")) & x.rlike("|".join(K.KIND_WORDS)))
    return chunks.where("symbol <> ''").groupBy("symbol").agg(F.max(defines).alias("d")).where("NOT d").select("symbol")


def sentences(where: str, absences, symbols) -> list[str]:
    """Report lines of collected absences (position order) and symbols."""
    out = [f"No definition found for '{s}' in {where}" for s in symbols]
    for pattern, state in absences:
        out.append(f"Pattern '{pattern}' IS in {where} but its match fell outside the selected chunks (budget/dedupe)" if state == "outside" else f"Pattern '{pattern}' not found in {where}")
    return out
