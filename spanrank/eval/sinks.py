"""Sinks of evaluation cells: JSON lines that a later run resumes, and a summary in Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics


def done(spark: SparkSession, path: str, schema) -> DataFrame:
    """The cells below ``path``; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def todo(tasks: DataFrame, cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """The tasks of which no cell has the key: what an interrupted run has left."""
    return tasks.join(cells.select(*key).distinct(), list(key), "left_anti")


def append(cells: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Add the cells whose key isn't there yet as JSON lines; the whole table is returned."""
    spark = cells.sparkSession
    todo(cells, done(spark, path, cells.schema), key).dropDuplicates(list(key)).write.mode("append").json(path)
    return done(spark, path, cells.schema)


def markdown(cells: DataFrame, by: str = "strategy") -> str:
    """The summary of the cells as a Markdown table, a row for each strategy, best hit rate first."""
    rows = metrics.summarise(cells, by).orderBy(F.desc("hit_rate"), by).collect()  # a row for each strategy
    head = [by, "hit rate", "coverage", "median tokens", "median ms", "cells"]
    body = [[r[by], f"{100 * r.hit_rate:.1f} %", f"{100 * r.mean_coverage:.1f} %", f"{r.median_tokens:.0f}", f"{r.median_latency_ms:.1f}", str(r.cells)] for r in rows]
    return "\n".join("| " + " | ".join(map(str, line)) + " |" for line in [head, ["---"] * len(head), *body])
