"""Hit, coverage and relevance of contexts against ground-truth spans; caps and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def stripped_lines(text: Column) -> Column:
    """Distinct stripped lines that aren't blank."""
    return F.array_distinct(F.filter(F.transform(X.line_array(text), X.strip), lambda x: x != ""))


def coverage(truth: Column, context: Column) -> Column:
    """Share of the truth's lines that the context has; 1 without truth lines."""
    want, have = stripped_lines(truth), stripped_lines(context)
    return F.when(F.size(want) == 0, 1.0).otherwise(1 - F.size(F.array_except(want, have)) / F.size(want))


def hit(truth: Column, context: Column) -> Column:
    """Whether the context has every line of the truth."""
    return F.size(F.array_except(stripped_lines(truth), stripped_lines(context))) == 0


def irrelevant_percent(truth: Column, context: Column) -> Column:
    want, have = stripped_lines(truth), stripped_lines(context)
    return F.when(F.size(have) == 0, 0.0).otherwise(100.0 * F.size(F.array_except(have, want)) / F.size(have))


def capped(context: Column, tokens: int = 8000) -> Column:
    """The context's first ``tokens`` tokens' worth of characters."""
    return F.substring(context, 1, 4 * tokens)


def file_recall(named: Column, wanted: Column) -> Column:
    """Share of wanted paths whose base name is among the named ones."""
    base = lambda c: F.array_distinct(F.transform(c, lambda p: F.element_at(F.split(p, "/"), -1)))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(base(named), base(wanted))) / F.size(base(wanted)))


def summarise(cells: DataFrame, by: str = "strategy") -> DataFrame:
    """Per strategy: median and mean tokens, hit rate, mean coverage, median latency, number of cells."""
    return cells.groupBy(by).agg(F.expr("percentile(tokens, 0.5)").alias("median_tokens"), F.avg("tokens").alias("mean_tokens"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("coverage").alias("mean_coverage"), F.expr("percentile(latency_ms, 0.5)").alias("median_latency_ms"), F.count("*").alias("cells"))


def hit_matrix(cells: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Hit rates by family and strategy as a pivot over the given strategies."""
    return cells.groupBy(rows).pivot(columns, values).agg(F.avg(F.col("hit").cast("double")))


def read_until(ranked: DataFrame, budget: int, by: str = "qid") -> DataFrame:
    """Rows of each query in rank order while what came before is under the budget (the last may overshoot)."""
    before = F.sum("tokens").over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("used_before", F.coalesce(before, F.lit(0))).where(F.col("used_before") < budget)


def refine_terms(chunks: DataFrame, seen: list[str], top: int = 4) -> DataFrame:
    """(term, n, weight): the most frequent identifiers of a first round that its query didn't name; snake and camel case first."""
    words = chunks.select(F.explode(F.regexp_extract_all(F.col("code"), F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))).alias("term"))
    counted = words.where(~F.lower("term").isin(*[s.lower() for s in seen])).groupBy("term").agg(F.count("*").alias("n"))
    shaped = F.col("term").contains("_") | F.col("term").rlike("[a-z][A-Z]")
    return counted.withColumn("weight", F.col("n") + F.when(shaped, 100).otherwise(0)).orderBy(F.desc("weight"), "term").limit(top)
