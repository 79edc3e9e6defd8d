"""Line grep, hit merging and context windows.

A file is one row with its lines as an array, so everything from the grep to
the windows happens inside the row: no shuffle and no join back to the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import Matcher

def with_hits(files: DataFrame, matcher: Matcher) -> DataFrame:
    """files(file, text) with lines and hits: array of (ln 0-based, pats indices) for matching lines."""
    lined = matcher.narrowed(files, "text").select("file", X.line_array(F.col("text")).alias("lines"))
    flagged = lined.withColumn("flags", matcher.flags(F.col("lines")))
    hits = F.filter(F.transform("flags", lambda p, i: F.struct(i.alias("ln"), p.alias("pats"))), lambda h: F.size(h["pats"]) > 0)
    return flagged.withColumn("hits", hits).drop("flags").where(F.size("hits") > 0)


def line_hits(files: DataFrame, matcher: Matcher) -> DataFrame:
    """(file, ln 1-based, line, n_patterns) of every matching line."""
    found = with_hits(files, matcher).select("file", "lines", F.explode("hits").alias("h"))
    return found.select("file", (F.col("h.ln") + 1).alias("ln"), X.bare(F.element_at("lines", F.col("h.ln") + 1)).alias("line"), F.size("h.pats").alias("n_patterns"))


def with_groups(found: DataFrame, reach: int) -> DataFrame:
    """found(..., hits) with groups: array of (first, last, hits, pats, at) of hits of which neighbours are at most ``reach`` lines apart.

    A group runs from one break to the next, so each hit is looked at once; at
    holds its hits' lines.
    """
    breaks = F.filter(F.transform("hits", lambda h, i: F.when((i == 0) | (h["ln"] - F.get("hits", i - 1)["ln"] > reach), i)), lambda i: i.isNotNull())
    marked = found.withColumn("_breaks", breaks)

    def group(i, k):
        part = F.slice("hits", i + 1, F.coalesce(F.get("_breaks", k + 1), F.size("hits")) - i)
        at = F.transform(part, lambda h: h["ln"])
        return F.struct(F.element_at(at, 1).alias("first"), F.element_at(at, -1).alias("last"), F.size(at).alias("hits"), F.array_distinct(F.flatten(F.transform(part, lambda h: h["pats"]))).alias("pats"), at.alias("at"))

    return marked.withColumn("groups", F.transform("_breaks", group)).drop("_breaks")


def hit_groups(files: DataFrame, matcher: Matcher, before: int, after: int) -> DataFrame:
    """(file, lines, first, last, hits, pats) of every merged group.

    A plain explode would have a filter inferred on the groups, which the
    optimizer evaluates below, inside the lambda functions that read the hits.
    """
    found = with_groups(with_hits(files, matcher), before + after).select("file", "lines", F.explode_outer("groups").alias("g")).where("g IS NOT NULL")
    return found.select("file", "lines", "g.first", "g.last", "g.hits", "g.pats")


def chunk_columns(found: DataFrame, matcher: Matcher) -> DataFrame:
    """Chunks of rows (file, lines, start, end, hits, pats, symbol); lines [start, end) make the code."""
    code = F.array_join(F.slice("lines", F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0))), "")
    names = F.array(*map(F.lit, matcher.patterns)) if matcher.patterns else F.array().cast("array<string>")
    made = found.select("file", (F.col("start") + 1).alias("line_start"), F.col("end").alias("line_end"), code.alias("code"), F.transform("pats", lambda i: F.element_at(names, i + 1)).alias("patterns"), F.size("pats").alias("matches"), F.col("hits").alias("hit_lines"), F.coalesce("symbol", F.lit("")).alias("symbol"))
    return made.withColumn("hash", F.substring(F.md5("code"), 1, 8)).withColumn("tokens", X.estimate_tokens(F.col("code")))


def window_chunks(files: DataFrame, matcher: Matcher, before: int = 40, after: int = 40) -> DataFrame:
    """Chunks of fixed context around merged hits."""
    found = hit_groups(files, matcher, before, after)
    found = found.withColumn("start", F.greatest(F.lit(0), F.col("first") - before)).withColumn("end", F.least(F.size("lines"), F.col("last") + after + 1))
    return chunk_columns(found.withColumn("symbol", F.lit(None).cast("string")), matcher)
