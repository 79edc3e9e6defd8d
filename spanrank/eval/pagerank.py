"""Personalised PageRank by joins, and the map of a repository made with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import Scratch


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 15) -> DataFrame:
    """(node, rank) of edges(src, dst): seeds(node) start with weight 1, others with 0.05; all alike without seeds.

    Nodes without outgoing edges pass nothing on.  Edges with their sources'
    degrees and the nodes are written once, and the ranks every third round:
    the rounds' plans stay short and read a lineage that is on shared storage.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    edges = scratch.save(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    base = nodes.withColumn("b", F.lit(1.0)) if seeds is None else nodes.join(seeds.select("node").distinct().withColumn("s", F.lit(1.0)), "node", "left").select("node", F.coalesce("s", F.lit(0.05)).alias("b"))
    base = base.crossJoin(F.broadcast(base.agg(F.sum("b").alias("t")))).select("node", (F.col("b") / F.col("t")).alias("base"))  # one row
    base = scratch.save(base)
    out = scratch.save(edges.join(edges.groupBy("src").agg(F.count("*").alias("k")), "src"))
    rank, kept = base.select("node", F.col("base").alias("rank")), None
    for i in range(rounds):
        sent = out.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("k")).alias("in"))
        rank = base.join(sent, "node", "left").select("node", ((1 - damping) * F.col("base") + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if i % 3 == 2 and i + 1 < rounds:
            before, kept = kept, scratch.save(rank)
            scratch.drop(before)
            rank = kept
    return rank


def reference_edges(files: DataFrame) -> DataFrame:
    """(src, dst): files that use a name, and the files that define it."""
    lines = files.select("file", F.explode(X.line_array(F.col("text"))).alias("line"))
    defs = lines.where(X.is_definition(F.col("line"))).select(F.col("file").alias("dst"), X.symbol(F.col("line")).alias("name")).where("length(name) >= 4").distinct()
    used = lines.select(F.col("file").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w{4,}"), F.lit(0)))).alias("name")).distinct()
    return used.join(defs, "name").where("src <> dst").select("src", "dst").distinct()


def repository_map(files: DataFrame, seeds: DataFrame | None = None, n_files: int = 12, n_symbols: int = 6) -> DataFrame:
    """(file, ln, line): the first definitions of the files of highest rank."""
    best = pagerank(reference_edges(files), seeds).orderBy(F.desc(F.round("rank", 9)), F.asc("node")).limit(n_files)
    lines = files.join(F.broadcast(best.select(F.col("node").alias("file"))), "file").select("file", X.line_array(F.col("text")).alias("lines"))
    marks = F.slice(F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("ln"), X.bare(x).alias("line"), X.is_definition(x).alias("d"))), lambda s: s["d"]), 1, n_symbols)
    return lines.select("file", F.explode(marks).alias("m")).select("file", (F.col("m.ln") + 1).alias("ln"), "m.line")
