"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(pairs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """pairs(u, v) with m of least(u, m, n), n being the number of pairs of u.

    A node that has over a thousandth of all pairs would fill one task of the
    join.  There are fewer than a thousand such nodes whatever the input, so
    they are broadcast; the others meet in a plain join.  Without such nodes
    that join is all, which keeps the plans of the many rounds small.
    """
    hot = least.where(F.col("n") > max(1000, total // 1000)).select("u", "m")
    if total <= 1000 or not hot.limit(1).count():
        return pairs.join(least.select("u", "m"), "u")
    spread = pairs.join(F.broadcast(hot), "u")
    return spread.unionByName(pairs.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.select("u", "m"), "u"))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over ``total`` edges (u, v) with u > v.

    Large-star: every node links its larger neighbours to the least node of its
    neighbourhood, itself included.  Small-star: it links its smaller
    neighbours and itself to the least of them.
    """
    count = F.count("*").alias("n")
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), count)
        out = _with_least(both, least, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), count)
        smaller = _with_least(edges, least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = smaller.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    ``edges`` has columns u and v of one orderable type, in any direction;
    nulls, loops and repeated edges are ignored.  Each round is written to the
    shared scratch folder, so a lost executor costs one round at most.  The
    loop ends when a round leaves the edge set as it was: then the edges are
    stars around the least nodes.  No edges: no rows.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    while True:
        big = scratch.save(_star(now, True, now.count()))
        small = scratch.save(_star(big, False, big.count()))
        row = small.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h"), F.sum(F.expr("cast(xxhash64(v, u) as decimal(38,0))")).alias("s")).first()
        scratch.drop(now, big)
        now = small
        if (row.n, row.h, row.s) == sign or not row.n:
            break
        sign = (row.n, row.h, row.s)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
