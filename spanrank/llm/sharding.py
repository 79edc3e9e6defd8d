"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Rows lie in local partitions.  The number of rows that partition p sends to
each destination is drawn exactly: given what is left of the destinations, the
counts of a uniformly shuffled deck are multivariate hypergeometric.  Every
partition permutes its rows and deals them by these counts, and after the
exchange every destination permutes what it got.  Shard sizes are exact and
every arrangement of the rows is equally likely.

The matrix has two levels, so that neither the driver nor a task holds more
than a corner of it.  The driver draws groups of partitions by top cells; a
task for each group draws its partitions by top cells with these margins.
After the exchange a task for each top cell draws its pieces by its own cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` cards are good; numpy's generator, and inversion beyond its range."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    lo, hi = max(0, draws - bad), min(draws, good)
    mean = draws * good / total
    spread = 12 * math.sqrt(draws * (good / total) * (bad / total)) + 50
    a, b = max(lo, int(mean - spread)), min(hi, int(mean + spread))
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(p - p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1]))


def communication_matrix(sent: list[int], room: list[int], seed) -> np.ndarray:
    """Counts [partition, destination] with the given row and column sums."""
    rng = np.random.default_rng(seed)
    left = list(room)
    out = np.zeros((len(sent), len(room)), np.int64)
    for p, n in enumerate(sent):
        total = sum(left)
        for c in range(len(left)):
            k = hypergeometric(rng, left[c], total - left[c], n)
            out[p, c] = k
            total -= left[c]
            n -= k
            left[c] -= k
    return out


def _draw(seed: int, name: str, piece: str):
    """Rows of a group's part of the matrix, as running sums: its pieces (n rows each) against ``room``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(piece)
        own = int(group[name].iloc[0])
        matrix = communication_matrix([int(n) for n in group["n"]], [int(x) for x in group["room"].iloc[0]], [seed, own])
        return pd.DataFrame({name: own, piece: group[piece].to_numpy(), "_upto": [np.cumsum(m)[:-1].tolist() for m in matrix]})

    return run


def _dealt(rows: DataFrame, deal: DataFrame, keys: list[str], seed: int, name: str) -> DataFrame:
    """rows with ``name``: where each goes, after its piece is permuted and cut by the running sums of deal."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("_place", F.lit(seed)), "_place")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1).join(deal, keys)
    return ranked.withColumn(name, F.size(F.filter("_upto", lambda x: x <= F.col("_rank")))).drop("_upto", "_rank")


def shuffle_to_shards(df: DataFrame, n_shards: int = 16, seed: int = 42, groups: int = 1024, fan: int = 256, cell_rows: int = 1 << 20) -> DataFrame:
    """Rows of df with ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    Shard sizes differ by one at most.  Each shard has ``fan // n_shards`` top
    cells, and these have cells of ``cell_rows`` rows at most, so no task sorts
    more, whatever the size of the table; source partitions are pieces of
    ``groups`` groups.  What reaches the driver is a count for each group.  The
    input is written once to the shared scratch folder with its place, and
    again after the first exchange, so that a lost executor can't change the
    deal.  Values and nulls don't matter, equal rows are dealt separately;
    columns named shard or slot are replaced.  No rows: none.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    df = df.drop("shard", "slot")
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("_row")
    placed = scratch.save(df.select(F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"), row).withColumn("_group", F.pmod("_part", F.lit(groups))))
    pieces = scratch.save(placed.groupBy("_group", "_part").agg(F.count("*").alias("n")))
    sent = sorted((r._group, r.n) for r in pieces.groupBy("_group").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sent)
    per = max(1, fan // n_shards)
    room, tops, at = [], [], 0
    for shard in range(n_shards):
        size, base = total // n_shards + (shard < total % n_shards), 0
        for j in range(per):
            k = size // per + (j < size % per)
            tops.append((at, shard, base, k, max(1, -(-k // cell_rows))))
            room.append(k)
            base, at = base + k, at + 1
    drawn = [(g, [int(x) for x in m]) for (g, _), m in zip(sent, communication_matrix([n for _, n in sent], room, [seed]))]
    rooms = spark.createDataFrame(drawn, "_group int, room array<long>")
    deal = pieces.join(F.broadcast(rooms), "_group").groupBy("_group").applyInPandas(_draw(seed + 1, "_group", "_part"), "_group int, _part int, _upto array<long>")

    tops = F.broadcast(spark.createDataFrame(tops, "_top int, shard int, _base long, _size long, _cells int"))
    first = _dealt(placed, deal, ["_group", "_part"], seed, "_top").drop("_group", "_part").join(tops, "_top")
    first = scratch.save(first.withColumn("_piece", F.expr(f"cast(pmod(xxhash64(_place, {seed + 2}), _cells) as int)")))
    cell = F.expr("transform(sequence(0, _cells - 1), j -> _size div _cells + if(j < _size % _cells, 1, 0))")
    pieces = first.groupBy("_top", "_piece").agg(F.count("*").alias("n")).join(tops, "_top").select("_top", "_piece", "n", cell.alias("room"))
    deal = pieces.groupBy("_top").applyInPandas(_draw(seed + 3, "_top", "_piece"), "_top int, _piece int, _upto array<long>")
    second = _dealt(first, deal, ["_top", "_piece"], seed + 4, "_cell")
    order = Window.partitionBy("_top", "_cell").orderBy(F.xxhash64("_place", F.lit(seed + 5)), "_place")
    before = F.expr("_base + _cell * (_size div _cells) + least(_cell, _size % _cells)")
    return second.withColumn("slot", (before + F.row_number().over(order) - 1).cast("long")).select("_row.*", "shard", "slot")
