"""Shared pieces of the training-data operators: scratch tables, Arrow text access, hashing."""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, checkpoint_root, delete_path

__all__ = ["Scratch", "checkpoint_root", "delete_path"]

# Chunk of UTF-8 text handled at once by a Python task; bounds its memory.
CHUNK_BYTES = 1 << 18

def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the len+1 offsets into them (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: workers wait for their next task with little of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, of which several are in memory at once on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of the batches that hold about ``limit`` bytes of ``column``, a row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = flat(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
    release()


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, of which ``key`` is unique; counts(key, n) are the rows of left (``total`` in all) of a key.

    A key that has over a thousandth of left's rows would fill one task.  There
    are fewer than a thousand such keys whatever the input, so their rows of
    right are broadcast; the others meet in a plain join.
    """
    hot = counts.where(F.col("n") > max(1000, total // 1000)).select(key)
    one = left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key)
    if how == "left":
        one = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return one.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


class Poly:
    """Polynomial hashes modulo 2**64 of any slices of a byte array, through prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def hidden(docs: DataFrame, *known: str):
    """docs under neutral column names, but for the ``known``, and a function that gives a result its names back.

    Operators that add working columns can then meet any names in their input.
    """
    names = docs.columns
    inner = docs.toDF(*[n if n in known else f"_c{i}" for i, n in enumerate(names)])
    return inner, lambda out: out.select(*inner.columns).toDF(*names)


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
