"""Document fingerprints by content-defined chunking with a normalised gear hash."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, parts, small_batches

_GEAR = np.random.default_rng(424242).integers(0, 1 << 32, 256, dtype=np.uint32)
_PAIR = np.dtype([("digest", "<u8"), ("length", "<u4")])


class Chunker:
    """Boundaries where a gear hash of the last 32 bytes has zero top bits.

    Normalised: below ``normal`` bytes two bits more must be zero, beyond it
    two bits fewer, so sizes gather around ``normal``; no cut before ``least``,
    a forced one at ``most``.  A boundary depends on the bytes around it only,
    so chunks away from an edit stay as they are.
    """

    def __init__(self, least: int = 16, normal: int = 48, most: int = 256):
        self.least, self.normal, self.most = least, normal, most
        bits = normal.bit_length() - 1
        self.strict, self.loose = np.uint32(32 - (bits + 2)), np.uint32(32 - max(1, bits - 2))

    def cuts(self, data: np.ndarray) -> list[int]:
        """Ends of the chunks of one text."""
        n = len(data)
        if not n:
            return []
        h = _GEAR[data]
        width = 1
        while width < 32 and width < n:
            h[width:] += h[:-width] << np.uint32(width)  # the right side is a copy: sums of 2 * width terms
            width *= 2
        weak = np.flatnonzero((h >> self.loose) == 0)
        tight = (h[weak] >> self.strict) == 0
        least, normal, most = self.least, self.normal, self.most
        out, at = [], 0
        for p, strong in zip((weak + 1).tolist(), tight.tolist()):
            while p - at > most:
                at += most
                out.append(at)
            if p - at >= normal or (strong and p - at >= least):
                at = p
                out.append(at)
        while n - at > most:
            at += most
            out.append(at)
        if at < n:
            out.append(n)
        return out

    def chunks(self, raw: bytes) -> np.ndarray:
        """Distinct (digest, length) pairs of the chunks, sorted by digest."""
        data = np.frombuffer(raw, np.uint8)
        end = np.array(self.cuts(data), np.int64)
        out = np.zeros(len(end), _PAIR)
        if len(end):
            start = np.concatenate([[0], end[:-1]])
            digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist())])
            out["digest"] = np.frombuffer(digests, "<u8")
            out["length"] = end - start
            _, first = np.unique(out["digest"], return_index=True)
            out = out[first]
        return out


def encode(pairs: np.ndarray) -> str:
    return base64.b64encode(pairs.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _PAIR)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment weighted by length: bytes of the shared chunks over the bytes of the smaller set.

    A text inside a longer one scores near 1.  Two empty sets are alike (1), an
    empty and another one are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = a["length"][np.isin(a["digest"], b["digest"], assume_unique=True)].sum()
    return float(shared) / float(min(a["length"].sum(), b["length"].sum()))


def _splitters(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ids that deal the rows into ranges of about equal count."""
    if n < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0]
    return sorted(set(found or []))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ghost, doc_id, text) so that each bucket, sorted by doc_id descending, ends with its successor.

    Buckets are ranges of doc_id between sampled splitters.  The first row of
    each bucket is sent to the bucket before it as a ghost, so neighbours meet
    without a global sort in one task.  The first row of all follows the last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = _splitters(docs, 2 * parts(docs.sparkSession))
    above = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    rows = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(above).cast("int"))
    heads = sorted((r.bucket, r.top) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())  # a row for each bucket
    if not heads:
        return rows.withColumn("ghost", F.lit(False))
    before = [(bucket, top, heads[i - 1][0]) for i, (bucket, top) in enumerate(heads)]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(before, "bucket int, top long, before int")), "bucket")
    ghost = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.col("before"))
    to = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(ghost.alias("b"), F.lit(True).alias("g")))
    sent = rows.select("doc_id", "text", F.explode(F.filter(to, lambda x: x["b"].isNotNull())).alias("t"))
    return sent.select("doc_id", "text", F.col("t.b").alias("bucket"), F.col("t.g").alias("ghost"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprint_edits(docs: DataFrame, least: int = 16, normal: int = 48, most: int = 256) -> DataFrame:
    """Fingerprints of every text of docs(doc_id, text) and of its edited text, with likenesses.

    Documents stand in descending doc_id (equal ids by text, null ids last);
    after the last comes the first again, and a lone document follows itself.
    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document.  Null texts are empty: they
    have the empty fingerprint.  No rows: none.
    """

    def run(batches):
        chunker = Chunker(least, normal, most)
        held: tuple | None = None  # bucket, doc_id, text, pairs
        rows: list[tuple] = []
        ended = None  # bucket of which the ghost has been used
        size = 0

        def close(text, pairs):
            n = len(held[2])
            k = n // 3
            edited = held[2][: n - k] + text[:k]
            other = chunker.chunks(edited.encode()) if edited != held[2] else held[3]
            rows.append((held[1], n, hashlib.sha256(edited.encode()).hexdigest(), encode(held[3]), encode(other), likeness(held[3], other), likeness(held[3], pairs)))
            return 2 * n

        for batch in batches:
            for bucket, ghost, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text"))):
                if bucket == ended:
                    continue  # further rows of the successor's id
                pairs = chunker.chunks(text.encode()) if held is None or text != held[2] else held[3]
                if held is not None:
                    size += close(text, pairs)
                held = None if ghost else (bucket, doc, text, pairs)
                ended = bucket if ghost else None
                if size > 4 << 20:
                    yield arrow_batch(_OUT, [list(c) for c in zip(*rows)])
                    rows, size = [], 0
        if rows:
            yield arrow_batch(_OUT, [list(c) for c in zip(*rows)])

    small_batches(docs.sparkSession)
    rows = with_next(docs).repartition(parts(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "text")
    return rows.select("bucket", "ghost", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
