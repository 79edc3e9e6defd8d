"""Sequence packing along a space-filling curve.

Documents are tokenised once.  Their token counts are projected to a few
dimensions by hashed signs, and the place on a Hilbert curve through that space
is the sort key.  A hash of the doc_id stands behind it, so that a large group
of like texts spreads over many ranges.  Then the documents of a range of keys are laid end to end and cut
every 1,024 tokens.  Neighbours on the curve share vocabulary, so a sequence
holds related documents.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, chunks, mix, parts, small_batches

DIMENSIONS, BITS = 3, 10
_BLANKS = re.compile(r"\s{2000}")
# Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: visible bytes are themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(other)): b for b in range(256)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by id, if the vocabulary is plain byte-level BPE of which the ids follow the merges."""
    model, first = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and spec["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
    if not plain or model.get("ignore_merges") or model.get("dropout"):
        return None
    vocab, pairs = model["vocab"], (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    byte, added = _byte_of_char(), {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}


def _added(spec: dict) -> dict[str, int] | None:
    """Ids of the added tokens, if each is found in a text as it stands and no other begins or ends inside it."""
    tokens = spec["added_tokens"]
    names = [t["content"] for t in tokens]
    odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens)
    crossed = any(a is not b and any(a.endswith(b[:k]) or b in a for k in range(1, len(b) + 1)) for a in names for b in names)
    return None if odd or crossed else {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Token ids of whole texts under a vocabulary file of the tokenizers library.

    They are the library's own with ``add_special_tokens=False``: a string of a
    special token inside a text becomes that token.  A plain byte-level
    vocabulary is encoded by tiktoken from the same ranks, which gives the same
    ids in a fifth of the time; other vocabularies, and texts that its pattern
    engine gives up on (very long runs of blanks), by the tokenizers library.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = [*spec["model"].get("vocab", {}).values()] if isinstance(spec["model"].get("vocab"), dict) else range(len(spec["model"].get("vocab", ())))
        last = max([0, *ids, *(t["id"] for t in spec["added_tokens"])])
        #: Stored width of an id: 16 bits where every id of the vocabulary fits, else 32.
        self.dtype = np.dtype("<u2" if last < 1 << 16 else "<u4")
        ranks, added = _ranks(spec), _added(spec)
        self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added) if ranks and added is not None else None

    @functools.cached_property
    def slow(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Little-endian ids of ``dtype``."""
        if self.fast and not _BLANKS.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(self.dtype).tobytes()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points [point, dimension] of ``bits`` bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of Gray code and rotation, from the top bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keys(ids: np.ndarray, offsets: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by slices (none empty) of a token array."""
    sums = np.stack([np.add.reduceat(s[ids & 0xFFFF], offsets[:-1]) for s in signs], axis=1)
    # by the norm of the token counts: a text's place does not depend on its length
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair, n = np.unique((owner << 32) | ids, return_counts=True)
    norm = np.sqrt(np.bincount(pair >> 32, weights=n.astype(np.float64) ** 2))[:, None]
    z = sums / norm / 4
    cells = np.clip((z + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


_TOKENS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])


def _spread(key: np.ndarray, doc_id: pa.Array) -> np.ndarray:
    """Sort keys: the place on the curve above 32 bits of a hash of the doc_id."""
    ids = doc_id.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    return (key << 32) | (mix(ids + np.uint64(1)) >> np.uint64(32)).astype(np.int64)


def _tokenise(path: str, cuts: list[int], end: int = 0):
    def run(batches):
        encode, kind = encoder(path).encode, encoder(path).dtype
        signs = np.random.default_rng(99).choice(np.array([-1.0, 1.0], np.float32), (DIMENSIONS, 1 << 16))
        for batch in chunks(batches, "text"):
            ids = [encode(t or "") + end.to_bytes(kind.itemsize, "little") for t in batch.column("text").to_pylist()]
            flat = np.frombuffer(b"".join(ids), kind).astype(np.int64)
            key = _spread(_keys(flat, np.cumsum([0, *(len(x) // kind.itemsize for x in ids)]), signs), batch.column("doc_id"))
            bucket = np.searchsorted(np.array(cuts, np.int64), key, side="right")
            yield arrow_batch(_TOKENS, [batch.column("doc_id"), key, bucket.astype(np.int32), ids])

    return run


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, sample_rows: int = 4096) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all rows.

    Every text is tokenised as a whole and ended by id 0; ids holds the piece's
    token ids, of 16 bits where the vocabulary's ids all fit, else of 32.
    Sequences are full but for the last of each task.  Range splitters come
    from about ``sample_rows`` rows, drawn as rows whatever their ids; all rows
    are packed.
    Null or empty texts are the end token alone.  Equal rows are packed
    separately, ties on the curve are broken by a hash of doc_id, doc_id and ids.
    No rows: none; other columns are not read.
    """
    small_batches(docs.sparkSession)
    n = parts(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.select("doc_id").count()
    sample = (docs.sample(sample_rows / rows, seed=5) if rows > sample_rows else docs).mapInArrow(_tokenise(tokenizer_path, []), "doc_id long, key long, bucket int, ids binary")
    found = sample.agg(F.percentile_approx("key", [i / (2 * n) for i in range(1, 2 * n)], 10_000)).first()[0]
    cuts = sorted(set(found or []))
    tokens = docs.mapInArrow(_tokenise(tokenizer_path, cuts), "doc_id long, key long, bucket int, ids binary")
    sorted_ = tokens.repartition(n, "bucket").sortWithinPartitions("bucket", "key", "doc_id", "ids")

    def run(batches):
        from pyspark import TaskContext

        kind = encoder(tokenizer_path).dtype
        wide = kind.itemsize
        sequence = TaskContext.get().partitionId() << 40
        offset, rows, held = 0, [], 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                at, total = 0, len(ids) // wide
                while at < total:
                    if offset == length:
                        sequence, offset = sequence + 1, 0
                    k = min(length - offset, total - at)
                    piece = ids[wide * at : wide * (at + k)]
                    crc = zlib.crc32(np.frombuffer(piece, kind).astype("<u4").tobytes())
                    rows.append((doc, at, k, crc, total, sequence, offset, piece))
                    at, offset, held = at + k, offset + k, held + k
                if held > 1 << 20:
                    yield arrow_batch(_PIECES, [list(c) for c in zip(*rows)])
                    rows, held = [], 0
        if rows:
            yield arrow_batch(_PIECES, [list(c) for c in zip(*rows)])

    return sorted_.select("doc_id", "ids").mapInArrow(run, _PIECES_DDL)
