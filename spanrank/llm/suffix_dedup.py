"""Exact removal of repeated byte strings through a sparse suffix array.

A full suffix array of the corpus needs over 16 bytes of shuffle for each byte
of text.  Here a suffix is kept only at anchors: of the ``length // 2``-byte
grams inside a window of ``length`` bytes the one with the least hash is the
window's anchor.  Equal windows have equal anchors at equal places, so every
repeated window is found by comparing what stands around anchors of equal
grams.  About one byte in fifty is an anchor.  Hashes choose anchors and leave
out those whose gram occurs once; every repeat is decided by its bytes.

1. One pass over the texts finds the anchors and the run of windows that each
   stands for (its domain).  Of the records of a gram that meet in several MB
   of text one goes on to its bucket, so a hot gram reaches it once a flush.
2. Buckets of gram hashes leave out what occurs once and ask for the others.
3. The domains asked for are fetched from the texts, range-partitioned by
   sampled splitters on the gram that leads their suffix, and sorted.  Equal
   grams never straddle two buckets.  In a bucket neighbours with equal domains
   are settled as a whole; the windows of the others are suffixes that
   multikey quicksort puts in order, and equal neighbours are repeats.
4. The domains of a hot gram are first collapsed by a distributed count of
   their bytes.  What is left is dealt by longer leads: the windows that start
   between a and b bytes before the gram share length - b + a bytes, which are
   their lead.  Leads that are still hot are halved to narrower ranges of
   starts, with the bytes that these windows cover.  Halves of equal bytes
   collapse again, so of a domain only what differs from the others is halved
   on: some rows for each halving, not one for each start.  A range of one
   start leads with the whole window.
5. The windows that repeat are joined to the texts and their bytes removed.
   Texts that occur twice are known by a 128-bit digest and go as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Poly, Scratch, arrow_batch, chunks, flat, parts, small_batches, spread_join

_MASK = np.uint64((1 << 22) - 1)
_ONE = Poly(11)
_RECORD = np.dtype([("gram", "<u8"), ("k1", "<u8"), ("k2", "<u8"), ("at", "<i8"), ("n", "<u2"), ("o", "<u2"), ("twice", "?")])
_FLUSH = 8 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, bits: int = 64) -> np.ndarray:
    """Records of all anchors; k1 is the index of the document and at the start of its first window there."""
    gram = length // 2
    if len(data) < length:
        return np.zeros(0, _RECORD)
    prefix = _ONE.prefix(data)
    start = np.arange(len(data) - gram + 1)
    hashes = _ONE.of(prefix, start, start + gram)
    least = _sliding_min((hashes & ~_MASK) | start.astype(np.uint64), length - gram + 1)
    doc_len = np.diff(offsets)
    whole = np.flatnonzero(doc_len >= length)
    if not len(whole):
        return np.zeros(0, _RECORD)
    count = doc_len[whole] - length + 1
    windows = np.repeat(offsets[whole] - np.cumsum(count) + count, count) + np.arange(count.sum())
    owner = np.repeat(whole, count)
    anchor = (least[windows] & _MASK).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    lo, p = windows[first], anchor[first]
    out = np.zeros(len(first), _RECORD)
    out["gram"], out["n"], out["o"] = hashes[p] >> np.uint64(64 - bits), np.diff(np.append(first, len(windows))), p - lo
    out["k1"], out["at"] = owner[first], lo - offsets[owner[first]]
    return out


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int, size: int = 1 << 20):
    """(data, offsets, document of each piece, its start there); long texts come in overlapping pieces."""
    if len(raw) <= 3 * size:
        yield raw, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        return
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(0, max(1, b - a - length + 1), size):
            piece = raw[a + at : min(b, a + at + size + length - 1)]
            yield piece, np.array([0, len(piece)]), np.array([i]), np.array([at])


def _sorted(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records by gram without repeats of one place, the first of each gram, and whether the gram has several places."""
    r = np.concatenate(pieces)
    r = r[np.lexsort((r["at"], r["k2"], r["k1"], r["gram"]))]
    same = np.ones(len(r), bool)
    same[:1] = False
    for name in ("gram", "k1", "k2", "at"):
        same[1:] &= r[name][1:] == r[name][:-1]
    twice = np.logical_or.reduceat(r["twice"], np.flatnonzero(~same)) if len(r) else r["twice"]
    r = r[~same]
    r["twice"] = twice
    first = np.flatnonzero(np.append(True, r["gram"][1:] != r["gram"][:-1])[: len(r)])
    n = np.diff(np.append(first, len(r)))
    several = (n > 1) | (np.logical_or.reduceat(r["twice"], first) if len(r) else n > 1)
    return r, first, several


_BLOB = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])


def _emit_anchors(length: int, buckets: int, bits: int):
    def packed(pieces: list[np.ndarray]):
        r, first, several = _sorted(pieces)
        sent = r[first]
        sent["twice"] = several
        known = np.repeat(several, np.diff(np.append(first, len(r))))
        known[first] = False
        where = (sent["gram"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        sent, where = sent[order], where[order]
        cut = np.flatnonzero(np.diff(where, prepend=-1))
        rows = [(int(where[a]), sent[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(sent)))]
        if known.any():
            rows.append((-1 - int(where[0]), r[known].tobytes()))
        return arrow_batch(_BLOB, [[x[0] for x in rows], [x[1] for x in rows]])

    def run(batches):
        pieces, held = [], 0
        for batch in chunks(batches, "text"):
            raw, offsets = flat(batch.column("text"))
            keys = flat(batch.column("key"))[0].view("<u8").reshape(-1, 2)
            for data, at, docs, base in _segments(raw, offsets, length):
                r = anchors(data, at, length, bits)
                at_doc = r["k1"].astype(np.int64)
                r["at"] += base[at_doc]
                r["k1"], r["k2"] = keys[docs[at_doc]].T
                pieces.append(r)
                held += len(data)
            if held >= _FLUSH:
                if sum(map(len, pieces)):
                    yield packed(pieces)
                pieces, held = [], 0
        if sum(map(len, pieces)):
            yield packed(pieces)

    return run


_ASK = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("n", pa.int32()), ("o", pa.int32()), ("gram", pa.int64())])
_ASK_DDL = "key binary, at long, n int, o int, gram long"


def _asked(r: np.ndarray) -> pa.RecordBatch:
    keys = pa.py_buffer(np.stack([r["k1"], r["k2"]], axis=1).tobytes())
    key = pa.Array.from_buffers(pa.binary(16), len(r), [None, keys]).cast(pa.binary())
    return arrow_batch(_ASK, [key, pa.array(r["at"]), pa.array(r["n"].astype(np.int32)), pa.array(r["o"].astype(np.int32)), pa.array(r["gram"].view(np.int64))])


def _judge(batches):
    """The places of grams that occur several times, from blobs sorted by bucket."""

    def bucket_of(pieces):
        r, first, several = _sorted(pieces)
        return _asked(np.ascontiguousarray(r[np.repeat(several, np.diff(np.append(first, len(r))))]))

    now, pieces = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            r = np.frombuffer(blob.as_buffer(), _RECORD).copy()
            if bucket < 0:
                yield _asked(r)
                continue
            if bucket != now and pieces:
                yield bucket_of(pieces)
                pieces = []
            now = bucket
            pieces.append(r)
    if pieces:
        yield bucket_of(pieces)


_DOMAIN = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("o", pa.int32()), ("hot", pa.bool_()), ("string", pa.binary())])
_DOMAIN_DDL = "key binary, at long, o int, hot boolean, string binary"


def _fetch(length: int):
    """Domain rows for the places asked for, from rows sorted so that a text comes before its places."""

    def run(batches):
        now = raw = last = None
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            held = 0
            columns = [batch.column(c).to_pylist() for c in ("key", "text", "at", "n", "o", "hot")]
            for key, text, at, n, o, hot in zip(*columns):
                if text is not None:
                    now, raw, last = key, text, None
                elif key == now and at != last:
                    last = at
                    out.append((key, at, o, hot, raw[at : at + n - 1 + length]))
                    held += n + length
                if held > 1 << 20:
                    yield arrow_batch(_DOMAIN, [list(c) for c in zip(*out)])
                    out, held = [], 0
            if out:
                yield arrow_batch(_DOMAIN, [list(c) for c in zip(*out)])

    return run


def multikey_quicksort(rows: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of the rows of a byte matrix of a multiple of eight columns.

    Three-way partition by a word of eight bytes, equal rows by the next; small parts by plain comparison.
    """
    rows = np.ascontiguousarray(rows)
    words, strings = rows.view(">u8"), rows.view(f"S{rows.shape[1]}").reshape(-1)
    order = np.arange(len(rows))
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.argsort(strings[part], kind="stable")]
            continue
        column = words[part, depth]
        sample = column[:: max(1, len(column) // 63)]
        pivot = np.sort(sample)[len(sample) // 2]
        less, same = column < pivot, column == pivot
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[~(less | same)]])
        todo += [(lo, lo + a, depth), (lo + a, lo + a + b, depth + 1), (lo + a + b, hi, depth)]
    return order


_RANGES = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("n", pa.int32())])
_RANGES_DDL = "key binary, at long, n int"


def _settle(rows: list[tuple], length: int) -> list[tuple]:
    """Ranges (key, at, n) of repeated windows among rows (lead, key, at, o, a, b, string) sorted by lead."""
    out, groups, at = [], [], 0
    while at < len(rows):
        to = at + 1
        while to < len(rows) and rows[to][0] == rows[at][0]:
            to += 1
        if to - at > 1:
            run = sorted(rows[at:to], key=lambda r: (r[3], r[6]))
            keep = [run[0]]
            for x, y in zip(run, run[1:]):
                if x[3] == y[3] and x[6] == y[6]:  # neighbours with equal domains: all their windows repeat
                    out += [_range(z, length) for z in (x, y)]
                else:
                    keep.append(y)
            if len(keep) > 1:
                groups += keep
        at = to
    if groups:
        out += _sort_windows(groups, length)
    return out


def _starts(row: tuple, length: int) -> tuple[int, int]:
    """First and last window of a row, as places in its string: those that start between a and b bytes before the gram."""
    _, _, _, o, a, b, string = row
    return max(0, o - b), min(len(string) - length, o - a)


def _range(row: tuple, length: int) -> tuple:
    i, j = _starts(row, length)
    return row[1], row[2] + i, j - i + 1


def _sort_windows(rows: list[tuple], length: int, most: int = 1 << 16) -> list[tuple]:
    """Repeated windows of rows, which hold whole runs of equal leads, by order and equal neighbours."""
    out, at = [], 0
    while at < len(rows):
        size, to = 0, at
        while to < len(rows) and (size < most or rows[to][0] == rows[to - 1][0]):
            i, j = _starts(rows[to], length)
            size += j - i + 1
            to += 1
        some = rows[at:to]
        data = np.frombuffer(b"".join(r[6] for r in some), np.uint8)
        bounds = np.array([_starts(r, length) for r in some])
        n = bounds[:, 1] - bounds[:, 0] + 1
        base = np.cumsum([0, *(len(r[6]) for r in some)])[:-1] + bounds[:, 0]
        row = np.repeat(np.arange(len(some)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = -(-length // 8) * 8
        view = np.zeros((len(row), wide), np.uint8)
        view[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[base[row] + place]
        order = multikey_quicksort(view)
        words = view.view(np.uint64)[order]
        same = (words[1:] == words[:-1]).all(axis=1)
        hit = np.zeros(len(row), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        at_hit = np.flatnonzero(hit)
        if len(at_hit):
            cut = np.append(True, (np.diff(at_hit) > 1) | (np.diff(row[at_hit]) > 0))
            begin = at_hit[cut]
            last = at_hit[np.append(np.flatnonzero(cut)[1:] - 1, len(at_hit) - 1)]
            out += [(some[r][1], some[r][2] + int(bounds[r, 0]) + p, k) for r, p, k in zip(row[begin].tolist(), place[begin].tolist(), (last - begin + 1).tolist())]
        at = to
    return out


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """Repeated windows (key, at, n) among domain rows, range-partitioned and sorted by their lead."""

    def run(batches):
        now, rows, held = None, [], 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("lead", "key", "at", "o", "a", "b", "string"))):
                if x[0] != now and held > 1 << 21:
                    if out := _settle(rows, length):
                        yield arrow_batch(_RANGES, [list(c) for c in zip(*out)])
                    rows, held = [], 0
                now = x[0]
                rows.append(x)
                held += len(x[6])
        if rows and (out := _settle(rows, length)):
            yield arrow_batch(_RANGES, [list(c) for c in zip(*out)])

    dealt = rows.select("lead", "key", "at", "o", "a", "b", "string").repartitionByRange(parts(rows.sparkSession), "lead").sortWithinPartitions("lead")
    return dealt.mapInArrow(run, _RANGES_DDL)


def _collapsed(rows: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One row of each string with its gram at one place, and the windows (key, at, n) of those that occur several times."""
    named = rows.withColumn("name", F.concat("string", F.unhex(F.lpad(F.hex("o"), 4, "0")), F.unhex(F.lpad(F.hex("a"), 4, "0"))))
    counts = scratch.save(named.groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct("key", "at", "o", "string", "a", "b")).alias("r")))
    again = spread_join(named.select("name", "key", "at", "string"), counts.where("n > 1").select("name"), "name", counts, rows.count())
    return counts.select("r.*"), scratch.save(again.select("key", "at", (F.length("string") - length + 1).cast("int").alias("n")))


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Rows (key, at, o, string, a, b) cut into what windows of either half of their starts cover; halves without windows are not made."""
    half = F.expr("cast((a + b) div 2 as int)")
    both = F.array(F.struct(F.col("a").alias("a"), half.alias("b")), F.struct((half + 1).alias("a"), F.col("b").alias("b")))
    there = F.filter(both, lambda t: (t["a"] <= t["b"]) & (t["a"] <= F.col("o")) & (t["b"] >= F.col("o") - (F.length("string") - length)))
    rows = rows.withColumn("_t", F.explode(there)).withColumns({"a": F.col("_t.a"), "b": F.col("_t.b")}).drop("_t")
    first, last = F.expr("greatest(0, o - b)"), F.expr(f"least(length(string) - {length}, o - a)")
    return rows.select("key", (F.col("at") + first).alias("at"), (F.col("o") - first).alias("o"), F.substring("string", first + 1, last - first + length).alias("string"), "a", "b")


def _compare_hot(domains: DataFrame, length: int, hot: int, scratch: Scratch) -> list[DataFrame]:
    """Repeated windows of the domains of hot grams, in tables (key, at, n)."""
    now, again = _collapsed(domains.select("key", "at", "o", "string", F.lit(0).alias("a"), F.lit(length - length // 2).alias("b")), length, scratch)
    out = [again]
    while now.limit(1).count():
        now, again = _collapsed(scratch.save(_halved(now, length)), length, scratch)
        lead = F.concat(F.unhex(F.lpad(F.hex("a"), 4, "0")), F.expr(f"substring(string, o - a + 1, {length} - b + a)"))
        now = scratch.save(now.withColumn("lead", lead))
        many = scratch.save(now.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > hot))
        marked = scratch.save(spread_join(now, many.select("lead", F.lit(True).alias("many")), "lead", many, now.count(), "left"))
        scratch.drop(now)
        out += [again, scratch.save(_compare(marked.where("many IS NULL"), length))]
        now = marked.where("many AND a < b").drop("lead", "many")  # a range of one start leads with its whole string, of which one row is left
    return out


def _cover(at: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the given ranges."""
    order = np.argsort(at)
    start, end = at[order], (at + n - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist()))


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = 256, bits: int = 64) -> DataFrame:
    """Every row of docs with ``kept`` binary and ``spans`` array<struct<start long, end long>>.

    Removed is each byte of the UTF-8 text that a ``length``-byte string covers
    which also starts anywhere else in the table, in the same text included;
    matches never cross texts.  spans are the maximal removed runs, kept the
    other bytes.  Null or empty texts: empty kept, no spans.  Equal rows are
    separate texts, so long ones lose everything.  Texts are told apart by
    128-bit digests, so doc_id is not needed and may be null or repeated.  Other
    columns pass through; columns named kept or spans are replaced.  Grams of
    over ``hot`` places are dealt by longer leads; ``bits`` of a gram's hash
    are used to leave out what occurs once.  Neither changes the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix")
    docs = docs.drop("kept", "spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = text.cast("binary")
    long_ = F.octet_length(text) >= length
    texts = docs.where(long_).select(F.unhex(F.md5(raw)).alias("key"), raw.alias("text"))
    n_rows, total = texts.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    copies = scratch.save(texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = max(2 * parts(spark), (total or 0) // (24 << 20))
    blobs = texts.mapInArrow(_emit_anchors(length, buckets, bits), "bucket long, blob binary")
    found = scratch.save(blobs.repartition(parts(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_judge, _ASK_DDL))

    grams = scratch.save(found.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    asks = spread_join(found, grams.select("gram", F.lit(True).alias("hot")), "gram", grams, found.count(), "left")
    often = copies.where(F.col("n") > max(1000, n_rows // 1000)).select("key")  # under a thousand
    once = texts.join(F.broadcast(often), "key", "left_anti").unionByName(texts.join(F.broadcast(often), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    stream = once.select("key", F.lit(0).alias("kind"), "text", *[F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("n", "int"), ("o", "int"), ("hot", "boolean"))])
    stream = stream.unionByName(asks.select("key", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("text"), "at", "n", "o", F.coalesce("hot", F.lit(False)).alias("hot")))
    domains = scratch.save(stream.repartition(parts(spark), "key").sortWithinPartitions("key", "kind", "at").drop("kind").mapInArrow(_fetch(length), _DOMAIN_DDL))
    gram = length // 2
    cold = domains.where("NOT hot").select("key", "at", "o", "string", F.lit(0).alias("a"), F.lit(length - gram).alias("b"), F.expr(f"substring(string, o + 1, {gram})").alias("lead"))
    ranges = _compare(cold, length)
    for more in _compare_hot(domains.where("hot"), length, hot, scratch):
        ranges = ranges.unionByName(more)
    ranges = ranges.join(copies.select("key"), "key", "left_anti").groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("_ranges"))
    told = scratch.save(ranges.withColumn("_whole", F.lit(False)).unionByName(copies.select("key", F.lit(None).cast(ranges.schema["_ranges"].dataType).alias("_ranges"), F.lit(True).alias("_whole"))).withColumnRenamed("key", "_key"))
    scratch.drop(found, grams, domains)

    fields = docs.schema.fields
    names = [f.name for f in fields]
    short = docs.where(~long_).withColumns({"_ranges": F.lit(None).cast(told.schema["_ranges"].dataType), "_whole": F.lit(False)})
    joined = spread_join(docs.where(long_).withColumn("_key", F.unhex(F.md5(raw))), told, "_key", copies.withColumnRenamed("key", "_key"), n_rows, "left").drop("_key").unionByName(short)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("kept", T.BinaryType()), T.StructField("spans", span)])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in chunks(batches, "text", 1 << 20):
            raw, off = flat(batch.column("text"))
            whole = batch.column("_whole").to_pylist()
            ranges = batch.column("_ranges")
            values, edge = ranges.flatten(), np.cumsum(np.append(0, ranges.value_lengths().fill_null(0).to_numpy()))
            where, count = values.field("at").to_numpy(), values.field("n").to_numpy().astype(np.int64)
            kept, spans = [], []
            for i in range(batch.num_rows):
                text = raw[off[i] : off[i + 1]].tobytes()
                some = slice(edge[i], edge[i + 1])
                runs = [(0, len(text))] if whole[i] else _cover(where[some], count[some], length) if edge[i + 1] > edge[i] else []
                at, left = 0, []
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                kept.append(b"".join([*left, text[at:]]))
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kept, pa.binary()), pa.array(spans, span_type)], names=[*names, "kept", "spans"])

    return joined.select(*[F.col(f"`{n}`") for n in names], "_ranges", "_whole").mapInArrow(cut, schema)
