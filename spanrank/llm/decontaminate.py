"""Benchmark decontamination with a generalised suffix automaton over item words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, flat, hidden, small_batches

# Word bytes stay (A-Z folded), every other byte is a blank; bytes above 7F are word bytes.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after folding A-Z."""
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """All substrings of the items' word sequences, and the windows among them.

    A window is ``width`` consecutive words of an item, or a whole item of
    fewer words.  Feeding words yields the longest match that ends at each
    word; the windows that end there are the suffixes of that match.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int):
        self.width = width
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.prefixes: list[list] = [[]]  # items of which a prefix ends in the state
        self.short: list[list] = [[]]  # (length, item) of whole short items in the state
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            at = 0
            for c in ids:
                at = self._extend(at, c)
                self.prefixes[at].append(item)
            if 0 < len(ids) < width:
                self.short[at].append((len(ids), item))
        self._finish()

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.prefixes.append([])
        self.short.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings up to len(p) + 1; transitions into q from p upwards move there."""
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        moved = [x for x in self.short[q] if x[0] <= self.len[copy]]
        self.short[copy] += moved
        self.short[q] = [x for x in self.short[q] if x[0] > self.len[copy]]
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def _finish(self) -> None:
        below: list[list[int]] = [[] for _ in self.len]
        for s in range(1, len(self.len)):
            below[self.link[s]].append(s)
        # a walk of the link tree: the items that hold a state's strings are one stretch of the walk's prefixes
        self.walk: list = []
        self.stretch: list[tuple[int, int]] = [(0, 0)] * len(self.len)
        begun, todo = [0] * len(self.len), [0]
        while todo:
            s = todo.pop()
            if s < 0:
                self.stretch[~s] = (begun[~s], len(self.walk))
                continue
            begun[s] = len(self.walk)
            self.walk += self.prefixes[s]
            todo.append(~s)
            todo += below[s]
        del self.prefixes
        self.hold = [0] * len(self.len)  # the state of the last ``width`` words of a longer match
        self.ends: list[tuple] = [()] * len(self.len)  # short items that end a match in the state
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[s]
            self.hold[s] = s if self.len[up] < self.width <= self.len[s] else self.hold[up]
            self.ends[s] = self.ends[up] + tuple(self.short[s])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs (start, end) of words inside windows, and the items of these windows."""
        ids = map(self.vocab.get, words)
        nxt, link, size, width = self.next, self.link, self.len, self.width
        hold, ends = self.hold, self.ends
        state = length = 0
        runs: list[list[int]] = []
        items: set = set()
        held: set = set()  # states of windows that occur
        for i, c in enumerate(ids, 1):
            if c is None:
                state = length = 0
                continue
            to = nxt[state].get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(c)
                length = size[state]
                if to is None:
                    state = length = 0
                    continue
            state = to
            length += 1
            covered = 0
            if length >= width:
                covered = width
                held.add(hold[state])
            if ends[state]:
                for n, item in ends[state]:
                    if n <= length:
                        covered = max(covered, n)
                        items.add(item)
            if covered:
                a = i - covered
                while runs and runs[-1][0] >= a:
                    runs.pop()
                if runs and runs[-1][1] >= a:
                    runs[-1][1] = i
                else:
                    runs.append([a, i])
        for s in held:
            items.update(self.walk[slice(*self.stretch[s])])
        return [(a, b) for a, b in runs], items


def item_blocks(items: DataFrame, max_words: int):
    """(item_id, words) in blocks of at most ``max_words`` words, but an item at least; made one at a time from rows that arrive one at a time."""
    block, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        words = words_of((row.text or "").encode())
        if block and held + len(words) > max_words:
            yield block
            block, held = [], 0
        if words:
            block.append((row.item_id, words))
            held += len(words)
    yield block


_built: list = [None, None]


def _automaton(block, width: int) -> SuffixAutomaton:
    """The automaton of a broadcast block; a worker process builds it once for all its tasks and keeps one."""
    if _built[0] != (block, width):
        _built[:] = [None, None]
        _built[:] = [(block, width), SuffixAutomaton(block.value, width)]
    return _built[1]


_SCHEMA = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of word spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan_block(names: list[str], block, width: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        automaton = _automaton(block, width)
        for batch in chunks(batches, "text", 1 << 20):
            raw, off = flat(batch.column("text"))
            raw = raw.tobytes()
            n, hits, items = [], [], []
            before = zip(batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()) if "_hits" in names else None
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                words = words_of(raw[a:b])
                runs, which = automaton.scan(words)
                if before:
                    spans_, items_ = next(before)
                    runs, which = _merged([*runs, *((x["start"], x["end"]) for x in spans_)]), which.union(items_)
                n.append(len(words))
                hits.append([{"start": x, "end": y} for x, y in runs])
                items.append(sorted(which))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hits", "items"])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, max_words: int = 1_000_000) -> DataFrame:
    """Rows of docs with n_words, hits (word spans inside windows, end exclusive) and items (ids).

    Automata are made of item blocks of at most ``max_words`` words, so what the
    driver holds and broadcasts at once has a fixed bound (about 1 KB a word).
    A further block scans the rows again from a written table and adds its hits
    to those of the blocks before, without a shuffle; its table goes before the
    next is written.  items are ids as strings, in their order.  Null, empty or
    wordless texts have no words and no hits; an empty benchmark hits nothing;
    items without words and null item ids are ignored.  Columns of docs named
    n_words, hits or items are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_words", "hits", "items")
    names = docs.columns
    extra = T._parse_datatype_string(_SCHEMA).fields
    scratch = Scratch(spark, "decontaminate")
    out = box = saved = None
    for block in item_blocks(items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text"), max_words):
        source = docs
        if out is not None:
            before, saved = saved, scratch.save(out)
            scratch.drop(before)
            box.destroy()
            source = saved.withColumnsRenamed({"n_words": "_n", "hits": "_hits", "items": "_items"})
        box = spark.sparkContext.broadcast(block)
        keep = source.schema.fields
        found = source.mapInArrow(_scan_block([f.name for f in keep], box, width), T.StructType([*keep, *extra]))
        out = found.select(*names, "n_words", "hits", "items")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, max_words: int = 1_000_000, max_coverage: float = 0.5) -> DataFrame:
    """docs without contaminated passages: same columns, passages cut from the texts.

    A passage is a run of words inside windows of ``width`` words.  Each is
    removed with what stands between its words; documents of which passages
    hold more than ``max_coverage`` of the words are dropped as a whole.
    Other documents keep text and row as they are.  n_chars, if there,
    follows the new text.  Nulls stay null.
    """
    docs, named = hidden(docs, "text", "n_chars")
    names = docs.columns
    found = find_contamination(docs, items, width, max_words)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    found = found.where(hit <= F.lit(max_coverage) * F.col("n_words"))
    fields = docs.schema.fields

    def run(batches):
        for batch in chunks(batches, "text", 1 << 20):
            hits = batch.column("hits").to_pylist()
            text = batch.column("text")
            columns = {n: batch.column(n) for n in names}
            if any(hits):
                columns["text"] = pa.array([_cut(t, h) if h else t for t, h in zip(text.to_pylist(), hits)], text.type)
                if "n_chars" in columns:
                    n = [len(t) if h else c for t, h, c in zip(columns["text"].to_pylist(), hits, columns["n_chars"].to_pylist())]
                    columns["n_chars"] = pa.array(n, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return named(found.select(*names, "hits").mapInArrow(run, T.StructType(fields)))


def _cut(text: str, hits: list[dict]) -> str:
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    at, left = 0, []
    for h in hits:
        left.append(raw[at : spans[h["start"]][0]])
        at = spans[h["end"] - 1][1]
    return b"".join([*left, raw[at:]]).decode()
