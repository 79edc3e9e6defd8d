"""Personal data by bootstrapped contextual extraction.

Base matchers give seed entities, and long strings of mixed letters and digits
are seeds of a fifth kind, ``secret`` (keys, tokens, passwords).  What stands
around an entity gives its lexical patterns: whole words before and after it,
exact or generalised to their shape.  Strings that look like an identifier but
are no seed are unseen instances.  Over the pattern-instance graph Spark scores
patterns by the belief in their instances and instances by their patterns until
no further pattern is promoted; promoted patterns mark the unseen instances
that they stand around.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, hidden, small_batches, spread_join

#: The kinds of the base matchers, and the one that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Patterns that are broadcast at most; a longer list is joined.
LISTED = 100_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: a failing start fails for all of its digit run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9][0-9\x20().-]{5,}[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+")
_MIXED = re.compile(r"[A-Za-z0-9]{8,}")
_TURN = re.compile(r"[0-9][A-Za-z]|[A-Za-z](?=[0-9])")
_WORD = re.compile(r"\S+")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches, in time linear in the text: each ``@`` is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all base matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _secrets(text: str):
    """(start, end, whether a seed) of runs of 8 or more ASCII letters and digits, some of both, that no other letter or digit touches.

    A seed has 16 characters or more and changes between letters and digits three times or more.
    """
    for m in _MIXED.finditer(text):
        a, b = m.span()
        turns = sum(1 for _ in _TURN.finditer(m[0]))
        if turns and not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum():
            yield a, b, b - a >= 16 and turns >= 3


def _free_of(spans: list[tuple[int, int, int]]):
    """Whether a stretch overlaps none of the sorted spans."""
    starts, reach = [x[0] for x in spans], []
    for _, _, e in spans:
        reach.append(max(e, reach[-1] if reach else 0))

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1)
        return not i or reach[i - 1] <= a

    return free


def look(text: str) -> tuple[list, list, list]:
    """Spans (start, kind index, end) of a text: base matches, further seeds, and unseen strings shaped like identifiers.

    Further seeds and unseen strings overlap no base match, and unseen strings no further seed.
    """
    base = base_spans(text)
    if "@" not in text and not _DIGIT.search(text):
        return base, [], []
    free = _free_of(base)
    mixed = [x for x in _secrets(text) if free(*x[:2])]
    more = [(a, 4, b) for a, b, sure in mixed if sure]
    unseen = [(a, 4, b) for a, b, sure in mixed if not sure]
    free = _free_of(sorted(base + more))
    at = text.find("@")
    while at >= 0:
        a = at
        if m := _HOST.match(text, at + 1):
            while a and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and free(a, m.end()):
                unseen.append((a, 0, m.end()))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        n = sum(map(str.isdigit, m[0]))
        if 7 <= n <= 19 and free(a, b) and not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum():
            unseen.append((a, 1 if m[0].count(".") == 3 and not re.search(r"[^0-9.]", m[0]) else 2 if n >= 12 else 3, b))
    return base, more, sorted(unseen)


def _name(word: str) -> str:
    """A word of a pattern: lower-cased, a very long one by its digest."""
    return word.lower() if len(word) <= 40 else "#" + hashlib.blake2b(word.lower().encode(), digest_size=8).hexdigest()


def _shape(word: str) -> str:
    return _name(_DIGITS.sub("9", _LETTERS.sub("w", word)))


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[list[str]]:
    """Lexical patterns around each span, from the words between blanks, taken whole.

    The part of the span's own word before it counts as a word.  Patterns are
    its two words before, its word before, the words on both sides, its three
    words before if the nearest is such a part (as in ``key = "``), and the
    shape of its two words before.  ``^`` and ``$`` stand for the text's ends.
    """
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    first = [a for a, _ in words]
    out = []
    for a, kind, b in spans:
        i, j = bisect_right(first, a) - 1, bisect_right(first, b - 1) - 1
        own, left = text[words[i][0] : a], []
        left = [own] if own else []
        left += [text[x:y] for x, y in reversed(words[max(0, i - 3) : i])]
        left += ["^"] * (3 - len(left))
        after = text[b : words[j][1]]
        right = after or (text[slice(*words[j + 1])] if j + 1 < len(words) else "$")
        l1, l2, l3 = map(_name, left[:3])
        k = KINDS[kind]
        mine = [f"{k}|{l2} {l1}|", f"{k}|{l1}|", f"{k}|{l1}|{_name(right)}", f"{k}~{_shape(left[1])} {_shape(left[0])}~"]
        out.append([*mine, f"{k}|{l3} {l2} {l1}|"] if own else mine)
    return out


def edges(docs: DataFrame) -> DataFrame:
    """(pattern, instance, seed) of every context of every seed and unseen instance, repeated as they occur."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("pattern", pa.string()), ("instance", pa.int64()), ("seed", pa.bool_())])

    def run(batches):
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                base, more, unseen = look(text)
                spans = [*base, *more, *unseen]
                sure = len(base) + len(more)
                for i, ((a, kind, b), patterns) in enumerate(zip(spans, contexts(text, spans))):
                    name = int.from_bytes(hashlib.blake2b(f"{kind}{text[a:b]}".encode(), digest_size=8).digest(), "little", signed=True)
                    rows += [(p, name, i < sure) for p in patterns]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern string, instance long, seed boolean")


def learn_patterns(docs: DataFrame, threshold: float = 0.8, support: int = 5, listed: int = LISTED) -> list[str] | DataFrame:
    """Patterns of confidence ``threshold`` or more over all rows of which ``support`` instances are believed.

    A seed is believed with 1, an unseen instance with the greatest confidence
    of the promoted patterns around it, else 0.  A pattern's confidence is the
    mean belief over its distinct instances; it is promoted when that reaches
    ``threshold`` and the sum reaches ``support``.  Beliefs only grow, so rounds
    go on until none is promoted any more.  Neither bound depends on the size
    of the table.  Up to ``listed`` patterns are collected; more of them stay a
    table (pattern) in the scratch folder, so what reaches the driver has a
    bound and no pattern is lost to it.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    graph = scratch.save(edges(docs).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    degree = scratch.save(graph.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("s"), F.sum((~F.col("seed")).cast("long")).alias("u")).where(F.col("n") >= support))
    open_ = graph.where("NOT seed")
    of_pattern, of_instance = degree.select("pattern", F.col("u").alias("n")), scratch.save(open_.groupBy("instance").agg(F.count("*").alias("n")))
    total = open_.count()
    promoted = scratch.save(degree.where((F.col("s") >= support) & (F.col("s") >= threshold * F.col("n"))).select("pattern", (F.col("s") / F.col("n")).alias("conf")))
    n = promoted.count()
    while n:
        belief = scratch.save(spread_join(open_, promoted, "pattern", of_pattern, total).groupBy("instance").agg(F.max("conf").alias("belief")))
        gained = spread_join(open_.select("pattern", "instance"), belief, "instance", of_instance, total).groupBy("pattern").agg(F.sum("belief").alias("more"))
        held = F.col("s") + F.coalesce("more", F.lit(0.0))
        now = degree.join(gained, "pattern", "left").where((held >= support) & (held >= threshold * F.col("n"))).select("pattern", (held / F.col("n")).alias("conf"))
        now = scratch.save(now)
        scratch.drop(promoted, belief)
        promoted, before, n = now, n, now.count()
        if n == before:
            break
    if n > listed:
        return promoted.select("pattern")
    found = sorted(r.pattern for r in promoted.select("pattern").collect())
    scratch.drop(graph, degree, of_instance, promoted)
    return found


def _told_by_table(docs: DataFrame, patterns: DataFrame, key: str, more: str) -> DataFrame:
    """docs with ``more``: the unseen spans, as (start, kind index, end), that the table of patterns marks.

    Spans depend on the text alone, so a digest of it is the key and equal
    texts are looked up once.  Texts without a digit or ``@`` have no
    candidates and aren't dealt anew.
    """
    schema = pa.schema([("key", pa.string()), ("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64()), ("pattern", pa.string())])

    def run(batches):
        for batch in chunks(batches, "text"):
            rows = []
            for name, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                unseen = look(text)[2]
                rows += [(name, *span, p) for span, patterns in zip(unseen, contexts(text, unseen)) for p in patterns]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    text = F.col("text").cast("string")
    able = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    asked = docs.where(able).select(F.sha2(text, 256).alias("key"), text.alias("text"))
    asked = asked.mapInArrow(run, "key string, start long, kind long, end long, pattern string").distinct()
    told = asked.join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    told = told.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("start", "kind", "end")).alias(more))
    told = Scratch(docs.sparkSession, "pii").save(told)
    found = docs.where(able).withColumn(key, F.sha2(text, 256)).join(told, key, "left").select(*docs.columns, more)
    return found.unionByName(docs.where(~able).withColumn(more, F.lit(None).cast(told.schema[more].dataType)))


def find_spans(docs: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """docs with base_spans and spans: arrays of (start, kind, end) in code points, by start, then kind.

    base_spans holds what the base matchers find; spans adds the further seeds
    and what the patterns, a list or a table (pattern), mark.  Null or empty
    texts have none.  Columns of these names are replaced; others pass through.
    """
    docs = docs.drop("base_spans", "spans")
    fields = docs.schema.fields
    docs = hidden(docs, "text")[0]
    names = docs.columns
    small_batches(docs.sparkSession)
    joined = isinstance(patterns, DataFrame)
    box = docs.sparkSession.sparkContext.broadcast(frozenset(() if joined else patterns))
    if joined:
        docs = _told_by_table(docs, patterns, "_key", "_more")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def listed(spans):
        return [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]

    def run(batches):
        known = box.value
        for batch in chunks(batches, "text"):
            base_column, all_column = [], []
            told = batch.column("_more").to_pylist() if joined else None
            for i, text in enumerate(batch.column("text").to_pylist()):
                base, more, unseen = look(text) if text else ([], [], [])
                if joined:
                    more = more + [(s["start"], s["kind"], s["end"]) for s in told[i] or []]
                elif known:
                    more = more + [x for x, patterns in zip(unseen, contexts(text, unseen)) if not known.isdisjoint(patterns)]
                base_column.append(listed(base))
                all_column.append(listed(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(base_column, kind), pa.array(all_column, kind)], names=[*names, "base_spans", "spans"])

    span = T._parse_datatype_string("array<struct<start:long,kind:string,end:long>>")
    more = [T.StructField("base_spans", span), T.StructField("spans", span)]
    found = docs.mapInArrow(run, T.StructType([*(T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, fields)), *more]))
    return found.toDF(*[f.name for f in fields], "base_spans", "spans")


def redact(docs: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind, such as ``[EMAIL]``.

    Overlapping spans become one, of the kind of the first.  n_chars, if
    there, follows the new text; texts without spans stay as they are.
    """
    docs, named = hidden(docs, "text", "n_chars")
    found = find_spans(docs, patterns).drop("base_spans")
    names, fields = docs.columns, docs.schema.fields

    def run(batches):
        for batch in chunks(batches, "text"):
            spans = batch.column("spans").to_pylist()
            columns = {n: batch.column(n) for n in names}
            if any(spans):
                texts = [_replace(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans)]
                columns["text"] = pa.array(texts, batch.column("text").type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return named(found.select(*names, "spans").mapInArrow(run, T.StructType(fields)))


def _replace(text: str, spans: list[dict]) -> str:
    at, left = 0, []
    for s in spans:
        if s["start"] >= at:
            left += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*left, text[at:]])
