"""Near-duplicate classes, repeated strings and components against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from spanrank.llm import queries
from spanrank.llm.common import Scratch
from spanrank.llm.components import components
from spanrank.llm.minhash_dedup import _linkable, agreement_bound, near_duplicates
from spanrank.llm.shingles import MinHash
from spanrank.llm.suffix_dedup import _collapsed, _halved, multikey_quicksort, remove_repeats
from tests.conftest import SF

from .helpers import DOCS, docs, prose, with_oddities


def shingles(text, k):
    import re

    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_classes(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def brute_kept(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(r, gone) if not g), sum(gone), bytes(gone).replace(b"\0", b" ").split()))
    return out


def test_op4_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_classes(rows, 3, 85)
    got = queries.op4_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def brute_rows(rows, k, percent):
    """(doc_id, n_shingles, component_id, kept) of every row, each by its own text."""
    by_row = brute_classes([(i, t) for i, (doc, t) in enumerate(rows) if doc is not None], k, percent)
    least = {}
    for i, (_, root) in by_row.items():
        least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    out = []
    for i, (doc, t) in enumerate(rows):
        component = doc if doc is None or not shingles(t, k) else least[by_row[i][1]]
        out.append((doc, len(shingles(t, k)), component, doc == component))
    return Counter(out)


def test_near_duplicates_odd_rows(spark):
    """Nulls, empty texts, copies without id, ids with several texts, repeated rows."""
    base = prose(5, 60)
    near = base.replace(base.split()[30], "other")
    rows = [(r.doc_id, r.text) for r in with_oddities(spark).collect()]
    rows += [(None, base), (None, base), (100, base), (101, near), (101, prose(6, 60)), (101, prose(6, 60)), (50, prose(6, 60)), (101, None), (101, ""), (102, near), (None, None), (7, base + " " + base)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("node", F.lit("n"))
    got = near_duplicates(d).collect()
    assert Counter(tuple(r) for r in got) == brute_rows(rows, 5, 80)
    assert near_duplicates(d.limit(0)).count() == 0


def test_signatures_refuse_no_pair_at_the_threshold():
    rng, hasher = np.random.default_rng(1), MinHash(32, 4)
    for percent in (80, 85):
        bound = agreement_bound(128, percent)
        assert 0.6 * 128 < bound + 5 < percent / 100 * 128
        for _ in range(300):
            x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            n = -(-percent * 300 // 100)
            y = np.concatenate([x[:n], rng.integers(0, 1 << 63, 300 - n, dtype=np.uint64)])[:n]
            assert (hasher.signature(np.sort(x)) == hasher.signature(np.sort(y))).sum() >= bound
    assert agreement_bound(128, 100) == 128


def test_group_without_its_hub(spark):
    """Copies with scattered edits: many pairs at the edge of the threshold, the leader links only some."""
    base = prose(77, 300).split()
    rows = []
    for i in range(60):
        r, w = random.Random(i), list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i * 3 + 1, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90, 95):
        want = brute_classes(rows, 3, percent)
        got = near_duplicates(d, words=3, percent=percent, bands=64, rows=3, block=16, part=8)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_only_linkable_nodes_are_compared_in_blocks(spark):
    """Edits of words of their own leave most of a cluster without any possible partner; no linked pair is left out."""
    base = prose(78, 150).split()
    texts = []
    for i in range(120):
        r, w = random.Random(i), list(base)
        for k in range(i % 12):
            w[r.randrange(len(w))] = f"edit{i}x{k}" if i % 5 else f"edit{k}"
        texts.append(" ".join(w))
    sets = [shingles(t, 3) for t in texts]
    members = spark.createDataFrame([(i, 7, i, len(s)) for i, s in enumerate(sets)], "node long, cluster long, class long, n_shingles long")
    left = _linkable(members, spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 3, 85, Scratch(spark, "t"))
    got = {r.node for r in left.collect()}
    linked = {i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 100 * len(x & y) >= 85 * len(x | y)}
    assert linked <= got
    assert len(linked) < 90 and len(got) < 100


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_op5_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len(r.text.encode()), n, len(runs), hashlib.sha256(k).hexdigest()) for r, (k, n, runs) in zip(rows, brute_kept([r.text for r in rows], 200))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_remove_repeats_odd_rows(spark):
    d = with_oddities(spark).withColumn("kept", F.lit(1)).withColumn("spans", F.lit(2))
    rows = d.select("doc_id", "text").collect()
    for length, hot, bits in ((200, 1024, 64), (30, 1024, 64), (30, 1, 64), (30, 1024, 3), (30, 2, 3), (31, 3, 0)):
        want = Counter((r.text, k) for r, (k, _, _) in zip(rows, brute_kept([r.text for r in rows], length)))
        got = remove_repeats(d, length, hot, bits).collect()
        assert Counter((r.text, bytes(r.kept)) for r in got) == want
    assert remove_repeats(d.limit(0)).count() == 0


def test_long_texts_in_pieces(spark):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz "
    long = "".join(rng.choices(alphabet, k=3_300_000))
    passage = long[1_048_400:1_048_900]  # lies across two pieces
    rows = [(1, long), (2, "0" * 50 + passage + "1" * 50), (3, "z" * 10)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(1_048_400, 1_048_900)], 2: [(50, 550)], 3: []}


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for small in (1, 32, 4096):
        rows = rng.choice(np.array([0, 7, 255], np.uint8), (500, 16))
        rows[::3, :12] = 7
        assert rows[multikey_quicksort(rows, small)].tolist() == sorted(rows.tolist())


def test_hot_grams_with_very_many_contexts(spark):
    """A passage between ever other words: every domain at its edges differs, and over 1,024 of them share a gram."""
    passage = prose(3, 12)[:45]
    rows = [(i, f"{i * 7919 % 99991:05d} {i % 13} " + passage + f" {i * 104729 % 99991:05d} tail") for i in range(1500)] + [(9999, "x" * 100)]
    want = {i: k for (i, _), (k, _, _) in zip(rows, brute_kept([t for _, t in rows], 40))}
    for hot in (1024, 16):
        got = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, hot).collect()}
        assert got == want


def test_halves_of_a_hot_domain_collapse(spark):
    """Domains that differ in one byte are halved only around it: a few rows for each halving, not one for each start."""
    length, n = 40, 64
    base = prose(4, 30).encode()[:60]
    rows = []
    for i in range(n):
        at = i % 20  # bytes before the gram, which starts at 20
        rows.append((bytes([i]) * 16, 0, 20, base[:at] + bytes([200 + i % 50]) + base[at + 1 :], 0, 20))
    now = spark.createDataFrame(rows, "key binary, at long, o int, string binary, a int, b int")
    made = 0
    scratch = Scratch(spark, "t")
    for _ in range(5):
        halves = scratch.save(_halved(now, length))
        made += halves.count()
        now, again = _collapsed(halves, length, scratch)
        windows = {(bytes(r.key), r.at + k) for r in again.collect() for k in range(r.n)}
        held = {(bytes(r.key), r.at): bytes(r.string) for r in halves.collect()}
        assert all(bytes(next(x for x in rows if x[0] == k)[3])[a : a + len(t)] == t for (k, a), t in held.items())
        assert all(sum(x[3][a : a + length] in y[3] for y in rows) > 1 for x in rows for k, a in windows if k == x[0])
        lead = F.expr(f"concat(string(a), '.', hex(substring(string, o - a + 1, {length} - b + a)))")
        now = scratch.save(now.withColumn("lead", lead))
        now = scratch.save(now.join(now.groupBy("lead").count().where("count > 4"), "lead").where("a < b").drop("lead", "count"))
    assert made < 8 * n  # halving every hot row down to single starts made over 30 * n


def test_docs_schema_is_read_by_name(spark):
    assert near_duplicates(docs(spark).select("text", "key", "doc_id")).count() == docs(spark).count()
    assert DOCS
