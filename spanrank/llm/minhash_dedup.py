"""MinHash near-duplicate classes: banding, signature verification, exact confirmation, star components.

Plan
----
1. One pass over the texts gives each row its set size, a 128-bit digest of its
   full shingle set and its signature of universal hash minima.
2. Rows with equal sets are one node by definition, so a group of exact copies
   shrinks to a row through a partial aggregation.
3. A bucket is the nodes that share a band of minima.  Every node is paired
   with the least node of each of its buckets (stars, never all pairs).
4. Signature verification: a pair stays if enough of its minima agree.  The
   bound is so low that a pair at the threshold falls below it with probability
   1e-7 at most.  Of what stays, each node takes the partner that agrees best.
5. These pairs are confirmed on full sets.  Rows are dealt by partner, in as
   many parts as it has nodes for; the partner's text goes once to each part
   and the others stream past it.  Components of the links are first classes.
6. Buckets whose nodes are all of one class are done.  The others may still
   hold links: their nodes are clustered.  The shingles that no other node of
   the cluster has bound what a node can share with any partner; nodes for which
   no partner of a fitting size is left are done, and no link is lost.  Of the
   others, those outside of a cluster's largest class are compared with all
   that are left in the cluster, in blocks of hashed nodes, again by
   signature first and then on full sets; only links that join two classes are
   emitted.  Members of the largest class, which may be many, are not compared
   with one another.  Components of these links join the classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, chunks, flat, mix, parts, small_batches, spread_join
from .components import components
from .shingles import MinHash, set_digest, shingle_sets

_SLIM = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature) of every row; an empty set has null digest and signature."""

    def run(batches):
        hasher = MinHash(bands, rows)
        for batch in chunks(batches, "text"):
            sets = shingle_sets(*flat(batch.column("text")), words)
            digests = [set_digest(s) if len(s) else None for s in sets]
            signatures = [hasher.signature(s).tobytes() if len(s) else None for s in sets]
            yield arrow_batch(_SLIM, [batch.column("doc_id"), [len(s) for s in sets], digests, signatures])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def agreement_bound(hashes: int, percent: int, miss: float = 1e-7) -> int:
    """The most agreeing minima that a pair of similarity ``percent`` falls short of with probability ``miss`` at most."""
    p, chance, below = percent / 100, (1 - percent / 100) ** hashes, 0.0
    for k in range(hashes + 1):
        below += chance
        if below > miss:
            return k
        chance *= (hashes - k) / (k + 1) * p / (1 - p) if p < 1 else 0.0
    return hashes


def _signatures(column: pa.Array) -> np.ndarray:
    raw, off = flat(column)
    return raw.view(np.uint32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint32)


def band_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(node, key) for each band of each signature; a key names band and minima."""
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64())])

    def run(batches):
        hasher = MinHash(bands, rows)
        for batch in batches:
            if batch.num_rows:
                keys = np.stack([hasher.keys(s) for s in _signatures(batch.column("signature"))]).view(np.int64)
                yield arrow_batch(schema, [pa.array(np.repeat(batch.column("node").to_numpy(), bands)), pa.array(keys.reshape(-1))])

    return reps.select("node", "signature").mapInArrow(run, "node long, key long")


def _agreeing(pairs: DataFrame, bound: int) -> DataFrame:
    """(node, least, agree) of the pairs (node, least, signature, other) with ``bound`` equal minima or more."""
    schema = pa.schema([("node", pa.int64()), ("least", pa.int64()), ("agree", pa.int32())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                agree = (_signatures(batch.column("signature")) == _signatures(batch.column("other"))).sum(axis=1).astype(np.int32)
                keep = pa.array(agree >= bound)
                yield arrow_batch(schema, [batch.column("node").filter(keep), batch.column("least").filter(keep), pa.array(agree[agree >= bound])])

    return pairs.select("node", "least", "signature", "other").mapInArrow(run, "node long, least long, agree int")


def _linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _confirm(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v) of rows linked to their lead, from rows (lead, salt, own, node, text) sorted so that a lead's own row comes first."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held = np.zeros(0, np.uint64)
        for batch in chunks(batches, "text"):
            found = []
            sets = shingle_sets(*flat(batch.column("text")), words)
            for s, own, node, lead in zip(sets, *(batch.column(c).to_pylist() for c in ("own", "node", "lead"))):
                if own:
                    held = s
                elif _linked(len(np.intersect1d(s, held, assume_unique=True)), len(s), len(held), percent):
                    found.append((node, lead))
            yield arrow_batch(schema, [[x[0] for x in found], [x[1] for x in found]])

    return rows.select("lead", "own", "node", "text").mapInArrow(run, "u long, v long")


def _block_links(words: int, percent: int, bound: int):
    """Links (u, v) of classes, between the loose nodes and all nodes of a group; only those that join local classes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        signature = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(len(group), -1)
        classes, loose, texts = group["class"].to_numpy(), group["loose"].to_numpy(), group["text"].to_numpy()
        sets: dict[int, np.ndarray] = {}
        parent = {int(c): int(c) for c in classes}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                raw = np.frombuffer(texts[k].encode(), np.uint8)
                sets[k] = shingle_sets(raw, np.array([0, len(raw)]), words)[0]
            return sets[k]

        found, every = [], np.flatnonzero(~loose)
        for a in np.flatnonzero(loose).tolist():
            others = every[classes[every] != classes[a]]
            others = others[(signature[others] == signature[a]).sum(axis=1) >= bound]
            for b in others.tolist():
                x, y = root(int(classes[a])), root(int(classes[b]))
                if x != y:
                    s, t = set_of(a), set_of(b)
                    if _linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent):
                        parent[max(x, y)] = min(x, y)
                        found.append((int(classes[a]), int(classes[b])))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _linkable(members: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The members (node, cluster, class, n_shingles) that may still have a link inside their cluster.

    A node shares at most its ``core`` with any partner: its shingles that another
    node of the cluster has too.  From ``100 * common >= percent * union`` follows
    that the partner has at most ``reach`` shingles.  So x and y can only be
    linked if each one's size is within the other's reach.  Sizes are compared in
    64 steps an octave, and a collision of hashes makes a core larger: both keep
    too many, never too few.
    """
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for batch in chunks(batches, "text"):
            sets = shingle_sets(*flat(batch.column("text")), words)
            count = [len(s) for s in sets]
            own = np.repeat(mix(batch.column("cluster").to_numpy().astype(np.uint64)), count)
            yield arrow_batch(schema, [pa.array(mix(np.concatenate(sets) ^ own).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), count))])

    held = members.select("node", "cluster").join(texts, "node").select("node", "cluster", "text").mapInArrow(run, "shingle long, node long")
    alone = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    reach = F.expr(f"{100 + percent} * (n_shingles - coalesce(alone, 0)) div {percent} - n_shingles").alias("reach")
    step = "cast(floor(64 * log2({})) as int)"
    known = members.join(alone, "node", "left").select("node", "cluster", "class", "n_shingles", reach).where("reach > 0")
    known = scratch.save(known.withColumns({"size": F.expr(step.format("n_shingles")), "most": F.expr(step.format("reach"))}))
    farthest = known.groupBy("cluster", "size").agg(F.max("reach").alias("reach"), F.count("*").alias("k"))
    partners = farthest.groupBy("cluster").agg(F.collect_list(F.struct("size", "reach")).alias("partners"), F.sum("k").alias("n"))
    partners = scratch.save(partners)
    met = spread_join(known, partners.select("cluster", "partners"), "cluster", partners, known.count())
    return met.where(F.expr("exists(partners, p -> p.size <= most AND p.reach >= n_shingles)")).select("node", "cluster", "class")


def _texts_of(docs: DataFrame, nodes: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(node, text) of nodes(node, rep, digest); if doc_ids repeat, the text is one whose set has the digest."""
    found = nodes.withColumnRenamed("rep", "doc_id").join(docs, "doc_id").select("node", "digest", "text")
    if not repeated:
        return found.select("node", "text")

    def run(batches):
        for batch in chunks(batches, "text"):
            sets = shingle_sets(*flat(batch.column("text")), words)
            keep = pa.array([len(s) > 0 and set_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(keep), batch.column("text").filter(keep)], names=["node", "text"])

    return found.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _count(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, block: int = 128, part: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text).

    Rows are linked when ``100 * |A & B| >= percent * |A | B|`` over the
    distinct word shingles of their texts.  A text of fewer words is one
    shingle; null, empty or blank texts have none, are linked with nothing and
    are kept.  component_id is the least doc_id of a row's class, kept says
    whether it is the row's own.  Each row is judged by its own text: rows of
    one doc_id with different texts may be of different classes, with equal
    texts they are of one.  A null doc_id is linked with nothing: component_id
    is null and kept is true.  An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound = agreement_bound(bands * rows, percent)
    slim = scratch.save(sketch(docs, words, bands, rows))
    named = slim.where("doc_id IS NOT NULL")
    same = named.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    reps = scratch.save(same.withColumn("node", F.monotonically_increasing_id()))  # written, so a node keeps its number

    keys = band_keys(reps, bands, rows)
    buckets = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    shared = scratch.save(spread_join(keys, buckets.select("key", "least"), "key", buckets, reps.count() * bands))
    stars = scratch.save(shared.where("node <> least").select("node", "least").distinct())
    signed = stars.join(reps.select("node", "signature"), "node")
    signed = spread_join(signed, reps.select(F.col("node").alias("least"), F.col("signature").alias("other")), "least", _count(stars, "least"), stars.count())
    best = _agreeing(signed, bound).groupBy("node").agg(F.max(F.struct("agree", F.negative("least").alias("l"))).alias("m"))
    led = scratch.save(best.select("node", F.negative("m.l").alias("lead")))

    repeated = bool(named.groupBy("doc_id").count().where("count > 1").limit(1).count())
    nodes = shared.select("node").distinct().join(reps.select("node", "rep", "digest"), "node")
    texts = scratch.save(_texts_of(docs, nodes, words, repeated))
    leads = scratch.save(_count(led, "lead").select("lead", "n", F.ceil(F.col("n") / part).cast("int").alias("salts")))
    salt = F.expr("cast(pmod(xxhash64(node, 4), salts) as int)").alias("salt")
    members = spread_join(led, leads.select("lead", "salts"), "lead", leads, led.count()).select("lead", salt, F.lit(False).alias("own"), "node").join(texts, "node")
    own = leads.select(F.col("lead").alias("node"), "lead", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(True).alias("own")).join(texts, "node")
    streams = members.select("lead", "salt", "own", "node", "text").unionByName(own.select("lead", "salt", "own", "node", "text"))
    streams = streams.repartition(parts(spark), "lead", "salt").sortWithinPartitions("lead", "salt", F.col("own").desc())
    first = scratch.save(components(scratch.save(_confirm(streams, words, percent)), scratch))

    classed = scratch.save(shared.join(first, "node", "left").select("node", "key", "least", F.coalesce("root", "node").alias("class")))
    mixed = classed.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("n")).where("a <> b")
    mixed = scratch.save(mixed.select("key", "n"))
    roots = first
    if mixed.limit(1).count():
        left = scratch.save(spread_join(classed, mixed.select("key"), "key", mixed, classed.count()))
        clusters = components(left.select(F.col("node").alias("u"), F.col("least").alias("v")), scratch).withColumnRenamed("root", "cluster")
        members = clusters.join(left.select("node", "class").distinct(), "node").join(reps.select("node", "n_shingles"), "node")
        members = scratch.save(_linkable(scratch.save(members), texts, words, percent, scratch))
        parts_of = members.groupBy("cluster", "class").agg(F.count("*").alias("k"))
        sizes = parts_of.groupBy("cluster").agg(F.sum("k").alias("n"), F.max(F.struct("k", "class")).alias("m"))
        sizes = scratch.save(sizes.select("cluster", "n", F.col("m.class").alias("largest"), F.ceil((F.col("n") - F.col("m.k")) / block).cast("int").alias("rows"), F.ceil(F.col("n") / (4 * block)).cast("int").alias("columns")))
        members = spread_join(members, sizes.drop("n"), "cluster", sizes, members.count()).withColumn("h", F.xxhash64("node", F.lit(3)))
        loose = members.where(F.col("class") != F.col("largest")).select("cluster", F.expr("cast(pmod(h, rows) as int)").alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"), F.lit(True).alias("loose"), "node", "class")
        every = members.select("cluster", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), F.expr("cast(pmod(h, columns) as int)").alias("j"), F.lit(False).alias("loose"), "node", "class")
        sent = loose.unionByName(every).join(reps.select("node", "signature"), "node").join(texts, "node").drop("node")
        links = sent.repartition(parts(spark), "cluster", "i", "j").groupBy("cluster", "i", "j").applyInPandas(_block_links(words, percent, bound), "u long, v long")
        more = components(scratch.save(links), scratch).select(F.col("node").alias("_class"), F.col("root").alias("_root"))
        every = classed.select("node", "class").distinct()
        roots = every.join(more, every["class"] == more["_class"], "left").select("node", F.coalesce("_root", "class").alias("root"))
    roots = scratch.save(roots)

    of_root = scratch.save(roots.join(reps.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n")))
    told = spread_join(roots, of_root.select("root", "component"), "root", of_root, roots.count()).select("node", "component")
    classes = scratch.save(reps.join(told, "node", "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id")))
    scratch.drop(reps, buckets, shared, stars, led, texts, leads, first, classed, mixed, roots, of_root)

    found = spread_join(named.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest"), classes.select("digest", "component_id"), "digest", classes, named.count()).drop("digest")
    alone = slim.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))
