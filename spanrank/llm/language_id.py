"""Language identification by multilingual mixture inference.

A document's n-grams are a mixture of languages.  Expectation-maximisation
estimates the proportions; the set of languages is the one with the greatest
likelihood less half a log(n) for each proportion (a BIC penalty).

The n-grams are byte trigrams of the lower-cased text, hashed to 2**16 bins.
Only the ratio of a bin's likelihoods between the languages matters to the
inference, so bins of like ratios are joined into classes: a document is then a
short histogram, and whole batches go through EM as matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, small_batches

BINS = 1 << 16
UNKNOWN = "und"
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:97] = _BLANK[123:128] = 32


def _bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of all texts, one after the other, and each text's offsets into them.

    Runs of bytes that are no letters count as one blank. A text begins with a
    blank and ends with two; its last two places, of which the trigrams would
    reach into the next text, are bin 0.
    """
    raw = [b" " + t.lower().encode() + b"  " for t in texts]
    data = _BLANK[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([len(r) for r in raw])
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[ends[:-1]] = True
    keep[ends - 1] = True
    x = data[keep].astype(np.uint32)
    offsets = np.concatenate([[0], np.cumsum(keep)[ends - 1]])
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:] if len(x) > 2 else x[:0]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(16)
    h = np.concatenate([h, np.zeros(min(2, len(x)), np.uint32)])
    h[offsets[1:] - 1] = h[offsets[1:] - 2] = 0
    return h, offsets


def _letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_bins(train: DataFrame) -> DataFrame:
    """(lang, bin, n) over all rows of train(text, lang): task-local sums, then a distributed sum."""
    small_batches(train.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text"):
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            h, off = _bins([t or "" for t in texts])
            lengths = np.diff(off)
            for lang in set(langs):
                mine = np.repeat(langs == lang, lengths)
                counts = total.setdefault(lang, np.zeros(BINS, np.int64))
                counts += np.bincount(h[: len(mine)][mine], minlength=BINS)
            if len(total) > 200:
                yield from flush(total)
                total = {}
        yield from flush(total)

    def flush(total):
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], schema=schema)

    return train.select("text", "lang").mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Mixture:
    """Class likelihoods of the learned languages, and inference with them.

    counts has the bins of each language and the n-grams in them.
    """

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], smooth: float = 0.5, grid: int = 8, settled: float = 1e-4):
        self.langs, self.settled = langs, settled

        def likelihood(i: int) -> np.ndarray:
            row = np.zeros(BINS)
            row[counts[i][0]] = counts[i][1]
            return (row + smooth) / (row + smooth).sum()

        total = np.zeros(BINS)
        for i in range(len(langs)):
            total += likelihood(i)
        # classes of bins with like shares; a class's likelihood is the sum over its bins
        of_bin = np.zeros(BINS, np.int64)
        for i in range(len(langs)):
            _, of_bin = np.unique(of_bin * (grid + 1) + np.round(likelihood(i) / total * grid).astype(np.int64), return_inverse=True)
        self.of_bin = of_bin.reshape(-1).astype(np.int32)
        k = int(self.of_bin.max()) + 1
        self.p = np.stack([np.bincount(self.of_bin, weights=likelihood(i), minlength=k) for i in range(len(langs))])

    def infer(self, hist: np.ndarray) -> np.ndarray:
        """Proportions [document, language] of histograms [document, class].

        The set of languages grows until the penalty of a further one exceeds
        all that the likelihood can still gain: no larger set can be better.
        """
        n = np.maximum(hist.sum(axis=1, keepdims=True), 1)
        every = self._em(hist, n, np.full((len(hist), len(self.langs)), 1 / len(self.langs)))
        rank = np.argsort(np.argsort(-every, axis=1, kind="stable"), axis=1, kind="stable")
        # by concavity no mixture of any languages has a greater likelihood than this
        f = np.maximum(every @ self.p, 1e-300)
        reach = (hist * np.log(f)).sum(axis=1)
        reach += n[:, 0] * np.log(np.maximum(((hist / f) @ self.p.T).max(axis=1) / n[:, 0], 1e-300)) + 1e-9 * np.abs(reach)
        best, best_score = np.zeros_like(every), np.full(len(hist), -np.inf)
        at = np.arange(len(hist))
        for m in range(1, len(self.langs) + 1):
            start = np.where(rank[at] < m, np.maximum(every[at], 1e-6), 0)
            mix = start / start.sum(axis=1, keepdims=True)
            if m > 1:
                mix = self._em(hist[at], n[at], mix)
            score = (hist[at] * np.log(np.maximum(mix @ self.p, 1e-300))).sum(axis=1) - 0.5 * (m - 1) * np.log(n[at, 0])
            better = score > best_score[at]
            best[at[better]], best_score[at[better]] = mix[better], score[better]
            at = at[reach[at] - 0.5 * m * np.log(n[at, 0]) > best_score[at]]
            if not len(at):
                break
        return best

    def _em(self, hist: np.ndarray, n: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """Expectation-maximisation of each row until no proportion moves by ``settled`` any more."""
        mix, at = mix.copy(), np.arange(len(mix))
        while len(at):
            now = mix[at]
            new = now * ((hist[at] / np.maximum(now @ self.p, 1e-300)) @ self.p.T) / n[at]
            mix[at] = new
            at = at[np.abs(new - now).max(axis=1) >= self.settled]
        return mix


def fit(train: DataFrame, block: int = 64) -> Mixture | None:
    """A model of the rows of train(text, lang) with lang; None if there are none.

    All rows and all languages count.  Counts reach the driver by ``block``
    languages at a time; what it holds grows with the languages, by 65,536 bins
    each at most, and not with the rows.
    """
    table = Scratch(train.sparkSession, "language").save(count_bins(train.where("lang IS NOT NULL AND text IS NOT NULL")))
    langs = sorted(r.lang for r in table.select("lang").distinct().collect())
    if not langs:
        return None
    counts = []
    for a in range(0, len(langs), block):
        got = table.where(F.col("lang").isin(langs[a : a + block])).toArrow()
        for lang in langs[a : a + block]:
            mine = got.filter(pc.equal(got.column("lang"), lang))
            counts.append((mine.column("bin").to_numpy(), mine.column("n").to_numpy()))
    return Mixture(langs, counts)


def predict(docs: DataFrame, model: Mixture | None, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score and mixture (map of language to proportion).

    lang_pred is the language of the largest proportion, score that proportion.
    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything under a model of no languages.  Columns of these names are replaced.
    """
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "mixture")]
    docs = docs.select(*dict.fromkeys([*names, "text"]))
    small_batches(docs.sparkSession)
    box = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.map_(pa.string(), pa.float64())

    def run(batches):
        model = box.value
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            known = [model is not None and _letter(t) for t in texts]
            lang, score, mixture = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            where = np.flatnonzero(known)
            if len(where):
                h, off = _bins([texts[i] for i in where])
                c = model.of_bin[h]
                k = model.p.shape[1]
                step = min(1024, max(1, (1 << 22) // max(k, len(model.langs))))
                for a in range(0, len(where), step):
                    some = where[a : a + step]
                    hist = np.stack([np.bincount(c[off[a + i] : off[a + i + 1]], minlength=k) for i in range(len(some))]).astype(np.float64)
                    for i, p in zip(some.tolist(), model.infer(hist)):
                        top = int(p.argmax())
                        lang[i], score[i] = model.langs[top], float(min(1.0, max(0.0, p[top])))
                        mixture[i] = [(model.langs[j], float(p[j])) for j in np.flatnonzero(p > 1e-3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, kind)], names=[*names, "lang_pred", "score", "mixture"])

    by = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(by[n] for n in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    return docs.mapInArrow(run, schema)


def held_out() -> F.col:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) with lang_pred, score, mixture and held_out.

    The model is fitted on the text and lang of documents that aren't held out.
    Only the text is an input of a prediction.  A null doc_id isn't held out.
    """
    docs = docs.withColumn("held_out", held_out())
    return predict(docs, fit(docs.where("NOT held_out")))
