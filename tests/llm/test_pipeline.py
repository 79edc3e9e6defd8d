"""The pipeline's stages, each on its own input, and the whole of it."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as cp
from spanrank.llm import decontaminate, pii
from tests.conftest import SF

from .helpers import docs, prose, with_oddities
from .test_dedup import brute_classes
from .test_operators import brute_base, brute_hits, brute_patterns, check_packing


def test_stages_on_their_own_input(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in cp.STAGES:
        after = stage(spark, before, SF)
        if name == "packing":
            check_packing(after.collect(), before)
            break
        assert after.columns == before.columns
        after = spark.createDataFrame(after.collect(), before.schema)
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(old)
        if name == "language_id":
            assert set(new) == {i for i, r in old.items() if r.text and any(c.isalpha() for c in r.text)}
            assert all(new[i] == old[i] for i in new)
        elif name == "minhash_near_dedup":
            want = brute_classes([(i, r.text) for i, r in old.items()], 5, 80)
            assert set(new) == {i for i, (_, root) in want.items() if i == root} and all(new[i] == old[i] for i in new)
        elif name == "benchmark_decontamination":
            for i, r in old.items():
                n, hit, *_ = brute_hits(r.text, items, 10)
                assert (i in new) == (hit <= 0.5 * n)
                if i in new:
                    assert (new[i] == r) == (hit == 0) and (not hit or brute_hits(new[i].text, items, 10)[0] == n - hit)
        else:
            assert set(new) == set(old)
            added = brute_patterns([r.text for r in old.values()])[1]
            for (i, r), more in zip(old.items(), added):
                want, at = "", 0
                for a, k, b in sorted([*brute_base(r.text), *more]):
                    want += r.text[at:a] + f"[{pii.KINDS[k].upper()}]" if a >= at else ""
                    at = max(at, b)
                assert new[i].text == want + r.text[at:] and not brute_base(new[i].text)
                assert more or brute_base(r.text) or new[i] == r
        before = after


def test_near_duplicate_stage_judges_rows_by_text(spark):
    """Ids that are null or repeated neither protect a copy nor lose a text."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(None, a), (None, a), (5, b), (5, c), (5, c), (4, b), (None, c), (None, prose(4, 60))]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    got = cp.drop_near_duplicates(spark, d, SF)
    assert got.columns == d.columns
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(map(repr, d.select("doc_id", "text").where("false").union(spark.createDataFrame([(None, a), (4, b), (5, c), (None, prose(4, 60))], "doc_id long, text string")).collect()))


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    pq.write_table(pa.table({"item_id": pa.array([1, None], pa.int64()), "text": pa.array(["the of and", None])}), tmp_path / "benchmark.parquet")
    odd = with_oddities(spark).withColumns({"hits": F.lit(1), "spans": F.lit("s"), "score": F.lit(0.5), "lang_pred": F.lit(None).cast("string")})
    for d in (odd, odd.limit(0), docs(spark, [None, "", "x"])):
        for name, stage in cp.STAGES:
            out = stage(spark, d, str(tmp_path))
            out.count()
            if name != "packing":
                assert out.columns == d.columns
                d = out
    assert decontaminate.words_of(b"The-OF") == [b"the", b"of"]
