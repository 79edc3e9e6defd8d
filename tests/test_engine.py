"""The search engine on small files: parsing, slicing, ranking, packing, reports."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanrank import cli
from spanrank.eval import metrics, pagerank, strategies
from spanrank.functions import patterns as P
from spanrank.functions import text as X
from spanrank.operators import blocks, dedupe, grep, history, index, pack, score
from spanrank.plans.search import Priors, SearchConfig, focused_read, search
from spanrank.sources import codetree
from spanrank.streaming import refresh

SAMPLE = '''import math


class Meter:
    """Weighs words."""

    def weigh(self, words):
        amount = 0
        for word in words:
            amount += self.size(word)
        return amount

    def size(self, word):
        return len(word)


def other():
    # an aside
    return 7


def connect_with_pause(call, limit=5):
    for turn in range(3):
        try:
            return call()
        except OSError:
            pause = 2 ** turn
    raise TimeoutError(limit)
'''


@pytest.fixture()
def sample(tmp_path):
    p = tmp_path / "sample.py"
    p.write_text(SAMPLE, encoding="utf-8")
    return str(p)


@pytest.fixture()
def project(tmp_path):
    filler = "\n".join(f"# line {i} of remarks" for i in range(40))
    for name, text in {"src/gear.py": f"def build_gear(n):\n    return n\n{filler}\n", "src/main.py": f"from gear import build_gear\nx = build_gear(3)\n{filler}\n", "tests/test_gear.py": f"def test_gear():\n    assert build_gear(1)\n{filler}\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}.py", t) for i, t in enumerate(texts)], "file string, text string")


# ---- queries

def test_alternatives():
    assert P.split_alternatives("(a|b)_c") == ["(a|b)_c"] and P.split_alternatives(r"a| b |\||[x|y]||") == ["a", "b", r"\|", "[x|y]"]
    with pytest.raises(ValueError, match="pattern is empty"):
        P.parse_query(" | ")


def test_phrases():
    assert P.parse_query("how does budget guarantee definition slots") == ["budget", "guarantee", "definition", "slots", "budget_guarantee", "guarantee_definition", "definition_slots"]
    assert P.parse_query("class Context") == ["class Context"] and P.parse_query("a b c|d") == ["a b c", "d"]


def test_router():
    assert P.is_vague(["alpha", "bravo", "charlie"]) and not P.is_vague(["alpha", "bravo"]) and not P.is_vague(["alpha", "Bravo", "charlie"])
    assert not P.is_vague(["alpha", "bravo", "charlie"], "off") and P.is_vague(P.parse_query("cache expiry refresh logic"), "learned") and not P.is_vague(P.parse_query("cache expiry refresh logic"))


def test_router_training(spark):
    rows = [(["alpha", "bravo", "gamma"], 1.0), (["alpha", "bravo", "delta", "omega"], 1.0), (["def x"], 0.0), ([r"\bfoo_Bar"], 0.0)]
    weights = P.train_router(spark.createDataFrame(rows, "patterns array<string>, label double"), rounds=30)
    assert P.accuracy(weights, rows) == 1.0


def test_batch_columns_equal_the_functions(spark):
    texts = ["how does budget guarantee definition slots", "the an of", "one two", "Cache refresh_all logic now"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", P.expand_column(F.col("t")).alias("p")).select("t", "p", P.vague_column(F.col("p")).alias("v"), P.learned_column(F.col("p")).alias("z")).collect()
    for r in got:
        want = P.expand_phrase(r.t, [r.t])
        assert list(r.p) == want and r.v == P.is_vague(want) and (r.z > 0) == P.is_vague(want, "learned")


def test_regex_dialects(spark):
    d = files(spark, "Score(x)\nÉTÉ\nfoo_1\nab ab\n")
    count = lambda *p: {r.ln for r in grep.line_hits(d, P.Matcher(spark, p)).collect()}
    assert count("score(") == {1} and count("été") == {2} and count(r"(?P<w>ab) (?P=w)") == {4} and count(r"\w+_\d") == {3}
    assert P.Matcher(spark, [r"(?P<a>x)(?(a)y|z)"]).python and count(r"(f)(?(1)oo|z)") == {3}


# ---- lines, tokens, blocks

def test_lines_equal_splitlines(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("ab \n\r\x0b\x0c\x1c\x85\u2028_", k=r.randrange(30))) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, row in zip(texts, d.select(X.line_array(F.col("t")).alias("l"), F.transform(X.line_array(F.col("t")), X.bare).alias("b")).collect()):
        assert list(row.l) == t.splitlines(keepends=True) and list(row.b) == t.splitlines()


def test_tokens_and_symbols(spark):
    d = spark.createDataFrame([("CacheInvalidator refresh_caches of invalidation HTTPServer2Go x",)], "t string")
    assert d.select(X.semantic_tokens(F.col("t"))).first()[0] == ["cache", "invalidator", "cacheinvalidator", "refresh", "cach", "refresh_caches", "invalid", "httpserver2"]
    lines = ["def foo(x):", "int bar = 3", "    call(1)", "x = 1", "print x"]
    got = spark.createDataFrame([(s,) for s in lines], "l string").select(X.symbol(F.col("l")).alias("s")).collect()
    assert [r.s for r in got] == ["foo", "bar", "call", None, "x"]


def spans(spark, text, **k):
    d = files(spark, text).select(X.line_array(F.col("text")).alias("l"))
    return [(s.lo, s.hi) for s in d.select(blocks.block_spans(F.col("l"), **k)).first()[0]]


def test_block_spans(spark):
    assert spans(spark, "x\n" * 50) == [(0, 50), (40, 50)]
    assert spans(spark, "import a\n\ndef f():\n  pass\nclass C:\n    def g(self):\n        def inner(): pass\n") == [(0, 2), (2, 4), (4, 5), (5, 7)]
    assert spans(spark, "def f():\n" + "  x\n" * 199) == [(0, 70), (60, 130), (120, 200)]
    d = spark.range(1).select(blocks.windows(F.lit(100), 60, 40, True).alias("a"), blocks.windows(F.lit(101), 60, 40, True).alias("b"))
    r = d.first()
    assert [tuple(s) for s in r.a] == [(0, 60), (40, 100)] and [tuple(s) for s in r.b] == [(0, 60), (40, 100), (80, 101)]


def test_enclosing_blocks():
    lines = SAMPLE.splitlines(keepends=True)
    layout = blocks.Layout(lines, "python")
    assert layout.around(9) == (6, 12, "weigh") and layout.around(3) == (3, 16, "Meter") and layout.around(0) == (0, 21, None)
    braces = blocks.Layout(["int a;\n", "void f() {\n", "  if (x) {\n", "    y();\n", "  }\n", "}\n", "z\n"], "c_like")
    assert braces.around(3)[:2] == (2, 4) and braces.around(6) == (0, 7, None)
    assert blocks.Layout(["{\n", "never shut\n"], "brace").around(1)[:2] == (0, 0)


def test_merging_and_windows(spark):
    d = files(spark, "hit\n" + "x\n" * 4 + "hit\n" + "x\n" * 9 + "HIT\n")
    found = grep.window_chunks(d, P.Matcher(spark, ["hit"]), 2, 3).orderBy("line_start").collect()
    assert [(r.line_start, r.line_end, r.hit_lines, r.matches) for r in found] == [(1, 9, 2, 1), (14, 16, 1, 1)]
    assert found[0].tokens == max(1, len(found[0].code) // 4)


# ---- scores

def test_scores(spark):
    rows = [("a.py", "def alpha_beta(x):\n    alpha_beta = 1\n"), ("tests/t.py", "# alpha\n# x\n# y\n# z\n"), ("build/b.py", "alpha beta\n")]
    d = spark.createDataFrame(rows, "file string, text string")
    m = P.Matcher(spark, ["alpha", "beta"])
    got = {r.file: r for r in score.lexical_score(grep.window_chunks(d, m), m).collect()}
    assert got["a.py"].score == 10 + 15 + 10 + 6 + 25 and got["a.py"].rank_reason == ["co_occurrence", "all_patterns", "rare_terms", "definition"]
    assert got["tests/t.py"].score == 0 and got["tests/t.py"].rank_reason == ["test_demoted", "mostly_comments"]
    assert got["build/b.py"].score == 10 + 25 - 15


def brute_cos(docs, query):
    count = lambda t: {w: re.findall(r"[a-z0-9_]{3,}", t.lower()).count(w) for w in re.findall(r"[a-z0-9_]{3,}", t.lower())}
    tf, q, n = [count(t) for t in docs], count(query), len(docs)
    idf = {w: math.log(1 + n / (1 + sum(w in t for t in tf))) for t in tf for w in t}
    qv = {w: c * idf.get(w, math.log(1 + n)) for w, c in q.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    return [sum(qv.get(w, 0) * c * idf[w] for w, c in t.items()) / norm(qv.values()) / norm([c * idf[w] for w, c in t.items()]) for t in tf]


def test_rerank_equals_the_formula(spark):
    docs = ["cache refresh expiry", "cache cache other words here", "unrelated text only"]
    d = spark.createDataFrame([(f"f{i}", 1, 1, t, 10.0, ["x"]) for i, t in enumerate(docs)], "file string, line_start int, line_end int, code string, score double, rank_reason array<string>")
    got = {r.file: r for r in score.rerank(d, "cache|expiry|refresh").collect()}
    for i, c in enumerate(brute_cos(docs, "cache|expiry|refresh")):
        bonus = round(12 * c)
        assert got[f"f{i}"].score == 10 + bonus and ("semantic" in got[f"f{i}"].rank_reason) == (bonus >= 4)


def test_bm25_and_fusion(spark):
    cut = spark.createDataFrame([("a", 0, 5, "cache refresh"), ("b", 0, 5, "cache"), ("c", 0, 5, "nothing else")], "file string, lo int, hi int, code string")
    built = index.build_index(cut, X.terms(F.col("code")))
    q = spark.createDataFrame([(1, "cache refresh")], "qid int, q string")
    got = index.bm25(built, q, X.terms(F.col("q"))).orderBy("rank").collect()
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    norm = lambda dl: 1.2 * (0.25 + 0.75 * dl / (5 / 3))
    assert [r.file for r in got] == ["a", "b"] and got[0].score == pytest.approx((idf(2) + idf(1)) * 2.2 / (1 + norm(2)), abs=1e-6) and got[1].score == pytest.approx(idf(2) * 2.2 / (1 + norm(1)), abs=1e-6)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [-1.0, 0.0])], "id string, vector array<double>")
    dense = index.dense_top(vectors, spark.createDataFrame([(1, [2.0, 0.0])], "qid int, vector array<double>"))
    assert [(r.id, r.sim) for r in dense.orderBy("rank").collect()] == [("a", 1.0), ("b", round(math.sqrt(0.5), 6))]
    fused = index.fuse(got and spark.createDataFrame([(1, "a", 2.0), (1, "c", 1.0)], "qid int, id string, score double"), dense).orderBy("rank").collect()
    assert [r.id for r in fused] == ["a", "b", "c"] and [r.fused for r in fused] == pytest.approx([1.0, math.sqrt(0.5) / 2, 0.25], abs=1e-5)


# ---- duplicates and packing

def test_dedupe(spark):
    lines = [f"line {i}" for i in range(10)]
    texts = ["\n".join(lines), "\n".join(lines), "\n".join([*lines[:9], "changed"]), "\n".join(lines[:5] + ["a", "b", "c", "d", "e"])]
    d = spark.createDataFrame([("f", i, i, t, float(9 - i), str(hash(t))) for i, t in enumerate(texts)], "file string, line_start int, line_end int, code string, score double, hash string")
    assert sorted(r.line_start for r in dedupe.dedupe(d).collect()) == [0, 3] and sorted(r.line_start for r in dedupe.dedupe(d, 2.0).collect()) == [0, 2, 3]
    assert [(r.a, r.b) for r in dedupe.near_pairs(d).orderBy("a", "b").collect()] == [(0, 1), (0, 2), (1, 2)]


def slow_fill(ranked, budget, objective):
    fitted, used = [], 0
    for c in pack.guaranteed(ranked, objective):
        if used + c.tokens <= budget:
            fitted, used = [*fitted, c], used + c.tokens
    while True:
        room = [c for c in ranked if c not in fitted and used + c.tokens <= budget]
        if not room:
            return sorted(fitted, key=lambda c: -c.score)
        best = max(room, key=lambda c: (c.score - 6 * sum(f.file == c.file for f in fitted), -ranked.index(c)))
        fitted, used = [*fitted, best], used + best.tokens


@pytest.mark.parametrize("seed", range(60))
def test_heap_fill_equals_the_plain_one(seed):
    r = random.Random(seed)
    rows = [pack.Candidate(r.choice(["a.py", "b.py", "c.py", "tests/test_a.py"]), i * 10, i * 10 + 5, float(r.randrange(30)), r.randrange(1, 40), r.choice([[], ["definition"]])) for i in range(r.randrange(25))]
    ranked = sorted(rows, key=lambda c: -c.score) if seed % 3 else rows
    for objective in ("auto", "single", "def+caller", "def+test"):
        budget = r.randrange(1, 200)
        assert pack.fill(ranked, budget, objective) == slow_fill(ranked, budget, objective)
        for route in (pack.hybrid, pack.vague):
            chosen = route(ranked[::2], ranked[1::2], budget, objective)
            assert any(c.cut for c in chosen) or sum(c.tokens for c in chosen) <= budget
            assert sum(c.tokens for c in chosen) <= max(budget, 56)


def test_overlapping_recall_is_left_out():
    a, b, c = pack.Candidate("f", 1, 10, 50, 5), pack.Candidate("f", 8, 12, 40, 5, recall=True), pack.Candidate("g", 8, 12, 30, 5, recall=True)
    assert pack.hybrid([a], [b, c], 100) == [a, c]


# ---- history

def test_history_formulas(spark):
    log = [(1, 0, ["a", "b"]), (2, 86400 * 90, ["a", "b", "c"]), (3, 0, ["c"]), (4, 0, [f"m{i}" for i in range(11)]), (5, 0, ["a", "d"])]
    changes = spark.createDataFrame([(c, f, 3) for c, _, fs in log for f in fs], "cid int, file string, changed int")
    commits = spark.createDataFrame([(c, t) for c, t, _ in log], "cid int, ts long")
    got = {r.file: r.churn for r in history.churn(changes, commits).collect()}
    w = {f: math.log(1 + sum(math.log(4) / math.sqrt(len(fs)) * math.exp((t - 86400 * 90) / (86400 * 90)) for _, t, fs in log if f in fs)) for f in "abcd"}
    assert all(got[f] == pytest.approx(w[f] / max(w.values())) for f in w)
    pair = {(r.a, r.b): r.c for r in history.pairs(changes).collect()}
    assert pair[("a", "b")] == 2 and pair[("d", "a")] == 1 and not any(a.startswith("m") for a, _ in pair)
    df = history.frequencies(changes).withColumnRenamed("file", "item")
    lifted = history.lift(history.pairs(changes), df, F.lit(5))
    r = {(x.a, x.b): x.r for x in lifted.collect()}
    assert r[("a", "b")] == pytest.approx(math.log((2 / 5 + 0.05) / (3 / 5 * 2 / 5 + 0.05)))
    co = {x.file: x.cochange for x in history.cochange(lifted, [("a", 10.0)]).collect()}
    assert co["b"] == pytest.approx(1.0) and 0 < co["d"] < 1
    assert [x.item for x in history.expand_symbols(lifted, ["a"], 1).collect()] == ["b"] and history.expand_symbols(lifted, [], 1).count() == 0
    fused = {x.file: x.fscore for x in history.fuse_files(spark.createDataFrame([("a", 10.0), ("b", 5.0)], "file string, score double"), history.churn(changes, commits), history.cochange(lifted, [("a", 10.0)])).collect()}
    assert fused["b"] == pytest.approx(10 * (0.5 + 0.3 * got["b"] + 0.5))
    heads = spark.createDataFrame([(1, "@@ -1 +1 @@ def parse_line(x):"), (1, "@@ -2 +2 @@ def _own():"), (1, "@@ -3 +3 @@"), (2, "@@ -1 +1 @@ return foo_bar(1)")], "cid int, line string")
    assert {(x.cid, x.sym) for x in history.hunk_symbols(heads).collect()} == {(1, "parse_line"), (2, "foo_bar")}
    shuffled = {x.file for x in history.shuffle_files(history.churn(changes, commits), ["file"]).collect()}
    assert shuffled == set(got)


# ---- the whole search

def test_read_one_file(spark, sample):
    got = focused_read(spark, sample, "def weigh", before=1, after=3)
    assert len(got.chunks) == 1 and "def weigh" in got.chunks[0].code and got.negative_evidence == []
    none = focused_read(spark, sample, "def nothing_like_it")
    assert none.chunks == [] and any("not found" in a for a in none.negative_evidence)
    whole = focused_read(spark, sample, r"amount \+=", boundary="fn").chunks[0]
    assert "def weigh" in whole.code and "return amount" in whole.code and whole.symbol == "weigh"
    assert "co_occurrence" in focused_read(spark, sample, "connect|limit|pause", before=6, after=6).chunks[0].rank_reason
    assert focused_read(spark, sample + "x", "a").chunks == []


def test_budgets(spark, sample):
    cut = focused_read(spark, sample, "def weigh", budget=5)
    assert len(cut.chunks) == 1 and "truncated to budget" in cut.chunks[0].code
    many = focused_read(spark, sample, "def", before=2, after=2, budget=60)
    assert many.total_tokens <= 60 or len(many.chunks) == 1
    assert any("fell outside" in a for a in focused_read(spark, sample, "import math|def other", before=0, after=0, budget=4).negative_evidence)


def test_folders(spark, project):
    got = focused_read(spark, project, "build_gear", budget=1200)
    names = {c.file.rsplit("/", 1)[-1] for c in got.chunks}
    assert names == {"gear.py", "main.py", "test_gear.py"} and got.files_searched == 3 and got.negative_evidence == []
    assert json.loads(got.to_json())["total_tokens"] == got.total_tokens and "RANKING:" in got.render()
    vague = focused_read(spark, project, "gear|build|remarks", budget=900)
    assert vague.chunks and vague.total_tokens <= 900
    log = [(i, f"{project}/src/{f}.py") for i in range(6) for f in ("gear", "main")]
    priors = Priors(spark.createDataFrame([(c, f, 2) for c, f in log], "cid int, file string, changed int"), spark.createDataFrame([(i, i * 1000) for i in range(6)], "cid int, ts long"), spark.createDataFrame([(i, s) for i in range(6) for s in ("build_gear", "test_gear")] + [(9, "solo_name")], "cid int, sym string"))
    for mode in history.MODES:
        assert focused_read(spark, project, "build_gear", budget=600, priors=priors, history=mode, expand_history=True).chunks
    frame = search(codetree.read_tree(spark, project), "build_gear", SearchConfig(budget=300))
    assert frame.agg(F.sum("tokens")).first()[0] <= 300


def test_tree_source(spark, tmp_path):
    for name in ("__init__.py", ".hidden.py", "node_modules/c.py", "b.bin", "big.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * (1_000_001 if name == "big.py" else 3))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfea")
    (tmp_path / "empty.md").write_text("")
    got = {r.file.rsplit("/", 1)[-1]: r.text for r in codetree.read_tree(spark, str(tmp_path), sliceBytes="1").collect()}
    assert set(got) == {"__init__.py", ".hidden.py", "bad.txt", "empty.md"} and got["bad.txt"] == "\ufffd\ufffda"
    assert "big.py" in {r.file.rsplit("/", 1)[-1] for r in codetree.read_tree(spark, str(tmp_path), maxBytes="none").collect()}
    assert codetree.read_log(spark, str(tmp_path)).count() == 0
    assert list(codetree.parse_numstat("\x1ec1 100\n\n1\t2\ta.py\n-\t-\tb.bin\n\x1ec2 50\n")) == [("c1", 100, "a.py", 3), ("c1", 100, "b.bin", 0)]
    assert list(codetree.parse_headers("\x1ec1 100\ndiff\n@@ -1 +1 @@ def f():\n+x\n")) == [("c1", 100, "@@ -1 +1 @@ def f():")]


def test_command_line(spark, sample, capsys):
    assert cli.main([sample, "def weigh"], spark) == 0 and "def weigh" in capsys.readouterr().out
    assert cli.main([sample, "zzz"], spark) == 1 and cli.main([sample, " "], spark) == 2 and cli.main(["/no/such", "x"], spark) == 1
    capsys.readouterr()
    assert cli.main([sample, "def weigh", "--json", "--budget", "500"], spark) == 0 and json.loads(capsys.readouterr().out)["chunks"]
    assert "spanrank" in cli.focused_read_tool(sample, "def weigh", spark=spark) and cli.focused_read_tool(sample, "|", spark=spark).startswith("error")


def test_stream_refresh(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "index")
    for i, rows in enumerate([[("a.py", "def cache_one(): pass", 1.0)], [("a.py", "def other_two(): pass", 2.0), ("b.py", "def cache_three(): pass", 1.0)]]):
        spark.createDataFrame(rows, "file string, text string, mtime double").write.parquet(str(src / f"part={i}"))
        q = refresh.refresh(spark.readStream.schema("file string, text string, mtime double").parquet(str(src)), out, str(tmp_path / "ck"))
        q.awaitTermination()
    now = refresh.current_index(spark, out)
    assert {r.file for r in now.postings.where("term = 'cache'").collect()} == {"b.py"}
    now.write(str(tmp_path / "kept"))
    assert index.TermIndex.read(spark, str(tmp_path / "kept")).terms.count() == now.terms.count()


# ---- evaluation

def test_metrics_and_strategies(spark, project):
    d = codetree.read_tree(spark, project)
    m = P.Matcher(spark, ["build_gear"])
    assert [r.file.rsplit("/", 1)[-1] for r in strategies.ranked_files(d, m).orderBy("rank").collect()] == ["main.py", "gear.py", "test_gear.py"]
    assert {r.name for r in strategies.collect_symbols(d).collect()} == {"build_gear"}
    assert {r.use_file.rsplit("/", 1)[-1] for r in strategies.usage_tasks(d).collect()} == {"main.py", "test_gear.py"}
    ranks = {r.node.rsplit("/", 1)[-1]: r.rank for r in pagerank.pagerank(pagerank.reference_edges(d)).collect()}
    assert max(ranks, key=ranks.get) == "gear.py" and pagerank.repository_map(d).count() == 2
    assert strategies.function_chunks(d).count() == 3 and strategies.merged_windows(d, m).count() == 3
    spans_ = spark.createDataFrame([("f", 0, 5), ("f", 5, 9), ("f", 11, 12), ("g", 1, 2)], "file string, lo int, hi int")
    assert sorted(map(tuple, strategies.interval_union(spans_).select("file", "lo", "hi").collect())) == [("f", 0, 9), ("f", 11, 12), ("g", 1, 2)]
    patch = spark.createDataFrame([(1, 0, "+++ b/x.py"), (1, 1, "@@ -10,0 +11,2 @@"), (1, 2, "@@ -3 +4 @@"), (1, 3, "+++ b/y.py"), (1, 4, "@@ -1,5 +1 @@")], "cid int, n int, line string")
    assert sorted(map(tuple, strategies.parse_hunks(patch).collect())) == [(1, "x.py", 2, 1), (1, "x.py", 9, 1), (1, "y.py", 0, 5)]
    row = spark.createDataFrame([("a\n b\n\n", "b\nc\na", ["x/f.py"], ["y/f.py", "g.py"])], "t string, c string, n array<string>, w array<string>")
    got = row.select(metrics.hit(F.col("t"), F.col("c")).alias("h"), metrics.coverage(F.col("c"), F.col("t")).alias("v"), metrics.irrelevant_percent(F.col("t"), F.col("c")).alias("i"), metrics.file_recall(F.col("n"), F.col("w")).alias("f")).first()
    assert got.h and got.v == pytest.approx(2 / 3) and got.i == pytest.approx(100 / 3) and got.f == 0.5
    texts = files(spark, 'def foo_bar():\n    """Refresh cache entries quickly."""\nraise ValueError("bad value here")\nMAX_SIZE = 3\nx = environ["APP_HOME"]\n')
    assert strategies.docstring_tasks(texts).first().words == ["Refresh", "cache", "entries", "quickly"] and strategies.raise_tasks(texts).first().message == "bad value here" and {r.name for r in strategies.config_tasks(texts).collect()} == {"MAX_SIZE", "APP_HOME"}
    ranked = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 10)], "qid int, rank int, tokens int")
    assert metrics.read_until(ranked, 100).count() == 2
    assert metrics.refine_terms(spark.createDataFrame([("refresh refresh fooBar cache",)], "code string"), ["cache"], 2).first().term == "fooBar"
    commits = spark.createDataFrame([(1, "Fix `parse_it` in reader"), (2, "Bump version now"), (3, "Fix it")], "cid int, subject string")
    assert [(r.cid, r.query) for r in strategies.mine_sessions(commits, spark.createDataFrame([(i, "f", 9) for i in (1, 2, 3)], "cid int, file string, changed int")).collect()] == [(1, "parse_it|Fix|reader")]


def test_prefilter_loses_no_line(spark):
    """Texts go before their lines are cut only where no line can match without its text."""
    files = spark.createDataFrame([("a", "one\ntwo three\n"), ("b", "beta\none"), ("c", "x\n"), ("d", "")], "file string, text string")
    for pattern, want in {"one": "ab", "^two": "a", "three$": "a", r"\bbeta\b": "b", "(?<!x)one": "ab", "ne|TWO": "ab", "one$": "ab", "[^o]ne": "", r"e\s*t": "b"}.items():
        got = {r.file for r in grep.line_hits(files, P.Matcher(spark, [pattern])).collect()}
        assert got == set(want), pattern


def test_groups_equal_a_plain_fold(spark):
    r = random.Random(4)
    for reach in (0, 1, 3):
        rows = [(i, sorted(r.sample(range(60), r.randrange(0, 25)))) for i in range(30)]
        d = spark.createDataFrame([(i, [(ln, [ln % 3]) for ln in at]) for i, at in rows], "i int, hits array<struct<ln:int,pats:array<int>>>")
        got = {x.i: [(g.first, g.last, g.hits, list(g.pats)) for g in x.groups] for x in grep.with_groups(d, reach).collect()}
        for i, at in rows:
            want = []
            for ln in at:
                if want and ln - want[-1][1] <= reach:
                    a, _, n, pats = want[-1]
                    want[-1] = (a, ln, n + 1, pats + [ln % 3] * (ln % 3 not in pats))
                else:
                    want.append((ln, ln, 1, [ln % 3]))
            assert got[i] == want


def test_near_pairs_equal_all_pairs(spark):
    r = random.Random(9)
    chunks = [(f"f{i % 2}", i, "\n".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 9)))) for i in range(60)]
    sets = {(f, i): frozenset(x.strip() for x in c.split("\n") if x.strip()) for f, i, c in chunks}
    want = {(f, i, j): round(len(a & b) / len(a | b), 6) for (f, i), a in sets.items() for (g, j), b in sets.items() if f == g and i < j and a and b and len(a & b) >= 0.7 * len(a | b) - 1e-12}
    got = dedupe.near_pairs(spark.createDataFrame(chunks, "file string, line_start int, code string")).collect()
    assert {(x.file, x.a, x.b): x.jaccard for x in got} == want and len(got) == len(want)


def test_deduplicated_chunks_equal_a_plain_greedy(spark):
    from spanrank import queries as q
    from tests.conftest import SF

    m = P.Matcher(spark, q.PATTERNS)
    scored = score.lexical_score(grep.window_chunks(q.documents(spark, SF), m, 1, 1), m).collect()
    kept = set()
    by = {}
    for c in sorted(scored, key=lambda c: (-c.score, c.file, c.line_start)):
        mine = {x.strip() for x in c.code.splitlines() if x.strip()}
        seen = by.setdefault(c.file, [])
        if not any(c.hash == h or mine and o and len(mine & o) >= 0.7 * len(mine | o) for h, o in seen):
            seen.append((c.hash, mine))
            kept.add((c.file, c.line_start, c.line_end))
    got = q.deduplicated_chunks(spark, SF).collect()
    assert {(r.file, r.line_start, r.line_end) for r in got} == kept and len(got) == len(kept) <= len(scored)


def test_history_of_a_folder_is_read(spark, project):
    """The priors of a folder come from its repository, named as its files are, and change the files' scores."""
    import subprocess

    def git(*args):
        subprocess.run(["git", "-C", project, "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)

    assert not codetree.in_repository(project)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    files = sorted(path for path, _, _ in codetree.scan(project))
    for i in range(5):
        with open(files[0], "a", encoding="utf-8") as f:
            f.write(f"# more {i}\n")
        git("commit", "-qam", f"change {i}")
    from spanrank.plans.search import _file_scores, load_priors

    priors = load_priors(spark, project)
    assert {r.file for r in priors.changes.select("file").distinct().collect()} >= set(files) and priors.commits.count() == 6
    rows = spark.createDataFrame([(f, 10.0) for f in files], "file string, score double")
    fscore = {r.file: r.fscore for r in _file_scores(rows, priors, 6, "churn-only").collect()}
    assert fscore[files[0]] == max(fscore.values()) and fscore[files[0]] > 10.0
    assert focused_read(spark, project, "build_gear", budget=600).chunks and cli.main([project, "build_gear", "--budget", "600"], spark) == 0


def test_paths_are_alike(spark):
    d = spark.createDataFrame([("/a/b/c.py",), ("\\a\\b\\c.py",), ("c/d.py",), ("/x/y",)], "f string")
    assert [r[0] for r in d.select(X.relative_path(F.col("f"), "/a/b/")).collect()] == ["c.py", "c.py", "c/d.py", "/x/y"]


def test_sinks_resume(spark, tmp_path):
    from spanrank.eval import sinks

    path = str(tmp_path / "cells")
    schema = "sha string, strategy string, tokens int, hit boolean, coverage double, latency_ms double"
    cells = spark.createDataFrame([("a", "x", 10, True, 1.0, 5.0), ("b", "x", 20, False, 0.5, 7.0)], schema)
    assert sinks.append(cells, path, ["sha", "strategy"]).count() == 2
    more = cells.unionByName(spark.createDataFrame([("a", "y", 5, True, 1.0, 1.0)], schema))
    assert sinks.todo(more, sinks.done(spark, path, schema), ["sha", "strategy"]).count() == 1
    assert sinks.append(more, path, ["sha", "strategy"]).count() == 3
    text = sinks.markdown(sinks.done(spark, path, schema))
    assert text.split("\n")[0].startswith("| strategy |") and "| x | 50.0 % | 75.0 % | 15 | 6.0 | 2 |" in text


def test_second_round_and_tested_tasks(spark):
    first = spark.createDataFrame([(1, "load_index(path)\nload_index(other)\nquery"), (2, "x")], "place int, code string")
    asked = []

    def again(query):
        asked.append(query)
        return spark.createDataFrame([(1, "second round")], "place int, code string")

    got = strategies.refined("query", first, again).orderBy("round", "place").collect()
    assert asked and asked[0].startswith("query|load_index") and [(r["round"], r.place) for r in got] == [(1, 1), (1, 2), (2, 1)]
    assert strategies.refined("query", first, again, 2).count() == 1
    files = spark.createDataFrame([("src/a.py", "def make_it():\n    pass\n"), ("tests/test_a.py", "import a\n\nassert a.make_it()\n")], "file string, text string")
    assert [tuple(r) for r in strategies.tested_tasks(files).collect()] == [("make_it", "src/a.py", 0, "tests/test_a.py", 2)]
