"""The other operators against brute force, round trips and held-out accuracy."""

import functools
import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanrank.llm import chat_format, decontaminate, fingerprints, language_id, packing, pii, queries, sharding, url_filter
from tests.conftest import SF

from .helpers import docs, prose, with_oddities


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    plain = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


# ---- 1 language identification

def test_op1_held_out_accuracy(spark):
    rows = queries.op1_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and held


def test_language_mixture_and_odd_rows(spark):
    en, fr = "the cat and the dog with this other thing that was there " * 6, "le chat et la souris avec une autre chose que nous avons vue " * 6
    train = spark.createDataFrame([(en, "en"), (fr, "fr"), (None, "en"), ("sans langue", None)] * 5, "text string, lang string")
    model = language_id.fit(train)
    rows = [(0, None), (1, ""), (2, "12 :)"), (3, en), (4, fr), (5, en + fr), (6, "x")]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, score int"), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4)] == ["und", "und", "und", "en", "fr"]
    assert got[6].lang_pred in ("en", "fr") and set(got[3].mixture) == {"en"}
    assert abs(got[5].mixture["en"] - 0.5) < 0.15 and set(got[5].mixture) == {"en", "fr"}
    texts = [t for _, t in rows if t is not None] + ["Zé x", "q", ""]
    bins, at = language_id._bins(texts)
    for i, t in enumerate(texts):  # a text's trigrams don't depend on its neighbours
        assert bins[at[i] : at[i + 1]].tolist() == language_id._bins([t])[0].tolist()
    none = language_id.fit(train.limit(0))
    assert none is None and language_id.predict(train, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(docs(spark).limit(0)).count() == 0


def test_every_label_is_learned_and_mixtures_may_be_large(spark):
    word = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(2)) * 2
    train = spark.createDataFrame([(f"{word(i)} " * (100 if i else 90), f"l{i:03d}") for i in range(260)], "text string, lang string")
    model = language_id.fit(train)
    assert len(model.langs) == 260
    (r,) = language_id.predict(spark.createDataFrame([(f"{word(0)} " * 50,)], "text string"), model).collect()
    assert r.lang_pred == "l000" and r.score > 0.9
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    said = [" ".join(a + b + c for a in x for b in x for c in x) + " " for x in letters]
    model = language_id.fit(spark.createDataFrame([(s * 40, x) for s, x in zip(said, letters)], "text string, lang string"))
    rows = [("".join(said[:m]) * 5,) for m in range(1, 7)]
    got = [r.mixture for r in language_id.predict(spark.createDataFrame(rows, "text string"), model).collect()]
    assert [set(g) for g in got] == [set(letters[:m]) for m in range(1, 7)] and all(abs(p - 1 / 6) < 0.05 for p in got[5].values())


# ---- 2 chat formatting

def brute_chat(rows):
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_op2_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = brute_chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op2_chat_format(spark, SF).collect()}
    assert got == want


def test_chat_odd_rows_and_parts(spark):
    rows = [(1, None, None, None), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 1, "assistant", "x<|end|>\n<|turn|>user\n"), (2, 0, "a\nb%0A", "<\\|end|>\\"), (2, 1, "assistant", "é" * 5000)] + [(3, i, "assistant", f"m{i}") for i in range(500)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    events = chat_format.events_of(d)
    want = brute_chat([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    for flush in (1 << 20, 100):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(chat_format.render(events, flush)).collect()}
        assert got == want
    assert chat_format.render(events.limit(0)).count() == 0


def test_event_folding(spark):
    log = [
        (1, 0, 0, "delta", "user", "hel"), (1, 0, 1, "delta", None, "lo"), (1, 0, 9, "edit", None, "hello!"),
        (1, 1, 2, "delta", "assistant", "bad"), (1, 1, 4, "regenerate", None, ""), (1, 1, 5, "delta", None, "good"),
        (1, 2, 3, "message", "user", "void, said before the regeneration"), (1, 2, 6, "message", "user", "thanks"),
        (1, 3, 7, "message", "assistant", "x"), (1, 3, 8, "delete", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").orderBy(F.rand(1))
    (row,) = chat_format.render(events).collect()
    assert [(r, t) for r, t, _, _ in chat_format.parse(row.formatted)] == [("user", "hello!"), ("assistant", "good"), ("user", "thanks")]
    assert [row.formatted[s.start : s.end] for s in row.loss] == ["good"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "%0A", "<s>"]), st.text(alphabet="<>|/\\[]SINTendturn_imsYS\n x")), max_size=5))
def test_template_round_trip(turns):
    text = "".join(chat_format.render_message(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat_format.parse(text)] == turns
    for _, t in turns:
        assert not any(c in chat_format.escape(t) for c in chat_format.CONTROL)


# ---- 3 decontamination

def brute_hits(text, items, width):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, which = split(text), set(), set()
    for i, t in items:
        x = split(t)
        k = min(width, len(x))
        wins = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if k else set()
        for j in range(len(w) - k + 1):
            if k and tuple(w[j : j + k]) in wins:
                hit.update(range(j, j + k))
                which.add(i)
    return len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(map(str, which))).encode()).hexdigest(), bool(hit)


def test_op3_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r.doc_id: brute_hits(r.text, items, 10) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op3_decontaminate(spark, SF).collect()}
    assert got == want and any(v[4] for v in want.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=24), max_size=6), st.text(alphabet="ab ", max_size=60), st.integers(1, 5))
def test_automaton_equals_brute_force(items, text, width):
    items = list(enumerate(items))
    automaton = decontaminate.SuffixAutomaton([(i, decontaminate.words_of(t.encode())) for i, t in items], width)
    words = decontaminate.words_of(text.encode())
    runs, which = automaton.scan(words)
    want = brute_hits(text, items, width)
    assert (len(words), sum(b - a for a, b in runs), len(which)) == want[:3]
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def test_decontamination_cuts_passages(spark):
    item = prose(50, 14)
    clean, dirty = prose(51, 200), prose(52, 60) + " " + item + ". " + prose(53, 60)
    rows = [(0, clean), (1, dirty), (2, item), (3, None), (4, "")]
    d = spark.createDataFrame([(i, t, 1, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, hits int, n_chars long")
    bench = spark.createDataFrame([(1, item), (2, None), (None, clean), (3, "...")], "item_id long, text string")
    for max_words in (1_000_000, 1):
        got = {r.doc_id: r for r in decontaminate.decontaminate(d, bench, max_words=max_words).collect()}
        assert sorted(got) == [0, 1, 3, 4] and got[0].text == clean and got[0].hits == 1 and got[3].text is None and got[4].text == ""
        assert item not in got[1].text and prose(52, 60) in got[1].text and prose(53, 60) in got[1].text and got[1].n_chars == len(got[1].text)
    assert decontaminate.find_contamination(d, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0


def test_item_blocks_add_up(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.find_contamination(d, items).select("doc_id", "hits", "items").collect()
    many = decontaminate.find_contamination(d, items, max_words=500).select("doc_id", "hits", "items").collect()
    assert sorted(one) == sorted(many)


def test_item_ids_may_be_strings(spark):
    said = prose(8, 12)
    items = spark.createDataFrame([("b-2", said), ("a/1", said), (None, said)], "item_id string, text string")
    (r,) = decontaminate.find_contamination(spark.createDataFrame([("x " + said,)], "text string"), items, max_words=5).collect()
    assert r["items"] == ["a/1", "b-2"] and [tuple(h) for h in r.hits] == [(1, 13)]


# ---- 6 fingerprints

def test_op6_neighbours_and_likeness(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text) for r in d.collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    chunker, prints = fingerprints.Chunker(), defaultdict(set)
    for i, (doc, text) in enumerate(rows):
        follower = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + follower[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.encode(chunker.chunks(text.encode())) and r.edited_fingerprint == fingerprints.encode(chunker.chunks(edited.encode()))
        assert r.near_next == fingerprints.likeness(fingerprints.decode(r.fingerprint), chunker.chunks(follower.encode()))
        prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got.values() if r.n_chars > 2000]
    assert 0.5 < np.median([r.near_edited for r in long]) < 0.75 and np.median([r.near_next for r in long]) < 0.1


def test_fingerprints_odd_rows(spark):
    d = with_oddities(spark)
    got = fingerprints.fingerprint_edits(d).collect()
    assert len(got) == d.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    (one,) = fingerprints.fingerprint_edits(d.where("doc_id = 6")).limit(1).collect()
    assert one.near_next == 1
    assert fingerprints.fingerprint_edits(d.limit(0)).count() == 0


def test_chunks_survive_shifts():
    chunker, text = fingerprints.Chunker(), prose(9, 2000).encode()
    assert fingerprints.likeness(chunker.chunks(text), chunker.chunks(b"some new words in front " + text)) > 0.95
    assert fingerprints.likeness(chunker.chunks(text[3000:6000]), chunker.chunks(text)) > 0.9  # contained
    ends = chunker.cuts(np.frombuffer(text, np.uint8))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes[:-1].min() >= 16 and sizes.max() <= 256


# ---- 7 packing

@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def whole_ids(texts):
    t = _tokenizer()
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_packing(pieces, d):
    want = Counter()
    rows = d.select("doc_id", "text").collect()
    for r, ids in zip(rows, whole_ids([r.text or "" for r in rows])):
        want[(r.doc_id, tuple(ids))] += 1
    by_doc, by_seq = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id][p.start].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
        ids = np.frombuffer(p.ids, "<u2").astype("<u4")
        assert zlib.crc32(ids.tobytes()) == p.ids_crc32 and len(ids) == p.length > 0
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        if n == 1 and sum(k[0] == doc for k in want) == 1:
            got = [p for s in sorted(by_doc[doc]) for p in by_doc[doc][s]]
            assert np.frombuffer(b"".join(bytes(p.ids) for p in got), "<u2").tolist() == list(ids) and all(p.doc_tokens == len(ids) for p in got)
    for pieces_ in by_seq.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= 1024
    return by_seq


def test_op7_round_trip(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    by_seq = check_packing(packing.pack(d, queries.tokenizer_path()).collect(), d)
    total = sum(n for s in by_seq.values() for _, n in s)
    assert len(by_seq) * 1024 - total <= 1024 * 8
    assert "ids" not in queries.op7_packing(spark, SF).columns


def test_packing_odd_rows(spark):
    d = with_oddities(spark).withColumn("ids", F.lit("clash"))
    check_packing(packing.pack(d, queries.tokenizer_path()).collect(), d)
    assert packing.pack(d.limit(0), queries.tokenizer_path()).count() == 0


def test_encoder_equals_tokenizer():
    odd = ["", " ", "  a", "a  b", "a \n b", "x\u00a0 y", " lead", "tail ", "a\tb  \n\n c", "don't we'll 's", "été  Ünï ×÷ Ж ж", "<|endoftext|> x <|endoftext|>", "a" * 3000, "1 2 3  4", "a \u3000 b", "\x1c a \x1d b", "ÿ ɏ ɐ"]
    encoder = packing.Encoder(queries.tokenizer_path())
    assert encoder.fast
    odd += [" " * 5000 + "x", "y" + "\n" * 3000, "".join(map(chr, range(1, 0x500)))]
    got = [encoder.encode(t) for t in odd]
    assert [np.frombuffer(g, "<u2").tolist() + [0] for g in got] == whole_ids(odd)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "x"])), max_size=6))
def test_encoder_equals_tokenizer_on_any_text(pieces):
    text = "".join(pieces)
    assert np.frombuffer(_encoder().encode(text), "<u2").tolist() + [0] == whole_ids([text])[0]


@functools.cache
def _encoder():
    return packing.Encoder(queries.tokenizer_path())


def test_packing_special_strings_and_ids_that_say_nothing(spark):
    """Strings of special tokens inside texts; ids all null or all equal still sample and pack every row."""
    made = [prose(i, 30) + (" <|endoftext|> end" if i % 3 == 0 else "") for i in range(60)]
    for ids in ([None] * 60, [7] * 60, range(60)):
        d = spark.createDataFrame(list(zip(ids, made)), "doc_id long, text string")
        check_packing(packing.pack(d, queries.tokenizer_path(), sample_rows=20).collect(), d)
    assert np.frombuffer(_encoder().encode("hello <|endoftext|> there"), "<u2").tolist() == whole_ids(["hello <|endoftext|> there"])[0][:-1]
    assert 50256 in whole_ids(["hello <|endoftext|> there"])[0]


def test_hilbert_neighbours_touch():
    bits, n = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# ---- 8 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.-_ +01239()é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_op8_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op8_pii(spark, SF).collect():
        base = brute_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        assert r.private == bool(r.spans) and r.n_added == len(r.spans.split(",")) * r.private - len(base)
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(filter(None, r.spans.split(",")))


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [f"text {i} call me at +1 (555) 010-{1000 + i} today" for i in range(12)]
    rows = [*seeds, "please call me at 555 010 7777 today", "order number is 20240101123 now", None, "", *[f"the number is {10**8 + i} here" for i in range(9)]]
    d = docs(spark, rows).withColumn("spans", F.lit(1))
    patterns = pii.learn_patterns(d)
    assert "phone|me at|" in patterns
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii.find_spans(d, patterns).collect()}
    assert got[12] == [(18, "phone", 30)] and got[13] == [] and got[14] == [] == got[15]
    clean = {r.doc_id: r for r in pii.redact(d.drop("spans"), patterns).collect()}
    assert clean[12].text == "please call me at [PHONE] today" and clean[12].n_chars == len(clean[12].text) and clean[13].text == rows[13] and clean[14].text is None
    assert pii.learn_patterns(d.limit(0)) == [] and pii.redact(d.limit(0).drop("spans"), []).count() == 0


def brute_patterns(texts, threshold=0.8, support=5):
    """Promoted patterns by plain dictionaries, and the spans that they add to each text."""
    graph = defaultdict(dict)
    looked = [pii.look(t or "") for t in texts]
    for t, (base, more, unseen) in zip(texts, looked):
        spans = [*base, *more, *unseen]
        for i, ((a, k, b), patterns) in enumerate(zip(spans, pii.contexts(t or "", spans))):
            for p in patterns:
                graph[p][k, t[a:b]] = graph[p].get((k, t[a:b]), False) or i < len(base) + len(more)
    conf = {}
    while True:
        belief = defaultdict(float)
        for p, c in conf.items():
            for x in graph[p]:
                belief[x] = max(belief[x], c)
        now = {}
        for p, found in graph.items():
            held = sum(1.0 if seed else belief[x] for x, seed in found.items())
            if held >= support and held >= threshold * len(found):
                now[p] = held / len(found)
        if len(now) == len(conf):
            break
        conf = now
    added = [[*more, *(s for s, ps in zip(unseen, pii.contexts(t or "", unseen)) if set(ps) & set(conf))] for t, (_, more, unseen) in zip(texts, looked)]
    return sorted(conf), added


def test_op8_learns_and_adds_what_brute_force_adds(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
        patterns, added = brute_patterns([r.text for r in rows])
        want = {r.doc_id: sorted([*brute_base(r.text), *more]) for r, more in zip(rows, added)}
        assert pii.learn_patterns(spark.createDataFrame(rows)) == patterns
        got = {r.doc_id: r.spans for r in queries.op8_pii(spark, sf).collect()}
        assert got == {i: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in x) for i, x in want.items()}
    assert patterns and any(added)


def test_scores_reach_their_fixpoint(spark):
    """A pattern promoted by instances that another pattern believes, and none by its own instances alone."""
    rows = [f"x{i} login {chr(97 + i)}u@site.org now" for i in range(8)] + ["x login zz@hosta end", "q login yy@hostb fin"]
    rows += [f"as account {w} yes" for w in ("zz@hosta", "yy@hostb")] + [f"as account {chr(97 + i)}u@site.org yes" for i in range(6)] + [f"odd thing w{i}@hostc here" for i in range(9)] + ["odd thing au@site.org here"]
    rows += ["as account vv@hostd yes"]
    got = pii.learn_patterns(spark.createDataFrame([(t,) for t in rows], "text string"))
    assert got == brute_patterns(rows)[0] and "email|login|" in got and "email|account|" in got and "email|thing|" not in got


def test_masked_identifiers_are_found_again(spark):
    """Identifiers whose form is broken so that the base matchers miss them, and look-alikes in other contexts."""
    import random

    r, said, masked, decoys = random.Random(3), {0: "write to", 1: "from host", 2: "card number", 3: "call me on"}, set(), 0
    rows = []
    for i in range(600):
        k, d = i % 4, lambda n: "".join(r.choice("0123456789") for _ in range(n))
        whole = [f"u{d(6)}@mail.example.org", f"10.{r.randrange(256)}.0.{r.randrange(256)}", "4111 1111 1111 1111", f"+1 ({d(3)}) 555-{d(4)}"][k]
        broken = [f"u{d(6)}@mailhost", f"10.{r.randrange(256)}.0.{300 + r.randrange(600)}", "4111 1111 1111 1112", f"({d(3)}) 555-{d(4)}"[1:].replace(") ", "-")][k]
        if k == 2:
            whole = next(c for c in (f"4{d(15)}" for _ in range(200)) if any(b[1] == 2 for b in brute_base(c)))
            broken = whole[:-1] + str((int(whole[-1]) + 1) % 10)
        text = f"{prose(i, 6)} {said[k]} {broken if i % 9 == 0 else whole} {prose(i + 999, 6)}"
        if i % 9 == 0:
            masked.add((len(rows), text.index(broken), text.index(broken) + len(broken)))
        rows.append(text)
        if i % 5 == 0:
            rows.append(f"{prose(i, 4)} part no {d(12 + i % 3)} {prose(i + 5, 4)}")
            decoys += 1
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(x.doc_id, s.start, s.end) for x in pii.find_spans(d, pii.learn_patterns(d)).collect() for s in x.spans if s not in x.base_spans}
    assert len(masked) >= 50 and decoys >= 100
    assert len(found & masked) >= 0.95 * len(masked) and len(found & masked) >= 0.95 * len(found)


def test_unrelated_rows_take_no_pattern_away(spark):
    rows = [*[f"please mail to user{i}@example.com now" for i in range(5)], "please mail to user9@localhost now"]  # five of six are believed
    few = docs(spark, rows)
    noise = spark.range(310_000).select(F.concat(F.lit("some noise "), F.col("id") + 10_000_000, F.lit(" here")).alias("text"))
    patterns = pii.learn_patterns(few.select("text"))
    assert "email|mail to|" in patterns and pii.learn_patterns(few.select("text").unionByName(noise)) == patterns


def test_pattern_table_finds_what_the_list_finds(spark):
    rows = [*[f"text {i} call me at +1 (555) 010-{1000 + i} today" for i in range(12)], "please call me at 555 010 7777 today", "please call me at 555 010 7777 today", "a me at 555 010 8888 b me at 555 010 9999 today", None, "", "no digits", "number 20240101123 now"]
    d = with_oddities(spark).unionByName(docs(spark, rows)).withColumns({"_key": F.lit("k"), "_more": F.lit(2), "_c0": F.lit(3)})
    patterns, table = pii.learn_patterns(d), pii.learn_patterns(d, listed=0)
    assert sorted(r.pattern for r in table.collect()) == patterns and patterns
    one, two = pii.find_spans(d, patterns), pii.find_spans(d, table)
    assert one.schema == two.schema and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert sum(len(r.spans) > len(r.base_spans) for r in two.collect()) == 3
    assert sorted(map(repr, pii.redact(d, patterns).collect())) == sorted(map(repr, pii.redact(d, table).collect()))


# ---- 9 sharding

def test_op9_laws(spark):
    rows = queries.op9_sharding(spark, SF).collect()
    d = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(d)
    for r in rows:
        raw = d[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_odd_rows(spark):
    d = with_oddities(spark)
    rows = sharding.shuffle_to_shards(d.repartition(5), 4, groups=2, fan=8, cell_rows=2).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in d.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shuffle_to_shards(d.limit(0)).count() == 0


def test_every_place_is_equally_likely(spark):
    """Two levels of the matrix over uneven partitions: each row's shard and slot have the mean of a uniform deal."""
    d = spark.range(0, 300, 1, 2).unionByName(spark.range(300, 600, 1, 7))
    place = np.zeros((600, 2))
    for seed in range(8):
        for r in sharding.shuffle_to_shards(d, 4, seed=seed, groups=3, fan=8, cell_rows=30).collect():
            place[r.id] += (r.shard, r.slot)
    for part in (place[:300], place[300:], place[::2]):
        assert abs(part[:, 0].mean() / 8 - 1.5) < 0.12 and abs(part[:, 1].mean() / 8 - 74.5) < 5


def test_communication_matrix_sums_and_spread():
    sent, room = [5, 0, 17, 40], [20, 21, 21]
    total = np.zeros((4, 3))
    for seed in range(300):
        m = sharding.communication_matrix(sent, room, seed)
        assert m.sum(axis=1).tolist() == sent and m.sum(axis=0).tolist() == room
        total += m
    assert np.allclose(total / 300, np.outer(sent, room) / 62, atol=0.6)


def test_hypergeometric_beyond_the_library():
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(400)]
    assert abs(np.mean(draws) - 400_000) < 100 and 380 < np.std(draws) < 620


# ---- 10 url filter

def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(url):
    host, path = split_url(url)
    best = (None, None)
    for said, rule in sorted(queries.RULES, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = (rule, said)
    return best


def test_op10_rules(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op10_url_filter(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        rule, said = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (*split_url(urls[r.page_id]), rule) and r.verdict in ("allow", "block")
        assert said is None or r.verdict == said


def test_url_components(spark):
    link = lambda to: f"<html><head><link rel='canonical' href='{to}'></head>"
    pages = [
        (0, "http://a.org/1", link("https://x.net/fr/bad")), (1, "https://A.org/1/?utm_source=z#t", None), (2, "http://b.org/2", link("http://a.org/1")),
        (3, "http://c.org/3", '<meta http-equiv="refresh" content="0; url=http://www.example.com/en/ok">'), (4, "http://d.org/4", link("http://c.org/3") + link("http://x.net/es/1")),
        (5, "http://e.org/5", ""), (6, None, link("http://x.net/fr/1")), (7, "no scheme", ""), (8, "http://x.net/fr/bad", ""), (9, "http://x.net/fr/bad", ""), (10, "http://f.org/q?page=2", ""), (11, "HTTP://EXAMPLE.com", "x"),
    ]
    d = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(d, queries.RULES).collect()}
    assert [got[i][1] for i in range(11)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow"]
    assert got[8][0] == "net/fr/" and got[0][0] is None and got[11] == (None, "allow")
    moved = spark.createDataFrame([("http://f.org/q?page=2", "http://x.net/fr/bad"), (None, "http://e.org/5")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(d, queries.RULES, moved).collect()}
    assert got[10] == "block" and got[5] == "allow"
    assert url_filter.filter_urls(d.limit(0), queries.RULES).count() == 0 and {r.verdict for r in url_filter.filter_urls(d, []).collect()} == {"allow"}


def test_relative_links_are_edges(spark):
    base = "https://x.org/a/b/c?q=1#f"
    want = {"/en/1": "https://x.org/en/1", "//h.net/x": "https://h.net/x", "d": "https://x.org/a/b/d", "../d": "https://x.org/a/d", "?p=2": "https://x.org/a/b/c?p=2", "http://y.org/z": "http://y.org/z", "mailto:a@b.org": "", "": "", "//[x": ""}
    assert {t: url_filter.resolve(base, t) for t in want} == want
    bad = [("http://x.net/fr/bad", "")]
    link = "<link rel=canonical href={}>".format
    pages = [*bad, ("http://x.net/1", link("/fr/bad")), ("http://x.net/a/2", "<meta http-equiv=refresh content='0; url=../fr/bad'>"), ("http://o.org/3", link("//x.net/fr/bad")), ("http://o.org/4", '<base href="http://x.net/fr/"><link href="bad" rel="canonical">'),
        ("http://x.net/5?a=1&b=2", ""), ("http://o.org/6", link('"http://x.net/5?a=1&amp;b=2"') + link("http://x.net/fr/bad")), ("http://o.org/7", link("/r?url=http://x.net/fr/bad")), ("http://o.org/8", "<meta http-equiv=refresh content=5>")]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(d, queries.RULES).collect()}
    assert [got[i] for i in range(9)] == ["block"] * 7 + ["allow"] * 2


def test_place_on_the_curve_does_not_depend_on_length():
    signs = np.random.default_rng(99).choice(np.array([-1.0, 1.0], np.float32), (packing.DIMENSIONS, 1 << 16))
    texts = [np.random.default_rng(i).zipf(1.3, 200).clip(max=60_000).astype("<u2") for i in range(20)]
    places = lambda texts: packing._keys(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), signs)
    assert places(texts).tolist() == places([np.tile(x, 64) for x in texts]).tolist() and len(set(places(texts))) == 20


@pytest.mark.parametrize("url", ["http://a@b:80/x?y#z", "x://", "a://b://c/d", "http://É.com/en/", "http://h?://q", "http://h\n/x"])
def test_url_parts(spark, url):
    (r,) = spark.createDataFrame([(url,)], "url string").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p")).collect()
    assert (r.h, r.p) == split_url(url)
