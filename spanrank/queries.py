"""Registered queries of the engine, each with the same query in DuckDB's SQL where that can express it.

``documents`` are the files of a corpus, ``benchmark`` items the queries.
``part`` gives a code corpus (a file for each brand and 200 part keys, a
definition for each part), orders and their lines a change history.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .eval import metrics, pagerank, strategies
from .functions import patterns as P
from .functions import text as X
from .functions.constants import PHRASE_STOP
from .operators import blocks, dedupe, evidence, grep, history, index, pack, score
from .plans.search import SearchConfig, candidates, search
from .sources.scratch import saved
from .streaming import refresh

PATTERNS = ["thr[a-z]+", "und", "tion[a-z]", "xyzzy"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; rows are dealt anew where the scan has fewer tasks than the cluster has cores (few files, few row groups)."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.select("doc_id").rdd.getNumPartitions() < cores else docs


def documents(spark, sf_dir) -> DataFrame:
    """Documents as files, named by a padded id so that names sort like ids."""
    return texts(spark, sf_dir).select(F.format_string("%012d", "doc_id").alias("file"), "text")


def code(spark, sf_dir) -> DataFrame:
    """The derived code corpus: files(file, text)."""
    part = table(spark, sf_dir, "part")
    file = F.concat(F.when(F.expr("p_partkey div 200") % 7 == 3, F.lit("tests/")).when(F.expr("p_partkey div 200") % 7 == 5, F.lit("vendor/")).otherwise(F.lit("src/")), F.regexp_replace("p_brand", "#", ""), F.lit("_"), F.expr("p_partkey div 200").cast("string"), F.lit(".py"))
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
    lines = F.concat(F.lit("def "), name, F.lit("(size):\n    # "), F.lower("p_type"), F.lit(" part\n    total = size * "), F.col("p_size").cast("string"), F.lit("\n    return pack_"), F.lower("p_type"), F.lit("(total)\n\n"))
    made = part.select(file.alias("file"), "p_partkey", lines.alias("t"))
    return made.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))), lambda s: s["t"]), "").alias("text"))


CODE = """
code AS (
  SELECT CASE WHEN (p_partkey // 200) % 7 = 3 THEN 'tests/' WHEN (p_partkey // 200) % 7 = 5 THEN 'vendor/' ELSE 'src/' END
         || replace(p_brand, '#', '') || '_' || (p_partkey // 200) || '.py' AS file,
         string_agg('def ' || replace(p_name, ' ', '_') || '_' || p_partkey || '(size):' || chr(10) || '    # ' || lower(p_type) || ' part' || chr(10)
           || '    total = size * ' || p_size || chr(10) || '    return pack_' || lower(p_type) || '(total)' || chr(10) || chr(10), '' ORDER BY p_partkey) AS text
  FROM part GROUP BY 1),
code_lines AS (SELECT file, unnest(range(1, len(l))) AS ln, unnest(l[:-2]) AS line FROM (SELECT file, string_split(text, chr(10)) AS l FROM code))"""
DOC_LINES = """
doc_lines AS (
  SELECT printf('%012d', doc_id) AS file, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS line
  FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')))"""
_PATS = [f"CASE WHEN regexp_matches(line, '{p}', 'i') THEN 1 ELSE 0 END" for p in PATTERNS]
HITS = f"""hits AS (SELECT file, ln, line, {' + '.join(_PATS)} AS n_patterns FROM doc_lines WHERE regexp_matches(line, '{'|'.join(PATTERNS)}', 'i'))"""


# ---- grep and windows

@register(f"WITH {DOC_LINES}, {HITS} SELECT file, CAST(ln AS INT) AS ln, n_patterns, strlen(line) AS line_bytes FROM hits")
def line_grep(spark, sf_dir):
    found = grep.line_hits(documents(spark, sf_dir), P.Matcher(spark, PATTERNS))
    return found.select("file", "ln", "n_patterns", F.octet_length("line").cast("long").alias("line_bytes"))


@register(f"WITH {DOC_LINES} " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) AS n_lines, count(DISTINCT file) AS n_files FROM doc_lines WHERE regexp_matches(line, '{p}', 'i')" for p in PATTERNS))
def grep_pattern_hits(spark, sf_dir):
    m = P.Matcher(spark, PATTERNS)
    hits = grep.with_hits(documents(spark, sf_dir), m).select("file", F.explode("hits").alias("h")).select("file", F.explode("h.pats").alias("i"))
    names = spark.createDataFrame(list(enumerate(PATTERNS)), "i int, pattern string")
    return names.join(hits, "i", "left").groupBy("pattern").agg(F.count("file").alias("n_lines"), F.countDistinct("file").alias("n_files"))


_GROUPS = """g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY ln) AS grp FROM (
  SELECT *, CASE WHEN ln - lag(ln) OVER (PARTITION BY file ORDER BY ln) <= 2 THEN 0 ELSE 1 END AS new FROM hits))"""


@register(f"WITH {DOC_LINES}, {HITS}, {_GROUPS} SELECT file, CAST(min(ln) AS INT) AS first_line, CAST(max(ln) AS INT) AS last_line, count(*) AS n_hits FROM g GROUP BY file, grp")
def merge_windows(spark, sf_dir):
    found = grep.hit_groups(documents(spark, sf_dir), P.Matcher(spark, PATTERNS), 1, 1)
    return found.select("file", (F.col("first") + 1).alias("first_line"), (F.col("last") + 1).alias("last_line"), F.col("hits").cast("long").alias("n_hits"))


@register(f"""WITH {DOC_LINES}, {HITS}, {_GROUPS},
n AS (SELECT file, max(ln) AS n FROM doc_lines GROUP BY file),
w AS (SELECT file, greatest(1, min(ln) - 1) AS a, least(any_value(n), max(ln) + 1) AS b FROM g JOIN n USING (file) GROUP BY file, grp),
ended AS (SELECT d.file, d.ln, d.line || CASE WHEN d.ln < n.n OR ends_with(t.text, chr(10)) THEN chr(10) ELSE '' END AS line
  FROM doc_lines d JOIN n USING (file) JOIN (SELECT printf('%012d', doc_id) AS file, text FROM documents) t USING (file))
SELECT w.file, CAST(a AS INT) AS line_start, CAST(b AS INT) AS line_end, substr(md5(string_agg(line, '' ORDER BY ln)), 1, 8) AS hash,
  CAST(greatest(1, length(string_agg(line, '' ORDER BY ln)) // 4) AS INT) AS tokens
FROM w JOIN ended e ON w.file = e.file AND e.ln BETWEEN a AND b GROUP BY ALL""")
def context_windows(spark, sf_dir):
    return grep.window_chunks(documents(spark, sf_dir), P.Matcher(spark, PATTERNS), 1, 1).select("file", "line_start", "line_end", "hash", "tokens")


@register(f"""WITH {DOC_LINES}, n AS (SELECT file, max(ln) AS n FROM doc_lines GROUP BY file)
SELECT file, CAST(lo AS INT) AS lo, CAST(least(n, lo + 6) AS INT) AS hi FROM (SELECT file, n, unnest(range(0, n, 4)) AS lo FROM n) WHERE lo = 0 OR lo - 4 + 6 < n""")
def fixed_windows(spark, sf_dir):
    lined = documents(spark, sf_dir).select("file", X.line_array(F.col("text")).alias("lines"))
    return lined.select("file", F.explode(blocks.windows(F.size("lines"), 6, 4, True)).alias("s")).select("file", "s.lo", "s.hi")


@register(f"""WITH {DOC_LINES}, {HITS}, s AS (SELECT file, greatest(0, ln - 4) AS lo, ln + 3 AS hi FROM hits),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT file, CAST(min(lo) AS INT) AS lo, CAST(max(hi) AS INT) AS hi FROM k GROUP BY file, grp""")
def interval_union(spark, sf_dir):
    found = grep.line_hits(documents(spark, sf_dir), P.Matcher(spark, PATTERNS))
    return strategies.interval_union(found.select("file", F.greatest(F.lit(0), F.col("ln") - 4).alias("lo"), (F.col("ln") + 3).alias("hi")))


# ---- code structure and lexical scores

@register(f"WITH {CODE} SELECT file, CAST(ln AS INT) AS ln, regexp_extract(line, 'def\\s+(\\w+)', 1) AS symbol FROM code_lines WHERE regexp_matches(line, '^\\s*(export\\s+)?(async\\s+)?(def|class)\\b')")
def definition_lines(spark, sf_dir):
    lines = code(spark, sf_dir).select("file", F.posexplode(X.line_array(F.col("text"))).alias("i", "line")).where(X.is_definition(F.col("line")))
    return lines.select("file", (F.col("i") + 1).alias("ln"), X.symbol(F.col("line")).alias("symbol"))


@register(f"""WITH {CODE}, d AS (SELECT file, ln - 1 AS lo FROM code_lines WHERE regexp_matches(line, '^def ')), n AS (SELECT file, max(ln) AS n FROM code_lines GROUP BY file)
SELECT file, CAST(lo AS INT) AS lo, CAST(coalesce(lead(lo) OVER (PARTITION BY file ORDER BY lo), n) AS INT) AS hi FROM d JOIN n USING (file)""")
def block_spans(spark, sf_dir):
    return blocks.blocks(code(spark, sf_dir)).select("file", "lo", "hi")


@register(f"""WITH {CODE}, t AS (SELECT file, ln FROM code_lines WHERE contains(line, 'return')), d AS (SELECT file, ln, line FROM code_lines WHERE starts_with(line, 'def ')),
h AS (SELECT t.file, t.ln, max(d.ln) AS head FROM t JOIN d ON t.file = d.file AND d.ln < t.ln GROUP BY ALL),
e AS (SELECT h.file, h.ln, h.head, min(d.ln) AS nxt FROM h LEFT JOIN d ON h.file = d.file AND d.ln > h.head GROUP BY ALL), n AS (SELECT file, max(ln) AS n FROM code_lines GROUP BY file)
SELECT e.file, CAST(e.head AS INT) AS line_start, CAST(coalesce(nxt - 1, n) AS INT) AS line_end, regexp_extract(c.line, 'def\\s+(\\w+)', 1) AS symbol
FROM e JOIN n USING (file) JOIN code_lines c ON c.file = e.file AND c.ln = e.head""")
def enclosing_blocks(spark, sf_dir):
    m = P.Matcher(spark, ["return"])
    return blocks.enclosing_chunks(code(spark, sf_dir), m, 0, 0).select("file", "line_start", "line_end", "symbol")


@register(f"""WITH {CODE}, r AS (SELECT file, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS term FROM code_lines)
SELECT file, count(*) AS n FROM r WHERE contains(term, '_') AND length(term) >= 5 GROUP BY file""")
def rare_terms(spark, sf_dir):
    lines = code(spark, sf_dir).select("file", F.transform(X.line_array(F.col("text")), X.bare).alias("l"))
    return lines.select("file", score.rare_terms(F.col("l")).cast("long").alias("n")).where("n > 0")


@register(f"""WITH {CODE}, h AS (SELECT file, ln FROM code_lines WHERE regexp_matches(line, 'widget|return pack_small', 'i')),
n AS (SELECT file, max(ln) AS n FROM code_lines GROUP BY file),
g AS (SELECT file, ln, sum(new) OVER (PARTITION BY file ORDER BY ln) AS grp FROM (SELECT *, CASE WHEN ln - lag(ln) OVER (PARTITION BY file ORDER BY ln) <= 2 THEN 0 ELSE 1 END AS new FROM h)),
w AS (SELECT file, greatest(1, min(ln) - 1) AS a, least(any_value(n), max(ln) + 1) AS b FROM g JOIN n USING (file) GROUP BY file, grp),
c AS (SELECT w.file, a, b, count(*) AS lines, max(CASE WHEN regexp_matches(line, 'widget', 'i') THEN 1 ELSE 0 END) AS p1, max(CASE WHEN regexp_matches(line, 'return pack_small', 'i') THEN 1 ELSE 0 END) AS p2,
  sum(CASE WHEN regexp_matches(line, 'widget|return pack_small', 'i') THEN len(list_filter(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda t: contains(t, '_') AND length(t) >= 5)) ELSE 0 END) AS rare,
  max(CASE WHEN regexp_matches(line, 'widget|return pack_small', 'i') AND starts_with(line, 'def ') THEN 1 ELSE 0 END) AS def, sum(CASE WHEN starts_with(ltrim(line), '#') THEN 1 ELSE 0 END) AS remarks
  FROM w JOIN code_lines l ON w.file = l.file AND l.ln BETWEEN a AND b GROUP BY w.file, a, b)
SELECT file, CAST(a AS INT) AS line_start, CAST(b AS INT) AS line_end, CAST(p1 + p2 AS INT) AS matches,
  CAST(greatest(0, 5 * (p1 + p2) + CASE WHEN p1 + p2 = 2 THEN 25 ELSE 0 END + least(15, 3 * rare) + 25 * def - CASE WHEN starts_with(file, 'tests/') THEN 8 ELSE 0 END
    - CASE WHEN starts_with(file, 'vendor/') THEN 15 ELSE 0 END - CASE WHEN remarks / lines > 0.7 THEN 10 ELSE 0 END) AS DOUBLE) AS score FROM c""")
def lexical_score(spark, sf_dir):
    m = P.Matcher(spark, ["widget", "return pack_small"])
    return score.lexical_score(grep.window_chunks(code(spark, sf_dir), m, 1, 1), m).select("file", "line_start", "line_end", "matches", "score")


# ---- tokens and ranking

_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND length(t) - {len(s)} >= 4 THEN left(t, length(t) - {len(s)})" for s in ("ation", "izing", "ized", "ing", "ies", "ion", "ers", "ed", "es", "er", "s")) + " ELSE t END"


@register(f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]{{3,}}')) AS w FROM documents),
s AS (SELECT lower(w) AS whole, list_filter([lower(x) FOR x IN string_split(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_')], lambda x: length(x) >= 3) AS p FROM w),
t AS (SELECT {_STEM} AS token FROM (SELECT unnest(p) AS t FROM s) UNION ALL SELECT whole FROM s WHERE len(p) > 1) SELECT token, count(*) AS n FROM t GROUP BY token""")
def semantic_tokens(spark, sf_dir):
    return score.semantic_counts(texts(spark, sf_dir).select("text"), "text")


TF = "tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS t FROM documents) GROUP BY ALL)"


@register(f"WITH {TF}, n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(ln(1 + any_value(n) / (1 + count(*))), 6) AS idf FROM tf, n GROUP BY term")
def term_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tf = score.term_counts(docs, ["doc_id"], X.terms(F.col("text")))
    total = docs.agg(F.count("*").alias("n"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(total))
    return stats.select("term", "df", "cf", F.round(F.log(1 + F.col("n") / (1 + F.col("df"))), 6).alias("idf"))


_Q = "the threat of entire region nation"


@register(f"""WITH {TF}, n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, ln(1 + any_value(n) / (1 + count(*))) AS idf FROM tf, n GROUP BY term),
q AS (SELECT t AS term, count(*) AS c FROM (SELECT unnest(regexp_extract_all('{_Q}', '[a-z0-9_]{{3,}}')) AS t) GROUP BY t),
qv AS (SELECT q.term, c * coalesce(idf, ln(1 + n)) AS qw FROM q LEFT JOIN idf USING (term), n), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM qv),
s AS (SELECT doc_id, sum(coalesce(qw, 0) * tf * idf) AS dot, sqrt(sum((tf * idf) ** 2)) AS dn FROM tf JOIN idf USING (term) LEFT JOIN qv USING (term) GROUP BY doc_id)
SELECT doc_id, round(dot / (dn * qn), 6) AS cos FROM s, qn WHERE dot > 0""")
def tfidf_cosine(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return score.cosine_to_query(docs, ["doc_id"], "text", _Q, spark, saved).select("doc_id", F.round("cos", 6).alias("cos"))


@register(f"""WITH tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}')) AS t FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}')) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS qid, t AS term, count(*) AS qw FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, doc_id, round(sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id)
SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 40""")
def bm25_topk(spark, sf_dir):
    cut = documents(spark, sf_dir).select("file", F.lit(0).alias("lo"), F.lit(1).alias("hi"), "text")
    built = index.build_index(cut, X.terms(F.col("text")), saved)
    found = index.bm25(built, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), X.terms(F.col("text")))
    return found.select("qid", F.col("file").cast("long").alias("doc_id"), "score", "rank")


_WINDOWS = """cut AS (SELECT file, lo, least(n, lo + 60) AS hi FROM (SELECT file, n, unnest(range(0, n, 40)) AS lo FROM (SELECT file, max(ln) AS n FROM doc_lines GROUP BY file)) WHERE lo = 0 OR lo - 40 + 60 < n),
tf AS (SELECT file, lo, hi, t AS term, count(*) AS tf FROM (SELECT c.file, lo, hi, unnest(regexp_extract_all(lower(line), '[a-z0-9_]{3,}')) AS t FROM cut c JOIN doc_lines d ON d.file = c.file AND d.ln > lo AND d.ln <= hi) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM cut), q AS (SELECT item_id AS qid, t AS term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS t FROM benchmark) GROUP BY ALL)"""


def _window_sql(share: str, unseen: str) -> str:
    return f"""WITH {DOC_LINES}, {_WINDOWS}, idf AS (SELECT term, ln({share}) AS idf FROM tf, n GROUP BY term),
qv AS (SELECT qid, q.term, c * coalesce(idf, {unseen}) AS qw FROM q LEFT JOIN idf USING (term), n), qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM qv GROUP BY qid),
w AS (SELECT file, lo, hi, term, tf * idf AS w FROM tf JOIN idf USING (term)), dn AS (SELECT file, lo, hi, sqrt(sum(w * w)) AS dn FROM w GROUP BY ALL),
s AS (SELECT qid, file, lo, hi, round(any_value(dot) / (any_value(dn) * any_value(qn)), 6) AS cos FROM (SELECT qid, file, lo, hi, sum(w * qw) AS dot FROM w JOIN qv USING (term) GROUP BY ALL) JOIN dn USING (file, lo, hi) JOIN qn USING (qid) GROUP BY ALL)
SELECT qid, file, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, cos, CAST(row_number() OVER (PARTITION BY qid ORDER BY cos DESC, file DESC, lo DESC) AS INT) AS rank FROM s WHERE cos > 0 QUALIFY rank <= 40"""


@register(_window_sql("1 + any_value(n) / (1 + count(*))", "ln(1 + n)"))
def tfidf_window_recall(spark, sf_dir):
    return index.tfidf_windows(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))


@register(_window_sql("any_value(n) / (1 + count(*))", "0"))
def tfidf_plain_windows(spark, sf_dir):
    """The baseline whose idf may be negative."""
    return index.tfidf_windows(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), smooth=False)


@register("""WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id AS id, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS sim FROM q, embeddings)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS INT) AS rank FROM s WHERE sim > 0 QUALIFY rank <= 40""")
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.where("id % 100 = 0").withColumnRenamed("id", "qid")
    return index.dense_top(vectors, asked).select("qid", "id", "rank")


_COS = "round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6)"


@register(f"""WITH q AS (SELECT vec_id AS qid, label, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT qid, vec_id AS id, {_COS} AS sim FROM q, embeddings WHERE {_COS} > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) <= 40),
l AS (SELECT qid, vec_id AS id, 10.0 / (1 + abs(qid - vec_id)) AS score FROM q JOIN embeddings e USING (label) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) <= 40),
b AS (SELECT qid, id, coalesce(score, 0.0) AS s, coalesce(sim, 0.0) AS d FROM l FULL JOIN d USING (qid, id)),
f AS (SELECT qid, id, d, round((s / greatest(max(s) OVER (PARTITION BY qid), 1e-12) + d / greatest(max(d) OVER (PARTITION BY qid), 1e-12)) / 2, 9) AS fused FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id DESC) AS rank, row_number() OVER (PARTITION BY qid ORDER BY d DESC, fused DESC, id DESC) AS dr FROM f)
SELECT qid, id, fused, CAST(rank AS INT) AS rank FROM r WHERE rank <= 40 OR dr <= 40""")
def hybrid_fusion(spark, sf_dir):
    """Labels stand for the lexical list: vectors of the query's label score by closeness of id."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("vector"))
    lexical = vectors.join(asked.select("qid", "label"), "label").select("qid", F.col("vec_id").alias("id"), (10.0 / (1 + F.abs(F.col("qid") - F.col("vec_id")))).alias("score"))
    lexical = index.top_by(lexical, 40, F.desc("score"), F.desc("id"))
    dense = index.dense_top(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked)
    return index.fuse(lexical, dense)


# ---- duplicates

@register("SELECT source AS file, doc_id AS line_start, substr(md5(text), 1, 8) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, source, doc_id) = 1")
def exact_duplicates(spark, sf_dir):
    """Documents as chunks of their source: of equal texts the first by score, file and place stays."""
    docs = texts(spark, sf_dir).where("text IS NOT NULL")
    chunks = docs.select(F.col("source").alias("file"), F.col("doc_id").alias("line_start"), F.col("doc_id").alias("line_end"), F.col("n_chars").cast("double").alias("score"), F.md5("text").alias("hash"), F.md5("text").alias("copies"), F.lit("").alias("code"))
    return dedupe.dedupe(chunks, 2.0, "copies").select("file", "line_start", F.substring("hash", 1, 8).alias("hash"))


@register("SELECT substr(md5(text), 1, 8) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def copy_groups(spark, sf_dir):
    """Sizes of the groups of equal documents, summed on both sides of the exchange."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1").select(F.substring("h", 1, 8).alias("hash"), "copies", "first_id")


@register(f"""WITH {DOC_LINES}, n AS (SELECT file, max(ln) AS n FROM doc_lines GROUP BY file),
w AS (SELECT file, lo, least(n, lo + 6) AS hi FROM (SELECT file, n, unnest(range(0, n, 2)) AS lo FROM n) WHERE lo = 0 OR lo - 2 + 6 < n),
i AS (SELECT DISTINCT w.file, lo, trim(line) AS line FROM w JOIN doc_lines d ON w.file = d.file AND d.ln > lo AND d.ln <= hi WHERE trim(line) <> ''),
s AS (SELECT file, lo, count(*) AS n FROM i GROUP BY ALL), k AS (SELECT a.file, a.lo AS a, b.lo AS b, count(*) AS k FROM i a JOIN i b ON a.file = b.file AND a.line = b.line AND a.lo < b.lo GROUP BY ALL)
SELECT k.file, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(k / (sa.n + sb.n - k), 6) AS jaccard FROM k JOIN s sa ON sa.file = k.file AND sa.lo = a JOIN s sb ON sb.file = k.file AND sb.lo = b WHERE k / (sa.n + sb.n - k) >= 0.7""")
def near_duplicate_windows(spark, sf_dir):
    lined = documents(spark, sf_dir).select("file", X.line_array(F.col("text")).alias("lines"))
    cut = lined.select("file", "lines", F.explode(blocks.windows(F.size("lines"), 6, 2, True)).alias("s"))
    chunks = cut.select("file", F.col("s.lo").alias("line_start"), F.array_join(F.slice("lines", F.col("s.lo") + 1, F.col("s.hi") - F.col("s.lo")), "").alias("code"))
    return dedupe.near_pairs(chunks)


@register()
def deduplicated_chunks(spark, sf_dir):
    m = P.Matcher(spark, PATTERNS)
    return candidates(documents(spark, sf_dir), m, SearchConfig(before=1, after=1)).select("file", "line_start", "line_end", "score", "hash")


# ---- change history

CHANGES = "ch AS (SELECT l_orderkey AS cid, l_partkey AS file, sum(l_quantity) AS changed FROM lineitem GROUP BY ALL)"
_PAIRS = f"{CHANGES}, k AS (SELECT cid FROM ch GROUP BY cid HAVING count(*) BETWEEN 2 AND 10), p AS (SELECT a.file AS a, b.file AS b, count(*) AS c FROM ch a JOIN k USING (cid) JOIN ch b ON a.cid = b.cid AND a.file <> b.file GROUP BY ALL)"
_LIFT = f"{_PAIRS}, n AS (SELECT count(DISTINCT cid) AS n FROM ch), df AS (SELECT file, count(*) AS df FROM ch GROUP BY file), r AS (SELECT a, b, c, ln((c / n + 1 / (4 * n)) / (da.df / n * db.df / n + 1 / (4 * n))) AS r FROM p JOIN df da ON da.file = a JOIN df db ON db.file = b, n)"


def changes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cid"), F.col("l_partkey").alias("file")).agg(F.sum("l_quantity").alias("changed"))


def lifted(spark, sf_dir):
    ch = changes(spark, sf_dir)
    n = ch.agg(F.countDistinct("cid").alias("n")).first().n
    return history.lift(history.pairs(ch), history.frequencies(ch).withColumnRenamed("file", "item"), F.lit(n).cast("double"))


@register(f"WITH {_PAIRS} SELECT a, b, c FROM p")
def cochange_pairs(spark, sf_dir):
    return history.pairs(changes(spark, sf_dir))


@register(f"WITH {_LIFT} SELECT a, b, c, round(r, 6) AS r FROM r")
def cochange_lift(spark, sf_dir):
    return lifted(spark, sf_dir).select("a", "b", "c", F.round("r", 6).alias("r"))


_CHURN = """sz AS (SELECT cid, count(*) AS k FROM ch GROUP BY cid), now AS (SELECT max(epoch(o_orderdate)) AS now FROM orders),
w AS (SELECT file, ln(1 + sum(ln(1 + changed) / sqrt(k) * exp(-(now - epoch(o_orderdate)) / (86400.0 * 90)))) AS w FROM ch JOIN sz USING (cid) JOIN orders ON o_orderkey = cid, now GROUP BY file), churn AS (SELECT file, w / (SELECT max(w) FROM w) AS churn FROM w)"""


def commits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cid"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))


@register(f"WITH {CHANGES}, {_CHURN} SELECT file, round(churn, 6) AS churn FROM churn")
def churn_decay(spark, sf_dir):
    return history.churn(changes(spark, sf_dir), commits(spark, sf_dir)).select("file", F.round("churn", 6).alias("churn"))


@register(f"""WITH {_LIFT}, x AS (SELECT b, round(max(r), 9) AS r FROM r WHERE a IN (1, 2, 3) AND b NOT IN (1, 2, 3) AND r > 0 GROUP BY b ORDER BY r DESC, b LIMIT 16)
SELECT b AS item, round(r / (SELECT max(r) FROM x), 6) AS w FROM x""")
def symbol_expansion(spark, sf_dir):
    return history.expand_symbols(lifted(spark, sf_dir), [1, 2, 3], 16).select("item", F.round("w", 6).alias("w"))


@register(f"""WITH {_LIFT}, {_CHURN}, t AS (SELECT p_partkey AS file, CAST(p_size AS DOUBLE) AS s FROM part), anc(a, s) AS (VALUES (1, 10.0), (2, 8.0), (3, 5.0)),
wa AS (SELECT a, exp(2 * s / 10.0) / (SELECT sum(exp(2 * s / 10.0)) FROM anc) AS wa FROM anc), co AS (SELECT b AS file, sum(wa * r) AS s FROM r JOIN wa USING (a) WHERE r > 0 GROUP BY b),
m AS (SELECT max(s) AS m FROM t) SELECT t.file, round((t.s / m + 0.3 * coalesce(churn, 0) + 0.5 * coalesce(co.s / (SELECT max(s) FROM co), 0)) * m, 6) AS fscore FROM t LEFT JOIN churn USING (file) LEFT JOIN co USING (file), m""")
def file_fusion(spark, sf_dir):
    scores = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").cast("double").alias("score"))
    co = history.cochange(lifted(spark, sf_dir), [(1, 10.0), (2, 8.0), (3, 5.0)])
    return history.fuse_files(scores, history.churn(changes(spark, sf_dir), commits(spark, sf_dir)), co).select("file", F.round("fscore", 6).alias("fscore"))


# ---- packing and evidence

_READ = """t AS (SELECT file, count(*) AS hits FROM hits GROUP BY file), s AS (SELECT file, hits, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM t JOIN (SELECT printf('%012d', doc_id) AS file, text FROM documents) USING (file)),
r AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY hits DESC, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s)"""


@register(f"WITH {DOC_LINES}, {HITS}, {_READ} SELECT file, CAST(hits AS INT) AS hits, tokens FROM r WHERE used < 20000")
def read_until_budget(spark, sf_dir):
    ranked = strategies.whole_files(documents(spark, sf_dir), P.Matcher(spark, PATTERNS))
    return metrics.read_until(ranked, 20000).select("file", "hits", "tokens")


def _per_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("lang").alias("qid"), F.col("doc_id").alias("row"), F.col("source").alias("file"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), (F.col("doc_id") % 50).cast("double").alias("score"), X.estimate_tokens(F.col("text")).alias("tokens"), F.array().cast("array<string>").alias("rank_reason"), F.lit(False).alias("recall"))
    return rows.withColumn("rank_pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "row")))


@register("""WITH RECURSIVE c AS (SELECT lang AS qid, doc_id AS r, source AS f, CAST(doc_id % 50 AS DOUBLE) AS s, greatest(1, length(text) // 4) AS t FROM documents WHERE lang IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, r) AS k FROM c),
caller AS (SELECT o.* FROM o JOIN o AS a ON a.qid = o.qid AND a.k = 1 AND o.f <> a.f QUALIFY row_number() OVER (PARTITION BY o.qid ORDER BY o.k) = 1),
p(qid, n, rows, files, used) AS (
  SELECT q.qid, 0, CASE WHEN t <= 4000 THEN [r] ELSE [] END, CASE WHEN t <= 4000 THEN [f] ELSE [] END, CASE WHEN t <= 4000 THEN t ELSE 0 END FROM (SELECT DISTINCT qid FROM o) q LEFT JOIN caller USING (qid)
  UNION ALL SELECT qid, n + 1, list_append(rows, r), list_append(files, f), used + t FROM (
    SELECT p.*, o.r, o.f, o.t FROM p JOIN o ON o.qid = p.qid AND NOT list_contains(p.rows, o.r) AND p.used + o.t <= 4000
    QUALIFY row_number() OVER (PARTITION BY p.qid ORDER BY o.s - 6 * len(list_filter(p.files, lambda x: x = o.f)) DESC, o.k) = 1)),
e AS (SELECT qid, max(n) AS n FROM p GROUP BY qid),
l AS (SELECT qid, unnest(rows) AS r, unnest(range(1, len(rows) + 1)) AS i FROM p JOIN e USING (qid, n))
SELECT qid, r AS row, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, i) AS INT) AS place FROM l JOIN o USING (qid, r)""")
def budget_pack(spark, sf_dir):
    """Each language's documents packed into 4,000 tokens with a discount for the same source."""
    return pack.pack(_per_language(spark, sf_dir), 4000).drop("cut")


@register(f"""WITH {DOC_LINES}, {HITS}, w AS (SELECT file, (ln - 1) // 6 AS b, count(*) AS n FROM hits GROUP BY ALL), top AS (SELECT file, b FROM w WHERE n >= 3),
s AS (SELECT file, ln - 1 AS lo, ln + 2 AS hi FROM hits) SELECT file, CAST(lo AS INT) AS lo FROM s WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.file = s.file AND s.lo <= top.b * 6 + 5 AND top.b * 6 <= s.hi)""")
def overlap_antijoin(spark, sf_dir):
    hits = grep.line_hits(documents(spark, sf_dir), P.Matcher(spark, PATTERNS))
    top = hits.groupBy("file", F.expr("(ln - 1) div 6").alias("b")).agg(F.count("*").alias("n")).where("n >= 3").select("file", (F.col("b") * 6).alias("first"), (F.col("b") * 6 + 5).alias("last"))
    spans = hits.select("file", (F.col("ln") - 1).alias("lo"), (F.col("ln") + 2).alias("hi"))
    return pack.clear_of(spans, top).select("file", "lo")


@register(f"""WITH {CODE}, d AS (SELECT file, ln, line, CASE WHEN starts_with(file, 'tests/') THEN 1 ELSE 0 END AS test, row_number() OVER (ORDER BY file, ln) AS pos FROM code_lines WHERE contains(line, 'def red_')),
best AS (SELECT * FROM d WHERE test = 0 ORDER BY pos LIMIT 1), caller AS (SELECT d.* FROM d, best WHERE d.file <> best.file AND d.test = 0 ORDER BY d.pos LIMIT 1), tst AS (SELECT * FROM d WHERE test = 1 ORDER BY pos LIMIT 1)
SELECT 'definition' AS slot, file, CAST(ln AS INT) AS line_start FROM best UNION ALL SELECT 'caller', file, CAST(ln AS INT) FROM caller UNION ALL SELECT 'test', file, CAST(ln AS INT) FROM tst""")
def objective_slots(spark, sf_dir):
    """What the packer reserves room for.

    Of the definitions only the first of each file can be one of them, so only
    these go to the packer.
    """
    lines = code(spark, sf_dir).select("file", F.posexplode(X.line_array(F.col("text"))).alias("i", "line")).where(F.col("line").contains("def red_"))
    first = lines.groupBy("file").agg((F.min("i") + 1).cast("int").alias("line_start")).withColumn("qid", F.lit(0))
    slim = first.select("qid", F.xxhash64("file", "line_start").alias("row"), F.row_number().over(Window.partitionBy("qid").orderBy("file")).alias("rank_pos"), "file", "line_start", F.col("line_start").alias("line_end"), F.lit(1.0).alias("score"), F.lit(1).alias("tokens"), F.array(F.lit("definition")).alias("rank_reason"), F.lit(False).alias("recall"))
    return slim.join(pack.reserved(slim).select("row", "slot"), "row").select("slot", "file", "line_start")


_WHOLE = " UNION ALL ".join(f"SELECT '{p}' AS pattern, bool_or(regexp_matches(text, '{p}', 'i')) AS inside, bool_or(regexp_matches(text, '{p}', 'i') AND printf('%012d', doc_id) IN (SELECT file FROM kept)) AS kept FROM documents" for p in [*PATTERNS, "233[.]233"])


@register(f"WITH {DOC_LINES}, {HITS}, {_READ}, kept AS (SELECT file FROM r WHERE used < 400), p AS ({_WHOLE}) SELECT pattern, CASE WHEN inside THEN 'outside' ELSE 'absent' END AS state FROM p WHERE NOT kept")
def negative_evidence(spark, sf_dir):
    """Patterns that the documents read under a budget lack, and whether the corpus has them."""
    files = documents(spark, sf_dir)
    read = metrics.read_until(strategies.whole_files(files, P.Matcher(spark, PATTERNS)), 400)
    kept = files.join(read.select("file"), "file", "left_semi").withColumnRenamed("text", "code")
    return evidence.pattern_absences(files, kept, P.Matcher(spark, [*PATTERNS, "233[.]233"])).select("pattern", "state")


@register(f"WITH {CODE} SELECT DISTINCT 'pack_' || lower(p_type) AS symbol FROM part")
def undefined_symbols(spark, sf_dir):
    """Names that the code's lines use or define, less those that a line defines."""
    lines = code(spark, sf_dir).select(F.explode(X.line_array(F.col("text"))).alias("code"))
    return evidence.undefined_symbols(lines.select("code", F.coalesce(X.symbol(X.bare(F.col("code"))), F.lit("")).alias("symbol")))


# ---- braces, symbols and languages

def braces(spark, sf_dir) -> DataFrame:
    """A second derived corpus: files of functions with braces, some in TypeScript and Rust."""
    part = table(spark, sf_dir, "part")
    file = F.concat(F.lit("lib/"), F.regexp_replace("p_brand", "#", ""), F.lit("_"), F.expr("p_partkey div 100").cast("string"), F.when(F.expr("p_partkey div 100") % 3 == 0, ".ts").when(F.expr("p_partkey div 100") % 3 == 1, ".rs").otherwise(".js"))
    head = F.when(F.expr("p_partkey div 100") % 3 == 1, "pub fn ").otherwise("export function ")
    lines = F.concat(head, F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("(size) {\n  if (size > "), F.col("p_size").cast("string"), F.lit(") {\n    return total(size);\n  }\n}\n\n"))
    made = part.select(file.alias("file"), "p_partkey", lines.alias("t")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))).alias("l"))
    return made.select("file", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))


_BRACES = """placed AS (SELECT 'lib/' || replace(p_brand, '#', '') || '_' || (p_partkey // 100) || CASE (p_partkey // 100) % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.rs' ELSE '.js' END AS file,
  replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_partkey FROM part),
b AS (SELECT *, 6 * (row_number() OVER (PARTITION BY file ORDER BY p_partkey) - 1) AS base, 6 * count(*) OVER (PARTITION BY file) AS n FROM placed)"""


@register(f"WITH {_BRACES} SELECT file, CAST(base + 2 AS INT) AS line_start, CAST(base + 3 AS INT) AS line_end FROM b")
def brace_blocks(spark, sf_dir):
    """The block about each return: from the nearest line that opens one to the line before that one's end."""
    m = P.Matcher(spark, ["return total"])
    return blocks.enclosing_chunks(braces(spark, sf_dir), m, 0, 0).select("file", "line_start", "line_end")


@register(f"WITH {_BRACES}, {CODE} SELECT DISTINCT file, 'c_like' AS language FROM b UNION SELECT file, 'python' FROM code")
def languages(spark, sf_dir):
    files = braces(spark, sf_dir).unionByName(code(spark, sf_dir))
    return files.select("file", X.language(F.col("file")).alias("language"))


@register(f"WITH {_BRACES} SELECT name, file, CAST(base AS INT) AS lo, CAST(least(n, base + 26) AS INT) AS hi FROM b WHERE ends_with(file, '.rs') OR ends_with(file, '.ts')")
def language_tasks(spark, sf_dir):
    files = braces(spark, sf_dir)
    both = strategies.language_tasks(files, "rust").unionByName(strategies.language_tasks(files, "typescript"))
    return both.select("name", "file", "lo", "hi")


@register(f"""WITH {CODE}, l AS (SELECT file, ln, line FROM code_lines WHERE starts_with(ltrim(line), 'return pack_')), d AS (SELECT file, ln, line FROM code_lines WHERE starts_with(line, 'def '))
SELECT file, CAST(ln - 3 AS INT) AS line_start, CAST(ln + 1 AS INT) AS line_end,
  CAST(greatest(0, 5 + 3 + 12 - CASE WHEN starts_with(file, 'tests/') THEN 8 ELSE 0 END - CASE WHEN starts_with(file, 'vendor/') THEN 15 ELSE 0 END) AS DOUBLE) AS score FROM l""")
def symbol_scores(spark, sf_dir):
    """Chunks named by their symbol: its definition line counts though the pattern hits another line."""
    m = P.Matcher(spark, ["return pack_"])
    return score.lexical_score(blocks.enclosing_chunks(code(spark, sf_dir), m, 0, 0), m).select("file", "line_start", "line_end", "score")


@register(f"WITH {CODE} SELECT regexp_extract(line, 'def\\s+(\\w+)', 1) AS name, file, CAST(ln - 1 AS INT) AS ln FROM code_lines WHERE starts_with(line, 'def ') AND NOT starts_with(file, 'tests/')")
def public_symbols(spark, sf_dir):
    return strategies.collect_symbols(code(spark, sf_dir)).select("name", "file", "ln")


@register(f"""WITH {CODE}, n AS (SELECT file, max(ln) AS n FROM code_lines GROUP BY file), d AS (SELECT regexp_extract(line, 'def\\s+(\\w+)', 1) AS name, file, ln - 1 AS ln FROM code_lines WHERE starts_with(line, 'def ') AND NOT starts_with(file, 'tests/'))
SELECT name, d.file, CAST(ln AS INT) AS lo, CAST(coalesce(lead(ln) OVER (PARTITION BY d.file ORDER BY ln), n) AS INT) AS hi FROM d JOIN n USING (file)""")
def definition_sites(spark, sf_dir):
    files = code(spark, sf_dir)
    return strategies.definition_sites(strategies.collect_symbols(files), files)


@register(f"""WITH {CODE}, n AS (SELECT file, max(ln) AS n FROM code_lines GROUP BY file), h AS (SELECT file, ln - 1 AS ln FROM code_lines WHERE contains(line, 'return pack_small')),
w AS (SELECT file, greatest(0, ln - 3) AS lo, least(n, ln + 4) AS hi FROM h JOIN n USING (file))
SELECT w.file, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, md5(string_agg(line || chr(10), '' ORDER BY c.ln)) AS hash FROM w JOIN code_lines c ON c.file = w.file AND c.ln > lo AND c.ln <= hi GROUP BY ALL""")
def padded_spans(spark, sf_dir):
    files = code(spark, sf_dir)
    hits = grep.line_hits(files, P.Matcher(spark, ["return pack_small"])).select("file", (F.col("ln") - 1).alias("ln"))
    return strategies.padded_spans(hits, files).select("file", "lo", "hi", F.md5("code").alias("hash"))


# ---- hunks and regions of a history

def patches(spark, sf_dir) -> DataFrame:
    """Lines of a patch for each order: a file for each part, a hunk with the part's name in its header."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    li = li.groupBy("l_orderkey", "l_partkey").agg(F.floor(F.max("l_quantity")).cast("int").alias("a"))
    rows = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("cid"), F.col("p_partkey").alias("k"), "p_partkey", F.regexp_replace("p_name", " ", "_").alias("name"), "a")
    path = F.concat(F.lit("+++ b/src/f"), F.col("p_partkey").cast("string"), F.lit(".py"))
    head = F.concat(F.lit("@@ -"), F.col("a").cast("string"), F.when(F.col("a") % 3 == 0, F.concat(F.lit(","), (F.col("a") % 5).cast("string"))).otherwise(""), F.lit(" +1 @@ def "), F.col("name"), F.lit("(size):"))
    return rows.select("cid", F.explode(F.array(F.struct((2 * F.col("k")).alias("n"), path.alias("line")), F.struct((2 * F.col("k") + 1).alias("n"), head.alias("line")))).alias("l")).select("cid", "l.n", "l.line")


_CUT = "h AS (SELECT l_orderkey AS cid, p_partkey, replace(p_name, ' ', '_') AS name, CAST(floor(max(l_quantity)) AS INT) AS a FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


@register(f"WITH {_CUT} SELECT cid, 'src/f' || p_partkey || '.py' AS path, CAST(greatest(0, a - 1) AS INT) AS start, CAST(CASE WHEN a % 3 = 0 THEN greatest(1, a % 5) ELSE 1 END AS INT) AS len FROM h")
def patch_hunks(spark, sf_dir):
    return strategies.parse_hunks(patches(spark, sf_dir))


@register(f"WITH {_CUT} SELECT DISTINCT cid, name AS sym FROM h")
def hunk_symbols(spark, sf_dir):
    return history.hunk_symbols(patches(spark, sf_dir).select("cid", "line"))


def _expanded(spark, sf_dir):
    """The names of parts 1 to 8 as coupled symbols, weaker by key."""
    part = table(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 8")
    return part.select(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("item"), (1.0 / F.col("p_partkey")).alias("w"))


_ITEMS = "e AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS item, 1.0 / p_partkey AS w FROM part WHERE p_partkey BETWEEN 1 AND 8)"


@register(f"WITH {CODE}, {_ITEMS}, d AS (SELECT file, ln, regexp_extract(line, 'def\\s+(\\w+)', 1) AS item FROM code_lines WHERE starts_with(line, 'def ')) SELECT file, CAST(ln - 1 AS INT) AS lo, 5 + coalesce(round_even(8 * w, 0), 0) AS score, w IS NOT NULL AS told FROM d LEFT JOIN e USING (item)")
def region_scores(spark, sf_dir):
    """Blocks that begin with the definition of a coupled symbol gain by its weight."""
    cut = blocks.blocks(code(spark, sf_dir)).withColumn("score", F.lit(5.0)).withColumn("rank_reason", F.array().cast("array<string>"))
    return history.region_boost(cut, _expanded(spark, sf_dir)).select("file", "lo", "score", F.array_contains("rank_reason", "region-history").alias("told"))


@register(f"""WITH {CODE}, {_ITEMS}, n AS (SELECT file, max(ln) AS n FROM code_lines GROUP BY file), t AS (SELECT * FROM e ORDER BY w DESC, item LIMIT 4),
s AS (SELECT item, w, c.file, c.ln FROM t JOIN code_lines c ON regexp_extract(c.line, '^def\\s+(\\w+)', 1) = item QUALIFY row_number() OVER (PARTITION BY item ORDER BY c.file, c.ln) = 1)
SELECT item AS symbol, file, CAST(ln AS INT) AS line_start, CAST(least(n, ln + 29) AS INT) AS line_end, CAST(12 + floor(14 * w) AS DOUBLE) AS score FROM s JOIN n USING (file)""")
def expansion_sites(spark, sf_dir):
    return history.expansion_chunks(code(spark, sf_dir), _expanded(spark, sf_dir)).select("symbol", "file", "line_start", "line_end", "score")


# ---- queries in batch

_STOP = ", ".join(f"'{w}'" for w in sorted(PHRASE_STOP))
_WORDS = f"w AS (SELECT item_id, text, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: length(x) >= 3 AND lower(x) NOT IN ({_STOP})) AS w FROM benchmark)"
_EXPANDED = f"{_WORDS}, e AS (SELECT item_id, CASE WHEN len(w) >= 3 THEN list_concat(w, [w[i] || '_' || w[i + 1] FOR i IN range(1, len(w))]) ELSE [text] END AS p FROM w)"


@register(f"WITH {_EXPANDED} SELECT item_id, CAST(len(p) AS INT) AS n, md5(array_to_string(p, '|')) AS hash FROM e")
def phrase_expansion(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.expand_column(F.col("text")).alias("p")).select("item_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("hash"))


@register(f"WITH {_EXPANDED} SELECT item_id, len(p) >= 3 AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '[a-z][a-z0-9]{{3,}}'))) = 0 AS vague FROM e")
def router_rule(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.vague_column(P.expand_column(F.col("text"))).alias("vague"))


@register(f"""WITH {_EXPANDED} SELECT item_id, round(-2.0264 + 1.4161 * len(p) + 0.3591 * len(list_filter(p, lambda x: regexp_full_match(x, '[a-z][a-z0-9]{{3,}}'))) / len(p) - 1.2606 * CASE WHEN len(list_filter(p, lambda x: contains(x, '_'))) > 0 THEN 1 ELSE 0 END
 - 1.2075 * CASE WHEN len(list_filter(p, lambda x: regexp_matches(x, '[A-Z]'))) > 0 THEN 1 ELSE 0 END - 0.0575 * CASE WHEN len(list_filter(p, lambda x: contains(x, chr(92)))) > 0 THEN 1 ELSE 0 END - 0.8742 * list_sum([length(x) FOR x IN p]) / (4 * len(p)), 4) AS z FROM e""")
def router_learned(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(P.learned_column(P.expand_column(F.col("text"))), 4).alias("z"))


# ---- evaluation

_SETS = """want AS (SELECT DISTINCT item_id, trim(l) AS l FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE trim(l) <> ''),
have AS (SELECT DISTINCT doc_id, trim(l) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '')"""


@register(f"""WITH {_SETS}, n AS (SELECT item_id, count(*) AS n FROM want GROUP BY item_id) SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS coverage, count(*) = any_value(n) AS hit FROM want JOIN have USING (l) JOIN n USING (item_id) GROUP BY ALL""")
def hit_coverage(spark, sf_dir):
    """Items and documents that share a line: an equi-join on lines, no pair is tried in vain."""
    want = table(spark, sf_dir, "benchmark").select("item_id", metrics.stripped_lines(F.col("text")).alias("w"))
    have = table(spark, sf_dir, "documents").select("doc_id", F.explode(metrics.stripped_lines(F.col("text"))).alias("l"))
    found = want.select("item_id", F.size("w").alias("n"), F.explode("w").alias("l")).join(have, "l").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("c"))
    return found.select("item_id", "doc_id", F.round(F.col("c") / F.col("n"), 6).alias("coverage"), (F.col("c") == F.col("n")).alias("hit"))


_TRIMMED = "list_distinct(list_filter([trim(l) FOR l IN string_split({}, chr(10))], lambda l: l <> ''))"


@register(f"""WITH p AS (SELECT doc_id, {_TRIMMED.format('b.text')} AS w, {_TRIMMED.format('substr(d.text, 1, 480)')} AS h FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE d.text IS NOT NULL AND b.text IS NOT NULL),
k AS (SELECT *, len(list_filter(w, lambda l: list_contains(h, l))) AS c FROM p)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(c / len(w), 6) END AS coverage, c = len(w) AS hit, CASE WHEN len(h) = 0 THEN 0.0 ELSE round(100.0 * (len(h) - c) / len(h), 6) END AS irrelevant FROM k""")
def context_metrics(spark, sf_dir):
    """Each document, capped to 120 tokens, as the context of one benchmark item."""
    docs = texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", metrics.capped(F.col("text"), 120).alias("context"), (F.col("doc_id") % 40).alias("item_id"))
    both = docs.join(table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.col("text").alias("truth")), "item_id")
    truth, context = F.col("truth"), F.col("context")
    return both.select("doc_id", F.round(metrics.coverage(truth, context), 6).alias("coverage"), metrics.hit(truth, context).alias("hit"), F.round(metrics.irrelevant_percent(truth, context), 6).alias("irrelevant"))


@register("SELECT doc_id, length(substr(text, 1, 32000)) AS n_chars, md5(substr(text, 1, 32000)) AS hash FROM documents WHERE text IS NOT NULL")
def capped_context(spark, sf_dir):
    cut = texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", metrics.capped(F.col("text")).alias("context"))
    return cut.select("doc_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("hash"))


@register("""WITH f AS (SELECT l_orderkey AS o, list_distinct(list('f' || (l_partkey % 7) || '.py')) AS named, list_distinct(list('f' || (l_suppkey % 7) || '.py')) AS wanted FROM lineitem GROUP BY l_orderkey)
SELECT o, round(len(list_filter(wanted, lambda x: list_contains(named, x))) / len(wanted), 6) AS recall FROM f""")
def file_recall(spark, sf_dir):
    """The share of wanted files that an answer names, by base name whatever the folder."""
    li = table(spark, sf_dir, "lineitem")
    path = lambda top, c: F.concat(F.lit(top), (F.col(c) % 7).cast("string"), F.lit(".py"))
    sets = li.groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(path("a/f", "l_partkey")).alias("named"), F.collect_set(path("src/b/f", "l_suppkey")).alias("wanted"))
    return sets.select("o", F.round(metrics.file_recall(F.col("named"), F.col("wanted")), 6).alias("recall"))


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("strategy"), F.concat(F.lit("family"), (F.col("user_id") % 3).cast("string")).alias("family"), (F.col("event_id") % 977).cast("int").alias("tokens"), (F.col("value") > 20).alias("hit"), (F.col("event_id") % 4 / 4.0).alias("coverage"), F.col("value").alias("latency_ms"))


_CELLS = "c AS (SELECT event_type AS strategy, 'family' || (user_id % 3) AS family, event_id % 977 AS tokens, value > 20 AS hit, (event_id % 4) / 4.0 AS coverage, value AS latency_ms FROM events)"


@register(f"""WITH {_CELLS} SELECT strategy, CAST(median(tokens) AS DOUBLE) AS median_tokens, round(avg(tokens), 6) AS mean_tokens, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coverage), 6) AS mean_coverage, round(median(latency_ms), 6) AS median_latency_ms, count(*) AS cells FROM c GROUP BY strategy""")
def strategy_summary(spark, sf_dir):
    s = metrics.summarise(_cells(spark, sf_dir))
    return s.select("strategy", "median_tokens", *[F.round(c, 6).alias(c) for c in ("mean_tokens", "hit_rate", "mean_coverage", "median_latency_ms")], "cells")


@register(f"WITH {_CELLS} SELECT family, " + ", ".join(f"round(avg(CASE WHEN strategy = '{s}' THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END), 6) AS \"{s}\"" for s in ("click", "error", "view")) + " FROM c GROUP BY family")
def family_matrix(spark, sf_dir):
    m = metrics.hit_matrix(_cells(spark, sf_dir), "family", "strategy", ["click", "error", "view"])
    return m.select("family", *[F.round(c, 6).alias(c) for c in ("click", "error", "view")])


@register(f"""WITH {CODE}, w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}')) AS term FROM code), t AS (SELECT term, count(*) AS n FROM w WHERE lower(term) NOT IN ('size', 'total') GROUP BY term)
SELECT term, n, n + CASE WHEN contains(term, '_') OR regexp_matches(term, '[a-z][A-Z]') THEN 100 ELSE 0 END AS weight FROM t ORDER BY weight DESC, term LIMIT 4""")
def refine_terms(spark, sf_dir):
    return metrics.refine_terms(code(spark, sf_dir).withColumnRenamed("text", "code"), ["size", "total"])


_RANKS = "".join(f", r{i} AS (SELECT nodes.node, 0.15 / n + 0.85 * coalesce(s, 0) AS rank FROM nodes CROSS JOIN cnt LEFT JOIN (SELECT dst AS node, sum(rank / k) AS s FROM r{i - 1} JOIN outd ON outd.src = r{i - 1}.node JOIN edges ON edges.src = r{i - 1}.node GROUP BY dst) USING (node))" for i in range(1, 16))


@register(f"""WITH edges AS (SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT DISTINCT 1000000 + s_suppkey, 2000000 + s_nationkey FROM supplier UNION SELECT DISTINCT 2000000 + c_nationkey, c_custkey FROM customer),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), cnt AS (SELECT count(*) AS n FROM nodes), outd AS (SELECT src, count(*) AS k FROM edges GROUP BY src), r0 AS (SELECT node, 1.0 / n AS rank FROM nodes, cnt) {_RANKS} SELECT node, round(rank, 9) AS rank FROM r15""")
def page_rank(spark, sf_dir):
    """Customers point to suppliers, suppliers to nations, nations to customers."""
    o, li, s, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier", "customer"))
    bought = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    sited = s.select((F.col("s_suppkey") + 1000000).alias("src"), (F.col("s_nationkey") + 2000000).cast("long").alias("dst"))
    held = c.select((F.col("c_nationkey") + 2000000).cast("long").alias("src"), F.col("c_custkey").alias("dst"))
    return pagerank.pagerank(bought.union(sited).union(held)).select("node", F.round("rank", 9).alias("rank"))


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return refresh.event_activity(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- the whole search

@register()
def focused_search(spark, sf_dir):
    return search(code(spark, sf_dir), "widget|return pack_small", SearchConfig(before=2, after=2, budget=1500))


@register()
def focused_search_vague(spark, sf_dir):
    return search(code(spark, sf_dir), "widget|economy|total", SearchConfig(before=2, after=2, budget=1500))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focused_search(spark, sf_dir)
