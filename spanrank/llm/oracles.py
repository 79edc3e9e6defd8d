"""DuckDB's SQL for the operators that it can express over whole tables, by brute force."""

from __future__ import annotations

from . import chat_format

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# RE2 has no look-ahead: the tails are consumed, and none of them begins another control string.
_CONTROL = _quoted(r"[<\[]\\*(?:" + "|".join(sorted({"".join(f"\\{x}" if x in "|/[]<>" else x for x in c[1:]) for c in chat_format.CONTROL}, key=len, reverse=True)) + ")")

CHAT = rf"""WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, replace(replace(role, '%', '%25'), chr(10), '%0A') AS r FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(8 + length(r) + len(regexp_extract_all(r, {_CONTROL})) + 1 + length(text) + len(regexp_extract_all(text, {_CONTROL})) + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

CONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, k FROM places JOIN windows USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)"""

REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
seg AS (SELECT doc_id, base, substr(h, 2 * base + 1, 1398) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199, 500)) AS base FROM d WHERE length(h) >= 400)),
w AS (SELECT doc_id, base + j AS i, md5(substr(h, 2 * j + 1, 400)) AS s FROM (SELECT *, unnest(range(0, least(500, length(h) // 2 - 199))) AS j FROM seg)),
twice AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i AS a, i + 200 AS b FROM w SEMI JOIN twice USING (s)),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY doc_id, g),
edges AS (SELECT doc_id, b AS start, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), length(h) // 2) AS stop FROM runs JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS k FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


def urls(rules: list[tuple[str, str]]) -> str:
    """Rules, and verdicts shared by addresses of one canonical form; links in pages aren't followed (the given ones hold none)."""
    rule, verdict = [], []
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rule.append(f"WHEN {fits} THEN '{text}'")
        verdict.append(f"WHEN {fits} THEN '{said}'")
    kept = "list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))"
    return rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, rest, {_fold("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  regexp_extract(regexp_replace(rest, '(?s)#.*', ''), '(?s)\?(.*)', 1) AS q FROM u),
j AS (SELECT page_id, host, path, CASE {' '.join(rule)} END AS rule, CASE {' '.join(verdict)} END AS own,
  CASE WHEN rest IS NOT NULL THEN host || regexp_replace(path, '/+$', '') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END AS node FROM p),
told AS (SELECT node, max(own = 'allow') AS allow FROM j WHERE own IS NOT NULL AND node IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN allow = false THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN told USING (node)"""
