"""URL filter that carries block decisions along redirect and canonical-link edges."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batch, small_batches
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit, not a page.
TRACKING = r"(utm_[a-z]+|ref|gclid|fbclid)"


def _after(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"\A([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"\A[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """The address that a site redirects to: no scheme, fragment, tracking parameters or last slash."""
    rest = F.regexp_replace(_after(url), r"(?s)#.*", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"\A{TRACKING}(=|\z)")), "&")
    place = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+\z", ""))
    return F.when(query != "", F.concat(place, F.lit("?"), query)).otherwise(place)


_CLEAR = re.compile(r"(?i)(?:href|url|content)\s*=\s*[\"']?\s*(?:[0-9.]+\s*;\s*url\s*=\s*)?[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)")
_VALUE = r"(?i)(?<![\w-]){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_HREF, _CONTENT = re.compile(_VALUE.format("href")), re.compile(_VALUE.format("content"))
_REFRESH = re.compile(r"(?i)http-equiv\s*=\s*[\"']?refresh\b")
_DELAY = re.compile(r"(?i)\s*[0-9.]+\s*[;,]\s*(?:url\s*=\s*)?[\"']?\s*([^\"'\s]+)")
_AMP = re.compile(r"(?i)&(?:amp|#0*38|#x0*26);")
_SCHEME = re.compile(r"(?i)[a-z][a-z0-9+.-]*:")


def resolve(base: str, target: str) -> str:
    """The absolute address of a link on the page ``base``; empty where there is none."""
    named = _SCHEME.match(target)
    if not target or named:
        return target if named and target.startswith("//", named.end()) else ""
    scheme, _, rest = base.partition("://")
    try:
        return scheme + urljoin(f"http://{rest}", target)[4:]
    except ValueError:  # no address, such as a bracket that isn't closed
        return ""


def _target(url: str, base_tag: str | None, tag: str) -> str:
    def value(pattern, tag):
        m = pattern.search(tag)
        return (m[1] or m[2] or m[3] or "").strip() if m else ""

    if _REFRESH.search(tag):
        m = _DELAY.match(value(_CONTENT, tag))
        found = m[1] if m else ""
    else:
        found = value(_HREF if tag[:5].lower() == "<link" else _CONTENT, tag)
    if not found:
        m = _CLEAR.search(tag)
        found = m[1] if m else ""
    plain = lambda x: _AMP.sub("&", x.split()[0]) if x.strip() else ""
    return resolve(resolve(url, plain(value(_HREF, base_tag or ""))) or url, plain(found))


def link_targets(pages: DataFrame) -> DataFrame:
    """(url, to) of the canonical links, og:url and meta refreshes of pages(url, html).

    Relative ones are resolved against the page's ``base`` tag, else its url.
    """
    small_batches(pages.sparkSession)
    schema = pa.schema([("url", pa.string()), ("to", pa.string())])

    def run(batches):
        for batch in batches:
            urls = batch.column("url").to_pylist()
            yield arrow_batch(schema, [urls, [_target(*x) for x in zip(urls, batch.column("base").to_pylist(), batch.column("tag").to_pylist())]])

    html = F.coalesce("html", F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    told = F.filter(tags, lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?canonical\b|property\s*=\s*[\"']?og:url\b|http-equiv\s*=\s*[\"']?refresh\b"))
    base = F.regexp_extract(html, r"(?i)(<base\b[^>]*>)", 1)
    return pages.select("url", base.alias("base"), F.explode(told).alias("tag")).mapInArrow(run, "url string, to string").where("to <> ''")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    A rule is (verdict, "host/path"); it fits its host and all subdomains, if
    the path starts with the rule's.  Of equally long rules the first wins.
    """
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    empty = F.lit(None).cast("string")
    return (empty, empty) if rule is None else (rule, verdict)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url, html).

    Edges are the pages' canonical links and meta refreshes, absolute or
    relative, redirects to the
    canonical form of an address, and the rows of ``redirects`` (src, dst) if
    given.  A page that a rule fits gets the rule's verdict.  Another page gets
    allow if a rule allows any address of its component, else block if a rule
    blocks one, else allow.  Addresses without a page count too.  Null urls and
    urls without ``://`` have no edges and are allowed.  Equal rows are judged
    alike; html may be null; other columns are not read.  No rows: none.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    named = url.contains("://")
    links = link_targets(pages.where(named).select(url.alias("url"), F.col("html").cast("string").alias("html"))).select(canonical_url(F.col("url")).alias("u"), "to")
    edges = links.select("u", canonical_url(F.col("to")).alias("v"), F.col("to").alias("seen"))
    if redirects is not None:
        given = redirects.where("src LIKE '%://%' AND dst LIKE '%://%'")
        edges = edges.unionByName(given.select(canonical_url(F.col("src")).alias("u"), canonical_url(F.col("dst")).alias("v"), F.col("dst").alias("seen")))
        edges = edges.unionByName(given.select(canonical_url(F.col("dst")).alias("u"), canonical_url(F.col("src")).alias("v"), F.col("src").alias("seen")))
    edges = scratch.save(edges)
    roots = components(edges.select("u", "v"), scratch)

    # an address and its canonical form are one node, so pages that differ in scheme or tracking only share it
    seen = pages.where(named).select(canonical_url(url).alias("node"), url.alias("url")).unionByName(edges.select(F.col("v").alias("node"), F.col("seen").alias("url")))
    said = seen.select("node", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("verdict")).where("verdict IS NOT NULL")
    said = said.groupBy("node").agg(F.max(F.expr("verdict = 'allow'")).alias("allow"))
    told = said.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.max("allow").alias("allow"))
    verdicts = told.join(roots.withColumnRenamed("node", "_node"), "root", "left").select(F.explode(F.array_distinct(F.array("root", F.coalesce("_node", "root")))).alias("_node"), "allow").groupBy("_node").agg(F.max("allow").alias("_allow"))

    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), F.when(named, canonical_url(url)).alias("_node"))
    judged = judged.withColumn("rule", rule).withColumn("_own", verdict)
    free = judged.where("rule IS NULL AND _node IS NOT NULL").join(verdicts, "_node", "left").withColumn("verdict", F.when(F.col("_allow") == F.lit(False), "block").otherwise("allow"))
    rest = judged.where("rule IS NOT NULL OR _node IS NULL").withColumn("verdict", F.coalesce("_own", F.lit("allow")))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    return rest.select(*cols).unionByName(free.select(*cols))
