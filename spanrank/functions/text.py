"""Column functions on text: lines, tokens, stems, token estimates.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_LINE = rf"[^{K.LINE_ENDS}]*(?:\r\n|[{K.LINE_ENDS}])|[^{K.LINE_ENDS}]+"


def line_array(text: Column) -> Column:
    """Lines of a text with their line ends; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LINE), F.lit(0))


def bare(line: Column) -> Column:
    """A line without its end."""
    return F.regexp_replace(line, rf"(?:\r\n|[{K.LINE_ENDS}])\z", "")


def strip(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\A\s+|\s+\z", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.expr("1") * F.floor(F.length(text) / 4)).cast("int")


def terms(text: Column) -> Column:
    """Plain terms ``[a-z0-9_]{3,}`` of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))


def stem(term: Column) -> Column:
    """The term without the first suffix of the list that leaves four characters."""
    out = None
    for suffix in K.STEM_SUFFIXES:
        fits = term.endswith(suffix) & (F.length(term) - len(suffix) >= 4)
        cut = F.substring(term, F.lit(1), F.length(term) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(term)


def words(text: Column) -> Column:
    """Words ``[A-Za-z0-9_]{3,}`` as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]{3,}"), F.lit(0))


def word_tokens(word: Column) -> Column:
    """Stemmed subwords of a snake_case or camelCase word, and the whole word if it has several."""
    pieces = F.split(F.regexp_replace(word, "(?<=[a-z0-9])(?=[A-Z])", "_"), "_")
    kept = F.filter(F.transform(pieces, F.lower), lambda s: F.length(s) >= 3)
    return F.concat(F.transform(kept, stem), F.when(F.size(kept) > 1, F.array(F.lower(word))).otherwise(F.array().cast("array<string>")))


def semantic_tokens(text: Column) -> Column:
    """Stemmed subwords of snake_case and camelCase words, and whole words of several subwords."""
    return F.flatten(F.transform(words(text), word_tokens))


def query_tokens(text: Column) -> Column:
    """Recall tokens of a query: semantic tokens, and each stemmed whole word twice more."""
    whole = F.transform(terms(text), stem)
    return F.concat(semantic_tokens(text), whole, whole)


def symbol(line: Column) -> Column:
    """The name after a keyword of definition, else the first name before a parenthesis; null if neither."""
    after = F.regexp_extract(line, f"(?U){K.SYMBOL_AFTER_KEYWORD}", 1)
    before = F.regexp_extract(line, f"(?U){K.SYMBOL_BEFORE_PAREN}", 1)
    return F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")))


def is_definition(line: Column) -> Column:
    return line.rlike(f"(?U){K.DEFINITION}")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"(?U)\A\s+", ""))


def is_test_path(file: Column) -> Column:
    low = F.lower(F.replace(file, F.lit("\\"), F.lit("/")))
    return F.element_at(F.split(low, "/"), -1).contains("test") | low.contains("/tests/") | low.startswith("tests/")


def is_vendor_path(file: Column) -> Column:
    low = F.lower(file)
    out = F.lit(False)
    for part in K.VENDOR_PARTS:
        out = out | low.contains(part)
    return out


def relative_path(file: Column, root: str) -> Column:
    """A path below ``root`` with forward slashes and without the root; other paths only get the slashes."""
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def language(file: Column) -> Column:
    """python, c_like or brace, by extension."""
    ext = F.regexp_extract(F.lower(file), r"(\.[^./\\]+)\z", 1)
    return F.when(ext.isin(*sorted(K.PYTHON_EXTS)), "python").when(ext.isin(*sorted(K.C_LIKE_EXTS)), "c_like").otherwise("brace")
