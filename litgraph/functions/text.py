"""Text columns: normal form, tokens, trigrams, query terms. Native expressions except the Unicode
compatibility folding, which Spark has no function for; it runs on Arrow batches and receives only
the rows that hold a non-ASCII character."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and words that stored keys and rankings depend on.
HAN = "\\u3400-\\u9fff\\uf900-\\ufaff"
PUNCT_CLASS = "[\\s\\-_/·•,.;:()\\[\\]{}'\"`~!?，。；：（）【】、]+"
STOPWORDS = (
    "the and for with from that this these those into onto over under than then there their they them were was "
    "are been being have has had not but can could would should will may might also such which while where when "
    "what who whom whose how why all any each few more most other some only own same very just about above after "
    "again against before below between both during further here once out off our ours your yours its itself his "
    "hers him she himself her herself use used using via per data based import def return self none true false print"
).split()
# The bounds of an interactive query.
MAX_LATIN_TERMS = 12
MAX_HAN_TERMS = 24


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def fold(c: Column) -> Column:
    """Compatibility-normalised, case-folded text."""
    return F.coalesce(_fold(F.when(c.rlike("[^\\x00-\\x7F]"), c)), F.lower(c))


def norm_text(s: str) -> str:
    """``norm`` of one string, for a query argument."""
    return " ".join(re.sub(PUNCT_CLASS, " ", unicodedata.normalize("NFKC", s).casefold()).split())


_PUNCT, _BLANK = re.compile(PUNCT_CLASS, re.ASCII), re.compile("[\\s\u00a0\u3000]+", re.ASCII)
_RUNS = re.compile(f"[{HAN}]+|[a-z0-9]+")


def norm_like(s: str) -> str:
    """What ``norm`` gives for a string, in Python; only ASCII white space is white space to it, as in the JVM."""
    folded = s.lower() if s.isascii() else unicodedata.normalize("NFKC", s).casefold()
    return _BLANK.sub(" ", _PUNCT.sub(" ", folded)).strip(" ")


def lex_sets(normed: str) -> tuple[set[str], set[str]]:
    """The different ``lex_tokens`` and ``char_ngrams`` of a normal form, in Python."""
    words = set()
    for r in _RUNS.findall(normed):
        words.update([r] if r[0] < "\u3400" or len(r) <= 2 else [r[i:i + 2] for i in range(len(r) - 1)])
    padded = f" {normed} "
    return words, {padded[i:i + 3] for i in range(max(1, len(padded) - 2))}


def collapse(c: Column) -> Column:
    """Punctuation and white space runs become one blank; no blank at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, PUNCT_CLASS, " "), "[\\s\\u00a0\\u3000]+", " "))


def norm(c: Column) -> Column:
    return collapse(fold(c))


def norm_ascii(c: Column) -> Column:
    """``norm`` for text known to be ASCII: stays in the JVM."""
    return collapse(F.lower(c))


def tokens(normed: Column) -> Column:
    """Latin words and digits, single Han characters, of an already normalised text."""
    return F.regexp_extract_all(normed, F.lit(f"([a-z0-9]+|[{HAN}])"), 1)


def runs(normed: Column) -> Column:
    return F.regexp_extract_all(normed, F.lit(f"([{HAN}]+|[a-z0-9]+)"), 1)


def windows(c: Column, n: int) -> Column:
    """Overlapping windows of ``n`` characters; the text itself when it is shorter."""
    return F.when(F.length(c) <= n, F.array(c)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))


def lex_tokens(normed: Column) -> Column:
    """Latin words; Han runs as overlapping pairs."""
    return F.flatten(F.transform(runs(normed), lambda r: F.when(r.rlike(f"^[{HAN}]"), windows(r, 2))
                                 .otherwise(F.array(r))))


def char_ngrams(normed: Column, n: int = 3) -> Column:
    padded = F.concat(F.lit(" "), normed, F.lit(" "))
    return windows(padded, n)


def latin_terms(normed: Column, most: int | None = None) -> Column:
    """The Latin words of a query: no repeats, no stop words, three characters or more; the longest come first (the
    earlier one among equals), the first ``most`` if that is given."""
    words = F.array_distinct(F.regexp_extract_all(normed, F.lit("([a-z0-9]+)"), 1))
    kept = F.filter(F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS])), lambda w: F.length(w) >= 3)
    placed = F.transform(kept, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    ordered = F.array_sort(placed)
    return F.transform(ordered if most is None else F.slice(ordered, 1, most), lambda s: s["w"])


def han_terms(normed: Column, most: int | None = None) -> Column:
    """Different three-character windows of the Han runs, the first ``most`` if that is given."""
    han = F.filter(runs(normed), lambda r: r.rlike(f"^[{HAN}]") & (F.length(r) >= 3))
    parts = F.array_distinct(F.flatten(F.transform(han, lambda r: windows(r, 3))))
    return parts if most is None else F.slice(parts, 1, most)


def han_pairs(normed: Column) -> Column:
    """Two-character Han runs: a trigram cannot match them, a substring can."""
    return F.array_distinct(F.filter(runs(normed), lambda r: r.rlike(f"^[{HAN}]{{2}}$")))


def search_units(normed: Column) -> Column:
    latin = F.filter(runs(normed), lambda r: ~r.rlike(f"^[{HAN}]"))
    return F.struct(F.concat(latin, han_terms(normed)).alias("terms"), han_pairs(normed).alias("pairs"))


def query_terms(normed: Column, max_latin: int | None = None, max_han: int | None = None) -> Column:
    return F.concat(latin_terms(normed, max_latin), han_terms(normed, max_han))


def has_han(c: Column) -> Column:
    return c.rlike(f"[{HAN}]")


def lang_of(c: Column, default: Column | None = None) -> Column:
    return F.when(has_han(c), F.lit("zh")).otherwise(F.coalesce(default, F.lit("en")) if default is not None else F.lit("en"))


def alias_language(declared: Column) -> Column:
    """Language of the Latin names in a document that declares ``declared``; null when unusable."""
    code = F.lower(F.split_part(F.regexp_replace(F.trim(declared), "_", "-"), F.lit("-"), F.lit(1)))
    return F.when(code == "zh", F.lit("en")).when(code.rlike("^[a-z]{2,3}$"), code)
