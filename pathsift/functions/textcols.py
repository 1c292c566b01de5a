"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EMPTY, STOP_WORDS

# URL authority: everything between ``scheme://`` and the first / ? or #.
# Keeps user info, port and case, like a netloc.
URL_AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
URL_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"


def authority(url: Column) -> Column:
    """B1: netloc of a URL ('' when the URL has no ``scheme://``)."""
    return F.regexp_extract(url, URL_AUTHORITY_RE, 1)


def domain_root(url: Column) -> Column:
    """B2: ``scheme://netloc/`` (scheme lower-cased, netloc untouched)."""
    return F.concat(F.lower(F.regexp_extract(url, URL_SCHEME_RE, 1)), F.lit("://"),
                    authority(url), F.lit("/"))


def sentinel(c: Column) -> Column:
    """Missing or blank text becomes the literal ``'empty'``."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(EMPTY))


def first_line_title(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


# H3 token separators: whitespace and ASCII punctuation except '-' and '_'
# (hyphenated words stay one token; '_' is a word character for H5).
TOKEN_SEP_RE = r"[\s!-,./:-@\[-^`{-~]+"


def word_tokens(text: Column) -> Column:
    """H3: lower-case, drop ``n't`` clitics, split off punctuation."""
    s = F.regexp_replace(F.lower(text), "n't", " ")
    return F.split(s, TOKEN_SEP_RE)


def clean_tokens(text: Column) -> Column:
    """H3 -> H4 -> H5: tokens, stop words removed *before* stripping, then
    non-word characters removed and only ``^[a-z]{3,}$`` kept."""
    toks = F.filter(word_tokens(text), lambda t: ~t.isin(STOP_WORDS))
    stripped = F.transform(toks, lambda t: F.regexp_replace(t, r"\W+", ""))
    return F.filter(stripped, lambda t: t.rlike("^[a-z]{3,}$"))


def token_rows(df, text_col: str, keep: list[str]):
    """H3-H5 as rows ``keep... , token``: explode first, then the stop-word
    set test (an ``InSet`` hash lookup), the strip and the filter are plain
    column expressions inside whole-stage codegen (the array form above runs
    interpreted lambdas)."""
    t = df.select(*keep, F.explode(word_tokens(F.col(text_col))).alias("_t"))
    t = t.filter(~F.col("_t").isin(STOP_WORDS))
    t = t.select(*keep, F.regexp_replace("_t", r"\W+", "").alias("token"))
    return t.filter(F.col("token").rlike("^[a-z]{3,}$"))
