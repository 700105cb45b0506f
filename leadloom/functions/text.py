"""Column functions over text: cleaning, keys, slugs, tokens, phrases.

All are built-in expressions but :func:`unescape_html` and :func:`ascii_slug`, whose
entity table and decomposition Spark has no expression for. Null gives null unless said
otherwise.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words a query's terms leave out.
STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")
#: Legal forms dropped from the end of a company's name.
LEGAL_SUFFIXES = ("ag", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "limited", "llc", "llp", "lp", "ltd", "oy", "plc", "pte", "pty", "sa")
#: Words dropped from the end of a name or domain for slugs of the fast kind.
SLUG_SUFFIXES = ("ai", "ag", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "io", "labs", "llc", "llp", "lp", "limited", "ltd", "oy", "plc", "pte", "pty", "sa", "systems", "tech")
#: Words dropped from the start of a name.
ARTICLES = ("a", "an", "the")
#: Texts of links that name nothing.
GENERIC_LINKS = (
    "apply", "apply now", "company", "company profile", "details", "learn more", "more", "open roles", "portfolio", "profile", "read more", "site", "view company", "visit site",
    "visit website", "website",
)


def clean_text(c: Column) -> Column:
    """Ends without white space of any kind; blank gives null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def one_line(c: Column) -> Column:
    """:func:`clean_text` with each run of white space as one space."""
    return F.regexp_replace(clean_text(c), r"(?U)\s+", " ")


def key_text(c: Column) -> Column:
    """Case-folded text in which runs of white space and commas are one space; blank gives null."""
    folded = F.replace(F.lower(clean_text(c)), F.lit("ß"), F.lit("ss"))
    return F.nullif(F.trim(F.regexp_replace(folded, r"(?U)[\s,]+", " ")), F.lit(""))


def match_text(c: Column) -> Column:
    """Letters a-z and digits with one space between words and around the whole; for phrases of whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def has_phrase(c: Column, phrase: str) -> Column:
    words = " ".join(re.findall("[a-z0-9]+", phrase.lower()))
    return match_text(c).contains(f" {words} ")


def any_phrase(c: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | has_phrase(c, p)
    return out


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: str | None) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if t not in STOPWORDS]


def search_text(*columns: Column) -> Column:
    """Lower-case text of the non-blank columns with spaces between."""
    return F.lower(F.concat_ws(" ", *[clean_text(c) for c in columns]))


def matches_terms(text: Column, query: str | None) -> Column:
    """Every term of the query is somewhere in the text; a query without terms matches all."""
    out = F.lit(True)
    for t in query_terms(query):
        out = out & text.contains(t)
    return out


def batch_slug(c: Column) -> Column:
    """Label of a batch: runs of other characters than letters, digits, ``._-`` are one dash; nothing left gives null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(clean_text(c), "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", ""), F.lit(""))


@F.pandas_udf(T.StringType())
def ascii_slug(values: pd.Series) -> pd.Series:
    """Letters decomposed, other signs dropped, lower case, runs of the rest as one dash."""

    def one(v: str | None) -> str | None:
        plain = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() if v else ""
        return re.sub("[^a-z0-9]+", "-", plain.lower()).strip("-") or None

    return pd.Series([one(v) for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    """Entities as characters, white space as single spaces, blank as null."""
    return pd.Series([(re.sub(r"\s+", " ", html.unescape(v)).strip() or None) if v is not None else None for v in values], dtype=object)


def strip_tags(c: Column) -> Column:
    """Text between tags on one line (entities kept)."""
    return one_line(F.regexp_replace(c, "<[^>]+>", " "))


def company_tokens(c: Column) -> Column:
    """Words of a company's name: ``&`` as and, no quotes, no leading the, no legal forms at the end."""
    plain = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "['’\"]", "")
    words = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    words = F.regexp_replace(words, r"^the(?:\s+|$)", "")
    words = F.regexp_replace(words, rf"(?:(?:^|\s+)(?:{'|'.join(LEGAL_SUFFIXES)}))+$", "")
    return F.filter(F.split(words, " "), lambda w: w != "")


def company_key(c: Column) -> Column:
    return F.nullif(F.array_join(company_tokens(c), ""), F.lit(""))


def slug_candidates(name: Column, domain_label: Column) -> Column:
    """Ordered distinct slugs: domain label, its compact form, the name compact, with dashes, and its first word."""
    words = company_tokens(name)
    several = F.size(words) > 1
    options = F.array(
        domain_label, F.regexp_replace(domain_label, "[^a-z0-9]", ""), F.array_join(words, ""),
        F.when(several, F.array_join(words, "-")), F.when(several, F.get(words, F.lit(0))),
    )
    return F.filter(F.array_distinct(F.array_compact(options)), lambda s: s != "")


def short_tokens(c: Column, suffixes: Sequence[str] = ()) -> Column:
    """Words without the suffixes at the end and the articles at the start; at least one word stays."""
    line = F.array_join(tokens(c), " ")
    if suffixes:
        line = F.regexp_replace(line, rf"(?:\s+(?:{'|'.join(suffixes)}))+$", "")
    line = F.regexp_replace(line, rf"^(?:(?:{'|'.join(ARTICLES)})\s+)+", "")
    return F.filter(F.split(line, " "), lambda w: w != "")


def short_slugs(name: Column, domain_stem: Column, most: int = 6) -> Column:
    """Ordered distinct slugs of the fast kind: words of the domain and of the name, each with and without suffixes, with dashes and run together."""
    groups = [short_tokens(domain_stem), short_tokens(domain_stem, SLUG_SUFFIXES), short_tokens(name, SLUG_SUFFIXES), short_tokens(name)]
    options = F.array(*[F.array_join(g, j) for g in groups for j in ("-", "")])
    return F.slice(F.filter(F.array_distinct(F.array_compact(options)), lambda x: F.length(x) >= 2), 1, most)


def first_label(c: Column, table: dict[str, str]) -> Column:
    """Label of the first pattern that is found; null if none is."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in table.items()])


def reasons(parts: dict[str, Column]) -> Column:
    """Texts whose condition holds, with ``; `` between; nothing gives null."""
    return F.nullif(F.concat_ws("; ", *[F.when(c, F.lit(t)) for t, c in parts.items()]), F.lit(""))


def display_name(slug: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(slug, "[-_]+", " ")))


def title_quality(title: Column) -> Column:
    """Number of words and of characters: fuller titles sort later."""
    return F.struct(F.size(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("words"), F.length(F.coalesce(title, F.lit(""))).alias("chars"))


def merge_lines(*columns: Column) -> Column:
    """Distinct non-null texts, one per line; nothing gives null."""
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*[clean_text(c) for c in columns]))), "\n"), F.lit(""))


def link_text(c: Column, generic: Sequence[str] = GENERIC_LINKS, most: int = 80) -> Column:
    """Text of a link that may be a name; generic or long ones give null."""
    line = one_line(c)
    return F.when(~F.lower(line).isin(*generic) & (F.length(line) <= most), line)


def mask_secrets(c: Column) -> Column:
    """Passwords of URLs and password parameters as stars."""
    out = F.regexp_replace(c, r"(://[^:/@\s]+):[^@/\s]+@", "$1:***@")
    return F.regexp_replace(out, r"(?i)((?:password|passwd|pwd|token)=)[^&\s]+", "$1***")
