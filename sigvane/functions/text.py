"""Text normalization and matching as Spark column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigvane import constants as K


# Unicode whitespace, for TRIM
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c.cast("string"), F.lit(_SPACES))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def is_missing(c: Column) -> Column:
    return c.isNull() | strip(c).isin(*K.MISSING_TOKENS)


def clean_text(c: Column) -> Column:
    """Trimmed text; missing tokens become null."""
    return F.when(~is_missing(c), strip(c))


def collapse_text(c: Column) -> Column:
    """Trimmed text with whitespace runs collapsed; empty becomes null."""
    return F.nullif(collapse_spaces(strip(c)), F.lit(""))


def normalize_ticker(c: Column) -> Column:
    return F.upper(clean_text(c))


def _cik_digits(c: Column) -> Column:
    return F.regexp_replace(clean_text(c), r"^(\d+)\.0$", "$1")


def normalize_cik(c: Column) -> Column:
    """Ten-digit zero-padded text; null when missing or not digits (see ``cik_is_invalid``)."""
    digits = _cik_digits(c)
    padded = F.when(F.length(digits) < 10, F.lpad(digits, 10, "0")).otherwise(digits)
    return F.when(digits.rlike(r"^\d+$"), padded)


def cik_is_invalid(c: Column) -> Column:
    return ~is_missing(c) & ~_cik_digits(c).rlike(r"^\d+$")


def parse_bool(c: Column) -> Column:
    """Common words to boolean; any other non-missing text counts as true; missing is null."""
    word = F.lower(strip(c))
    return (
        F.when(c.isNull(), F.lit(None).cast("boolean"))
        .when(word.isin(*K.TRUE_WORDS), True)
        .when(word.isin(*K.FALSE_WORDS), False)
        .otherwise(F.length(c.cast("string")) > 0)
    )


def name_key(c: Column) -> Column:
    """Company name reduced for matching: lower case, no punctuation, no legal suffixes."""
    suffixes = "|".join(K.LEGAL_SUFFIXES)
    text = F.replace(F.lower(strip(c)), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, r"[.,'’\-()]", " ")
    text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_])({suffixes})(?![\p{{L}}\p{{N}}_])", " ")
    return strip(collapse_spaces(text))


def to_price_ticker(c: Column) -> Column:
    return F.translate(c, ".", "-")


def from_price_ticker(c: Column) -> Column:
    return F.translate(c, "-", ".")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the lower-cased parts joined by `` | ``; parts are whitespace-normalized already."""
    normalized = [F.coalesce(F.lower(p), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(" | ", *normalized), 256)


def normalize_source_type(c: Column) -> Column:
    """Known aliases to their canonical type; unknown types are kept."""
    entries = [F.lit(x) for pair in K.SOURCE_TYPE_ALIASES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(strip(c))), strip(c))


def keyword_pattern(keywords: Iterable[str]) -> str:
    terms = [re.sub(r"\s+", " ", k.strip()).lower() for k in keywords]
    return "(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in terms if t) + ")(?![a-z0-9])"


def matches_keyword(title: Column, description: Column, keywords: Iterable[str] = K.POSTING_KEYWORDS) -> Column:
    """Whether any keyword occurs in the whitespace-normalized title or description, bounded by non-alphanumerics."""
    pieces = [F.coalesce(c, F.lit("")) for c in (title, description)]
    return F.lower(F.concat_ws(" ", *pieces)).rlike(keyword_pattern(keywords))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Plain substring test, no word boundaries."""
    return c.rlike("|".join(re.escape(w) for w in words))


def sampling_bucket(
    matched: Column,
    title: Column,
    description: Column,
    leadership: Iterable[str] = K.LEADERSHIP_WORDS,
    technical: Iterable[str] = K.TECHNICAL_WORDS,
) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return (
        F.when(F.coalesce(matched, F.lit(False)), "ai_keyword_matched")
        .when(contains_any(text, leadership), "leadership_strategy")
        .when(contains_any(text, technical), "technical_non_ai")
        .otherwise("non_technical")
    )


def html_to_text(c: Column) -> Column:
    """Drop script and style blocks, tags and entities; collapse whitespace."""
    text = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"&[a-z#0-9]+;", " ")
    return collapse_spaces(text)


def strip_code_fence(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"(?m)^```(json)?|```$", ""))


def snippet(
    raw_text: Column, title: Column, size: int | None = None, boilerplate: str = K.BOILERPLATE_PATTERN, title_chars: int | None = None
) -> Column:
    """Text without boilerplate lines, from the title's first occurrence on.

    ``title_chars`` looks for so many first characters of the title only, ``size`` cuts the result.
    """
    lines = F.split(F.coalesce(raw_text, F.lit("")), r"\r\n|[\n\r]")
    kept = F.filter(lines, lambda line: (strip(line) != "") & ~line.rlike(f"(?i){boilerplate}"))
    text = F.array_join(kept, " ")
    wanted = F.lower(F.coalesce(title, F.lit("")))
    found = F.instr(F.lower(text), wanted if title_chars is None else F.substring(wanted, 1, title_chars))
    start = F.when((F.length(wanted) > 0) & (found > 1), found).otherwise(F.lit(1))
    return F.substring(text, start, F.length(text) if size is None else F.lit(size))


def role_type(c: Column) -> Column:
    """Known role labels; any other non-empty label is ``non-ai``; empty is null."""
    return F.when(c.isin(*K.ROLE_TYPES), c).when(F.length(c) > 0, "non-ai")
