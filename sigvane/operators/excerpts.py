"""Keyword-window excerpts of long documents, as array expressions on the document row: no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigvane import constants as K

_HEADING = r"(?iuU)item\s+(\d+a?b?)[.\s]"


@cache
def _letters_like(letter: str) -> str:
    """The characters that equal ``letter`` when case is ignored: those of the same lower case of the upper case."""

    def folded(c: str) -> str:
        upper = c.upper() if len(c.upper()) == 1 else c
        return upper.lower()[0]

    return "".join(c for c in map(chr, range(0x10000)) if folded(c) == folded(letter))


def term_pattern(terms: Sequence[str]) -> str:
    """The terms as whole words; a look at the first letter spares most places the alternatives."""
    word = r"[\p{L}\p{N}_]"
    first = re.escape("".join(sorted({c for t in terms for c in _letters_like(t[0])})))
    return rf"(?=[{first}])(?<!{word})(?iu:{'|'.join(re.escape(t) for t in terms)})(?!{word})"


def hit_spans(documents: DataFrame, text: str, terms: Sequence[str], out: str = "spans") -> DataFrame:
    """Array of (start, end) offsets, 0-based and end-exclusive, of every term hit; null without hits."""
    return _match_spans(documents, text, term_pattern(terms), out)


def _match_spans(documents: DataFrame, text: str, pattern: str, out: str, matches: str | None = None) -> DataFrame:
    """Offsets are running lengths of the pieces between matches and of the matches themselves, which go to ``matches``."""
    # Nothing is pushed below a generator: a filter on the spans does not search the text again.
    found = F.struct(
        F.transform(F.split(F.col(text), pattern, -1), F.length).alias("_gaps"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_matches")
    )
    rows = documents.select("*", F.explode_outer(F.array(found)).alias("_found")).select("*", "_found._gaps", "_found._matches").drop("_found")
    rows = rows.withColumn("_hits", F.transform("_matches", F.length))
    rows = rows.drop("_matches") if matches is None else rows.withColumnRenamed("_matches", matches)
    walk = """aggregate(arrays_zip(slice(_gaps, 1, size(_hits)), _hits),
        named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)),
        (acc, h) -> named_struct(
            'at', acc.at + h.`0` + h._hits,
            'spans', concat(acc.spans, array(named_struct('start', acc.at + h.`0`, 'end', acc.at + h.`0` + h._hits)))),
        acc -> acc.spans)"""
    return rows.withColumn(out, F.when(F.size("_hits") > 0, F.expr(walk))).drop("_gaps", "_hits")


def excerpts(
    documents: DataFrame,
    text: str = "text",
    terms: Sequence[str] = K.FILING_TERMS,
    radius: int = K.EXCERPT_RADIUS,
    budget: int | None = None,
) -> DataFrame:
    """One row per excerpt: overlapping windows around hits merged, trimmed and labelled with the section
    of the last heading before them.

    With a ``budget`` excerpts are kept in order until the next one would exceed it in characters, and
    ``n_dropped`` says how many of the document's were left out.
    """
    keep = [c for c in documents.columns if c != text]
    rows = hit_spans(documents, text, terms).where(F.col("spans").isNotNull())
    rows = _match_spans(rows, text, _HEADING, "_headings", "_labels")
    rows = rows.withColumn("_labels", F.transform("_labels", lambda h: F.lower(F.regexp_extract(h, _HEADING, 1))))
    # ``transform(array(x), v -> ...)[0]`` evaluates x once and names it v.  Window ends never decrease, so
    # an island starts where a window clears the one before it.
    windows = f"transform(spans, s -> named_struct('f', greatest(0, s.start - {radius}), 't', least(length(`{text}`), s.end + {radius})))"
    islands = f"""transform(array({windows}), w -> arrays_zip(
        transform(filter(w, (p, i) -> i = 0 OR p.f > get(w, i - 1).t), p -> p.f),
        transform(filter(w, (p, i) -> i = size(w) - 1 OR get(w, i + 1).f > p.t), p -> p.t)))[0]"""
    chunks = f"""transform({islands}, (z, i) -> named_struct(
        'excerpt_index', i, 'start', z.`0`, 'heading', get(_labels, size(filter(_headings, h -> h.end <= z.`0`)) - 1),
        'excerpt', regexp_replace(substring(`{text}`, z.`0` + 1, z.`1` - z.`0`), '(?U)^\\\\s+|\\\\s+$', '')))"""
    rows = rows.select(*keep, F.expr(chunks).alias("_chunks"))
    dropped = []
    if budget is not None:
        fitting = f"""aggregate(_chunks, named_struct('total', 0L, 'n', 0), (a, x) -> named_struct(
            'total', a.total + length(x.excerpt), 'n', a.n + IF(a.total + length(x.excerpt) <= {budget}, 1, 0)), a -> a.n)"""
        rows = rows.withColumn("_n", F.expr(fitting))
        rows = rows.withColumns({"n_dropped": F.size("_chunks") - F.col("_n"), "_chunks": F.slice("_chunks", F.lit(1), F.col("_n"))})
        dropped = ["n_dropped"]
    flat = rows.select(*keep, *dropped, F.explode_outer("_chunks").alias("_e")).where(F.col("_e").isNotNull()).select(*keep, *dropped, "_e.*")
    heading = F.col("heading")
    names = F.create_map(*[F.lit(x) for pair in K.SECTION_NAMES.items() for x in pair])
    section = F.when(heading.isNull(), "other").otherwise(F.coalesce(F.try_element_at(names, heading), F.concat(F.lit("item_"), heading)))
    return flat.select(*keep, "excerpt_index", "start", section.alias("section"), "excerpt", *dropped)


def latest_of_form(filings: DataFrame, form: str = "10-K") -> DataFrame:
    """The first filing of a form in columnar arrays (newest first): accession, document and date."""
    zipped = F.arrays_zip("form", "accessionNumber", "primaryDocument", "filingDate")
    first = F.filter(zipped, lambda f: f["form"] == form)
    first = F.get(first, F.lit(0))
    others = [c for c in filings.columns if c not in ("form", "accessionNumber", "primaryDocument", "filingDate")]
    return filings.select(
        *others, first["accessionNumber"].alias("accession"), first["primaryDocument"].alias("document"), first["filingDate"].alias("filing_date")
    ).where(F.col("accession").isNotNull())


def verify_quotes(quotes: DataFrame, documents: DataFrame, key: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """Quotes with whether their document holds them verbatim."""
    return quotes.join(documents.select(key, text), key, "left").withColumn(
        "found", F.coalesce(F.contains(F.col(text), F.col(quote)), F.lit(False))
    ).drop(text)
