"""Quality rules: counts of every text, and a hashed n-gram log-likelihood ratio against trusted text.

Two multinomials over hashed n-grams are counted over the whole corpus: one over the trusted texts (labelled good),
one over all texts.  A text's ratio is the mean, over its n-grams, of log(trusted share / raw share); every text
whose ratio reaches ``threshold`` passes.  No text is drawn at random.

Defined results: a null text has no word; a text without n-grams has ratio 0 (n-grams include the text's ends, so
this does not occur); with no trusted text all ratios are 0; ids labelled more than once are trusted when the largest
label is 1; null ids are never trusted.  Repeated rows count each time.  Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane.llm.common import WordHashes, encoded, free_name, hashed_ngrams, text_of

BITS = 16
THRESHOLD = -0.25  # nats a n-gram
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"

MEASURES = pa.struct([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("ratio", pa.float64())])


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words found twice or more, the first finding included.  Exact."""
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    spans = 1
    while spans < width:  # number the windows of twice the length by the pairs of numbers of their halves
        step = min(spans, width - spans)
        top = int(codes.max()) + 1
        codes = np.unique(codes[:-step] * top + codes[step:], return_inverse=True)[1]
        spans += step
    often = (np.bincount(codes) >= 2)[codes]
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(text: str | None, cache: WordHashes, weights: np.ndarray) -> dict:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    buckets = hashed_ngrams(raw, cache, BITS)
    return {
        "n_words": len(words),
        "word_chars": len(text) - spaces,
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": repeated_lines(raw),
        "n_repeat_words": repeated_words(words),
        "ratio": float(weights[buckets].mean()) if len(buckets) else 0.0,
    }


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that the task saw."""
    cache, size = WordHashes(), 1 << BITS
    raw_counts, trusted_counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        for raw, good in zip(encoded(batch.column("text").to_pylist()), batch.column("good").to_pylist(), strict=True):
            counts = np.bincount(hashed_ngrams(raw, cache, BITS), minlength=size) if len(raw) > size else None
            if counts is None:
                found, times = np.unique(hashed_ngrams(raw, cache, BITS), return_counts=True)
            else:
                found = np.flatnonzero(counts)
                times = counts[found]
            raw_counts[found] += times
            if good:
                trusted_counts[found] += times
    seen = np.flatnonzero(raw_counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw_counts[seen]), pa.array(trusted_counts[seen])], names=["bucket", "raw", "trusted"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(trusted share / raw share) per bucket, counted over all documents; 2**BITS numbers come back."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    marked = (
        docs.select("doc_id", text_of().alias("text"))
        .join(good.hint("shuffle_hash"), F.col("doc_id") == F.col("good_id"), "left")
        .select("text", F.col("good_id").isNotNull().alias("good"))
    )
    counted = marked.mapInArrow(_counts, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    rows = counted.toArrow()  # at most 2**BITS rows
    raw, trusted = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[rows["bucket"].to_numpy()] = rows["raw"].to_numpy()
    trusted[rows["bucket"].to_numpy()] = rows["trusted"].to_numpy()
    if not trusted.sum():
        return np.zeros(1 << BITS)
    return np.log((trusted + 1) / (trusted + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def measures_column(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """A struct of the counts and the ratio of every text."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double")
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for batch in batches:
            yield pa.array([measure(value, cache, shipped.value) for value in batch.to_pylist()], MEASURES)

    return measures(text_of(text))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column ``quality_rules``: the measures, ``base_failed`` and ``kept``."""
    name = free_name(docs, "quality_rules")
    with_measures = docs.withColumn(name, measures_column(docs, fit(docs, labels)))
    m = F.col(name)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    return with_measures.withColumn(name, m.withField("base_failed", failed).withField("kept", ~failed & (m["ratio"] >= threshold)))
