"""What several operators share: columns, written tables, words and hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import runtime

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` (names compare without case) is called so."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


FORGET = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, forget: bool = False) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Cuts the lineage, keeps the columns prunable, and survives the executors that wrote it.  ``forget`` lets Spark
    delete the shuffle files of the write when it has ended, instead of when the driver collects its garbage.
    """
    path = runtime.scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(FORGET, None)
    if forget:
        conf.set(FORGET, "true")
    try:
        df.write.parquet(path)
    finally:
        if forget:
            conf.set(FORGET, before) if before is not None else conf.unset(FORGET)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words (as bytes), remembered up to ``limit`` words; later ones are hashed each time."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive entries; fewer entries than that give none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= MULTIPLIER
        out += hashes[k : n + k]
        out ^= out >> np.uint64(29)
    return out


def hashed_ngrams(raw: bytes, cache: WordHashes, bits: int) -> np.ndarray:
    """Buckets (below 2**bits) of the word unigrams and bigrams and of the byte trigrams of a text.

    The text's start and end count as a word, so an empty text has one bigram.
    """
    words = cache.of([b"\n", *raw.split(), b"\n"])
    letters = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    trigrams = (letters[:-2] << np.uint64(16)) | (letters[1:-1] << np.uint64(8)) | letters[2:]
    both = np.concatenate([words[1:-1], rolled(words, 2), trigrams + np.uint64(1 << 30)])
    both ^= both >> np.uint64(31)
    both *= MULTIPLIER
    return (both >> np.uint64(64 - bits)).astype(np.uint32)


def encoded(values: Iterable[str | None]) -> Iterable[bytes]:
    for value in values:
        yield b"" if value is None else value.encode("utf-8", "surrogatepass")
