"""Document fingerprints: a homomorphic multiset hash over paragraphs, in column expressions only.

A paragraph (a line) hashes to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors
modulo powers of two, lane by lane.  The order of the paragraphs therefore does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (``add``, ``subtract``), without the rest of the text.

The vector has two blocks.  ``SUMS`` lanes modulo 2**32 come from hashes of the whole paragraph and decide equality.
The others count one bits of hashes of the paragraph's chunks of ``CHUNK_WORDS`` words, three counters (modulo 2**21,
2**21 and 2**20) to a lane, and a last lane counts the chunks.  Read as sums of +1 and -1 they estimate how many
chunks two documents do not share: ``likeness`` is one minus that number over the number of both documents' chunks.

Defined results: a null text is empty; an empty text is one empty paragraph without chunks; where neither side has
chunks, the likeness is 1 for equal fingerprints and else 0.  Repeated rows have equal fingerprints.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane.llm.common import free_name, text_of

SUMS = 16
PLANES = 2
CHUNK_WORDS = 8
COUNTERS = 3 * 21 * PLANES
LANES = SUMS + 21 * PLANES + 1
LOW = (1 << 32) - 1
ONES = (1 << 42) | (1 << 21) | 1
WRAP = (1 << 62) - 1
CHUNKS = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1," + str(CHUNK_WORDS) + "}+"


def vector(text: Column) -> Column:
    """The fingerprint of a text as an array of ``LANES`` longs."""
    paragraphs = F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p, F.length(p)))
    chunks = F.transform(F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0)), lambda c: F.xxhash64(F.rtrim(c, F.lit(" \t\x0b\x0c\r"))))
    # Each layer of hashes is made once, as a field of a one-row array, and then read in every lane.
    layers = F.array(F.struct(paragraphs.alias("lines"), chunks.alias("chunks")))
    layers = F.transform(layers, lambda h: F.struct(h["lines"].alias("lines"), *[_plane(h["chunks"], k).alias(f"plane{k}") for k in range(PLANES)]))

    def lanes(hashes: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.lit(SUMS)), lambda lane: _sum(hashes["lines"], lambda h: F.xxhash64(lane, h), LOW, LOW))
        return F.concat(sums, *[_counters(hashes[f"plane{k}"]) for k in range(PLANES)], F.array(F.size(hashes["plane0"]).cast("long")))

    return F.transform(layers, lanes)[0]


def _plane(hashes: Column, number: int) -> Column:
    """The chunk hashes themselves, or one of their further hashes."""
    return F.transform(hashes, lambda h: F.xxhash64(F.lit(number), h)) if number else hashes


def _sum(hashes: Column, term, mask: int, wrap: int) -> Column:
    """The masked terms added up, modulo ``wrap`` + 1."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + term(h).bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(wrap).cast("long")))


def _counters(hashes: Column) -> Column:
    """21 lanes of three counters: how many hashes have bit s, s + 21 and s + 42."""
    return F.transform(F.sequence(F.lit(0), F.lit(20)), lambda shift: _sum(hashes, lambda h: F.call_function("shiftrightunsigned", h, shift), ONES, WRAP))


def _wrapped(left: Column, right: Column, sign: int) -> Column:
    """Lane by lane sum or difference, each counter within its power of two."""

    def lane(a: Column, b: Column, i: Column) -> Column:
        fields = []
        for shift, bits in ((0, 21), (21, 21), (42, 20)):
            mask = F.lit((1 << bits) - 1)
            x, y = F.shiftright(a, shift).bitwiseAND(mask), F.shiftright(b, shift).bitwiseAND(mask)
            fields.append(F.shiftleft((x + sign * y + F.lit(1 << bits)).bitwiseAND(mask), shift))
        counters = reduce(lambda p, q: p.bitwiseOR(q), fields)
        return F.when(i < SUMS, (a + sign * b + F.lit(1 << 32)).bitwiseAND(F.lit(LOW))).when(i < LANES - 1, counters).otherwise(a + sign * b)

    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: lane(F.get(left, i), F.get(right, i), i))


def add(left: Column, right: Column) -> Column:
    """The fingerprint of both multisets of paragraphs together."""
    return _wrapped(left, right, 1)


def subtract(left: Column, right: Column) -> Column:
    """The fingerprint of ``left`` without the paragraphs of ``right``."""
    return _wrapped(left, right, -1)


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of chunks in common, 0 to 1; 1 for equal fingerprints."""
    n_left, n_right = F.get(left, F.lit(LANES - 1)), F.get(right, F.lit(LANES - 1))

    def apart(a: Column, b: Column) -> Column:
        """Squared differences of the three +1/-1 sums of a lane."""
        terms = []
        for shift, bits in ((0, 21), (21, 21), (42, 20)):
            mask = F.lit((1 << bits) - 1)
            sums = [2 * F.shiftright(v, shift).bitwiseAND(mask) - n for v, n in ((a, n_left), (b, n_right))]
            terms.append(F.pow((sums[0] - sums[1]).cast("double"), F.lit(2.0)))
        return reduce(lambda p, q: p + q, terms)

    def counters(v: Column) -> Column:
        return F.slice(v, SUMS + 1, 21 * PLANES)

    square = F.aggregate(F.zip_with(counters(left), counters(right), apart), F.lit(0.0), lambda acc, x: acc + x) / COUNTERS
    both = n_left + n_right
    estimate = F.least(F.greatest(1 - square / both, F.lit(0.0)), F.lit(1.0))
    return F.when(left == right, 1.0).when(both == 0, 0.0).otherwise(estimate)


def as_text(fingerprint: Column) -> Column:
    """Hex digits of fixed width, lane by lane."""
    digits = F.transform(fingerprint, lambda lane, i: F.lpad(F.lower(F.hex(lane)), 16, "0"))
    sums = F.transform(F.slice(digits, 1, SUMS), lambda d: F.substring(d, 9, 8))
    return F.concat(F.array_join(sums, ""), F.array_join(F.slice(digits, SUMS + 1, LANES - SUMS), ""))


def fingerprint_documents(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every text (an array of longs) under a free name."""
    return docs.withColumn(free_name(docs, column), vector(text_of()))


def _cuts(keys: DataFrame, ranges: int) -> list[int]:
    """Ids of the table that cut it into about equal ranges, in descending order, the largest first."""
    row = keys.agg(F.max("key").alias("top"), F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges).alias("cuts")).first()
    return sorted({row["top"], *row["cuts"]}, reverse=True) if row["top"] is not None else [0]


def _range_of(key: Column, cuts: list[int]) -> Column:
    """The number of the last cut that is not below the key, by halving."""
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    ends = F.lit(cuts)

    def step(low: Column, size: Column) -> Column:
        return F.when((low + size < len(cuts)) & (F.get(ends, low + size) >= key), low + size).otherwise(low)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, lanes, and the next row's text and lanes (``next_text``, ``next_lanes``).

    Rows are ordered by descending id, then text; the first follows the last; null ids come last.  The ids are cut
    into ranges (eight to a shuffle partition); rows move once, to their range, and the rows that open a range move
    to the range before as well.
    """
    ranges = ranges or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), text_of().alias("text"))
    cuts = _cuts(rows.select("key"), ranges)
    own = _range_of(F.col("key"), cuts)
    opens = F.get(F.lit(cuts), own) == F.col("key")
    before = F.when(own == 0, len(cuts) - 1).otherwise(own - 1)
    places = F.filter(F.array(F.struct(own.alias("range"), F.lit(False).alias("guest")), F.when(opens, F.struct(before.alias("range"), F.lit(True).alias("guest")))), lambda p: p.isNotNull())
    dealt = rows.select("doc_id", "key", "text", F.explode(places).alias("place")).select("doc_id", "key", "text", "place.*")
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    hashed = dealt.repartition("range").withColumn("lanes", vector(F.col("text")))
    after = F.lead(F.struct("text", "lanes")).over(order)
    return hashed.withColumn("after", after).where(~F.col("guest")).select("doc_id", "text", "lanes", F.col("after.text").alias("next_text"), F.col("after.lanes").alias("next_lanes"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every text against its edit and against the next document's text.

    The edit replaces the last floor(n / 3) code points by the first as many (or all) of the next row's.  A table of
    one row is its own next.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    changed = "int(floor(n_chars / 3))"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, int(n_chars) - {changed}), substring(next_text, 1, {changed}))"))
    rows = rows.withColumn("edited_lanes", vector(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
