"""What each of five filters takes away, in every order of applying them.

A document has a mask of the filters it fails; only counts by (part, mask) matter afterwards.  The 120 orders are
ranked lexicographically (Lehmer code), so all orders that begin with the same letters are one interval of ranks: a
mask is removed at step s in exactly the intervals of the prefixes of length s whose last letter it fails and whose
earlier letters it passes.  Every such interval adds the mask's counts at its start and takes them off behind its end;
a running sum over the ranks gives each order's totals.  A mask meets 65 prefixes for each letter, whatever the number
of documents.

Failure conditions: A under 100 words; B 100 * distinct words < 80 * words; C 100 * [A-Z] characters > 10 * code
points; D any of #$%&*|; E the text of a document of a smaller id, in any part.

Defined results: a null text is empty (fails A, and E behind another empty one); a null part is the empty string; rows
with one id and one text are copies of no smaller id, so they fail E only if a smaller id has the text; a null id is
larger than all others, and not smaller than another null; a document labelled more than once is good or toxic if any
of its labels says so; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane.llm.common import text_of, written

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]  # in lexicographic order: the place is the rank
MEASURES = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def prefixes() -> list[tuple[str, int, int, int, int]]:
    """(last letter, mask of the letters before it, step, first rank, rank behind the last) of every prefix of an order."""
    out, left = [], 1
    for step in range(STEPS, 0, -1):
        for rank, letters in enumerate(permutations(FILTERS, step)):
            out.append((letters[-1], sum(map(bit, letters[:-1])), step, rank * left, (rank + 1) * left))
        left *= STEPS - step + 1
    return out


def own_failures(text: Column) -> Column:
    """The mask of A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = {
        "A": size < MIN_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * size,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(c, bit(k)).otherwise(0) for k, c in failed.items()), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents, good ones and toxic ones by the set of filters failed."""
    narrow = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        "doc_id",
        F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("text_key"),
        own_failures(text_of()).alias("own"),
    )
    narrow = written(narrow, "failures")  # the texts are read once
    first = narrow.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = narrow.join(first.drop("copies"), "text_key", "left").join(said, F.col("doc_id") == F.col("label_id"), "left")
    copied = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    mask = F.col("own") + F.when(copied, bit("E")).otherwise(0)
    return told.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def interactions(counts: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step) from (part, mask, n, good, toxic)."""
    spark = counts.sparkSession
    counts = written(counts, "mask_counts")  # at most 32 rows for each part
    table = spark.createDataFrame(prefixes(), "letter string, before int, step int, start int, stop int")  # 325 rows
    failing = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(bit(k)) != 0, F.lit(k)) for k in FILTERS]), lambda k: k.isNotNull())
    met = counts.withColumn("letter", F.explode(failing)).join(F.broadcast(table), "letter")
    here = F.col("mask").bitwiseAND(F.col("before")) == 0
    alone = F.col("mask") == F.expr(f"shiftleft(1, ascii(letter) - {ord(FILTERS[0])})")
    changes = {
        "removed": F.when(here, F.col("n")), "redundant": F.when(~here, F.col("n")), "unique_fails": F.when(alone, F.col("n")),
        "good_lost": F.when(here, F.col("good")), "toxic_lost": F.when(here, F.col("toxic")),
    }
    met = met.select("part", "step", "start", "stop", *[F.coalesce(changes[m], F.lit(0)).alias(m) for m in MEASURES])
    ends = F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign")))
    ends = met.withColumn("end", F.explode(ends)).groupBy("part", "step", F.col("end.rank").alias("rank"))
    ends = ends.agg(*[F.sum(F.col(m) * F.col("end.sign")).alias(m) for m in MEASURES])
    cells = counts.groupBy("part").agg(F.sum("n").alias("documents"))
    cells = cells.select("part", "documents", F.posexplode(F.array(*map(F.lit, ORDERS))).alias("rank", "filter_order"))
    cells = cells.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    running = Window.partitionBy("part", "step").orderBy("rank")
    dense = cells.join(ends, ["part", "step", "rank"], "left").withColumns({m: F.sum(F.coalesce(F.col(m), F.lit(0))).over(running) for m in MEASURES})
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    dense = dense.withColumn("kept", F.col("documents") - F.sum("removed").over(so_far))
    everywhere = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    dense = dense.withColumn("shapley", F.sum("removed").over(everywhere))
    return dense.select("part", "filter_order", "step", "kept", *MEASURES, "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return interactions(mask_counts(docs, labels, part))
