"""From raw documents to packed token sequences: five stages, each written before the next reads it.

Defined results, of all stages: rows without an id are documents of their own, rows of one id stay rows of their own
until the third stage, columns beside ``doc_id``, ``text`` and ``n_chars`` pass through whatever they are called, and an
empty table gives an empty one of the same columns.  The stages' docstrings say what null, empty and
repeated texts become; very long texts are read whole everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane.llm import line_dedup, near_dedup, packing, pii, quality_classifier
from sigvane.llm.common import free_name, table, written
from sigvane.llm.queries import PSEUDONYM_KEY

MIN_QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score reaches ``MIN_QUALITY``.

    A null text is scored like an empty one, and repeated rows alike.  Without two labelled rows of each class the score
    of every text is the share of label 1, so all stay or all go.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return docs.withColumn(score, quality_classifier.score_column(docs, model)).where(F.col(score) >= MIN_QUALITY).select(*docs.columns)


def with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with the text replaced and counted anew."""
    changed = docs.withColumn("text", text)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document of a smaller id holds.

    No row goes: a document whose lines all stand elsewhere, like one of null text, is left with an empty text.  Rows of
    one id are one document, so lines they share stay in each.
    """
    left = line_dedup.drop_repeated_lines(docs)
    return with_text(left, F.col(free_name(docs, "line_dedup"))["text"], docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near-duplicates.

    Rows of one id are one class with all that is near to any of them; one row of a class stays, one without an id only
    where no row of it has one.  Texts without a word are one class.
    """
    return near_dedup.keep_one(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms.

    Null and empty texts stay as they are, and equal values become equal pseudonyms in all documents.
    """
    return with_text(pii.pseudonymize(docs, PSEUDONYM_KEY), F.col("text"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null or empty text is one piece of the end id alone; a text beyond 2048 ids is several pieces; of equal rows each is packed.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each),
    ("pseudonyms", with_pseudonyms),
    ("packing", packed),
]

ORACLE_SQL = None  # the first, third and fourth stage cannot be said in SQL; tests/llm/test_pipeline.py holds all five against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage{number}")
    return docs
