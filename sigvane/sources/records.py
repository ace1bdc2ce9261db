"""CSV files whose quoted values hold line breaks, split among tasks all the same.

A line begins a record when an even number of quotes stands before it in its file.  Quotes are summed per block (the part
of a file that one task reads), the block sums are added up in order of the file, and every block then knows whether
it begins inside quotes.  Lines are glued inside their block; what a block begins with that belongs to a record of an earlier
block is one row per block and goes to that record at the end.  No file is read in one task.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigvane import runtime


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, block, number, record): the records of delimited text, with line breaks inside quotes kept.

    ``number`` counts the records that begin in a block from 1.  A quote doubled inside quotes counts twice, so it changes
    nothing.  Where the last quote of a file is missing, its last record runs to the end.  A line break before ``\\n`` may be
    ``\\r``; it is taken off at the end of a record.  Blank records are left out.
    """
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit(quote), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    ).withColumn("quotes", quotes)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("_q"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_q").over(earlier), F.lit(0)).alias("before"))

    inside = Window.partitionBy("file", "block").orderBy("place")
    open_quotes = F.col("before") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.join(blocks, ["file", "block"]).withColumn("begins", (open_quotes % 2 == 0).cast("int"))
    numbered = begun.withColumn("number", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    pieces = numbered.groupBy("file", "block", "number").agg(glued.alias("text"))
    kept = runtime.scratch_path(spark, "pieces.parquet")
    pieces.write.parquet(kept)
    pieces = spark.read.schema(pieces.schema).parquet(kept)

    # A block without a record of its own hands on to the last one before it that has some.
    ends = pieces.groupBy("file", "block").agg(F.max("number").alias("_last"))
    owner = F.last(F.when(F.col("_last") > 0, F.struct(F.col("block").alias("b"), F.col("_last").alias("n"))), ignorenulls=True).over(earlier)
    heads = pieces.where("number = 0").join(ends.select("file", "block", owner.alias("_to")), ["file", "block"])
    rest = heads.groupBy("file", F.col("_to.b").alias("block"), F.col("_to.n").alias("number")).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("rest"))
    whole = F.concat_ws("\n", "text", F.col("rest.text"))
    records = pieces.where("number > 0").join(rest, ["file", "block", "number"], "left")
    return records.select("file", "block", "number", F.regexp_replace(whole, r"\r\z", "").alias("record")).where(F.trim("record") != "")


def read_quoted_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header in every file; columns are text unless a schema is given.

    All files must have the same header, without repeated names.
    """
    records = quoted_records(spark, path)
    is_header = (F.col("block") == 0) & (F.col("number") == 1)
    headers = [r["h"] for r in records.where(is_header).select(F.ltrim("record", F.lit("\ufeff")).alias("h")).distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError("the files differ in their headers" if headers else "no header was found")
    names = next(csv.reader(io.StringIO(headers[0], newline="")))
    if len(set(names)) < len(names):
        raise ValueError("the header repeats a name")
    columns = schema or ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("record", columns, {"escape": '"', "multiLine": "true"})
    return records.where(~is_header).select(parsed.alias("_r")).select("_r.*")
