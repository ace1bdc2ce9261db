"""Tables in: CSV, Parquet, JSON snapshots, per-key JSON files and JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import schemas
from sigvane.operators import normalize
from sigvane.operators.extraction import document_errors, document_warnings
from sigvane.operators.ordering import prefix_sums
from sigvane.sources.records import read_quoted_csv

LONG_TEXT = 12_000  # characters; longer texts are kept and reported


def read_table(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """A .csv or .parquet table; CSV columns are text unless a schema is given, so identifiers keep their zeros.

    CSV files are split among tasks; ``multi_line`` allows line breaks inside quotes, at the price of a shuffle of the text.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "parquet"):
        raise ValueError("table path must end with .csv or .parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "parquet":
        return reader.parquet(path)
    if multi_line:
        return read_quoted_csv(spark, path, schema)
    return reader.option("header", True).option("escape", '"').csv(path)


def load_scores(spark: SparkSession, path: str, available_at: str | None = None) -> DataFrame:
    return normalize.normalize_scores(read_table(spark, path), available_at).strict("score file")


def load_financials(spark: SparkSession, path: str, allow_early: bool = False) -> DataFrame:
    return normalize.normalize_financials(read_table(spark, path), allow_early).strict("financial file")


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    return normalize.normalize_prices(read_table(spark, path)).strict("price file")


def load_postings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Descriptions hold line breaks, so records are glued from lines unless the caller knows better."""
    return normalize.normalize_postings(read_table(spark, path, multi_line=multi_line)).strict("posting file")


def load_companies(spark: SparkSession, path: str) -> DataFrame:
    return normalize.normalize_companies(read_table(spark, path)).strict("company master")


def read_optional(spark: SparkSession, path: str, schema: str, label: str, missing: list[str]) -> DataFrame:
    """The table, or an empty one of ``schema`` with ``label`` appended to ``missing`` when there is no such path."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        missing.append(label)
        return spark.createDataFrame([], schema)


def read_json_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table stored as one JSON array per file, also in folders below ``path``.

    A column of type ``variant`` keeps whatever the snapshot holds there.  A file is read by one task, so a large table has many.
    """
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def read_json_files(spark: SparkSession, directory: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One JSON document per file, files chosen by name."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(directory)


def search_results(spark: SparkSession, directory: str) -> DataFrame:
    """One row per search result of the per-ticker files."""
    files = read_json_files(spark, directory, schemas.SEARCH_RESULTS, "jobs_*.json")
    return files.select("ticker", "company", "snapshot", F.posexplode("results").alias("result_index", "_r")).select("*", "_r.*").drop("_r")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and 1-based line number, numbered without reading a file in one task."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")
    )
    numbered = prefix_sums(lines, ["file"], ["_block", "_place"], before="_earlier")
    return numbered.select("file", (F.col("_earlier") + 1).alias("line_number"), "value")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid source documents of JSON-lines files, and the bad rows with file, line number and reason.

    Documents keep their whole text; those over ``LONG_TEXT`` characters carry a warning.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    schema = schemas.DOCUMENTS + ", _corrupt string"
    parsed = lines.withColumn("_d", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = parsed.select("file", "line_number", "_d.*")
    reasons = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("invalid_json"))).otherwise(document_errors(rows))
    rows = rows.withColumn("errors", reasons)
    good = rows.where(F.size("errors") == 0).drop("file", "line_number", "_corrupt", "errors")
    good = good.withColumn("warnings", document_warnings(LONG_TEXT))
    return good, rows.where(F.size("errors") > 0).select("file", "line_number", "errors")


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXTRACTIONS).json(path)


def latest_snapshot(table: DataFrame, column: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot; on a partition column only its folder is read."""
    newest = table.agg(F.max(column)).scalar()
    return table.where(F.col(column) == newest)


def new_rows(incoming: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not processed before, so a rerun only adds what is missing."""
    return incoming.join(done.select(*keys).distinct(), keys, "left_anti")


_LEVELS = 6  # cells of 1, 16, ... 16^5 days


def _cells(history: DataFrame) -> DataFrame:
    """(_i, held_by, _level, _cell): every validity span as the few aligned cells that make it up."""
    first, last = "coalesce(valid_from, DATE '0001-01-01')", "coalesce(valid_to, DATE '9999-12-31')"
    spans = history.selectExpr("identifier AS _i", "company_id AS held_by", f"unix_date({first}) AS a", f"unix_date({last}) AS b", f"explode(sequence(0, {_LEVELS - 1})) AS _level")
    wide = spans.selectExpr(
        "*", "ceil(a / pow(16D, _level)) AS lo", "floor(b / pow(16D, _level)) AS hi",
        "16 * ceil(a / pow(16D, _level + 1)) AS up", "16 * floor(b / pow(16D, _level + 1)) AS down",
    )

    def between(low: str, high: str) -> str:
        return f"if({low} < {high}, sequence({low}, {high} - 1), CAST(array() AS array<bigint>))"

    # What the next wider cells hold is left to them.
    cells = f"if(_level < {_LEVELS - 1} AND up < down, concat({between('lo', 'up')}, {between('down', 'hi')}), {between('lo', 'hi')})"
    return wide.selectExpr("_i", "held_by", "_level", f"explode({cells}) AS _cell")


def valid_identifiers(facts: DataFrame, history: DataFrame, date: str, identifier: str = "identifier") -> DataFrame:
    """Facts with the company that held their identifier on the date (validity is [from, to), open when null).

    A day lies in one cell of every width and a span is cut into cells without overlap, so the join is by equal keys
    and makes no pair that is not in the result.
    """
    days = facts.select(F.col(identifier).alias("_i"), F.col(date).cast("date").alias("_d")).where("_i IS NOT NULL AND _d IS NOT NULL").distinct()
    probes = days.selectExpr("_i", "_d", f"explode(sequence(0, {_LEVELS - 1})) AS _level")
    probes = probes.selectExpr("_i", "_d", "_level", "floor(unix_date(_d) / pow(16D, _level)) AS _cell")
    held = probes.join(_cells(history), ["_i", "_level", "_cell"]).select("_i", "_d", "held_by")
    return facts.join(held, (F.col(identifier) == F.col("_i")) & (F.col(date).cast("date") == F.col("_d")), "left").drop("_i", "_d")
