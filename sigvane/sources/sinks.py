"""Tables out."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

FILES_A_TASK = 1000
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"
_IN_NAMES = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write as .csv or .parquet by the path's suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df.write.mode(mode).parquet(path)
    elif suffix == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError("output path must end with .csv or .parquet")
    return path


def write_extractions(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON object per line; null fields are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_ordered(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write Parquet files that follow ``order`` (nulls last) by name and inside, and return their index.

    The index has a row per file: its name, the position of its first row, its rows, and the first and last key.
    Rows are sorted by ranges of the keys, so no task holds more than its range.
    """
    df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).write.mode("overwrite").parquet(path)
    place, key = F.col("_metadata.row_index"), F.struct(*order)
    stored = df.sparkSession.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_name").alias("file"), place.alias("_place"), key.alias("_key"))
    files = stored.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min_by("_key", "_place").alias("first_key"), F.max_by("_key", "_place").alias("last_key"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("first_position", F.coalesce(F.sum("rows").over(before), F.lit(0)) + 1)


def read_ordered(spark: SparkSession, path: str, index: DataFrame, position: str = "position") -> DataFrame:
    """The rows of ``write_ordered`` with their 1-based position in the whole order."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    placed = rows.join(index.select(F.col("file").alias("_file"), "first_position"), "_file")
    return placed.withColumn(position, F.col("first_position") + F.col("_place")).drop("_file", "_place", "first_position")


def write_json_snapshot(df: DataFrame, path: str, by: list[str], rows_per_file: int = 10_000) -> str:
    """Write files of one JSON array each, of about ``rows_per_file`` rows; rows go to files by a hash of ``by``.

    ``by`` should tell rows apart, or equal ones share a file.  Null fields are left out.
    """
    files = max(1, -(-df.count() // rows_per_file))
    number = F.pmod(F.xxhash64(*by), F.lit(files)).alias("file")
    lines = df.select(number, F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("line"))
    arrays = lines.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("line")), ",\n").alias("value"))
    arrays.select("file", F.concat(F.lit("["), "value", F.lit("]")).alias("value")).write.mode("overwrite").partitionBy("file").text(path)
    return path


def _put_files(batches: Iterator[pa.RecordBatch], prefix: str) -> Iterator[pa.RecordBatch]:
    """A file of the values of every key; equal keys follow each other.  A file is moved into place whole, so a task may run again."""
    made, own = 0, uuid.uuid4().hex
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in itertools.groupby(rows, lambda row: row[0]):
        folder = prefix + _IN_NAMES.sub(lambda m: f"%{ord(m[0]):02X}", key)
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/.{own}", "wb") as out:
            out.writelines((value or "").encode() + b"\n" for _, value in group)
        os.replace(f"{folder}/.{own}", f"{folder}/part-00000.txt")
        made += 1
    yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})


def write_by_key(df: DataFrame, folder: str, key: str, files: int) -> str:
    """Write the text column beside ``key`` as a file per key, laid out as ``partitionBy(key).text(folder)`` does.

    A file takes its time whatever its size, so about ``files`` of them are dealt by number.  Below ``file:``, which all executors
    must share, tasks make the files without Hadoop: without its native library it starts a process for the mode of each file and folder.
    """
    (text,) = (c for c in df.columns if c != key)
    tasks = files // FILES_A_TASK + 1
    if not folder.startswith("file:"):
        df.repartition(tasks, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(folder)
        return folder
    local = re.sub("^file:(//)?(?=/)", "", folder)
    os.makedirs(local)  # refused where the folder exists
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(_NO_NAME))
    dealt = df.select(name.alias("key"), text).repartition(tasks, "key").sortWithinPartitions("key")
    prefix = f"{local}/{key}="
    dealt.mapInArrow(lambda batches: _put_files(batches, prefix), "files long").agg(F.sum("files")).collect()
    return folder


def write_snapshot(df: DataFrame, path: str, snapshot: str) -> str:
    """Write one snapshot as a partition; other snapshots stay."""
    tagged = df.withColumn("snapshot", F.lit(snapshot))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)
    return path


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def write_outputs(tables: Mapping[str, DataFrame], folder: str, signals: list[str], outcomes: list[str], caveat: str, suffix: str = "parquet") -> DataFrame:
    """Write every table to ``folder`` with a one-row metadata table beside them, and return that row.

    Its ``tables`` give the rows of each table as they were counted while it was written, so no table is read again.
    """
    counts = []
    for name, df in tables.items():
        counted = Observation(f"{name} {uuid.uuid4().hex}")
        write_table(df.observe(counted, F.count(F.lit(1)).alias("rows")), f"{folder}/{name}.{suffix}")
        counts.append(F.struct(F.lit(name).alias("table"), F.lit(counted.get["rows"]).cast("long").alias("rows")))
    spark = next(iter(tables.values())).sparkSession
    metadata = spark.range(1).select(
        F.array(*[F.lit(s) for s in signals]).alias("signals"),
        F.array(*[F.lit(o) for o in outcomes]).alias("outcomes"),
        F.lit(caveat).alias("caveat"),
        F.array(*counts).alias("tables"),
        F.current_timestamp().alias("created_at"),
    )
    metadata.write.mode("overwrite").json(f"{folder}/metadata.json")
    return spark.read.json(f"{folder}/metadata.json")
