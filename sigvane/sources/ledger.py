"""Per-key JSON files that come again: only new and changed files are parsed, and keys that went are reported.

The ledger holds key and content hash of every file; ledger, rows and log of a run are published as one version, so a run
that dies leaves the version before it, and the next run compares with that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import runtime
from sigvane.sources import versions

LEDGER = "key string, hash string"
NOT_PACKED = (".json", ".jsonl", ".txt")
# Small files: a task lists many folders and opens many files; the driver keeps no block locations and forgets the list when it is used.
MANY_FILES = {
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    "spark.sql.files.openCostInBytes": "64k",
    "spark.sql.sources.ignoreDataLocality": "true",
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
}


def _files(spark: SparkSession, directory: str, key_pattern: str, glob: str) -> DataFrame:
    """(key, text) of every file.  Spark's text reader unpacks compressed files, but copies the whole configuration for each file."""
    key = F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1).alias("key")
    chosen = spark.read.options(pathGlobFilter=glob, recursiveFileLookup=True)
    if glob.endswith(NOT_PACKED):
        return chosen.format("binaryFile").load(directory).select(key, F.col("content").cast("string").alias("text"))
    return chosen.text(directory, wholetext=True).select(key, F.col("value").alias("text"))


def refresh(spark: SparkSession, directory: str, root: str, schema: str, key_pattern: str = r"([^/]+)\.json$", glob: str = "*.json") -> DataFrame:
    """Bring the rows below ``root`` up to the files of ``directory``; returns the log (key, action) of this run.

    The first group of ``key_pattern`` in a file's path is its key; a key with several files is refused.  Actions are added,
    changed, unchanged, deleted, and unreadable for a new or changed file that is not one JSON document: it has no rows until
    it changes again.  Rows are those of ``schema`` with the key.  Every file's text is read for its hash, and unchanged ones are not parsed.
    A file is opened once: with very many small ones that takes longest.  Texts are kept in a table of the run for it.
    """
    with runtime.settings(spark, MANY_FILES):
        found = runtime.written(_files(spark, directory, key_pattern, glob).withColumn("hash", F.sha2("text", 256)), "files")
    hashed = found.select("key", "hash")
    first_run = versions.current(spark, root).isEmpty()
    known = spark.createDataFrame([], LEDGER) if first_run else versions.read_current(spark, root, "ledger")
    seen = hashed.groupBy("key").agg(F.max("hash").alias("hash"), F.count(F.lit(1)).alias("_files"))
    both = seen.join(known.select("key", F.col("hash").alias("_old")), "key", "full")
    action = F.when(F.col("hash").isNull(), "deleted").when(F.col("_old").isNull(), "added").when(F.col("hash") != F.col("_old"), "changed").otherwise("unchanged")
    compared = runtime.materialize(both.select("key", "hash", "_files", action.alias("action")))
    repeated = [r["key"] for r in compared.where("_files > 1").limit(3).collect()]
    if repeated:
        raise ValueError(f"several files have the key {', '.join(repeated)}")

    fresh = found.select("key", "text").join(compared.where(F.col("action").isin("added", "changed")).select("key"), "key")
    parsed = fresh.select("key", F.from_json("text", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    parsed = runtime.materialize(parsed.select("key", "_r.*"))
    rows = parsed.where(F.col("_corrupt").isNull()).drop("_corrupt")
    if not first_run:
        same = compared.where("action = 'unchanged'").select("key")
        rows = rows.unionByName(versions.read_current(spark, root, "rows").join(same, "key", "left_semi"))
    broken = parsed.where(F.col("_corrupt").isNotNull()).select("key", F.lit(True).alias("_broken"))
    log = compared.join(broken, "key", "left").select("key", F.when(F.col("_broken"), "unreadable").otherwise(F.col("action")).alias("action"))

    version = versions.Publication(spark, root)
    version.stage("ledger", compared.where("action <> 'deleted'").select("key", "hash"))
    version.stage("rows", rows)
    written = version.stage("log", log)
    version.commit()
    return written
