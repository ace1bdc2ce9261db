"""Sets of tables that change together.

A publication writes each table to a folder of its own version and, when all are there, appends one row per table to
the manifest.  Readers find tables through the manifest only, so a run that dies in between leaves the
version before it as it was; nothing is overwritten.  Row counts are observed while a table is written.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, run string, table string, path string, rows long, published_at timestamp"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published tables, oldest version first; an empty table where nothing was published."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The tables of the newest version; of two runs that took the same number the one of the larger name counts."""
    rows = manifest(spark, root)
    newest = rows.agg(F.max(F.struct("version", "run"))).scalar()
    return rows.where(F.struct("version", "run") == newest)


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the newest version."""
    row = current(spark, root).where(F.col("table") == table).first()
    if row is None:
        raise ValueError(f"no table {table} has been published in {root}")
    return spark.read.parquet(row["path"])


class Publication:
    """A new version of a set of tables: ``stage`` each, then ``commit``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.run = uuid.uuid4().hex
        self.staged: list[tuple[str, str, int]] = []

    def stage(self, table: str, df: DataFrame) -> DataFrame:
        """Write ``df`` to this version's folder and read it back; nobody else sees it before ``commit``."""
        if table in {name for name, _, _ in self.staged}:
            raise ValueError(f"table {table} is already part of this version")
        path = f"{self.root}/{self.run}/{table}.parquet"
        counted = Observation(f"{table} {self.run}")
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self.staged.append((table, path, counted.get["rows"]))
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self) -> DataFrame:
        """Append the manifest rows, as one file; from then on this is the current version."""
        version = 1 + (manifest(self.spark, self.root).agg(F.max("version").alias("v")).first()["v"] or 0)
        rows = self.spark.createDataFrame([(version, self.run, *x) for x in self.staged], MANIFEST.rsplit(",", 1)[0])
        rows.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest.parquet")
        return current(self.spark, self.root)
