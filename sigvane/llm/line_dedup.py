"""Exact line deduplication against levelled sorted runs of line hashes.

Documents are taken in batches of ascending id.  The distinct line keys of a batch, with the smallest id that holds
each, are merge-anti-joined with every run written before and what is left is added as a new sorted run (a bucketed,
sorted table, so the runs are neither shuffled again nor read by more than their bucket's task).  When a level has
``fanout`` runs they are compacted into one run of the next level.  In the end the runs hold every key once, with
its owner; a document keeps the lines whose keys it owns.  Keys are 128-bit hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.  Keys shorter than ``min_chars``
code points are never dropped.  Of the others, all lines in documents other than the key's owner (the smallest id
holding it) go.

Defined results: a null or empty text is one empty line; rows with one id are one document (equal rows keep equal
lines); each row without an id is a document of its own, after all ids and in the order in which these rows are
written aside; an empty table gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import runtime
from sigvane.llm.common import free_name, text_of, written

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS = 10
NO_ID = (1 << 63) - 1
KEYS = "h1 long, h2 long, owner long, place long"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits for the line's key, or nothing for a short one."""
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, owners, places = [], [], []
        for owner, place, text in zip(*[batch.column(c).to_pylist() for c in ("owner", "place", "text")], strict=True):
            found = {line_key(line, min_chars) for line in text.encode("utf-8", "surrogatepass").split(b"\n")}
            found.discard(None)
            digests.extend(found)
            owners.extend([owner] * len(found))
            places.extend([place] * len(found))
        pairs = pa.py_buffer(b"".join(digests))
        both = pa.Array.from_buffers(pa.int64(), 2 * len(digests), [None, pairs]).to_numpy().reshape(-1, 2)
        columns = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(owners, pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "owner", "place"])


class LineRuns:
    """The runs, newest level first.  Each holds (h1, h2, owner, place), bucketed and sorted by (h1, h2), keys unique over all runs."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark = spark
        self.fanout = fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = runtime.scratch_path(self.spark, name)
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def add(self, keys: DataFrame) -> None:
        """Add the keys (unique in the batch) that no run holds, then compact full levels."""
        for name, _ in (run for level in self.levels for run in level):
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(keys))
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = None
            for name, _ in level:
                run = self.spark.table(name)
                merged = run if merged is None else merged.unionByName(run)
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._write(merged.repartition(self.buckets, "h1", "h2")))
            self._forget(level)
            self.levels[depth] = []

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")  # the files stay until the checkpoint folder is cleared

    def close(self) -> DataFrame:
        """All (h1, h2, owner, place), read by path; the table names are given back."""
        runs = [run for level in self.levels for run in level]
        self._forget(runs)
        if not runs:
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema(KEYS).parquet(*[path for _, path in runs])


def _limits(ids: DataFrame, batches: int) -> list[int]:
    """Ids that cut the table into about equal batches."""
    cuts = ids.agg(F.percentile_approx("owner", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def _placed(docs: DataFrame, owner: str, place: str) -> DataFrame:
    """``docs`` with the id as ``owner`` and ``place`` -1; a row without an id has the largest owner and a place of its own."""
    number = F.col("doc_id").cast("long")
    known = docs.where(number.isNotNull()).withColumns({owner: number, place: F.lit(-1).cast("long")})
    # Written, so that every reading finds the same places.
    alone = written(docs.where(number.isNull()).withColumn(place, F.monotonically_increasing_id()), "rows_without_id")
    return known.union(alone.withColumn(owner, F.lit(NO_ID)).select(known.columns))


def owned_keys(rows: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, owner, place) for every line key of the (owner, place, text), by way of the runs."""
    limits = _limits(rows.select("owner"), batches) if batches > 1 else []
    runs = LineRuns(rows.sparkSession, fanout)
    for low, high in zip([None, *limits], [*limits, None], strict=True):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("owner") > low)
        if high is not None:
            batch = batch.where(F.col("owner") <= high)
        keys = batch.mapInArrow(lambda parts: _keys(parts, min_chars), KEYS)
        first = keys.groupBy("h1", "h2").agg(F.min(F.struct("owner", "place")).alias("first"))
        runs.add(first.select("h1", "h2", "first.owner", "first.place"))
    return runs.close()


def drop_repeated_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with a struct column ``line_dedup`` of (text, n_lines, n_dropped): what is left and the counts."""
    name, key, place, keys = (free_name(docs, c) for c in ("line_dedup", "line_owner", "line_place", "line_keys"))
    rows = _placed(docs, key, place)
    owned = owned_keys(rows.select(F.col(key).alias("owner"), F.col(place).alias("place"), text_of().alias("text")), batches, fanout, min_chars)
    owned = owned.groupBy(F.col("owner").alias(key), F.col("place").alias(place)).agg(F.collect_list("h1").alias(keys))

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def kept(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, owned_by in parts:
            rows = []
            for text, mine in zip(texts.to_pylist(), owned_by.to_pylist(), strict=True):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                mine = set(mine or ())
                stay = []
                for line in lines:
                    digest = line_key(line, min_chars)
                    if digest is None or int.from_bytes(digest[:8], "little", signed=True) in mine:
                        stay.append(line)
                rows.append({"text": b"\n".join(stay).decode("utf-8", "surrogatepass"), "n_lines": len(lines), "n_dropped": len(lines) - len(stay)})
            yield pa.array(rows, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    return (
        rows.join(owned, [key, place], "left")
        .withColumn(name, kept(text_of(), F.col(keys)))
        .drop(key, place, keys)
    )
