"""Permutations as arithmetic: the place of an element is computed, so nothing is sorted.

Each round pairs place x with the place k - x (modulo the size) and swaps the pair or leaves it, by a bit drawn from the larger
of the two.  Both members of a pair see the same bit, so every round, and with it the whole, is a bijection for any size.  A swap
puts an element on a uniform place, since k is; that none of the rounds swaps it has probability ``2 ** -ROUNDS``.
Places are computed in Arrow batches: as column expressions the rounds either run interpreted or grow with every use of a place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane.runtime import written

ROUNDS = 32
PRIME = 2**31 - 1
BLOCK = 32_768  # slots whose values, or rows, meet in one task
REPLICATES = 25  # that a task draws of a block at once


@lru_cache(maxsize=4096)
def round_keys(seed: int, replicate: int) -> np.ndarray:
    """The keys k, a, b, c of every round, from an MD5 of seed, replicate and round."""
    digests = [hashlib.md5(f"{seed}:{replicate}:{r}".encode()).hexdigest() for r in range(1, ROUNDS + 1)]
    return np.array([(int(d[:12], 16), int(d[12:20], 16) % PRIME, int(d[20:28], 16) % PRIME, int(d[28:], 16)) for d in digests], dtype=np.int64)


def walked(place: np.ndarray, size: np.ndarray | int, keys: Iterable[tuple]) -> np.ndarray:
    """The places after the rounds of ``keys``; a round undoes itself, so the rounds backwards lead back."""
    x = place
    for k, a, b, c in keys:
        mirror = k % size - x
        mirror = np.where(mirror < 0, mirror + size, mirror)
        mixed = (np.maximum(x, mirror) % PRIME * a + b) % PRIME
        x = np.where((mixed * mixed + c) % PRIME & 1 == 1, mirror, x)
    return x


def permuted(place: Column, size: Column, replicate: Column, seed: int) -> Column:
    """The place, from 0 to ``size`` - 1, that ``place`` goes to in a replicate; none of them may be null."""

    @F.pandas_udf("long")
    def walk(place: pd.Series, size: pd.Series, replicate: pd.Series) -> pd.Series:
        drawn, which = np.unique(replicate.to_numpy(), return_inverse=True)
        if not len(drawn):
            return place
        keys = np.stack([round_keys(seed, int(r)) for r in drawn])
        return pd.Series(walked(place.to_numpy(), size.to_numpy(), keys[which].transpose(1, 2, 0)))

    return walk(place, size, replicate)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def shuffled_sums(
    rows: DataFrame,
    by: str,
    slot: str,
    size: str,
    value: str,
    weights: Sequence[str],
    group: str,
    replicates: int,
    seed: int,
    block: int = BLOCK,
    at_once: int = REPLICATES,
) -> DataFrame:
    """Sums of the shuffled ``value`` per (``by``, replicate, ``group``): of itself, its square and its products with ``weights``.

    In a replicate a row gets the value of the slot that its own is ``permuted`` to; the slots of a ``by`` group of ``size`` rows
    run from 0.  The values go to their rows, found by the rounds backwards, as arrays of place and value: a task holds ``block``
    slots and ``at_once`` replicates of them, first those of the values and then those of the rows.  Sums come as ``_n``, ``_sum``,
    ``_squares`` and ``_by_{weight}``.  ``block`` is at most 32768.
    """
    spark = rows.sparkSession
    packed = F.array_sort(F.collect_list(F.struct(slot, value, *weights, group))).alias("_all")
    blocks = rows.groupBy(by, F.floor(F.col(slot) / block).cast("int").alias("_block")).agg(F.max(size).cast("long").alias("_size"), packed)
    blocks = written(blocks.select(by, "_block", "_size", *[F.col(f"_all.{c}").alias(c) for c in (value, *weights, group)]), "blocks")
    first = F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(at_once))).alias("_first")
    keys = [by, "_block", "_first"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                key, here, n, start = (one.column(c) for c in (by, "_block", "_size", "_first"))
                here, n, start = here[0].as_py(), n[0].as_py(), start[0].as_py()
                given, _ = _flat(one.column(value))
                slots = here * block + np.arange(len(given), dtype=np.int64)
                places, values, cuts = [], [], []
                for replicate in range(start, min(start + at_once, replicates + 1)):
                    row = walked(slots, n, round_keys(seed, replicate)[::-1].tolist())
                    home = row // block
                    order = np.argsort(home.astype(np.int32), kind="stable")
                    homes, counts = np.unique(home, return_counts=True)
                    places.append((row % block)[order].astype(np.int16))
                    values.append(given[order])
                    cuts.append((np.full(len(homes), replicate), homes, counts))
                replicate, homes, counts = (np.concatenate(c) for c in zip(*cuts, strict=True))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        key.take(pa.array(np.zeros(len(homes), dtype=np.int32))), pa.array(homes.astype(np.int32)),
                        pa.array(np.full(len(homes), start, dtype=np.int32)), pa.array(replicate.astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values))),
                    ],
                    names=[*keys, "_rep", "_place", "_value"],
                )

    def add(pieces: pa.Table, home: pa.Table) -> pa.Table:
        start = home["_first"][0].as_py()
        groups = home[group].combine_chunks().flatten().dictionary_encode()
        code = groups.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        levels, begin, counts = np.unique(code[order], return_index=True, return_counts=True)
        place, lengths = _flat(pieces["_place"])
        replicate = pieces["_rep"].to_numpy() - start
        shuffled = np.empty((replicate.max() + 1, len(code)))
        shuffled[np.repeat(replicate, lengths), place] = _flat(pieces["_value"])[0]
        shuffled = shuffled[:, order]

        def summed(products: np.ndarray) -> pa.Array:
            return pa.array(np.add.reduceat(products, begin, axis=1).ravel())

        times = len(shuffled) * len(levels)
        columns = {
            by: home[by].take(pa.array(np.zeros(times, dtype=np.int32))),
            "_rep": pa.array(np.repeat(np.arange(start, start + len(shuffled), dtype=np.int32), len(levels))),
            group: groups.dictionary.take(pa.array(np.tile(levels, len(shuffled)))),
            "_n": pa.array(np.tile(counts, len(shuffled)).astype(np.int64)), "_sum": summed(shuffled), "_squares": summed(shuffled * shuffled),
        }
        columns |= {f"_by_{w}": summed(shuffled * _flat(home[w])[0][order]) for w in weights}
        return pa.table(columns)

    kinds = dict(rows.dtypes)
    key = f"`{by}` {kinds[by]}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few rows make many, so their size says nothing
    values = blocks.select(by, "_block", "_size", first, value).repartition(tasks, *keys)
    pieces = values.mapInArrow(draw, f"{key}, _block int, _first int, _rep int, _place array<smallint>, _value array<double>")
    homes = blocks.select(by, "_block", first, *weights, group)
    sums = ", ".join(f"`{c}` double" for c in ("_sum", "_squares", *[f"_by_{w}" for w in weights]))
    parts = pieces.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInArrow(add, f"{key}, _rep int, `{group}` {kinds[group]}, _n long, {sums}")
    totals = [F.sum(c).alias(c) for c in ("_n", "_sum", "_squares", *[f"_by_{w}" for w in weights])]
    return parts.groupBy(by, "_rep", group).agg(*totals)
