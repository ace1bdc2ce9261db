"""Packing documents into sequences: first-fit decreasing on a tournament tree, in randomised groups.

Every document becomes ids (its text by the vocabulary, then ``end_id``), cut into pieces of ``length`` ids and a
rest.  Pieces are dealt at random (by a hash) to groups of about ``group_size``; each group is packed on its own, the
longest piece first, into the first sequence with room, which a tournament tree of the capacities left finds in
logarithmic time.  Only (id, start, length) of pieces are shuffled, never ids or texts.

Defined results: a null text is empty and has the end id alone; equal rows are packed each on their own, wherever
the hash of their place in the table deals them; an empty table gives no piece.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigvane.llm import tokens
from sigvane.llm.common import text_of, written

LENGTH = 2048
END_ID = 1
GROUP_SIZE = 4096


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) per item, items given in descending order.

    ``tree[1]`` is the most room left in any bin, leaves are the bins from the left; an item goes down to the
    leftmost leaf with room for it.
    """
    leaves = 1 << max(len(sizes) - 1, 0).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def _pieces(batches: Iterator[pa.RecordBatch], length: int, end_id: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    tokenizer = tokens.loaded(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            encoded = tokenizer.encode(text) + end
            n = len(encoded) // 4
            for start in range(0, n, length):
                piece = encoded[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], batch.column("doc_id").type), *[pa.array(c, pa.int64()) for c in columns[1:]]],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        )


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        lambda batches: _pieces(batches, length, end_id, vocabulary), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, group_size: int = GROUP_SIZE, seed: int = 11) -> DataFrame:
    """The pieces with ``sequence_id`` (group times 2**32 plus the bin) and ``offset``."""
    cut = written(pieces(docs, length, end_id, vocabulary).withColumn("place", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group_size))
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(groups)))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "place"], ascending=[False, True])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        rows["sequence_id"] = rows["pack_group"].to_numpy() * (1 << 32) + bins
        rows["offset"] = offsets
        return rows.drop(columns=["place", "pack_group"])

    return dealt.groupBy("pack_group").applyInPandas(packed, f"doc_id {dict(cut.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
