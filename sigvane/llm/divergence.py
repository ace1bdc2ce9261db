"""How far apart the sources of a language are, by hash-consed segment trees over term ids.

The kept terms of a language are cut into blocks by a hash; inside a block a term's id is its place in UTF-8 order.
Every source has a segment tree over the ids of a block, with its counts at the leaves.  Nodes are hash-consed over
all trees of the block: equal subtrees are one node, so a level holds each (left, right) pair once.  Two trees are
compared by walking down both at once; equal pairs of nodes of one comparison are merged into one with a multiplicity
(what a memo table does from below), so each distinct pair of counts is priced once.  Blocks give sums, which add up.

A block holds about ``BLOCK_ROWS`` counts of one language, whatever the vocabulary is, and one row per source with the source's total.

Terms are maximal runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased.  Shares are exact integers:
1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).

Defined results: null text, language and source are empty strings; a source without terms has share 1 + floor(SCALE /
V) everywhere; a language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs;
ties go by the item's UTF-8 bytes; repeated rows count each time; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigvane.llm.common import written

MIN_DOCUMENTS, TOP_TERMS = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
BLOCK_ROWS, HELD, PAIRS = 1 << 15, 400_000, 4096
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text; bytes from 128 on are what characters beyond ASCII consist of."""
    return raw.translate(LETTERS).split(b" ") if raw else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term, summed up while they fit."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            n.pop(b"", None)
            names = list(n)
            for first in range(0, len(names), 50_000):
                here = names[first : first + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(here), pa.string()), pa.array([source] * len(here), pa.string()), pa.array(here, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in here], pa.int64()), pa.array([docs[t] for t in here], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        columns = [batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()]
        for lang, source, raw in zip(*columns, strict=True):
            n, docs = held[lang, source]
            found = terms(raw)
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flushed()
    yield from flushed()


def shares(counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * size)), exact; in Python's integers where 64 bits are too few."""
    if len(counts) and int(counts.max()) + PRIOR > (1 << 63) // SCALE - 1:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + SCALE * (counts + PRIOR) // (totals + PRIOR * size)).astype(np.int64)


class Forest:
    """The hash-consed segment trees of some sparse rows (tree, id, count); node 0 of every level is the subtree of zeros."""

    def __init__(self, tree: np.ndarray, place: np.ndarray, count: np.ndarray, trees: int, size: int):
        self.size = size
        self.height = max(size - 1, 0).bit_length()
        self.leaf_counts, node = np.unique(np.append(0, count), return_inverse=True)
        node = node[1:]
        self.children: list[np.ndarray] = []  # from the leaves' parents up: (left node, right node) of each node
        for _ in range(self.height):
            above = tree * (1 << 32) + (place >> 1)
            parents, slot = np.unique(above, return_inverse=True)
            sides = np.zeros((len(parents) + 1, 2), np.int64)  # the last row stands for the zeros
            sides[slot, place & 1] = node
            key = sides[:, 0] * (1 << 31) + sides[:, 1]
            _, first, node = np.unique(key, return_index=True, return_inverse=True)
            self.children.append(sides[first])
            tree, place, node = parents >> 32, parents & 0xFFFFFFFF, node[:-1]
        self.roots = np.zeros(trees, np.int64)
        self.roots[tree] = node

    def met_counts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, count in a, count in b, number of ids), each distinct pair of counts of a pair of trees once."""
        pair, left, right = np.arange(len(a)), self.roots[a], self.roots[b]
        times = np.ones(len(a), np.int64)
        for sides in reversed(self.children):
            pair, left, right, times = np.tile(pair, 2), sides[left].T.reshape(-1), sides[right].T.reshape(-1), np.tile(times, 2)
            order = np.lexsort((right, left, pair))
            pair, left, right, times = pair[order], left[order], right[order], times[order]
            new = np.append(True, (pair[1:] != pair[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
            starts = np.flatnonzero(new)
            pair, left, right, times = pair[starts], left[starts], right[starts], np.add.reduceat(times, starts)
        times = times - np.where((left == 0) & (right == 0), (1 << self.height) - self.size, 0)  # ids behind the last term
        return pair, self.leaf_counts[left], self.leaf_counts[right], times

    def leaves(self, a: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in a, id, count in a, count in b) of all ids that a tree of ``a`` counts; subtrees of zeros are not entered."""
        which, left, right, place = np.arange(len(a)), self.roots[a], np.full(len(a), self.roots[b]), np.zeros(len(a), np.int64)
        for sides in [*reversed(self.children), None]:
            full = left > 0
            which, left, right, place = which[full], left[full], right[full], place[full]
            if sides is not None:
                which, left, right = np.tile(which, 2), sides[left].T.reshape(-1), sides[right].T.reshape(-1)
                place = np.concatenate([2 * place, 2 * place + 1])
        return which, place, self.leaf_counts[left], self.leaf_counts[right]


def _block(rows: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """The part sums of all pairs of sources, and each source's first terms, of one block of a language's terms."""
    kind = rows["kind"].to_numpy()
    words = rows.filter(pa.array(kind == 0))
    if not len(words):
        return
    lang = rows["lang"][0].as_py()
    language = rows.filter(pa.array(kind == 2))
    size, whole = language["m"][0].as_py(), language["n"][0].as_py()
    groups = rows.filter(pa.array(kind == 1)).sort_by("source")
    sources, totals = groups["source"].to_pylist(), groups["n"].to_numpy()
    number = {s: i for i, s in enumerate(sources)}
    names = sorted({t.encode() for t in words["term"].to_pylist()})
    ids = {t.decode(): i for i, t in enumerate(names)}
    place = np.fromiter((ids[t] for t in words["term"].to_pylist()), np.int64, len(words))
    tree = np.fromiter((number[s] for s in words["source"].to_pylist()), np.int64, len(words))
    _, first = np.unique(place, return_index=True)  # one row of each term has the language's count
    everything = len(sources)
    forest = Forest(
        np.append(tree, np.full(len(first), everything)), np.append(place, place[first]),
        np.append(words["n"].to_numpy(), words["m"].to_numpy()[first]), everything + 1, len(names),
    )

    def out(part: str, source: list[str], item: list[str], value: np.ndarray) -> pa.RecordBatch:
        fixed = [pa.array([x] * len(source), pa.string()) for x in (lang, part)]
        return pa.RecordBatch.from_arrays(
            [fixed[0], pa.array(source, pa.string()), fixed[1], pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"]
        )

    for a in range(everything - 1):
        for start in range(a + 1, everything, PAIRS):
            others = np.arange(start, min(start + PAIRS, everything))
            pair, x, y, times = forest.met_counts(np.full(len(others), a), others)
            apart = np.abs(shares(x, np.full(len(pair), totals[a]), size) - shares(y, totals[others][pair], size)) * times
            value = np.zeros(len(others), np.int64)
            np.add.at(value, pair, apart)
            yield out("pair", [sources[a]] * len(others), [sources[i] for i in others], value)
    for start in range(0, everything, PAIRS):
        some = np.arange(start, min(start + PAIRS, everything))
        which, at, x, y = forest.leaves(some, everything)
        value = shares(x, totals[some][which], size) - shares(y, np.full(len(which), whole), size)
        which, at, value = which[value > 0], at[value > 0], value[value > 0]
        order = np.lexsort((at, -value, which))
        which, at, value = which[order], at[order], value[order]
        begins = np.searchsorted(which, which)
        best = np.flatnonzero(np.arange(len(which)) - begins < top)
        yield out("term", [sources[some[i]] for i in which[best]], [names[i].decode() for i in at[best]], value[best])


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the terms a source has more of than its language."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = named.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = written(counted, "term_counts")
    often = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("m")).where(F.col("docs") >= min_documents)
    kept = written(counted.select("lang", "source", "term", "n").join(often.drop("docs"), ["lang", "term"]), "kept_terms")
    blocks = 1 + kept.count() // BLOCK_ROWS
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["n"])
    groups = written(groups, "sources")
    languages = often.groupBy("lang").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("m"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    missing, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "source", "term", "n", "m")
    rows = rows.unionAll(groups.select("lang", every, F.lit(1), "source", missing, "n", number)).unionAll(languages.select("lang", every, F.lit(2), missing, missing, "n", "m"))

    def block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block(pa.Table.from_batches(list(parts)), top)

    found = written(rows.groupBy("lang", "block").applyInArrow(block, FOUND), "divergence")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionAll(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    words = found.where("part = 'term'").select("*", place).where(F.col("rank") <= top)
    return pairs.select("*", place).unionByName(words)
