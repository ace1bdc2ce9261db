"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text's weighted set is its five-word shingles, each weighing 1 + log2(its count), so that a passage repeated many
times in a text does not outweigh the rest of it.  Shingle d with weight w arrives at the registers
at the times of a Poisson process of rate w, each arrival at a random register; a register keeps its first arrival.
A shingle whose next arrival is later than every register's first one is done (early termination).  Two texts
agree in a register with probability J = sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d), the
probability Jaccard similarity; it is the plain one where all weights are equal.

Texts with the same word sequence are one node before anything else, and only one of them goes on.
Signatures are cut into bands; in each bucket of a band every node is compared with the bucket's first, and
the links that the texts themselves confirm are closed to classes.  Buckets that then still hold several classes are
finished exactly, so that no link of a bucket is lost: their members meet in blocks of ``BLOCK``, and a block gives
back only links that join two classes, never its pairs.  Buckets inside one class, however large, cost nothing more.

Defined results: a text of one to four words is one shingle; texts without words (null, empty, white space) are
copies of one another and have no shingles; rows with one id are one document, which puts the classes of its texts together;
each row without id is a document of its own, behind all ids, in the class of its text (``classes``: one row for equal
texts, and no class_id where no member has an id); an empty table gives none.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane.llm.common import MULTIPLIER, WordHashes, encoded, free_name, rolled, text_of, written

WORDS = 5
SIMILARITY = 0.8
BLOCK, SLICE = 512, 8192  # members of a bucket compared at once, shingles looked at together
BANDS, ROWS = 26, 5  # a pair at 0.8 shares no band with probability 3e-5


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(raw: bytes, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, as sorted hashes, and their weights."""
    words = cache.of(raw.split())
    found, counts = np.unique(rolled(words, min(WORDS, len(words))) if len(words) else words, return_counts=True)
    return found, 1 + np.log2(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of ``registers`` shingle hashes per non-empty weighted set; all sets advance together."""
    sizes = np.array([len(s) for s, _ in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    first = np.full(len(sets) * registers, np.inf)
    kept = np.zeros(len(sets) * registers, np.uint64)
    time = np.zeros(len(element))
    state = _mixed(element + MULTIPLIER)
    while len(element):
        state = _mixed(state + MULTIPLIER)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / weight
        slot = owner * registers + (_mixed(state ^ MULTIPLIER) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(time < first[slot])
        better = better[np.lexsort((element[better], time[better]))][::-1]  # the earliest is written last
        first[slot[better]] = time[better]
        kept[slot[better]] = element[better]
        last = first.reshape(-1, registers).max(axis=1)
        on = time < last[owner]
        owner, element, weight, time, state = owner[on], element[on], weight[on], time[on], state[on]
    return kept.reshape(-1, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, by prefix sums over the shingles in order of their weight ratio."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = np.union1d(a[0], b[0])
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])] = a[1]
    y[np.searchsorted(both, b[0])] = b[1]
    common = (x > 0) & (y > 0)
    if not common.any():
        return 0.0
    if (x[common] == y[common]).all() and (x[common] == 1).all() and x.max() == 1 and y.max() == 1:
        return float(common.sum() / len(both))
    with np.errstate(divide="ignore"):
        ratio = x / y  # infinite where only the first has the shingle
    order = np.argsort(ratio, kind="stable")
    x, y, ratio, common = x[order], y[order], ratio[order], common[order]
    below = np.append(0, np.cumsum(y))[np.searchsorted(ratio, ratio, "right")]  # ratio at most ours: max is y_e / y_d
    above = x.sum() - np.append(0, np.cumsum(x))[np.searchsorted(ratio, ratio, "right")]
    return float((1 / (above[common] / x[common] + below[common] / y[common])).sum())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        ids, hashes, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))
        for first in range(0, len(ids), 256):
            ids_here, hashes_here, raws = ids[first : first + 256], hashes[first : first + 256], list(encoded(texts[first : first + 256]))
            sets = [shingles(raw, cache) for raw in raws]
            keys = [xxhash.xxh3_128_digest(b" ".join(raw.split())) for raw in raws]
            full = [i for i, found in enumerate(sets) if len(found[0])]
            empty = [i for i, found in enumerate(sets) if not len(found[0])]
            for part, width in ((full, BANDS), (empty, 0)):
                bands = _bands([sets[i] for i in part]) if part and width else np.zeros(0, np.int64)
                ends = pa.array(np.arange(len(part) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids_here[i] for i in part], batch.column("doc_id").type), pa.array([hashes_here[i] for i in part], pa.int64()),
                        pa.array([keys[i] for i in part], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands, pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "words_key", "bands"],
                )


def _bands(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One number per set and band."""
    rows = signatures(sets, BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
    bands = rows[:, :, 0].copy()
    for r in range(1, ROWS):
        bands = _mixed(bands * MULTIPLIER + rows[:, :, r])
    return bands.reshape(-1).view(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar."""

    @F.arrow_udf("double")
    def similar(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = WordHashes()
        last, last_set = None, None
        for ids, ours, theirs in parts:
            out = []
            for b, left, right in zip(ids.to_pylist(), encoded(ours.to_pylist()), encoded(theirs.to_pylist()), strict=True):
                if b != last:
                    last, last_set = b, shingles(right, cache)
                out.append(probability_jaccard(shingles(left, cache), last_set))
            yield pa.array(out, pa.float64())

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = pairs.hint("merge").join(left.hint("merge"), "a").hint("merge").join(right.hint("merge"), "b")
    return both.select("a", "b", similar("b", "a_text", "b_text").alias("similarity")).where(F.col("similarity") >= similarity).select("a", "b")


def _block_links(rows: pa.Table, similarity: float) -> pa.Table:
    """Links that join the classes met in a block of a bucket, or in two blocks of it; exact, without listing pairs.

    Counts of common shingles come from products of incidence matrices, a slice of the shingles at a time.
    """
    members, blocks = rows["member"].to_pylist(), rows["block"].to_numpy()
    label_of, labels = np.unique(rows["label"].to_numpy(), return_inverse=True)
    cache = WordHashes(100_000)
    sets = [shingles(raw, cache) for raw in encoded(rows["text"].to_pylist())]
    n, sizes = len(sets), np.array([len(s) for s, _ in sets])
    owner = np.repeat(np.arange(n), sizes)
    weight = np.concatenate([w / w.sum() for _, w in sets]).astype(np.float32)
    _, column, times = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True, return_counts=True)
    met = times[column] > 1
    owner, weight, column = owner[met], weight[met], (np.cumsum(times > 1) - 1)[column[met]]
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    weighted = np.array([w.max(initial=1) > 1 for _, w in sets])
    # Of two members of different classes one at least is outside the largest class.
    rest = np.flatnonzero(labels != np.bincount(labels).argmax())
    common, mass, back = (np.zeros((len(rest), n)) for _ in range(3))
    for first in range(0, int(column.max(initial=-1)) + 1, SLICE):
        here = slice(*np.searchsorted(column, [first, first + SLICE]))
        has = np.zeros((n, SLICE), np.float32)
        has[owner[here], column[here] - first] = 1
        common += has[rest] @ has.T
        if weighted.any():
            share = np.zeros((n, SLICE), np.float32)
            share[owner[here], column[here] - first] = weight[here]
            mass += share[rest] @ has.T
            back += has[rest] @ share.T
    apart = labels[rest][:, None] != labels[None, :]
    if (rows["low"].to_numpy() != rows["high"].to_numpy()).any():
        apart &= blocks[rest][:, None] != blocks[None, :]  # pairs of one block are looked at where the block is alone
    plain = ~weighted[rest][:, None] & ~weighted[None, :]
    near = apart & plain & (common >= similarity * (sizes[rest][:, None] + sizes[None, :] - common))
    # The similarity never exceeds the share of either text's weight that lies on common shingles.
    near |= apart & ~plain & (np.minimum(mass, back) >= similarity - 1e-4)
    parent = list(range(len(label_of)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: tuple[list, list] = ([], [])
    for row, j in np.argwhere(near).tolist():
        i = int(rest[row])
        x, y = top(labels[i]), top(labels[j])
        if x != y and (plain[row, j] or probability_jaccard(sets[i], sets[j]) >= similarity):
            parent[x] = y
            found[0].append(members[i])
            found[1].append(members[j])
    kind = rows["member"].type
    return pa.table({"a": pa.array(found[0], kind), "b": pa.array(found[1], kind)})


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the links, by minimum labels and label jumping.

    Every round is one aggregation by node; a node of many links is pre-aggregated before the shuffle.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.hint("merge"), edges["u"] == labels["node"]).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near.hint("merge"), "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        moved = written(lowered.join(jump.hint("merge"), "low").select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def _some_id(docs: DataFrame) -> Column:
    """The id, any value where it is null: ``_text_hash`` tells the two apart."""
    return F.coalesce(F.col("doc_id"), F.lit(0).cast(dict(docs.dtypes)["doc_id"]))


def _text_hash() -> Column:
    return F.xxhash64(text_of(), F.col("doc_id").isNull())


def _classed(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, words_key), and nodes (words_key, first, class_first): the first (unnamed, doc_id, text_hash) of the node and of its class."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", _text_hash().alias("text_hash"), text_of().alias("text"))
    signed = written(rows.mapInArrow(_signed, f"doc_id {kind}, text_hash long, words_key binary, bands array<long>"), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    firsts = signed.groupBy("words_key").agg(F.min(place).alias("first"), F.any_value("bands").alias("bands"))
    firsts = written(firsts.select(F.monotonically_increasing_id().alias("node"), "*"), "firsts")
    buckets = written(firsts.select(F.col("node").alias("member"), F.posexplode("bands").alias("band", "bucket")).distinct(), "buckets")
    leaders = written(
        buckets.groupBy("band", "bucket").agg(F.min("member").alias("leader"), F.max("member").alias("last")).where(F.col("last") > F.col("leader")).drop("last"), "leaders"
    )
    shared = written(buckets.join(leaders.hint("merge"), ["band", "bucket"]), "shared")
    wanted = firsts.join(shared.select(F.col("member").alias("node")).distinct().hint("merge"), "node", "left_semi")
    wanted = wanted.select("node", F.coalesce("first.doc_id", F.lit(0).cast(kind)).alias("some_id"), "first.text_hash")
    texts = rows.select(_some_id(docs).alias("some_id"), "text_hash", "text").join(wanted.hint("merge"), ["some_id", "text_hash"])
    texts = written(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    pairs = shared.where(F.col("member") > F.col("leader")).select(F.col("member").alias("a"), F.col("leader").alias("b")).distinct()
    links = written(_verified(pairs, texts, similarity).unionAll(_same_id(signed, firsts)), "links")
    labels = components(links)

    # Buckets whose members are still apart (of two members, the one pair has been compared).
    placed = shared.join(labels.withColumnRenamed("node", "member"), "member", "left").select("band", "bucket", "member", F.coalesce("label", "member").alias("label"))
    mixed = placed.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high AND n > 2")
    apart = placed.join(mixed.select("band", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), ["band", "bucket"])
    apart = apart.withColumn("block", F.pmod(F.xxhash64("member", "band"), "blocks").cast("int"))
    dealt = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "member", "label")
    with_text = dealt.join(texts.withColumnRenamed("node", "member"), "member")
    more = with_text.groupBy("band", "bucket", "low", "high").applyInArrow(lambda rows: _block_links(rows, similarity), "a long, b long")
    more = written(more.distinct(), "more_links")
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    linked = firsts.select("words_key", "node", "first").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_class = linked.groupBy("label").agg(F.min("first").alias("class_first"))
    return signed.drop("bands"), linked.join(of_class.hint("merge"), "label").select("words_key", "first", "class_first")


def _same_id(signed: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links between the nodes of an id that has several texts: each to the smallest."""
    held = signed.where(F.col("doc_id").isNotNull()).select("doc_id", "words_key")
    several = held.groupBy("doc_id").agg(F.min("words_key").alias("low"), F.max("words_key").alias("high")).where("low < high").drop("high")
    low = firsts.select(F.col("words_key").alias("low"), F.col("node").alias("b"))
    met = held.join(several, "doc_id").where("words_key > low").select("words_key", "low").distinct()
    return met.join(firsts.select("words_key", F.col("node").alias("a")), "words_key").join(low, "low").select("a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and copy_of (the smallest id with the same words), one row per id."""
    rows, nodes = _classed(docs, similarity)
    nodes = nodes.select("words_key", F.col("first.doc_id").alias("copy_of"), F.col("class_first.doc_id").alias("class_id"))
    own = F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("own")
    return rows.join(nodes, "words_key").groupBy("doc_id", own).agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of")).drop("own")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: the smallest id (of its texts, and of rows without id, the smallest hash), rows without id after all ids."""
    some_id, text_hash, number = (free_name(docs, c) for c in ("some_id", "text_hash", "row_number"))
    _, nodes = _classed(docs, similarity)
    stay = nodes.select("class_first.*").distinct()
    stay = stay.select(_some_id(stay).alias(some_id), F.col("text_hash").alias(text_hash))
    keyed = docs.withColumns({some_id: _some_id(docs), text_hash: _text_hash()})
    left = keyed.join(stay.hint("merge"), [some_id, text_hash], "left_semi")
    equal = Window.partitionBy(some_id, text_hash).orderBy(text_hash)
    return left.withColumn(number, F.row_number().over(equal)).where(F.col(number) == 1).select(*docs.columns)
