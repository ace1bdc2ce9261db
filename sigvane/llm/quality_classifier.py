"""Quality scores from a naive-Bayes support-vector model (hashed n-gram indicators, hinge loss).

The indicators are those of word unigrams and bigrams, of byte trigrams, and of three shapes of n-grams whatever their
words (a word twice in a row, three times in a row, eight words found again), each hashed to one of 2**bits buckets.
Every indicator is scaled by its class log-count ratio, a text's vector is brought to unit length, and a
linear model with hinge loss is fitted by dual coordinate descent.  A logistic curve fitted on rows kept out of the
descent turns margins into probabilities.

The model is fitted on a sample of at most about ``max_rows`` labelled rows, drawn by a hash of the id (all rows
where there are fewer); its size on the driver and as a broadcast is therefore fixed.  Scoring reads every text.

Defined results: a null text is empty, an empty text has the one bigram (start, end); ids without label, labels
without document and null labels are ignored; an id labelled more than once counts once, with the most frequent
label, the larger one on ties; with fewer than two rows of a class every text gets the share of label 1
(plus one over plus two).  Repeated rows are scored alike.  Other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane.llm.common import WordHashes, encoded, hashed_ngrams, id_remainder, rolled, text_of, written

BITS = 18
HELD_OUT_MODULUS = 5


def indicators(raw: bytes, cache: WordHashes, bits: int) -> np.ndarray:
    """The distinct buckets of a text."""
    words = cache.of(raw.split())
    same = words[1:] == words[:-1]
    windows = rolled(words, 8)
    shapes = [same.any(), (same[1:] & same[:-1]).any(), len(np.unique(windows)) < len(windows)]
    return np.unique(np.concatenate([hashed_ngrams(raw, cache, bits), np.flatnonzero(shapes).astype(np.uint32)]))


@dataclass
class Model:
    """``weights`` and ``ratios`` per bucket, the bias, and the curve margin -> probability."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, buckets: np.ndarray) -> float:
        ratio = self.ratios[buckets]
        norm = math.sqrt(float(ratio @ ratio)) or 1.0
        margin = float(self.weights[buckets] @ ratio) / norm + self.bias
        return 1.0 / (1.0 + math.exp(-min(max(self.slope * margin + self.offset, -700.0), 700.0)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smoothing: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each indicator among rows of label 1 over that among label 0."""
    shares = []
    for wanted in (1, 0):
        counts = np.full(size, smoothing)
        for buckets, label in zip(rows, labels, strict=True):
            if label == wanted:
                counts[buckets] += 1
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss and squared norm, one dual variable at a time; the bias is a feature of value one."""
    weights, bias = np.zeros(size), 0.0
    signs = np.where(labels == 1, 1.0, -1.0)
    alphas = np.zeros(len(rows))
    squares = [float(v @ v) + 1.0 for v in values]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1.0
            alpha = min(max(alphas[i] - gradient / squares[i], 0.0), cost)
            step = (alpha - alphas[i]) * signs[i]
            if step:
                alphas[i] = alpha
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1), by Newton steps on smoothed targets."""
    ones, zeros = int((labels == 1).sum()), int((labels != 1).sum())
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, offset = 1.0, math.log((ones + 1) / (zeros + 1))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float(np.sum(np.logaddexp(0, z) - target * z)) + 5e-4 * a * a

    best = loss(slope, offset)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        g = p - target
        h = np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(g @ margins) + 1e-3 * slope, float(g.sum())
        haa, hab, hbb = float(h @ (margins * margins)) + 1e-3, float(h @ margins), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-6 and (now := loss(slope - step * da, offset - step * db)) > best:
            step /= 2
        if step <= 1e-6:
            break
        slope, offset, gain, best = slope - step * da, offset - step * db, best - now, now
        if gain < 1e-9:
            break
    return max(slope, 0.0), offset


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> Model:
    """The model of these bucket sets; every fifth row fits the curve, the others the weights."""
    size = 1 << bits
    if min((labels == 1).sum(), (labels != 1).sum()) < 2:
        share = ((labels == 1).sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, math.log(share / (1 - share)))
    apart = np.zeros(len(labels), bool)
    for label in (0, 1):
        apart[np.flatnonzero((labels == 1) == bool(label))[1::5]] = True
    used = np.flatnonzero(~apart)
    part = [rows[i] for i in used]
    ratios = log_count_ratios(part, labels[used], size)
    values = []
    for buckets in part:
        ratio = ratios[buckets]
        values.append(ratio / (math.sqrt(float(ratio @ ratio)) or 1.0))
    weights, bias = dual_descent(part, values, labels[used], size, cost, epochs, seed)
    model = Model(weights, ratios, bias, 1.0, 0.0)
    margins = []
    for i in np.flatnonzero(apart):
        ratio = ratios[rows[i]]
        margins.append(float(weights[rows[i]] @ ratio) / (math.sqrt(float(ratio @ ratio)) or 1.0) + bias)
    model.slope, model.offset = logistic_curve(np.array(margins), labels[apart])
    return model


def training_labels(labels: DataFrame, modulus: int = HELD_OUT_MODULUS) -> DataFrame:
    """(doc_id, label): one row per labelled id outside the held-out remainder 0."""
    return (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (id_remainder(modulus) != 0))
        .groupBy("doc_id")
        .agg(F.when(F.avg("label") >= 0.5, 1).otherwise(0).alias("label"))
    )


def _buckets(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        found = [indicators(raw, cache, bits).tobytes() for raw in encoded(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8192, bits: int = BITS, cost: float = 1.0, epochs: int = 20, max_bytes: int = 256 << 20) -> Model:
    """Fit on about ``max_rows`` labelled ids (of a repeated one the smallest text), drawn by a hash.

    What goes to the driver is the sample, of at most ``max_bytes`` of hashed indicators: ids are taken in the order of their hash while they fit.
    """
    marked = training_labels(labels)
    span = 1 << 30
    cut = span * min(1.0, max_rows / max(marked.count(), 1))
    sample = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < cut)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")  # about max_rows rows of 12 bytes
    found = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = written(found.mapInArrow(lambda batches: _buckets(batches, bits), f"doc_id {dict(docs.dtypes)['doc_id']}, label int, buckets binary"), "sample")
    sizes = found.select("doc_id", F.xxhash64("doc_id").alias("place"), F.octet_length("buckets").alias("size")).toArrow().sort_by("place")
    fitting = sizes["doc_id"].to_pylist()[: int(np.searchsorted(np.cumsum(sizes["size"].to_numpy()), max_bytes, "right"))]
    if len(fitting) < len(sizes):
        found = found.where(F.col("doc_id").isin(fitting))
    rows = found.toArrow()
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["buckets"].to_pylist(), rows["label"].to_pylist(), strict=True))
    return fit_rows([np.frombuffer(b, np.uint32) for _, b, _ in rows], np.array([label for _, _, label in rows], int), bits, cost, epochs)


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of ``docs``' text column, 0 to 1."""
    shipped = docs.sparkSession.sparkContext.broadcast(
        Model(model.weights.astype(np.float32), model.ratios.astype(np.float32), model.bias, model.slope, model.offset)
    )
    bits = int(math.log2(len(model.weights)))

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for batch in batches:
            yield pa.array([shipped.value.score(indicators(raw, cache, bits)) for raw in encoded(batch.to_pylist())], pa.float64())

    return scores(text_of(text))
