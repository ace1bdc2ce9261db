"""Language-model scores by a subword lattice.

An existing vocabulary's pieces span a lattice over every word; the probability of a word is the sum over all its
segmentations, by forward recursion in log space.  No piece holds a space after another character, so a text's
marginal probability is the product over its words, times that of one end.  A piece's weight is its share in the
training words, segmented by the vocabulary itself, smoothed by a prior that falls with the piece's existing score.

The corpus is counted over all training documents: documents are dealt to blocks of about ``block_chars``
characters, each block lists its distinct words once, the counts (and the lattice score of each distinct word) are
made on the word table, and every block gets back the rows of its own words.  Nothing that grows with the corpus
passes through the driver; only the counts of the vocabulary's pieces do.

Words are runs without ASCII white space, A-Z lower-cased.  ``base_score`` is the add-one unigram score of the same
tokens.  Defined results: a null or empty text is the end alone; without training documents all counts are zero and
the prior alone weights the pieces; repeated rows are counted and scored each on their own; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigvane.llm.common import encoded, id_remainder, text_of, written

VOCABULARY = "piece_bpe_32k.model"
END = "\n"  # no word holds white space
SPACE = "▁"
LITERAL_SPACE = "\ue000"  # stands for the mark itself where a word holds it
MODULUS, HELD_OUT = 7, 2
BLOCK_CHARS = 8_000_000
PRIOR_COUNT = 32_000.0


class Vocabulary:
    """The pieces of a model file: those that can span a word, the byte pieces and the end."""

    def __init__(self, path: str | None = None):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.model.is_byte(i)}
        self.end = self.model.eos_id()
        self.usable = [not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)) for i in range(size)]

    def prior(self) -> np.ndarray:
        """Shares that fall with the rank that the scores give; bytes and the end as the last piece."""
        size = len(self.pieces)
        share = np.zeros(size)
        for i, usable in enumerate(self.usable):
            if usable:
                share[i] = 1.0 / (2.0 - self.model.get_score(i))
        for i in (*self.bytes.values(), self.end):
            share[i] = 1.0 / (size + 2.0)
        return share / share.sum()

    def count(self, words: list[str], times: list[int]) -> np.ndarray:
        """How often each piece occurs in the vocabulary's own segmentation of the words."""
        counts = np.zeros(len(self.pieces))
        for ids, n in zip(self.model.encode(words, num_threads=1), times, strict=True):
            for i in ids:
                counts[i] += n
        return counts


class Lattice:
    """Log probability of words under log weights of pieces."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.arcs: dict[str, float | None] = {}  # None: only the beginning of a piece
        for piece, usable, weight in zip(vocabulary.pieces, vocabulary.usable, weights.tolist(), strict=True):
            if usable and weight > -math.inf:
                self.arcs[piece] = weight
                for end in range(1, len(piece)):
                    self.arcs.setdefault(piece[:end], None)
        self.byte_weights = [float(weights[vocabulary.bytes[b]]) for b in range(256)]

    def by_bytes(self, character: str) -> float:
        raw = (SPACE if character == LITERAL_SPACE else character).encode("utf-8", "surrogatepass")
        return math.fsum(self.byte_weights[b] for b in raw)

    def log_probability(self, word: str) -> float:
        """log of the sum over all segmentations of the word, its leading space mark included."""
        text = SPACE + (word.replace(SPACE, LITERAL_SPACE) if SPACE in word else word)
        arcs, n = self.arcs, len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for start in range(n):
            terms = into[start]
            if not terms:
                continue
            if len(terms) == 1:
                here = terms[0]
            else:
                top = max(terms)
                here = top + math.log(sum([math.exp(t - top) for t in terms]))
            into[start] = []
            if arcs.get(text[start]) is None:
                into[start + 1].append(here + self.by_bytes(text[start]))
            for end in range(start + 1, n + 1):
                weight = arcs.get(text[start:end], 0.0)
                if weight == 0.0:
                    break
                if weight is not None:
                    into[end].append(here + weight)
        top = max(into[n])
        return top + math.log(sum(math.exp(t - top) for t in into[n]))


def _block_words(block: pa.Table) -> pa.Table:
    """Every distinct word of a block, with its count in the block's training documents."""
    seen: Counter[bytes] = Counter()
    train: Counter[bytes] = Counter()
    n_train = 0
    for raw, held in zip(encoded(block["text"].to_pylist()), block["held_out"].to_pylist(), strict=True):
        (seen if held else train).update(raw.lower().split())
        n_train += not held
    words = [*train, *(w for w in seen if w not in train)]
    counts = [*train.values(), *[0] * (len(words) - len(train))]
    words = [*(w.decode("utf-8", "surrogatepass") for w in words), END]
    number = block["block"][0].as_py()
    return pa.table({"block": pa.array([number] * len(words), pa.int64()), "word": pa.array(words, pa.string()), "times": pa.array([*counts, n_train], pa.int64())})


def _piece_counts(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary(path)
    counts = np.zeros(len(vocabulary.pieces))
    for batch in batches:
        words, times = batch.column("word").to_pylist(), batch.column("times").to_pylist()
        counts += vocabulary.count(words, times)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], names=["piece", "times"])


def _word_scores(batches: Iterator[pa.RecordBatch], path: str | None, weights: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
    lattice = Lattice(Vocabulary(path), weights)
    ten = math.log(10)
    for batch in batches:
        scores = [(float(weights[end]) if word == END else lattice.log_probability(word)) / ten for word in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("times"), pa.array(scores, pa.float64())], names=["word", "times", "score"])


def _score_block(words: pa.Table, docs: pa.Table, n: int, v: int) -> pa.Table:
    numbers = {word.encode("utf-8", "surrogatepass"): i for i, word in enumerate(words["word"].to_pylist())}
    times = words["times"].to_numpy()
    base = np.log10((times + 1) / (n + v + 1))
    scores, known = words["score"].to_numpy(), (times > 0).astype(np.int64)
    rows = []
    for raw in encoded(docs["text"].to_pylist()):
        tokens = [*raw.lower().split(), END.encode()]
        found = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        rows.append((len(tokens), int(known[found].sum()), float(base[found].sum()), float(scores[found].sum())))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table(
        {
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()),
            "train_tokens": pa.array([n] * len(rows), pa.int64()), "base_score": pa.array(columns[2], pa.float64()), "score": pa.array(columns[3], pa.float64()),
        }
    )


def score(docs: DataFrame, vocabulary: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = docs.select("doc_id", text_of().alias("text"), (id_remainder(MODULUS) == HELD_OUT).alias("held_out"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    pairs = written(dealt.groupBy("block").applyInArrow(_block_words, "block long, word string, times long"), "block_words")
    words = written(pairs.groupBy("word").agg(F.sum("times").alias("times")), "words")
    n, v = words.where("times > 0").agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    pieces = Vocabulary(vocabulary)
    ends = words.where(F.col("word") == END).agg(F.sum("times")).first()[0] or 0
    counts = PRIOR_COUNT * pieces.prior()
    counted = words.where((F.col("times") > 0) & (F.col("word") != END)).mapInArrow(lambda b: _piece_counts(b, vocabulary), "piece long, times double")
    for piece, times in counted.groupBy("piece").agg(F.sum("times")).collect():  # at most the vocabulary's size
        if pieces.usable[piece] or piece in pieces.bytes.values():
            counts[piece] += times
    counts[pieces.end] += ends
    with np.errstate(divide="ignore"):
        weights = np.log(counts / counts.sum())
    end = pieces.end
    scored = words.mapInArrow(lambda b: _word_scores(b, vocabulary, weights, end), "word string, times long, score double")
    known = pairs.select("block", "word").join(scored, "word")
    result = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return known.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(lambda w, d: _score_block(w, d, n, v), result)
