"""Encoding to and decoding from a sentence-piece vocabulary by streaming Viterbi.

The best segmentation of a text is the one with the largest sum of the pieces' scores (ties: the longer last piece).
Characters without a piece of their own, line ends among them, fall back to the pieces of their UTF-8 bytes, each with
a score below every other piece's.  A space is the mark U+2581; a mark in the text itself goes by bytes, so decoding gives back
every text exactly.  Nothing is normalised and no space is put in front.

The encoder keeps no more than the longest piece's characters besides what is undecided: it remembers the starts
from which some piece can still grow, and as soon as the backpointer paths of all of them run through one boundary,
the ids before it are committed.  What lies between two places that no piece crosses (before a run of spaces) is
encoded on its own, and short ones of these are remembered.

Defined results: a null or empty text has no ids; repeated rows are encoded alike; other columns pass through.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane.llm.common import free_name

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNLIKELY = -1e8  # pieces below are kept for spaces only
WORD = re.compile(r" *[^ \n]+| +|\n")  # no piece crosses from one match to the next if spaces only lead and no piece holds a line end
STOPS = ".,;:!?"


class Node:
    """A place in the tree of all pieces: how they go on, and the piece that ends here."""

    __slots__ = ("after", "ids", "score")

    def __init__(self) -> None:
        self.after: dict[str, Node] = {}
        self.score: float | None = None
        self.ids: tuple[int, ...] = ()


class Pieces:
    """A vocabulary as a tree, with the bytes of each piece and the ids of the byte pieces."""

    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        size = model.get_piece_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.raw = [b""] * size
        for i in range(size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.raw[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[name.replace(SPACE, " ")] = (model.get_score(i), i)
                self.raw[i] = name.replace(SPACE, " ").encode()
        self.byte_score = min((s for s, _ in self.scores.values() if s > UNLIKELY), default=0.0) - 10.0
        self.longest = max(map(len, self.scores), default=1)
        self.crossed = any(" " in p.lstrip(" ") or "\n" in p for p in self.scores)
        self.stops = {c for c in STOPS if not any(a.isalpha() and b == c for p in self.scores for a, b in zip(p, p[1:], strict=False))}

    @cached_property
    def root(self) -> Node:
        """The tree, which only encoding needs."""
        root = Node()
        for piece, (score, i) in self.scores.items():
            node = root
            for character in piece:
                node = node.after.setdefault(character, Node())
            node.score, node.ids = score, (i,)
        return root

    def single(self, character: str) -> Node:
        """The node of a character; one without a piece of its own gets the ids of its bytes."""
        node = self.root.after.get(character)
        if node is None or node.score is None:
            raw = character.encode("utf-8", "surrogatepass")
            found = Node()
            found.score, found.ids = self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)
            if node is None:
                return found  # not remembered: there are a million characters
            node.score, node.ids = found.score, found.ids
        return node


class StreamingViterbi:
    """Takes characters in any portions, gives ids as soon as they are certain.

    Lists run from the last committed boundary: the best score up to each boundary, the boundary before it and the
    ids between the two.  ``open`` holds the starts from which a piece may still grow, the earliest first, with the
    place in the tree they have reached.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.scores: list[float] = [0.0]
        self.before: list[int] = [0]
        self.ids: list[tuple[int, ...]] = [()]
        self.open: list[tuple[int, dict[str, Node]]] = []

    def _commit(self, boundary: int) -> list[int]:
        """The ids up to ``boundary``; the lists go on from there."""
        parts, at = [], boundary
        while at:
            parts.append(self.ids[at])
            at = self.before[at]
        base = self.scores[boundary]
        self.scores = [score - base for score in self.scores[boundary:]]
        self.before = [0, *[b - boundary for b in self.before[boundary + 1 :]]]
        self.ids = [(), *self.ids[boundary + 1 :]]
        self.open = [(start - boundary, after) for start, after in self.open]
        parts.reverse()
        return [i for ids in parts for i in ids]

    def _shared(self) -> int:
        """The last boundary on the paths of every start that may still matter: the open ones and the end."""
        fronts = {start for start, _ in self.open}
        fronts.add(len(self.scores) - 1)
        while len(fronts) > 1:
            last = max(fronts)
            fronts.remove(last)
            fronts.add(self.before[last])
        return fronts.pop()

    def _extend(self, text: str) -> None:
        """Relax every arc that ends inside ``text``; starts are taken in order, so ties keep the longer piece."""
        scores, before, ids = self.scores, self.before, self.ids
        root, single = self.pieces.root.after, self.pieces.single
        base, n = len(scores) - 1, len(text)
        scores.extend([-math.inf] * n)
        before.extend([0] * n)
        ids.extend([()] * n)
        still = []
        for start, after in self.open:
            score, end = scores[start], base
            for character in text:
                node = after.get(character)
                if node is None:
                    break
                end += 1
                if node.score is not None and score + node.score > scores[end]:
                    scores[end], before[end], ids[end] = score + node.score, start, node.ids
                after = node.after
            else:
                if after:
                    still.append((start, after))
        for i in range(n):
            start = end = base + i
            score = scores[start]
            node = root.get(text[i])
            if node is None or node.score is None:
                node = single(text[i])
            at = i
            while True:
                end += 1
                at += 1
                if node.score is not None and score + node.score > scores[end]:
                    scores[end], before[end], ids[end] = score + node.score, start, node.ids
                after = node.after
                if at == n:
                    if after:
                        still.append((start, after))
                    break
                node = after.get(text[at])
                if node is None:
                    break
        self.open = still

    def push(self, text: str) -> list[int]:
        window, out = self.pieces.longest, []
        for first in range(0, len(text), window):
            self._extend(text[first : first + window])
            if shared := self._shared():
                out.extend(self._commit(shared))
        return out

    def finish(self) -> list[int]:
        """The ids of what is left."""
        self.open = []
        return self._commit(len(self.scores) - 1)


class Words(dict):
    """The ids of words, as bytes; up to ``limit`` short ones are remembered, and the older half of them forgotten then."""

    def __init__(self, pieces: Pieces, limit: int, short: int = 24):
        super().__init__()
        self.pieces, self.limit, self.short = pieces, limit, short

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in self.pieces.stops and word[-2].isalpha():
            ids = self[word[:-1]] + self[word[-1]]  # no piece crosses from a letter to such a stop
        else:
            stream = StreamingViterbi(self.pieces)
            ids = array("i", stream.push(word) + stream.finish()).tobytes()
        if len(word) <= self.short:
            if len(self) >= self.limit:
                for old in list(islice(self, self.limit // 2)):
                    del self[old]
            self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts, word by word where no piece crosses between words; remembered words take about 250 bytes each."""

    def __init__(self, pieces: Pieces, limit: int = 400_000):
        self.pieces = pieces
        self.words = Words(pieces, limit)

    def encode(self, text: str) -> bytes:
        """Signed 32-bit ids."""
        if self.pieces.crossed:
            return self.words[text] if text else b""
        return b"".join(map(self.words.__getitem__, WORD.findall(text)))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


_LOADED: dict[str | None, Encoder] = {}


def loaded(path: str | None = None) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Pieces(path))
    return _LOADED[path]


def encode_column(text: Column, path: str | None = None) -> Column:
    """The ids of a text column, array<int>."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = loaded(path)
        for batch in batches:
            rows = [encoder.encode(value or "") for value in batch.to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]) // 4
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))

    return encode(text)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The text of a column of ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = loaded(path)
        for batch in batches:
            batch = batch.fill_null([])
            ends, values = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False)
            yield pa.array((encoder.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)), pa.string(), size=len(batch))

    return decode(ids)


def code_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` of every text and ``decoded``, the text read back from them (under free names)."""
    ids, decoded, coded = free_name(docs, "ids"), free_name(docs, "decoded"), free_name(docs, "coded")

    @F.arrow_udf("ids array<int>, decoded string")
    def both_ways(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = loaded(path)
        for batch in batches:
            rows = [encoder.encode(value or "") for value in batch.to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]) // 4
            values = np.frombuffer(b"".join(rows), "<i4")
            texts = pa.array((encoder.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)), pa.string(), size=len(rows))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), texts], names=["ids", "decoded"])

    # One worker for each task does both.
    return docs.withColumn(coded, both_ways(F.col("text"))).withColumns({ids: F.col(coded)["ids"], decoded: F.col(coded)["decoded"]}).drop(coded)
