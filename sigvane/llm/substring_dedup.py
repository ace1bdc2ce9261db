"""Passages that occur earlier in the corpus, by compressed FM-indexes.

A passage goes where ``WINDOW`` consecutive words of it also start earlier (in a smaller id, or before in the same
document).  Texts are cut into segments: consecutive windows whose smallest anchor (a hash of ``ANCHOR`` words, the
rare ones before the frequent ones) is the same.  Equal windows have equal smallest anchors, so the segments of an anchor
meet in one shard, and no document has to be streamed past the shards of others; a segment is about 30 words, and
shards grow in number, not in size.  A task sends equal segments once, as the place of the first; the later ones are known to be copies.

A shard's segments are written one behind the other in order of their places, and indexed: suffixes sorted by their
first WINDOW words, the last column of that order as a wavelet matrix of packed bits with sampled ranks.  Every segment is then streamed
through the index.  Backward search extends a window from its last word to its first: where only the segment itself
is left, no window across what was read is found twice, and the search goes on behind it; where WINDOW words have
been read, the matching statistic reaches the threshold, and the first row of the interval tells the earliest place.

Words are the runs of characters other than ASCII white space, unchanged.  The 32 768 most frequent words travel as 16
bits, the others as 44 bits of a hash; two windows are taken for equal when they differ only in words that agree in all
44, which a pair of different rare words does once in 2e13.

A window of nothing but frequent anchors is a segment of its own, dealt by all its words, so no frequent phrase makes a
large shard.  An anchor counts as frequent from a 16 384th of all anchors; for corpora where that is more than a task
can hold, ``anchor`` takes more words.

Defined results: a null or empty text has no words; kept words are joined by one space; documents are ordered by id, those
with one id or none by a hash of their text, rows without id last; rows with one id and one text are one document and
get one result; an empty table gives an empty result.  Ids must be integers.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigvane.llm.common import free_name, rolled, text_of, written

WINDOW, ANCHOR = 20, 4
FREQUENT = 1 << 15  # words of one unit of 16 bits
RARE, SEPARATOR = 1 << 15, 0xFFFF  # the other words have 14 bits in a unit from RARE on and 15 bits in each of the next two
BUCKET_BITS, HOT_SHARE = 18, 2.0**-14  # anchors are counted in so many buckets; a larger share of all is frequent
CHUNK, STRETCH = 8 << 20, 1 << 20  # bytes of text cut at once, and hashed at once
SHARD, LANE = 1 << 20, 12  # words of a shard, windows searched in turn
SLOT_BITS = 20
NO_ID = (1 << 63) - 1

SEGMENTS = "shard int, owner long, tie int, start int, stop int, words binary"
HITS = "owner long, tie int, start int, stop int"


SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = np.random.default_rng(WINDOW).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
RATIO = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of RATIO and of its inverse modulo 2**64."""
    return _powers(RATIO, n), _powers(pow(RATIO, -1, 1 << 64), n)


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the words and a 64-bit hash of each, from differences of one running sum over the bytes.

    A long text is taken in stretches that end between words.
    """
    letters = np.frombuffer(raw, np.uint8)
    full = ~SPACES[letters]
    edges = np.flatnonzero(np.diff(full, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    word = 0
    while word < len(starts):
        first = starts[word]
        behind = max(int(np.searchsorted(ends, first + STRETCH, "right")), word + 1)
        size = int(ends[behind - 1] - first)
        up, down = powers(STRETCH) if size <= STRETCH else (_powers(RATIO, size), _powers(pow(RATIO, -1, 1 << 64), size))
        sums = np.append(np.uint64(0), np.cumsum(LETTERS[letters[first : first + size]] * up[:size]))
        from_, to = starts[word:behind] - first, ends[word:behind] - first
        hashes[word:behind] = (sums[to] - sums[from_]) * down[from_]
        word = behind
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return starts, hashes


def _counted(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once with its sum; those of most sum where they are many."""
    order = np.argsort(hashes)
    hashes, times = hashes[order], times[order]
    new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    hashes, times = hashes[new], np.add.reduceat(times, new) if len(new) else times
    if len(hashes) > 4 * FREQUENT:
        most = np.argpartition(-times, 2 * FREQUENT)[: 2 * FREQUENT]
        hashes, times = hashes[most], times[most]
    return hashes, times


def _surveyed(batches: Iterator[pa.RecordBatch], anchor: int = ANCHOR) -> Iterator[pa.RecordBatch]:
    """A task's most frequent words and its anchors by bucket, at most FREQUENT + 2**BUCKET_BITS rows."""
    words, times, anchors = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for part in _chunks([raw] for raw in batch.column("text").cast(pa.binary()).to_pylist()):
            _, found = words_of(b"\n".join(raw for raw, in part))
            anchors += np.bincount(rolled(found, anchor) >> np.uint64(64 - BUCKET_BITS), minlength=len(anchors))
            words, times = _counted(np.append(words, found), np.append(times, np.ones(len(found), np.int64)))
    most = np.argsort(-times)[:FREQUENT]
    seen = np.flatnonzero(anchors)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([False] * len(most) + [True] * len(seen)), pa.array(np.append(words[most].view(np.int64), seen)), pa.array(np.append(times[most], anchors[seen])),
        ],
        names=["anchor", "key", "n"],
    )


def _chunks(rows: Iterable[Sequence]) -> Iterator[list]:
    """Rows, the text last in each, in runs of about CHUNK bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def survey(texts: DataFrame, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the most frequent words, a mark for each bucket of frequent anchors, and the number of anchors.

    Words and marks only make segments short and shards even; any other choice gives the same result.
    """
    counted = texts.mapInArrow(lambda batches: _surveyed(batches, anchor), "anchor boolean, key long, n long").groupBy("anchor", "key").agg(F.sum("n").alias("n"))
    counted = written(counted, "survey")
    words = counted.where("NOT anchor").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()
    buckets = counted.where("anchor").select("key", "n").toArrow()  # at most 2**BUCKET_BITS rows
    anchors = np.zeros(1 << BUCKET_BITS, np.int64)
    anchors[buckets["key"].to_numpy()] = buckets["n"].to_numpy()
    total = int(anchors.sum())
    return words["key"].to_numpy().view(np.uint64), anchors > HOT_SHARE * total, total


class Codes:
    """Words as 16-bit units: one for a frequent word, three with bits of the hash for the others."""

    def __init__(self, frequent: np.ndarray):
        self.hashes = np.append(frequent, np.uint64(0))
        self.slots = np.full(1 << SLOT_BITS, len(frequent), np.int32)  # of words that share a slot the last one has it
        self.slots[(frequent >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = np.arange(len(frequent))

    def units(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of all words, and where those of each begin and the last ones end."""
        code = self.slots[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        rare = (self.hashes[code] != hashes) | (code == len(self.hashes) - 1)
        at = np.append(0, np.cumsum(np.where(rare, 3, 1)))
        units = np.empty(at[-1], "<u2")
        units[at[:-1]] = code
        first, value = at[:-1][rare], hashes[rare]
        units[first] = RARE + (value >> np.uint64(30) & np.uint64(0x3FFF)).astype(np.int64)
        units[first + 1] = value >> np.uint64(15) & np.uint64(0x7FFF)
        units[first + 2] = value & np.uint64(0x7FFF)
        return units, at


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals, ordered by (owner, start), that meet or overlap as one; longer ones do not start earlier."""
    if not len(start):
        return owner, start, stop
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > stop[:-1])))
    return owner[first], start[first], np.maximum.reduceat(stop, first)


def cut(rows: list[tuple[int, int, bytes]], codes: Codes, hot: np.ndarray, shards: int, anchor: int = ANCHOR) -> Iterator[pa.RecordBatch]:
    """Segments of some documents (owner, tie, text): each distinct one with its first place, and the intervals of the later ones."""
    rows = sorted(set(rows))
    starts, hashes = words_of(b"\n".join(raw for _, _, raw in rows))
    if len(hashes) < WINDOW:
        return
    ends = np.cumsum([len(raw) + 1 for _, _, raw in rows])
    document = np.searchsorted(ends, starts, "right")
    sizes = np.bincount(document, minlength=len(rows))
    first_word = np.cumsum(sizes) - sizes
    anchors = rolled(hashes, anchor)
    order = anchors >> np.uint64(1) | hot[(anchors >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    least = sliding_least(order, WINDOW - anchor + 1)
    least = np.where(least >> np.uint64(63) > 0, rolled(hashes, WINDOW), least)
    inside = document[: len(least)] == document[WINDOW - 1 :]
    begins = inside & np.append(True, (least[1:] != least[:-1]) | ~inside[:-1] | (document[1 : len(least)] != document[: len(least) - 1]))
    begins = np.flatnonzero(begins)
    if not len(begins):
        return
    # A segment ends with the last window before the next segment or the end of the document.
    behind = np.minimum(np.append(begins[1:], len(hashes)), (first_word + sizes)[document[begins]] - WINDOW + 1) + WINDOW - 1
    units, at = codes.units(hashes)
    buffer, at = units.tobytes(), 2 * at
    seen: set[bytes] = set()
    sent, data, again = [], [], []
    for k, (a, b) in enumerate(zip(at[begins].tolist(), at[behind].tolist(), strict=True)):
        piece = buffer[a:b]
        if piece in seen:
            again.append(k)
        else:
            seen.add(piece)
            sent.append(k)
            data.append(piece)
    owners, ties = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)

    def out(which: np.ndarray, shard: np.ndarray, start: np.ndarray, stop: np.ndarray, words: list[bytes | None]) -> pa.RecordBatch:
        columns = [shard.astype(np.int32), owners[which], ties[which], (start - first_word[which]).astype(np.int32), (stop - first_word[which]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.binary())], names=["shard", "owner", "tie", "start", "stop", "words"])

    sent = np.array(sent, np.int64)
    shard = (least[begins[sent]] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)
    for i in range(0, len(sent), 20_000):
        here = sent[i : i + 20_000]
        yield out(document[begins[here]], shard[i : i + 20_000], begins[here], behind[here], data[i : i + 20_000])
    again = np.array(again, np.int64)
    which, start, stop = _merged(document[begins[again]], begins[again], behind[again])
    if len(which):
        yield out(which, np.abs(owners[which]) % shards, start, stop, [None] * len(which))


class FMIndex:
    """Counts and first places of up to ``width`` consecutive symbols of a text; symbol 0 separates and ends it."""

    def __init__(self, text: np.ndarray, width: int):
        self.text = text
        rows, groups = self._sorted(text, width)
        last = text[rows - 1].astype(np.uint32)  # before the first place stands the last one, a separator
        self.first = rows.astype(np.int32)  # at the start of a group of equal windows: its earliest place
        self.first[groups] = np.minimum.reduceat(self.first, groups)
        self.levels = max(int(text.max(initial=1)).bit_length(), 1)
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=1 << self.levels)))
        self.words, self.samples, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (last >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view("<u8")
            self.words.append(packed)
            self.samples.append((np.cumsum(np.bitwise_count(packed), dtype=np.int64) - np.bitwise_count(packed)).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        symbols = np.arange(1 << self.levels)
        self.offsets = self.starts[:-1] - self._down(np.zeros(len(symbols), np.int64), symbols)

    @staticmethod
    def _sorted(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places by their first ``width`` symbols, and where each group of equal ones begins; several ranks are compared in one key."""
        ranks, have = text.astype(np.int64), 0
        while have < width:
            bits = max(int(ranks.max()).bit_length(), 1)
            one = max(have, 1)
            parts = min(62 // bits, -(-width // one))
            key = np.zeros(len(text), np.int64)
            for part in range(parts):
                shift = min(part * one, width - one)
                key <<= bits
                key[: len(text) - shift] |= ranks[shift:]
            order = np.argsort(key)
            ordered = key[order]
            new = np.append(True, ordered[1:] != ordered[:-1])
            ranks = np.empty(len(text), np.int64)
            ranks[order] = np.cumsum(new) - 1
            have = min(parts * one, width)
        return order, np.flatnonzero(new)

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The places in the last level of the matrix, rank by rank."""
        for level in range(self.levels):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.samples[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of rows after one more symbol to the left."""
        both = self._down(np.concatenate([low, high]), np.tile(symbol, 2)) + np.tile(self.offsets[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def repeated(self, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, earliest place) of each window that the text holds twice, of those that begin in ``first`` to ``last`` of a lane."""
        at, end = first.copy(), last
        length, low, high = (np.zeros(len(at), np.int64) for _ in range(3))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            place = at + width - 1 - length
            symbol = self.text[place]
            new = length == 0
            low[new], high[new] = self.starts[symbol[new]], self.starts[symbol[new] + 1]
            old = np.flatnonzero(~new)
            low[old], high[old] = self.extended(low[old], high[old], symbol[old])
            length = length + 1
            alone = high - low == 1
            whole = ~alone & (length == width)
            if whole.any():
                found.append((at[whole], self.first[low[whole]]))
            at = np.where(alone, place + 1, np.where(whole, at + 1, at))
            length[alone | whole] = 0
            on = at <= end
            if not on.all():
                at, end, length, low, high = at[on], end[on], length[on], low[on], high[on]
        if not found:
            return first[:0], first[:0]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def symbols(data: list[bytes]) -> np.ndarray:
    """Segments one behind the other as numbers from 1 on, a 0 behind each."""
    units = np.frombuffer(SEPARATOR.to_bytes(2, "little").join([*data, b""]), "<u2").astype(np.int64)
    rare = np.flatnonzero((units >= RARE) & (units < SEPARATOR))
    value = (units[rare] << 15 | units[rare + 1]) << 15 | units[rare + 2]
    units[rare] = RARE
    stay = np.ones(len(units), bool)
    stay[rare + 1] = stay[rare + 2] = False
    units = units[stay]
    here = np.zeros(SEPARATOR + 1, np.int64)
    here[units] = 1
    here[RARE:] = 0
    rank = np.cumsum(here)
    found = np.where(units == SEPARATOR, 0, rank[units])
    if len(rare):
        found[units == RARE] = rank[-1] + 1 + np.unique(value, return_inverse=True)[1]
    return found


def _searched(rows: pa.Table) -> pa.Table:
    """The intervals of a shard's documents that occur earlier."""
    rows = rows.sort_by([("owner", "ascending"), ("tie", "ascending"), ("start", "ascending")])
    known = rows["words"].is_null().to_numpy()
    places = [rows.filter(pa.array(~known))[c].to_numpy() for c in ("owner", "tie", "start", "stop")]
    data = rows["words"].drop_null().to_pylist()
    found = [tuple(rows.filter(pa.array(known))[c].to_numpy() for c in ("owner", "tie", "start", "stop"))]
    first: dict[bytes, int] = {}
    at = np.fromiter((first.setdefault(piece, i) for i, piece in enumerate(data)), np.int64, len(data))
    copies = np.flatnonzero(np.any([c != c[at] for c in places[:3]], axis=0) if len(data) else at)
    found.append(tuple(c[copies] for c in places))
    kept = np.array(list(first.values()), np.int64)
    if len(kept):
        places = [c[kept] for c in places]
        text = symbols(list(first))
        ends = np.flatnonzero(text == 0)
        begins = np.append(0, ends[:-1] + 1)
        index = FMIndex(text, WINDOW)
        lanes = (ends - begins - WINDOW + LANE) // LANE
        segment = np.repeat(np.arange(len(begins)), lanes)
        lane = begins[segment] + LANE * (np.arange(len(segment)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        window, earliest = index.repeated(lane, np.minimum(lane + LANE - 1, ends[segment] - WINDOW), WINDOW)
        window = np.sort(window[earliest < window])
        segment = np.searchsorted(begins, window, "right") - 1
        segment, start, stop = _merged(segment, window, window + WINDOW)
        start, stop = (x - begins[segment] + places[2][segment] for x in (start, stop))
        found.append((places[0][segment], places[1][segment], start, stop))
    kinds = (np.int64, np.int32, np.int32, np.int32)
    return pa.table([pa.array(np.concatenate([f[k] for f in found]).astype(kind)) for k, kind in enumerate(kinds)], names=["owner", "tie", "start", "stop"])


def earlier_intervals(rows: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """(owner, tie, start, stop) of words in windows that start earlier too, for rows of (owner, tie, text); intervals may overlap."""
    frequent, hot, total = survey(rows.select("text"), anchor)
    shards = 1 + 3 * total // SHARD
    shipped = rows.sparkSession.sparkContext.broadcast((frequent, hot))  # at most FREQUENT words and 2**BUCKET_BITS marks

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, marks = Codes(shipped.value[0]), shipped.value[1]
        columns = ([*zip(b.column("owner").to_pylist(), b.column("tie").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True)] for b in batches)
        for part in _chunks(row for rows in columns for row in rows):
            yield from cut(part, codes, marks, shards, anchor)

    return rows.mapInArrow(segments, SEGMENTS).groupBy("shard").applyInArrow(_searched, HITS)


def drop_repeated_passages(docs: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with a struct column ``substring_dedup`` of (text, n_words, n_removed): the kept words and the counts."""
    name, owner, tie, hits = (free_name(docs, c) for c in ("substring_dedup", "passage_owner", "passage_tie", "passage_hits"))
    rows = docs.withColumns(
        {owner: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), tie: F.expr("CAST(pmod(xxhash64(coalesce(CAST(text AS STRING), '')), 2147483647) AS INT)")}
    )
    found = earlier_intervals(rows.select(F.col(owner).alias("owner"), F.col(tie).alias("tie"), text_of().alias("text")), anchor)
    found = written(found, "passages", forget=True).groupBy(F.col("owner").alias(owner), F.col("tie").alias(tie)).agg(F.collect_list(F.struct("start", "stop")).alias(hits))

    @F.arrow_udf("text string, n_words long, n_removed long")
    def kept(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, intervals in parts:
            out = []
            for raw, gone in zip(texts.cast(pa.binary()).to_pylist(), intervals.to_pylist(), strict=True):
                words = raw.split()
                n = len(words)
                if gone:
                    stay = np.ones(n, bool)
                    for interval in gone:
                        stay[interval["start"] : interval["stop"]] = False
                    words = [words[i] for i in np.flatnonzero(stay)]
                out.append({"text": b" ".join(words).decode("utf-8", "surrogatepass"), "n_words": n, "n_removed": n - len(words)})
            yield pa.array(out, pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]))

    return rows.join(found, [owner, tie], "left").withColumn(name, kept(text_of(), F.col(hits))).drop(owner, tie, hits)
