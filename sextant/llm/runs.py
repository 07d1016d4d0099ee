"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with a smallest period q, at least max(LEAST, TIMES * q) long, that no neighbouring word extends.
For every level m = 2, 4, 8, ... the words are covered by blocks of length m that begin at multiples of m / 2.  A run of
period q with m / 2 <= q < m holds such a block together with its copy q words on (1.5 m - 1 + q <= 4 q), and since the block is
longer than q, its next occurrence in the neighbouring window of m words is exactly q away.  So one query a block is enough:
the next position after the block's among the suffixes that begin with the block.  They are an interval of the suffix
array, and a wavelet matrix over the array answers the queries as range successors, all blocks of all levels at once in numpy.
Neighbouring blocks of one level with the same distance are a progression: they belong to one candidate, whose ends
lie within half a block of the progression's and are found by comparing words q apart.

Only a block whose every word recurs within m - 1 words can have an answer in its window.  That is told by a maximum over the
distances to each word's next occurrence, so suffixes are sorted and queries asked for stretches of such blocks alone.

Texts are worked on in slices of about BATCH words; a text is never cut, and memory grows with the longest text (some 4 * log2(n)
bytes a word where all of it is repetitive).

Defined results: null and empty texts have no words and no runs; ids may be null or repeat; repeated rows give repeated
results; ties of the greatest exponent go to the smallest start, then period; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from sextant.llm.words import by_rows

LEAST, TIMES = 6, 4
BATCH = 1 << 18
Words = list[bytes]


def next_same(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Distance to the next occurrence of the same word in the same text; the length of all where there is none."""
    n = len(ids)
    out = np.full(n, n, np.int64)
    order = np.argsort(ids, kind="stable")
    same = (ids[order[1:]] == ids[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    here = order[:-1][same]
    out[here] = order[1:][same] - here
    return out


def repeating_blocks(distance: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(m, begins) of the blocks all of whose words recur within m - 1 words."""
    n, out = len(distance), []
    m, most = 2, distance  # most: the greatest distance in blocks of length m / 2 beginning at multiples of m / 4 (of 1 for m = 2)
    while m <= n // 2:
        if m == 2:
            most = np.maximum(most[:-1], most[1:])
        else:
            most = np.maximum(most[:-2:2], most[2::2])
        begins = np.flatnonzero(most < m) * (m // 2)
        if len(begins):
            out.append((m, begins))
        m *= 2
    return out


class Suffixes:
    """Suffix array of the stretches ``[lo, hi)`` of ``ids``, with the interval of every asked block, by doubling of ranks.

    Words of a stretch are followed by an end of its own, so no block reaches into the next one.  Suffixes are told apart by as
    many words as the longest block has; the order of the rest doesn't matter to any interval.
    """

    def __init__(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, blocks: list[tuple[int, np.ndarray]]):
        size = hi - lo + 1
        first = np.cumsum(size) - size
        n = int(size.sum())
        self.back = np.repeat(lo - first, size) + np.arange(n)  # place in ids
        ends = first + size - 1
        words = ids[np.minimum(self.back, len(ids) - 1)].astype(np.int64)
        words[ends] = int(ids.max()) + 1 + np.arange(len(ends))
        order = np.argsort(words, kind="stable")
        rank = self._ranks(words, order)
        self.begin, self.end, self.at, self.length = [], [], [], []
        asked = dict(blocks)
        m = 1
        while m < max(asked):
            key = rank * (n + 1)
            key[: n - m] += rank[m:] + 1
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key, order)
            m *= 2
            if m in asked:
                stretch = np.searchsorted(lo, asked[m], side="right") - 1
                at = asked[m] - lo[stretch] + first[stretch]
                count = np.bincount(rank, minlength=n)
                self.at.append(at)
                self.begin.append(rank[at])
                self.end.append(rank[at] + count[rank[at]])
                self.length.append(np.full(len(at), m))
        self.array = order
        self.at, self.begin, self.end, self.length = (np.concatenate(x) for x in (self.at, self.begin, self.end, self.length))

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        """A key's rank is the place of the first of its equals, where its interval begins."""
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        return rank


class Wavelet:
    """Wavelet matrix: per bit, from the highest, how many ones lie before each place; zeros go first to the next bit."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(self.n - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, ones, self.n - int(ones[-1])))
            values = np.concatenate([values[~one], values[one]])

    def less(self, begin: np.ndarray, end: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of [begin, end) are less, for each query."""
        out = np.zeros(len(begin), np.int64)
        for bit, ones, zeros in self.levels:
            a, b = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            up = (than >> bit) & 1 == 1
            out += np.where(up, (end - b) - (begin - a), 0)
            begin, end = np.where(up, zeros + a, begin - a), np.where(up, zeros + b, end - b)
        return out

    def smallest(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) among [begin, end)."""
        out = np.zeros(len(begin), np.int64)
        for bit, ones, zeros in self.levels:
            a, b = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            low = (end - b) - (begin - a)
            up = k >= low
            out += np.where(up, 1 << bit, 0)
            k = np.where(up, k - low, k)
            begin, end = np.where(up, zeros + a, begin - a), np.where(up, zeros + b, end - b)
        return out

    def successor(self, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` among [begin, end); n where there is none."""
        k = self.less(begin, end, np.minimum(least, self.n - 1))
        k = np.where(least >= self.n, end - begin, k)
        some = np.flatnonzero(k < end - begin)
        out = np.full(len(begin), self.n, np.int64)
        out[some] = self.smallest(begin[some], end[some], k[some])
        return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and which range each belongs to."""
    own = np.repeat(np.arange(len(begin)), size)
    return begin[own] + np.arange(len(own)) - (np.cumsum(size) - size)[own], own


def find(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs; ``text`` numbers the text of each word, and texts follow each other."""
    n = len(ids)
    blocks = repeating_blocks(next_same(ids, text)) if n >= LEAST else []
    if not blocks:
        return np.zeros((0, 3), np.int64)
    cover = np.zeros(n + 1, np.int64)  # a block's window: m places after its own, and the block that begins at the last of them
    for m, begins in blocks:
        np.add.at(cover, begins, 1)
        np.add.at(cover, np.minimum(begins + 2 * m, n), -1)
    inside = np.cumsum(cover[:-1]) > 0
    joined = inside[1:] & inside[:-1] & (text[1:] == text[:-1])  # a stretch ends with its text
    lo = np.flatnonzero(inside & ~np.concatenate([[False], joined]))
    hi = np.flatnonzero(inside & ~np.concatenate([joined, [False]])) + 1
    s = Suffixes(ids, lo, hi, blocks)
    got = Wavelet(s.array).successor(s.begin, s.end, s.at + 1)
    period = got - s.at
    good = (got < len(s.array)) & (2 * period >= s.length) & (period < s.length)
    at, period, length = s.back[s.at[good]], period[good], s.length[good]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((at, length))
    at, period, length = at[order], period[order], length[order]
    # progressions: neighbouring blocks of a level, the same distance to the next occurrence
    new = np.concatenate([[True], (length[1:] != length[:-1]) | (period[1:] != period[:-1]) | (at[1:] - at[:-1] != length[1:] // 2)])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    q, half = period[heads], length[heads] // 2
    left, right = at[heads], at[tails] + length[heads]  # words q apart are equal from left up to right
    first = np.searchsorted(text, text[left], side="left")
    last = np.searchsorted(text, text[left], side="right")
    room = np.minimum(half, left - first)
    places, own = _ranges(left - room, room)
    differ = ids[places] != ids[places + q[own]]
    worst = np.full(len(heads), -1, np.int64)
    np.maximum.at(worst, own[differ], places[differ])
    begin = np.where(worst >= 0, worst + 1, left - room)
    room = np.clip(last - q - right, 0, half)
    places, own = _ranges(right, room)
    differ = ids[places] != ids[places + q[own]]
    worst = np.full(len(heads), n, np.int64)
    np.minimum.at(worst, own[differ], places[differ])
    end = np.where(worst < n, worst, right + room) + q
    long = (end - begin) >= np.maximum(LEAST, TIMES * q)
    return np.stack([begin[long], (end - begin)[long], q[long]], 1)


def plant(key: int | None, words: Words) -> Words:
    """The query's rewriting: for one id in ten the words from some place on become periodic."""
    h, n = (-1 if key is None else zlib.crc32(str(key).encode())), len(words)
    if h < 0 or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: Words, runs: np.ndarray) -> Words:
    """The words without those that stand in a run behind its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(steps[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def runs_of(texts: list[Words]) -> list[np.ndarray]:
    """Runs of each text by start, then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64)
    sizes = np.array([len(w) for w in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    got = find(ids, text)
    own = text[got[:, 0]] if len(got) else np.zeros(0, np.int64)
    got[:, 0] -= first[own]
    order = np.lexsort((got[:, 2], got[:, 0], own))
    return np.split(got[order], np.searchsorted(own[order], np.arange(1, len(texts))))


def each(rows: Iterator[tuple], rewrite: Callable[[int | None, Words], Words] | None) -> Iterator[tuple]:
    """(id, words, runs) of (id, text) rows, in slices of about BATCH words."""
    held: list[tuple] = []
    size = 0

    def out() -> Iterator[tuple]:
        for (key, words), runs in zip(held, runs_of([w for _, w in held]), strict=True):
            yield key, words, runs

    for key, text in rows:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        held.append((key, rewrite(key, words) if rewrite else words))
        size += len(words)
        if size >= BATCH:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """id, runs (start, length, period of words), collapsed: the text's words without the repetitions."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, words, runs in each(rows, rewrite):
            found = [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()]
            yield key, found, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")

    return by_rows(docs.select(id_col, text_col), run, f"{id_col} {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string", chunk=64, out=64)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """id, n_runs, the run of greatest exponent (start, length, period, exponent_milli; null without runs), and digests of all
    runs and of the collapsed text."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, words, runs in each(rows, rewrite):
            found = runs.tolist()
            best = (None,) * 4
            if found:
                start, length, period = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                best = (start, length, period, 1000 * length // period)
            listed = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
            yield key, len(found), *best, listed, hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    schema = f"{id_col} {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return by_rows(docs.select(id_col, text_col), run, schema, chunk=64)
