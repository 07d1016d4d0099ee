"""Token ids in files, compressed by an adaptive context-mixing range coder in independent blocks.

Ids (below 65,536) of the documents in id order are cut into blocks.  Every block starts from the same empty model and
carries a checksum, so blocks are coded and decoded in any order.  Three orders predict an id: order 2 and order 1 name the
id last seen after the two ids (the id) before, with a confidence; order 0 is the adaptive distribution of all ids.  The
chances that the named ids hit are mixed by weights that learn, from the confidence of order 2, that of order 1 and the
order-0 frequency that the named id had when it was last seen there, and are refined by the counts of that combination; what both miss is coded by the order-0
distribution, and an id new to the block as a plain number.

A block adapts in epochs that double in length: within one the model stands still, after it the model learns from all its
ids at once.  The ids of an epoch are dealt to the block's lanes, one stretch each.  Every lane is a range coder of its own,
and the lanes of several blocks advance together as numpy vectors.  All model arithmetic is on integers, so decoding repeats
it exactly.

Defined results: null and empty texts are the end id alone; an empty table has no file rows; very long texts run over as many
blocks as they need; repeated and null ids keep their place in the order (id, nulls first, then hash of the text); input
columns beside id and text are ignored, whatever their names; a block whose checksum differs raises an error.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.core.shared import new_path
from sextant.llm.words import by_rows, spread

BLOCK = 1 << 20
LANES = 4096
#: Blocks that are coded together.
TOGETHER = 2
#: Characters of the texts that are cut together.
CHARS = 1 << 23
IDS = 1 << 16
SURE, LEVELS = 8, 4
CELLS = SURE * SURE * 2 * LEVELS
WINDOW, LOWEST = np.uint64((1 << 48) - 1), np.uint64(1 << 32)
WORD, UPPER, LOWER = np.uint64(16), np.uint64(32), np.uint64((1 << 32) - 1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Integer squash (logistic, 12 bits) over -2047..2047 and its inverse stretch."""
    x = np.arange(-2047, 2048)
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x / 256.0))), 1, 4095).astype(np.int64)
    return squash, (np.searchsorted(squash, np.arange(4096)) - 2047).clip(-2047, 2047).astype(np.int64)


SQUASH, STRETCH = _tables()
#: Level of the id that order 2 names, confidence of order 2, of order 1, and whether both name the same id, for each cell.
_LEVEL, _SURE2, _SURE1, _SAME = (a.ravel() for a in np.indices((LEVELS, SURE, SURE, 2)))


def lanes_of(n: int) -> int:
    return max(1, min(LANES, 1 << (n >> 8).bit_length() - 1)) if n >> 8 else 1


def epochs(n: int, lanes: int) -> list[tuple[int, int]]:
    """Where the epochs of a block of n ids begin and end; the last is filled up to a multiple of the lanes."""
    out, at, size = [], 0, lanes
    while at < n:
        size = min(size, -(-(n - at) // lanes) * lanes)
        out.append((at, at + size))
        at, size = at + size, at + size
    return out


class Model:
    """The model of a group of blocks of one length, a row each.  What concerns an epoch's ids has a row a step and a column a lane."""

    def __init__(self, blocks: int, lanes: int):
        self.n = blocks
        row = np.repeat(np.arange(blocks), lanes)
        self.base, self.cells = row * IDS, row * CELLS  # where each lane's block begins in the tables
        self.counts = np.zeros((blocks, IDS), np.int64)
        self.order0 = np.zeros(blocks * IDS, np.uint64)  # order 0: where an id's share of 65,536 starts | the share << 32
        self.slots = np.zeros(blocks * IDS, np.uint16)  # the id of each of the 65,536 places
        self.fresh = np.zeros(blocks, np.int64)  # where the shares end and new ids begin
        self.after1 = np.zeros(blocks * IDS, np.uint32)  # named id | confidence << 16
        self.after2 = np.zeros(blocks * IDS, np.uint32)  # named id | confidence << 16 | level << 19
        self.seen = np.zeros((blocks, CELLS, 3), np.int64)
        self.weights = np.tile(np.array([26000, 14000, 8000], np.int64), (blocks, 1))
        self.bounds = np.zeros(0, np.uint64)
        self.mix()

    def mix(self) -> None:
        """Bounds of the three events of every cell, of 65,536: order 2 is right up to the first, order 1 up to the second (<< 32), both are wrong."""
        hit2, total = self.seen[:, :, 0], self.seen.sum(2)
        hit1 = self.seen[:, :, 1] + hit2 * _SAME

        def rate(key: np.ndarray, size: int, hits: np.ndarray) -> np.ndarray:
            one = np.eye(size, dtype=np.int64)[key]
            return (((hits @ one) * 4096 + 1024) // (total @ one + 2))[:, key].clip(1, 4095)

        parts = np.stack([STRETCH[rate(_SURE2, SURE, hit2)], STRETCH[rate(_SURE1 * 2 + _SAME, 2 * SURE, hit1)], STRETCH[rate(_LEVEL, LEVELS, hit2)]])
        mixed = SQUASH[((self.weights.T[:, :, None] * parts).sum(0) >> 16).clip(-2047, 2047) + 2047]
        error = hit2 * 4096 - mixed * total
        pull = (error[None] * parts).sum(2) // (np.maximum(total.sum(1), 1) * 8)
        self.weights = np.clip(self.weights + pull.T, 0, 1 << 17)
        mixed = SQUASH[((self.weights.T[:, :, None] * parts).sum(0) >> 16).clip(-2047, 2047) + 2047]
        first = ((hit2 * 65536 + mixed * 16 * 24) // (total + 24)).clip(64, 65536 - 128)
        rest = total - hit2
        own = rate(_SURE1 * 2 + _SAME, 2 * SURE, hit1)
        second = ((self.seen[:, :, 1] * 65536 + own * 16 * 24) // (rest + 24)).clip(64, 65536 - 128)
        second = np.where(_SAME == 1, 0, (65536 - first) * second >> 16)
        self.bounds = (first | first + second << 32).astype(np.uint64).ravel()

    def learn(self, ids: np.ndarray, known: list[tuple[np.ndarray, ...]]) -> None:
        """Takes in an epoch's ids with what ``look`` told of each step."""
        cell, at2, at1, old2, old1 = (np.stack(own) for own in list(zip(*known, strict=True))[2:])
        right2, right1 = old2 & np.uint32(IDS - 1) == ids, old1 & np.uint32(IDS - 1) == ids
        event = np.where(right2, 0, 2 - right1)
        self.seen += np.bincount((cell * 3 + event).ravel(), minlength=self.seen.size).reshape(self.seen.shape)
        new = np.bincount((ids + self.base).ravel(), minlength=self.n * IDS).reshape(self.n, IDS)
        novel = ((self.counts == 0) * new).sum(1)
        share = (novel * IDS // max(1, ids.size // self.n)).clip(64, IDS // 2)
        self.counts += new
        kinds, total = (self.counts > 0).sum(1), self.counts.sum(1)
        share = np.minimum(share, IDS - kinds - 1).clip(0)
        scale = np.maximum(IDS - share - kinds, 0)
        sizes = np.where(self.counts > 0, 1 + self.counts * scale[:, None] // np.maximum(total, 1)[:, None], 0)
        ends = np.cumsum(sizes, 1)
        self.fresh = ends[:, -1]
        self.order0 = (ends - sizes | sizes << 32).astype(np.uint64).ravel()
        for b in range(self.n):
            self.slots[b * IDS : b * IDS + self.fresh[b]] = np.repeat(np.arange(IDS, dtype=np.uint16), sizes[b])
        level = np.where(sizes > 512, 3, np.where(sizes > 64, 2, (sizes > 4) * 1)).astype(np.uint32).ravel() << np.uint32(19)
        for table, at, right, old, own in ((self.after2, at2, right2, old2, level), (self.after1, at1, right1, old1, None)):
            entry = ids.astype(np.uint32) | np.where(right, np.minimum((old >> np.uint32(16) & np.uint32(SURE - 1)) + np.uint32(1), np.uint32(SURE - 1)), np.uint32(0)) << np.uint32(16)
            table[at.ravel()] = (entry if own is None else entry | own.take(ids + self.base, mode="clip")).ravel()  # the last of equal places stays
        self.mix()

    def look(self, before: np.ndarray, before2: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids named by order 2 and 1, cell, places in the tables of both and their entries."""
        at1 = self.base + before
        at2 = self.base + (before * 40503 + before2 * 30011 & IDS - 1)
        old1, old2 = self.after1.take(at1, mode="clip"), self.after2.take(at2, mode="clip")
        named1, named2 = old1 & np.uint32(IDS - 1), old2 & np.uint32(IDS - 1)
        cell = ((old2 >> np.uint32(16)) * np.uint32(2 * SURE) + (old1 >> np.uint32(16)) * np.uint32(2) + (named1 == named2)) + self.cells
        return named2, named1, cell, at2, at1, old2, old1


class _Writer:
    """Range coders, one a lane: a 48-bit window, 16-bit words; a carry goes into the words already written."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, WINDOW, np.uint64)
        self.room = 3 * steps + 3  # an id takes three words at most
        self.words = np.zeros(lanes * self.room, np.uint16)
        self.base = np.arange(lanes) * self.room
        self.at = self.base.copy()

    def put(self, start: np.ndarray, size: np.ndarray, only: np.ndarray | None = None) -> None:
        """Narrows every lane (or those in ``only``) to [start, start + size) of 65,536."""
        unit = self.range >> WORD
        low = self.low + start * unit
        size = size * unit
        if only is not None:
            low, size = np.where(only, low, self.low), np.where(only, size, self.range)
        at = self.at[np.flatnonzero(low > WINDOW)] - 1
        while len(at):  # a word that runs over carries into the one before
            self.words[at] += np.uint16(1)
            at = at[self.words[at] == 0] - 1
        low &= WINDOW
        move = size < LOWEST
        self.words[self.at] = (low >> UPPER).astype(np.uint16)  # stays only where the lane moves on
        self.at += move
        by = move * WORD
        self.low, self.range = (low << by) & WINDOW, size << by

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, lane after lane, and how many each lane has."""
        for _ in range(3):  # the whole window settles the rest
            self.words[self.at] = (self.low >> UPPER).astype(np.uint16)
            self.at += 1
            self.low = (self.low << WORD) & WINDOW
        counts = self.at - self.base
        return self.words.reshape(-1, self.room)[np.arange(self.room) < counts[:, None]].astype("<u2"), counts


class _Reader:
    """The same lanes read back: ``off`` is how far the code lies above the window's low end."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray):
        self.words = np.concatenate([words.astype("<u2", copy=False), np.zeros(4, "<u2")])
        self.at = firsts + 3
        one, two, three = (self.words[firsts + i].astype(np.uint64) for i in range(3))
        self.off = one << UPPER | two << WORD | three
        self.range = np.full(len(firsts), WINDOW, np.uint64)

    def place(self, unit: np.ndarray, off: np.ndarray) -> np.ndarray:
        # doubles hold both exactly, and a quotient below 2**17 of a divisor below 2**32 is never rounded up to a whole number
        return np.minimum(off.astype(np.float64) / unit.astype(np.float64), IDS - 1).astype(np.int64)

    def event(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes one of the three events whose bounds these are; where order 2 is wrong, and where order 1 is too."""
        unit = self.range >> WORD
        first, second = (bounds & LOWER) * unit, (bounds >> UPPER) * unit
        wrong2, missed = self.off >= first, self.off >= second
        start = np.where(missed, second, first * wrong2)
        size = np.where(missed, unit << WORD, np.where(wrong2, second, first)) - start
        off = self.off - start
        move = size < LOWEST
        by = move * WORD
        self.off, self.range = off << by | self.words.take(self.at, mode="clip") * move, size << by
        self.at += move
        return wrong2, missed

    def take_some(self, k: np.ndarray, unit: np.ndarray, off: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        off, size, at = off - start * unit, size * unit, self.at.take(k, mode="clip")
        move = size < LOWEST
        by = move * WORD
        self.off[k], self.range[k] = off << by | self.words.take(at, mode="clip") * move, size << by
        self.at[k] = at + move


def encode_group(ids: np.ndarray) -> list[bytes]:
    """Codes of blocks of one length, the rows of ``ids``: lanes' word counts, then their words."""
    blocks, n = ids.shape
    lanes = lanes_of(n)
    model, writer = Model(blocks, lanes), _Writer(blocks * lanes, -(-n // lanes))
    for lo, hi in epochs(n, lanes):
        part = np.zeros((blocks, hi - lo), np.int64)
        part[:, : min(hi, n) - lo] = ids[:, lo:hi]
        part = np.ascontiguousarray(part.reshape(blocks * lanes, -1).T)
        before = before2 = np.zeros(blocks * lanes, np.int64)
        fresh = np.repeat(model.fresh.astype(np.uint64), lanes)
        known = []
        for ids_now in part:
            known.append(model.look(before, before2))
            named2, named1, cell = known[-1][:3]
            wrong2, wrong1 = named2 != ids_now, named1 != ids_now
            missed = wrong2 & wrong1
            bounds = model.bounds.take(cell, mode="clip")
            first, second = bounds & LOWER, bounds >> UPPER
            start = np.where(missed, second, first * wrong2)
            writer.put(start, np.where(missed, np.uint64(IDS), np.where(wrong2, second, first)) - start)
            own = model.order0.take(ids_now + model.base, mode="clip")
            start, size = own & LOWER, own >> UPPER
            new = missed & (size == 0)
            if new.any():
                writer.put(np.where(new, fresh, start), np.where(new, np.uint64(IDS) - fresh, size), missed)
                writer.put(ids_now.astype(np.uint64), np.uint64(1), new)
            else:
                writer.put(start, size, missed)
            before2, before = before, ids_now
        if hi < n:
            model.learn(part, known)
    words, counts = writer.close()
    ends = np.cumsum(counts.reshape(blocks, lanes).sum(1))
    pieces = np.split(words, ends[:-1])
    return [c.astype("<u4").tobytes() + w.tobytes() for c, w in zip(counts.reshape(blocks, lanes), pieces, strict=True)]


def decode_group(codes: list[bytes], n: int) -> np.ndarray:
    """The ids of blocks of n ids each, a row a block."""
    blocks, lanes = len(codes), lanes_of(n)
    counts = np.concatenate([np.frombuffer(c, "<u4", lanes) for c in codes]).astype(np.int64)
    reader = _Reader(np.concatenate([np.frombuffer(c, "<u2", offset=4 * lanes) for c in codes]), np.cumsum(counts) - counts)
    model, out = Model(blocks, lanes), np.zeros((blocks, n), np.uint32)
    for lo, hi in epochs(n, lanes):
        part = np.zeros(((hi - lo) // lanes, blocks * lanes), np.int64)
        before = before2 = np.zeros(blocks * lanes, np.int64)
        fresh = np.repeat(model.fresh, lanes)
        known = []
        for t in range(len(part)):
            known.append(model.look(before, before2))
            named2, named1, cell = known[-1][:3]
            wrong2, missed = reader.event(model.bounds.take(cell, mode="clip"))
            got = part[t]
            got[:] = np.where(wrong2, named1, named2)
            k = np.flatnonzero(missed)
            if len(k):
                base, end = model.base.take(k, mode="clip"), fresh.take(k, mode="clip")
                unit, off = reader.range.take(k, mode="clip") >> WORD, reader.off.take(k, mode="clip")
                place = reader.place(unit, off)
                found = model.slots.take(base + place, mode="clip").astype(np.int64)
                own = model.order0.take(base + found, mode="clip")
                start, size = own & LOWER, own >> UPPER
                new = place >= end
                if new.any():
                    end = end.astype(np.uint64)
                    start, size = np.where(new, end, start), np.where(new, np.uint64(IDS) - end, size)
                    reader.take_some(k, unit, off, start, size)
                    own = k[new]
                    unit, off = reader.range[own] >> WORD, reader.off[own]
                    found[new] = reader.place(unit, off)
                    reader.take_some(own, unit, off, found[new].astype(np.uint64), np.uint64(1))
                else:
                    reader.take_some(k, unit, off, start, size)
                got[k] = found
            before2, before = before, got
        out[:, lo:hi] = part.T.reshape(blocks, -1)[:, : min(hi, n) - lo]
        if hi < n:
            model.learn(part, known)
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of at most BLOCK ids; blocks of one length go together."""
    out: list[bytes] = [b""] * len(blocks)
    for own in _alike([len(b) for b in blocks]):
        for i, code in zip(own, encode_group(np.stack([blocks[i] for i in own])), strict=True):
            out[i] = code
    return out


def decode_blocks(codes: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(codes)
    for own in _alike(sizes):
        for i, ids in zip(own, decode_group([codes[i] for i in own], sizes[own[0]]), strict=True):
            out[i] = ids.astype("<u4")
    return out


def _alike(sizes: list[int]) -> list[list[int]]:
    """Positions of equal sizes, at most TOGETHER in a list."""
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        by_size.setdefault(n, []).append(i)
    return [own[at : at + TOGETHER] for own in by_size.values() for at in range(0, len(own), TOGETHER)]


#: A part (behind its newline, or the space of a text's first) of Latin letters that ASCII signs may end; apostrophes bind letters.
_WORD = r"^(?P<stem>[ \n]?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class Parts:
    """The ids of parts, in flat arrays, and how often each was met; Arrow finds the parts, many at once."""

    def __init__(self):
        self.place = pa.array([], pa.large_string())
        self.flat = np.zeros(0, "<u4")
        self.begin, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))

    def find(self, keys: pa.Array) -> np.ndarray:
        """Where the parts are, -1 for those not known."""
        return pc.fill_null(pc.index_in(keys, value_set=self.place), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New parts, their ids one after another, and how many each has; their places."""
        self.place = pa.concat_arrays([self.place, keys])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, ids.astype("<u4")])
        self.size = np.concatenate([self.size, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(keys), np.int64)])
        return np.arange(len(self.met) - len(keys), len(self.met))

    def forget(self, but: int) -> np.ndarray:
        """Keeps those met most often; where each part is now, -1 if forgotten."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[:but])
        moved = np.full(len(self.met) + 1, -1)  # the last for those not known before
        moved[stay] = np.arange(len(stay))
        self.place = self.place.take(pa.array(stay))
        self.flat = self.flat[spread(self.begin[stay], self.size[stay])]
        self.size, self.met = self.size[stay], self.met[stay] >> 1
        self.begin = np.cumsum(self.size) - self.size
        return moved


class Tokens:
    """Ids of texts by the tokenizers library.

    No pre-token of the byte-level files spans a single space, or holds a single newline and more, between two other
    characters, so what such spaces and newlines separate (a part) is encoded once and remembered; texts with other runs of
    white space go to the library whole.  A word that signs end is two pre-tokens wherever it stands: the word is encoded once,
    whatever signs follow.  Arrow cuts a batch of texts and numbers its different parts, numpy puts the ids together.
    When ``remembered`` parts are known, the half of them that was met most often stays.
    """

    def __init__(self, path: str, remembered: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = self.library.get_vocab()
        self.opens = {}  # before a part: which ids open with it, by the letters that stand for a space and a newline
        for before, letter in ((" ", "\u0120"), ("\n", "\u010a")):
            self.opens[before] = np.zeros(max(names.values(), default=0) + 1, bool)
            self.opens[before][[i for t, i in names.items() if t.startswith(letter)]] = True
        self.remembered = remembered
        self.memory = Parts()  # parts, those that open a text behind a space; no ids: white space may bind the part

    def encoded(self, parts: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after another, and how many each has.  ``before`` stands before every part: a space, a newline
        (the parts' own), or nothing."""
        lead = " " if before == " " else ""
        if before:  # many at once: the first token of every part opens with what stands before it
            joined = [lead + lead.join(parts[i : i + 128]) for i in range(0, len(parts), 128)]
            ids = np.concatenate([np.array(got.ids, "<u4") for got in self.library.encode_batch_fast(joined, add_special_tokens=False)])
            starts = np.flatnonzero(self.opens[before][ids])
            if len(starts) == len(parts) and starts[0] == 0:
                return ids, np.diff(starts, append=len(ids))
        own = [np.array(got.ids, "<u4") for got in self.library.encode_batch_fast([lead + p for p in parts], add_special_tokens=False)]
        return np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))

    def encode(self, keys: pa.Array, words: bool) -> np.ndarray:
        """Sends new parts to the library; their places.  Words have no white space but what stands before them."""
        kind = np.where(pc.starts_with(keys, " "), 3, np.where(pc.starts_with(keys, "\n"), 2, 1))
        if not words:  # white space binds some
            bare = [key[1:] if key[:1] in (" ", "\n") else key for key in keys.to_pylist()]
            kind[[not b or b[0].isspace() or b[-1].isspace() for b in bare]] = 0
        at = np.zeros(len(keys), np.int64)
        for k in np.unique(kind).tolist():
            own = keys.filter(pa.array(kind == k))
            texts = own.to_numpy(zero_copy_only=False).tolist()
            ids, sizes = self.encoded([t[1:] for t in texts] if k == 3 else texts, ("", " ", "\n", "")[k]) if k else (np.zeros(0, "<u4"), np.zeros(len(own), np.int64))
            at[kind == k] = self.memory.add(own, ids, sizes)
        return at

    def learn(self, keys: pa.Array) -> np.ndarray:
        """Takes in new parts; their places."""
        memory, at = self.memory, np.zeros(len(keys), np.int64)
        cut = pc.extract_regex(keys, _WORD)
        word = cut.is_valid().to_numpy(zero_copy_only=False)
        at[~word] = self.encode(keys.filter(pa.array(~word)), words=False)
        cut = cut.drop_null()
        stem, tail = (pc.struct_field(cut, name).dictionary_encode() for name in ("stem", "tail"))
        known = memory.find(stem.dictionary)
        known[known < 0] = self.encode(stem.dictionary.filter(pa.array(known < 0)), words=True)
        known, tails = known[stem.indices.to_numpy()], tail.dictionary.to_pylist()
        ids, sizes = self.encoded(tails, "") if tails else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        of = tail.indices.to_numpy()
        ended = sizes[of] > 0
        stems, of = known[ended], of[ended]
        memory.met += np.bincount(stems, minlength=len(memory.met))
        begin = np.stack([memory.begin[stems], len(memory.flat) + (np.cumsum(sizes) - sizes)[of]], 1)
        size = np.stack([memory.size[stems], sizes[of]], 1)
        both = np.concatenate([memory.flat, ids])[spread(begin.ravel(), size.ravel())]
        known[ended] = memory.add(keys.filter(pa.array(word)).filter(pa.array(ended)), both, size.sum(1))
        at[word] = known
        return at

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        starts, part = np.cumsum(sizes) - sizes, coded.indices.to_numpy().astype(np.int64)
        del cut
        opening, own = np.unique(part[starts], return_inverse=True)
        part[starts] = len(coded.dictionary) + own
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary.take(pa.array(opening)), pa.scalar("", pa.large_string()))
        keys = pa.concat_arrays([coded.dictionary, spaced])
        met = np.bincount(part, minlength=len(keys))
        at = self.memory.find(keys)
        fresh = np.flatnonzero((at < 0) & (met > 0))
        if len(self.memory.met) + len(fresh) > self.remembered < self.remembered // 2 + len(self.memory.met):
            at = self.memory.forget(self.remembered // 2)[at]
            fresh = np.flatnonzero((at < 0) & (met > 0))
        if len(fresh):
            at[fresh] = self.learn(keys.take(pa.array(fresh)))
        self.memory.met[at[met > 0]] += met[met > 0]  # parts differ, and so do their places
        at = at[part]
        size = self.memory.size[at]
        bound = np.logical_or.reduceat(size == 0, starts)
        ends = np.cumsum(size)[starts + sizes - 1]
        ids = np.empty(ends[-1], "<u4")
        done = 0
        for lo in range(0, len(at), 1 << 18):
            hi = lo + (1 << 18)
            own = self.memory.flat[spread(self.memory.begin[at[lo:hi]], size[lo:hi])]
            ids[done : done + len(own)] = own
            done += len(own)
        whole = {i: np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4") for i in np.flatnonzero(bound).tolist()}
        return [whole[i] if i in whole else own for i, own in enumerate(np.split(ids, ends[:-1]))]


_kept: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    """One a worker process; the next task finds it with its parts."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = Tokens(path)
    return _kept[path]


def write(docs: DataFrame, tokenizer_path: str, to: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Writes the blocks as Parquet: part and block number the blocks in id order; ``docs`` lists a block's documents."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), _tokens(tokenizer_path)
        blocks: list[list] = []
        open_ids: list[np.ndarray] = []
        listed: list[tuple] = []
        size, number, row = 0, 0, 0

        def flush() -> Iterator[tuple]:
            nonlocal number
            for (ids, own), code in zip(blocks, encode_blocks([b[0] for b in blocks]) if blocks else [], strict=True):
                yield part, number, len(ids), zlib.crc32(ids.tobytes()), code, own
                number += 1
            blocks.clear()

        def close() -> None:
            nonlocal open_ids, listed, size
            if size:
                blocks.append([np.concatenate(open_ids).astype("<u4"), listed])
            open_ids, listed, size = [], [], 0

        def texts() -> Iterator[tuple]:
            held, chars = [], 0
            for key, text, _ in rows:
                held.append((key, text or ""))
                chars += len(held[-1][1])
                if chars >= CHARS or len(held) == 1 << 16:
                    yield from zip([k for k, _ in held], tokens([t for _, t in held]), strict=True)
                    held, chars = [], 0
            yield from zip([k for k, _ in held], tokens([t for _, t in held]), strict=True)

        for key, ids in texts():
            ids = np.append(ids, np.uint32(end_id))
            at = 0
            while at < len(ids):
                take = min(BLOCK - size, len(ids) - at)
                open_ids.append(ids[at : at + take])
                listed.append({"row": row, "id": key, "n": take})
                size, at = size + take, at + take
                if size == BLOCK:
                    close()
                    if len(blocks) == TOGETHER:
                        yield from flush()
            row += 1
        close()
        yield from flush()

    by_rows(ordered, run, f"part int, block int, n_ids int, crc long, code binary, docs array<struct<row:long,id:{kind},n:int>>", out=TOGETHER).write.parquet(to)


def read(spark, path: str) -> DataFrame:
    """part, row, id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType["id"].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def out() -> Iterator[tuple]:
            for (part, block, _, crc, _, own), ids in zip(held, decode_blocks([h[4] for h in held], [h[2] for h in held]), strict=True):
                if zlib.crc32(ids.tobytes()) != crc:
                    raise ValueError(f"part {part}, block {block}: checksum differs")
                at = 0
                for d in own:
                    yield part, d["row"], d["id"], block, d["n"], zlib.crc32(ids[at : at + d["n"]].tobytes())
                    at += d["n"]

        for row in rows:
            held.append(row)
            if len(held) == TOGETHER:
                yield from out()
                held = []
        if held:
            yield from out()

    pieces = by_rows(files.select("part", "block", "n_ids", "crc", "code", "docs"), run, f"part int, row long, id {kind}, block int, n int, crc long", chunk=TOGETHER)
    whole = pieces.groupBy("part", "row").agg(F.first("id").alias("id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"))

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part, row, key, n, own in rows:
            crc = own[0]["crc"]
            for p in own[1:]:  # crc32 is affine: a piece's own checksum, moved on from the one before
                zeros = bytes(4 * p["n"])
                crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ p["crc"]
            yield part, row, key, n, crc

    got = by_rows(whole.select("part", "row", "id", "n_tokens", "pieces"), joined, f"part int, row long, id {kind}, n_tokens long, ids_crc32 long")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    own = Window.partitionBy("part").orderBy("row")
    return got.join(before, "part").withColumn("start", F.col("offset") + F.sum("n_tokens").over(own) - F.col("n_tokens")).select("part", "row", "id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to the shared folder and describes every document as read back from them."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, path, id_col, text_col)
    return read(docs.sparkSession, path).withColumnRenamed("id", id_col)
