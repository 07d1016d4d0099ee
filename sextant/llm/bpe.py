"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Texts are cut at white space, and what stands between (a chunk) is cut into words once and remembered.  Frequent words of the corpus are ranged into shards; executors merge each shard's words once and compile them into a
minimal acyclic automaton: words share prefixes and suffixes.  Each state knows how many words end behind it, so summing the
counts passed over on a walk numbers the words densely, and the number addresses the word's ids (the transducer's output) in
one flat array.  The tables are 32-bit arrays, sent to the executors, mapped into memory there, and walked for all new words
of a batch at once.  Words that are in none are merged exactly, by merge rank, all of one length together.

The model file is one of the public JSON vocabularies with word ends; its path is a parameter.

Defined results: null texts count as empty and have no ids; the special tokens' strings in a text are their ids, as the
file asks; bytes that are no text can't occur; repeated rows repeat; extra columns are ignored, whatever their
names; an empty table gives an empty lexicon and no rows; very long texts are encoded whole and very long words merged
with a heap in n log n.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import json
import mmap
import os
import struct
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.llm.words import Memory, by_rows, numbered, spread

#: str.split() cuts at these too, though they are no white space to Unicode.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Opens what stands for a special token; no chunk or word has white space.
MARK = "\n"
#: Characters of the texts that are cut together.
CHARS = 1 << 22
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the others
    take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class WordBpe:
    """Exact merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.letters = byte_letters()
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.size = max(self.names, default=0) + 1
        self.byte_ids = np.array([[self.ids.get(c + e, self.size) for c in self.letters] for e in ("", self.end)], np.int64)
        known = sorted((self.ids[a] * self.size + self.ids[b], r, self.ids[a + b]) for (a, b), r in self.rank.items())
        self.pair_keys = np.array([k for k, _, _ in known] + [np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([r for _, r, _ in known] + [len(pairs)], np.int32)
        self.merged = np.zeros(len(pairs) + 1, np.int64)
        self.merged[self.pair_ranks[:-1]] = [i for _, _, i in known]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letters are lowered one by one, so there is no final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """Normalised words of a stretch of text without special tokens."""
        return _PIECES.findall(self.normal(text))

    def spaced(self, text: str) -> str:
        """Normalised chunks, whose words are the text's, with one space between them.  A text that may hold special tokens or
        separators is cut into words, and a special token is its id behind a MARK."""
        if self.special and "<" in text and self.cut.search(text) or any(c in text for c in _SEPARATORS):
            return " ".join([f"{MARK}{p}" if isinstance(p, int) else p for p in self.pieces(text)])
        return " ".join(self.normal(text).split())

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the leftmost pair of lowest rank is merged until none is left."""
        parts: list[str | None] = list(word) if word.isascii() and word.isalnum() else [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        if len(parts) > 40:
            return [self.ids[p] for p in self._merge_long(parts)]
        rank, never = self.rank.get, len(self.rank)
        ranks = list(map(rank, zip(parts, parts[1:]), itertools.repeat(never)))
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), never)
        return [self.ids[p] for p in parts]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, the number of merges where there is none."""
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.pair_ranks[-1])

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has.  Words of one length in bytes are the rows of a matrix
        and take each merge together; long ones, and those of bytes that the file doesn't name, go one by one."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        sizes, found = np.zeros(len(raw), np.int64), []
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            if n:
                parts = np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), np.uint8).reshape(-1, n)
                parts = np.concatenate([self.byte_ids[0][parts[:, :-1]], self.byte_ids[1][parts[:, -1:]]], 1)
                alone = np.full(len(rows), n > 40) | (parts == self.size).any(1)
                for i in rows[alone].tolist():
                    own = np.array(self.merge(words[i]), np.int64)
                    found.append((np.array([i]), own[None]))
                rows, parts = rows[~alone], parts[~alone]
                ranks = self._ranks(parts[:, :-1], parts[:, 1:])
                while len(rows):
                    done, every = np.ones(len(rows), bool), np.arange(len(rows))
                    if ranks.shape[1]:
                        best = ranks.argmin(1)  # the leftmost of the lowest
                        least = ranks[every, best]
                        done = least == self.pair_ranks[-1]
                    if done.any():
                        found.append((rows[done], parts[done]))
                        if done.all():
                            break
                        go = ~done
                        rows, parts, ranks, best, least = rows[go], parts[go], ranks[go], best[go], least[go]
                        every = np.arange(len(rows))
                    here = np.arange(ranks.shape[1]) <= best[:, None]
                    parts = np.where(here, parts[:, :-1], parts[:, 1:])
                    parts[every, best] = self.merged[least]
                    ranks = np.where(here[:, :-1], ranks[:, :-1], ranks[:, 1:])
                    for k, at in ((np.flatnonzero(best > 0), best - 1), (np.flatnonzero(best < ranks.shape[1]), best)):
                        ranks[k, at[k]] = self._ranks(parts[k, at[k]], parts[k, at[k] + 1])
        for rows, parts in found:
            sizes[rows] = parts.shape[1]
        begin, flat = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.int64)
        for rows, parts in found:
            flat[begin[rows][:, None] + np.arange(parts.shape[1])] = parts
        return flat, sizes

    def _merge_long(self, parts: list) -> list[str]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    pair = (parts[left], parts[after[left]])
                    if (r := rank.get(pair)) is not None:
                        heapq.heappush(heap, (r, left, *pair))
        return [p for p in parts if p is not None]

    def pieces(self, text: str) -> list[str | int]:
        """Words, and special tokens as their ids."""
        if not self.special or "<" not in text:
            return self.words(text)
        out: list[str | int] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self.words(part))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens with one space between them: the file names no decoder."""
        return " ".join(self.names[i] for i in ids)


class Lexicon:
    """Minimal acyclic transducer from words to id lists, in flat arrays."""

    MAGIC = b"MAT2"
    #: keys (state and byte), targets, skips, finals, offsets, flat
    KINDS = (np.uint32, np.uint32, np.uint32, np.uint8, np.uint32, np.uint32)

    @staticmethod
    def compile(entries: Iterable[tuple[str, list[int]]]) -> bytes:
        """Built in sorted order: states behind the last word's branch are final in form and shared when equal."""
        known: dict[tuple, int] = {}
        forms: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            form = (node[0], tuple((b, settle(c) if isinstance(c, list) else c) for b, c in node[1]))
            if form not in known:
                known[form] = len(forms)
                forms.append(form)
            return known[form]

        root: list = [False, []]
        path, previous = [root], b""
        offsets, flat = array("I", [0]), array("I")
        for word, ids in sorted((w.encode("utf-8", "surrogatepass"), i) for w, i in entries):
            if word == previous:
                continue
            common = len(os.path.commonprefix([word, previous]))
            if len(path) > common + 1:
                edges = path[common][1]
                edges[-1] = (edges[-1][0], settle(path[common + 1]))
                del path[common + 1 :]
            for b in word[common:]:
                node: list = [False, []]
                path[-1][1].append((b, node))
                path.append(node)
            path[-1][0] = True
            previous = word
            flat.extend(ids)
            offsets.append(len(flat))
        start = settle(root)
        if len(forms) >= 1 << 24:
            raise ValueError("too many states for one automaton; compile fewer words a shard")
        behind = array("I", bytes(4 * len(forms)))
        keys, targets, skips = array("I"), array("I"), array("I")
        for i, (final, edges) in enumerate(forms):  # children come before their parents
            passed = int(final)
            for b, c in edges:
                keys.append(i << 8 | b)
                targets.append(c)
                skips.append(passed)
                passed += behind[c]
            behind[i] = passed
        finals = array("B", [f for f, _ in forms] + [0] * (-len(forms) % 4))
        parts = (keys, targets, skips, finals, offsets, flat)
        return Lexicon.MAGIC + struct.pack("<7q", start, *map(len, parts)) + b"\0" * 4 + b"".join(a.tobytes() for a in parts)

    def __init__(self, blob: bytes | mmap.mmap, at: int = 0):
        if blob[at : at + 4] != self.MAGIC:
            raise ValueError("not a lexicon")
        start, *sizes = struct.unpack("<7q", blob[at + 4 : at + 60])
        self.start, got = start, []
        at += 64
        for kind, n in zip(self.KINDS, sizes, strict=True):
            got.append(np.frombuffer(blob, kind, n, at))
            at += got[-1].nbytes
        self.keys, self.targets, self.skips, self.finals, self.offsets, self.flat = got

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it isn't in the lexicon; all words step together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        text = np.frombuffer(b"".join(words), np.uint8)
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(size > 0)
        state, number = np.full(len(live), self.start, np.uint32), np.zeros(len(live), np.int64)
        step = 0
        while len(live) and len(self.keys):
            key = state << np.uint32(8) | text[first[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, number = self.targets[at], number[ok] + self.skips[at]
            step += 1
            ended = size[live] == step
            hit = ended & (self.finals[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return out

    def ids(self, number: int) -> list[int]:
        return self.flat[self.offsets[number] : self.offsets[number + 1]].tolist()


#: Compiled automata in word order: the first word of each and its tables.
Shards = list[tuple[bytes, bytes]]


class Mapped:
    """Automata of disjoint word ranges in one memory map; its file has no name any more, so nothing is left behind."""

    def __init__(self, shards: Shards):
        self.lows = [low for low, _ in shards]
        self.shards: list[Lexicon] = []
        if shards:
            with tempfile.TemporaryFile() as f:
                for _, blob in shards:
                    f.write(blob)
                f.flush()
                whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            at = 0
            for _, blob in shards:
                self.shards.append(Lexicon(whole, at))
                at += len(blob)

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words some automaton holds (their positions), their ids one after another, and how many each has."""
        own: list[list[tuple[bytes, int]]] = [[] for _ in self.shards]
        for i, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            if (at := bisect.bisect_right(self.lows, raw) - 1) >= 0:
                own[at].append((raw, i))
        at, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for shard, part in zip(self.shards, own, strict=True):
            number = shard.find([raw for raw, _ in part])
            held = number[number >= 0]
            begin, size = shard.offsets[held].astype(np.int64), np.diff(shard.offsets).astype(np.int64)[held]
            at.append(np.array([i for _, i in part], np.int64)[number >= 0])
            ids.append(shard.flat[spread(begin, size)])
            sizes.append(size)
        return np.concatenate(at), np.concatenate(ids), np.concatenate(sizes)


def count_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """word, n over all texts; tasks add up their own words before the shuffle, in tables of bounded size."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe, held = WordBpe(path), Counter()

        def out() -> Iterator[tuple]:
            words: Counter = Counter()
            for chunk, n in held.items():
                if chunk.isalpha():
                    words[chunk] += n
                elif not chunk.startswith(MARK):
                    for word in _PIECES.findall(chunk):
                        words[word] += n
            held.clear()
            return iter(list(words.items()))

        def count(texts: list[str]) -> None:
            chunks, number, _ = numbered(texts)
            for chunk, n in zip(chunks, np.bincount(number, minlength=len(chunks)).tolist(), strict=True):
                held[chunk] += n

        texts, chars = [], 0
        for (text,) in rows:
            texts.append(bpe.spaced(text or ""))
            chars += len(texts[-1])
            if chars >= CHARS:
                count(texts)
                texts, chars = [], 0
                if len(held) > 300_000:
                    yield from out()
        if texts:
            count(texts)
        yield from out()

    return by_rows(docs.select(text_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, size: int) -> int:
    """The least count that at most ``size`` words reach.  What reaches the driver is a histogram: a row for each count up to
    4,096 and for each power of two above."""
    n = F.col("n")
    bin_of = F.when(n <= 4096, n).otherwise(F.lit(2).cast("double") ** F.floor(F.log2(n))).cast("long")
    total = 0
    for row in sorted(counts.groupBy(bin_of.alias("at")).count().collect(), key=lambda r: -r.at):
        total += row["count"]
        if total > size:
            return row.at + 1 if row.at <= 4096 else 2 * row.at
    return 1


def lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = 200_000, max_word: int = 64, shard: int = 20_000) -> Shards:
    """Automata of the most frequent words of all texts: all that reach a count which at most ``size`` words reach (a
    documented bound, as is ``max_word``).  Words are ranged into shards of about ``shard`` words, which executors merge and
    compile; only the finished tables, some 40 bytes a word, come back."""
    counts = materialise(count_words(docs, path, text_col).where(F.length("word") <= max_word), "words")
    frequent = counts.where(F.col("n") >= least_count(counts, size)).select("word")
    ranged = frequent.repartitionByRange(max(1, -(-min(size, frequent.count()) // shard)), "word").sortWithinPartitions("word")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = [w for (w,) in rows]
        if words:
            bpe = WordBpe(path)
            yield words[0].encode("utf-8", "surrogatepass"), Lexicon.compile((w, bpe.merge(w)) for w in words)

    return sorted((bytes(r.low), bytes(r.tables)) for r in by_rows(ranged, run, "low binary, tables binary").collect())


class Encoder:
    """Encodes texts through the lexicon.  Arrow cuts a batch of texts and numbers its different chunks; what chunks and words
    encode to is remembered, of up to ``remembered`` ones, and ids and tokens of the texts are put together by numpy and Arrow."""

    def __init__(self, path: str, shards: Shards, remembered: int = 400_000):
        self.bpe, self.lexicon, self.memory = WordBpe(path), Mapped(shards), Memory(remembered)
        names = self.bpe.names
        self.decimals = pa.array(list(map(str, range(self.bpe.size))), pa.large_string())
        self.tokens = pa.array([names.get(i, "") for i in range(self.bpe.size)], pa.large_string())

    def learn(self, chunks: list[str]) -> None:
        cut = {c: _PIECES.findall(c) for c in chunks if not c.startswith(MARK) and not c.isalpha()}  # letters alone are one word
        special = [c for c in chunks if c.startswith(MARK)]
        self.memory.add(special, np.array([int(c[1:]) for c in special], np.int64), np.ones(len(special), np.int64))
        words = dict.fromkeys(c for c in chunks if c not in cut and not c.startswith(MARK))
        words.update(dict.fromkeys(w for own in cut.values() for w in own))
        new = [w for w in words if w not in self.memory.place]
        at, ids, sizes = self.lexicon.find(new)
        self.memory.add([new[i] for i in at.tolist()], ids, sizes)
        rest = np.ones(len(new), bool)
        rest[at] = False
        new = [new[i] for i in np.flatnonzero(rest).tolist()]
        self.memory.add(new, *self.bpe.merge_all(new))
        more = [c for c in cut if c not in self.memory.place]  # what is one word is known by now
        at = self.memory.places([w for c in more for w in cut[c]])
        ends = np.concatenate([[0], np.cumsum(self.memory.size[at])])
        upto = np.concatenate([[0], np.cumsum(np.fromiter((len(cut[c]) for c in more), np.int64, len(more)))])
        self.memory.add(more, self.memory.ids(at), np.diff(ends[upto]))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, ids joined by spaces, decoded text."""
        if not texts:
            return
        chunks, number, sizes = numbered([self.bpe.spaced(t or "") for t in texts])
        at = self.memory.meet(chunks, np.bincount(number, minlength=len(chunks)), self.learn)[number]
        ends = np.concatenate([[0], np.cumsum(self.memory.size[at])])
        ends = ends[np.concatenate([[0], np.cumsum(sizes)])]
        ids, bounds = pa.array(self.memory.ids(at)), pa.array(ends, pa.int32())
        joined = [pc.binary_join(pa.ListArray.from_arrays(bounds, kind.take(ids)), pa.scalar(" ", pa.large_string())) for kind in (self.decimals, self.tokens)]
        for n, own, text in zip(np.diff(ends).tolist(), *joined, strict=True):
            yield n, own.as_py(), text.as_py()


_kept: dict[tuple[str, bytes], Encoder] = {}


def _encoder(path: str, shards: Shards) -> Encoder:
    """One encoder a worker process; the next task of the same job finds it with its words."""
    key = (path, hashlib.sha256(b"".join(x for s in shards for x in s)).digest())
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(path, shards)
    return _kept[key]


def encode(docs: DataFrame, path: str, shards: Shards, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_tokens, and ids (decimal, joined by spaces) with the decoded text, or with ``digest`` their SHA-256."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(shards)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder = _encoder(path, shared.value)

        def out(held: list[tuple]) -> Iterator[tuple]:
            for (key, _), (n, ids, text) in zip(held, encoder.encode([t for _, t in held]), strict=True):
                yield (key, n, sha(ids), sha(text)) if digest else (key, n, ids, text)

        held, chars = [], 0
        for row in rows:
            held.append(row)
            chars += len(row[1] or "")
            if chars >= CHARS or len(held) == 4096:
                yield from out(held)
                held, chars = [], 0
        yield from out(held)

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return by_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, {names[0]} string, {names[1]} string")
