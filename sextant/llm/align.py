"""Alignment of two tokenizers' ids over the same bytes.

Byte offsets at which tokens of both tokenizers end cut a text into groups: the dictionaries of ends to token numbers are
intersected, and the sorted common ends slice both id lists; every A token of a slice is linked with every B token of it.

Neither tokenizer merges over a place where a space follows another character than white space: the byte-level file's
pre-tokens begin there, and no piece of the other file has a space behind another character (``_separable`` looks).  So both
tokenizers' tokens end at every such place, and a text is aligned unit by unit between them; a unit is aligned once
and remembered, up to a bound, by every worker process.  New units are joined for the tokenizers and aligned by numpy, many at
once.  Where no token of either file holds a letter and a sign behind it (``signs_apart``), a word and the signs that end it
are aligned apart and put together.

A pair of ids counts the documents that hold it linked.  Texts are aligned once; each row's pairs are stored, packed, beside
its digest.  Counts of pairs are summed by Spark; the most frequent ones, at most ``common``, are broadcast, and
pairs beside them meet their counts in a join, so nothing that grows with the data is held whole anywhere.

Defined results: a null or empty text, and one whose joined tokens of either side don't give back a space and the text (characters
that a tokenizer rewrites), has no tokens: zeros and an empty digest.  Strings of special tokens are plain text.  Every row is
a document: rows with a null or repeated id count by themselves.  Ties of the highest count all count as best.  An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.llm.words import by_rows

#: Pairs are numbers a * IDS + b; ids of 65,536 and more are refused.
IDS = 1 << 16
#: Units that a worker process remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 500_000, 64
#: Units whose alignment is one step of numpy.
TOGETHER = 4096
#: A group of more links than this is folded to its different pairs.
WIDE = 4096
#: Places between units: white space as Python sees it holds all that the library does.
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")
#: A space behind other white space.
_BEHIND = re.compile(r"[^\S ] ")
#: ASCII signs that may end a word of Latin letters (apostrophes bind letters); a letter and a sign in one token.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORD, _MIXED = re.compile(f"[{_LATIN}]+"), re.compile(f"[{_LATIN}][{re.escape(_SIGNS)}]")
#: n_a, n_b, n_groups, n_links, groups as text, pairs (a number for each link), different pairs of wide groups and how often.
Unit = tuple[int, int, int, int, bytes, bytes, tuple[np.ndarray, ...]]

_BY_FILES: dict[tuple[str, str], Aligner] = {}


def letters_of_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Groups and links of texts under two tokenizer files; ``of`` keeps one in a worker process."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = letters_of_bytes()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8", "surrogatepass"))
        if max(len(self.a_bytes), len(self.b_bytes)) > IDS:
            raise ValueError(f"ids of {IDS} and more")
        self.text = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.ended = [f"{i}{sign}".encode() for sign in ",|;" for i in self.text]  # an id and what follows it in a digest's text
        self.ended_sizes = np.array([len(t) for t in self.ended], np.int64)
        special = {i for i, token in self.a.get_added_tokens_decoder().items() if token.special}  # no text becomes these
        of_text = [t for i, t in enumerate(self.a_bytes) if i not in special] + [t for i, t in enumerate(self.b_bytes) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        self.signs_apart = not any(_MIXED.search(t.decode("utf-8", "replace")) for t in of_text)
        self.separable = not any(" " in p.lstrip(b" ").decode("utf-8", "replace") for p in self.b_bytes)
        self.units: dict[str, Unit | None] = {}
        self.again: set[str] = set()  # units met in another batch than the one that brought them
        self.tails: dict[str, Unit | None] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in _BY_FILES:
            _BY_FILES[a_path, b_path] = cls(a_path, b_path)
        return _BY_FILES[a_path, b_path]

    def align(self, raw: bytes, a: list[int], b: list[int]) -> Unit | None:
        """Both id lists over ``raw``; None where one of them spells other bytes."""
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return None
        a_at = dict(zip(accumulate(map(len, a_parts)), range(1, len(a) + 1), strict=True))
        b_at = dict(zip(accumulate(map(len, b_parts)), range(1, len(b) + 1), strict=True))
        a_from = b_from = links = 0
        groups, pairs, wide, text = [], [], [], self.text
        common = sorted(a_at.keys() & b_at.keys())
        for end in common:
            a_to, b_to = a_at[end], b_at[end]
            if a_to - a_from == 1 == b_to - b_from:
                x, y = a[a_from], b[b_from]
                groups.append(text[x] + "|" + text[y])
                pairs.append(x * IDS + y)
                links += 1
            else:
                own_a, own_b = a[a_from:a_to], b[b_from:b_to]
                groups.append(f"{','.join([text[x] for x in own_a])}|{','.join([text[y] for y in own_b])}")
                size = len(own_a) * len(own_b)
                links += size
                if size <= WIDE:
                    pairs.extend([x * IDS + y for x in own_a for y in own_b])
                else:
                    (x, n), (y, m) = (np.unique(ids, return_counts=True) for ids in (own_a, own_b))
                    wide.append(np.stack([np.add.outer(x * IDS, y).ravel(), np.multiply.outer(n, m).ravel()]))
            a_from, b_from = a_to, b_to
        return len(a), len(b), len(common), links, ";".join(groups).encode(), array("I", pairs).tobytes(), tuple(wide)

    def cut(self, text: str) -> list[str]:
        """A space and the text, in units; all of it where a piece could span two units."""
        if not self.separable:
            return [text]
        parts = text.split(" ")
        if "" not in parts and not text[-1].isspace() and not _BEHIND.search(text):
            return parts
        return [u[1:] if u[0] == " " else u for u in _CUT.split(f" {text}")]

    def learn(self, texts: list[list[str]]) -> None:
        """Takes in new units; when too many are known, those met again stay."""
        wanted = set(chain.from_iterable(texts))
        fresh = wanted - self.units.keys()
        self.again |= wanted - fresh
        if len(self.units) + len(fresh) > REMEMBERED:
            stay = self.again & self.units.keys()
            self.units = {u: self.units[u] for u in stay} if len(stay) <= REMEMBERED // 2 else {}
            self.again = set()
            fresh = wanted - self.units.keys()
        whole, ended = list(fresh), []
        if self.signs_apart:
            whole = []
            for u in fresh:
                word = u.rstrip(_SIGNS)
                if word and len(word) < len(u) and _WORD.fullmatch(word):
                    ended.append((u, word, u[len(word) :]))
                else:
                    whole.append(u)
            whole += {word for _, word, _ in ended} - fresh - self.units.keys()
        alone = []
        joined = []
        for u in whole:
            (alone if not u or u[0].isspace() or u[-1].isspace() or len(u) > LONGEST else joined).append(u)
        for at in range(0, len(joined), TOGETHER):
            alone += self.align_joined(joined[at : at + TOGETHER])
        for at in range(0, len(alone), 4096):
            own = alone[at : at + 4096]
            spaced = [" " + u for u in own]
            a, b = self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(own, num_threads=1)
            for u, raw, x, y in zip(own, spaced, a, b, strict=True):
                self.units[u] = self.align(raw.encode("utf-8", "surrogatepass"), x.ids, y)
        for u, word, signs in ended:
            x, y = self.units[word], self.tail(signs)
            self.units[u] = None if x is None or y is None else (x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + b";" + y[4], x[5] + y[5], x[6] + y[6])

    def tail(self, signs: str) -> Unit | None:
        """Signs behind a letter, where both tokenizers' tokens end."""
        if signs not in self.tails:
            if len(self.tails) >= 4096:
                self.tails.clear()
            ids = [self.a.encode_batch_fast([f" a{signs}"], add_special_tokens=False)[0].ids, self.b.encode(f"a{signs}")]
            for own, spelt in zip(ids, (self.a_bytes, self.b_bytes), strict=True):
                head = 0
                while own and head < 2:  # the space and the letter
                    head += len(spelt[own.pop(0)])
            self.tails[signs] = self.align(signs.encode(), *ids)
        return self.tails[signs]

    def align_joined(self, units: list[str]) -> list[str]:
        """Aligns units that no white space opens or ends as one text, whose tokens end where they do; gives back those that it left out."""
        parts = [units[at : at + 128] for at in range(0, len(units), 128)]
        texts = [" ".join(own) for own in parts]
        ids_a = [got.ids for got in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        left, kept, all_a, all_b = [], [], [], []
        for own, text, x, y in zip(parts, texts, ids_a, ids_b, strict=True):
            raw = f" {text}".encode("utf-8", "surrogatepass")
            if b"".join([self.a_bytes[i] for i in x]) == raw == b"".join([self.b_bytes[i] for i in y]):
                kept += own
                all_a += x
                all_b += y
            else:
                left += own
        if not kept:
            return left
        a, b = np.array(all_a, np.int64), np.array(all_b, np.int64)
        size_a, size_b = self.sizes[0][a], self.sizes[1][b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in kept])
        beside = np.searchsorted(end_b, end_a)  # both end at the same byte, so every place is within
        common = end_b[beside] == end_a
        last_a, last_b = np.flatnonzero(common), beside[common]
        group = np.searchsorted(end_a[last_a], ends)  # the last group of each unit
        from_a, from_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
        n_a, n_b = last_a + 1 - from_a, last_b + 1 - from_b
        links = n_a * n_b
        if (end_a[last_a[group]] != ends).any() or not size_a.all() or not size_b.all() or links.max() > WIDE:
            return left + kept
        of = np.repeat(np.arange(len(links)), links)
        within = np.arange(len(of)) - (np.cumsum(links) - links)[of]
        pairs = (a[from_a[of] + within // n_b[of]] * IDS + b[from_b[of] + within % n_b[of]]).astype("<u4").tobytes()
        follows, tokens = np.zeros(len(a), np.int64), np.empty(len(a) + len(b), np.int64)
        follows[last_a] = len(self.text)
        tokens[np.arange(len(a)) + np.repeat(from_b, n_a)] = a + follows
        follows = np.zeros(len(b), np.int64)
        follows[last_b] = 2 * len(self.text)
        tokens[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = b + follows
        text = b"".join([self.ended[i] for i in tokens.tolist()])
        counts = [last_a[group] + 1, last_b[group] + 1, group + 1, np.cumsum(links)[group]]
        to = np.cumsum(self.ended_sizes[tokens])[counts[0] + counts[1] - 1].tolist()
        till = (4 * counts[3]).tolist()
        told = zip(*(np.diff(c, prepend=0).tolist() for c in counts), strict=True)
        self.units.update({u: (*n, text[s : e - 1], pairs[p:q], ()) for u, n, s, e, p, q in zip(kept, told, [0, *to[:-1]], to, [0, *till[:-1]], till, strict=True)})
        return left

    def __call__(self, texts: list[str | None]) -> list[list[Unit] | None]:
        """The units of each text; None for a text without tokens."""
        cut = [self.cut(t) if t else [] for t in texts]
        self.learn(cut)
        out = []
        for own in cut:
            units = list(map(self.units.__getitem__, own))
            out.append(None if not units or None in units else units)
        for u in {u for own in cut for u in own if len(u) > LONGEST}:
            del self.units[u]
        return out


def _summed(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs in order, and how often."""
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    if times is None:
        pairs = np.sort(pairs)
    else:
        order = np.argsort(pairs)
        pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.diff(np.append(first, len(pairs))) if times is None else np.add.reduceat(times, first)


def pack(pairs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ordered pairs as differences in four planes of bytes, times as bytes; a byte of 255 stands for a number behind them."""
    planes = np.diff(pairs, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return planes.tobytes(), np.minimum(times, 255).astype(np.uint8).tobytes() + times[times >= 255].astype("<i8").tobytes()


def unpack(pairs: bytes, times: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    p = np.cumsum(np.ascontiguousarray(np.frombuffer(pairs, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)
    if times is None:
        return p, np.zeros(0, np.int64)
    t = np.frombuffer(times[: len(p)], np.uint8).astype(np.int64)
    t[t == 255] = np.frombuffer(times[len(p) :], "<i8")
    return p, t


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a_ids, b_ids and groups: how many A and B tokens each group takes of the two lists."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        aligner = Aligner.of(a_path, b_path)
        for key, text in rows:
            (units,) = aligner([text])
            a, b, own = [], [], []
            for g in b";".join(u[4] for u in units or []).decode().split(";") if units else []:
                x, y = ([int(i) for i in side.split(",")] for side in g.split("|"))
                a += x
                b += y
                own.append({"a": len(x), "b": len(y)})
            yield key, a, b, own

    return by_rows(docs.select(id_col, text_col), run, f"{id_col} {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<a:int,b:int>>", chunk=64, out=64)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own for each row), id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (packed)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        aligner, number = Aligner.of(a_path, b_path), TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def out() -> Iterator[tuple]:
            nonlocal number
            for (key, _), units in zip(held, aligner([t for _, t in held]), strict=True):
                number += 1
                if units is None:
                    yield number, key, 0, 0, 0, 0, "", b"", b""
                    continue
                n_a, n_b, n_groups, n_links, texts, pairs, wide = zip(*units, strict=True)
                pair, times = _summed(np.frombuffer(b"".join(pairs), "<u4"))
                if more := list(chain.from_iterable(wide)):
                    pair, times = _summed(np.concatenate([pair, *(w[0] for w in more)]).astype(np.uint32), np.concatenate([times, *(w[1] for w in more)]))
                sha = hashlib.sha256(b";".join(texts)).hexdigest()
                yield number, key, sum(n_a), sum(n_b), sum(n_groups), sum(n_links), sha, *pack(pair, times)

        size = 0
        for key, text in rows:
            held.append((key, text))
            size += len(text or "")
            if size > 500_000:
                yield from out()
                held, size = [], 0
        yield from out()

    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return by_rows(docs.select(id_col, text_col), run, schema, chunk=64, out=128)


def pair_counts(rows: DataFrame, folded: int = 2_000_000) -> DataFrame:
    """pair, n: how many rows hold it; a task folds its rows' pairs, up to a bound of different ones, before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([pair, *held]), np.concatenate([n, np.ones(size, np.int64)]))

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pair), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + 50_000]), pa.array(n[at : at + 50_000])], names=["pair", "n"])

        for batch in batches:
            for packed in batch.column(0):
                held.append(unpack(packed.as_buffer())[0])
                size += len(held[-1])
                if size > folded:
                    pair, n = fold()
                    held, size = [], 0
                    if len(pair) > folded:
                        yield from out()
                        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, n = fold()
        yield from out()

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count from which on at most ``most`` pairs have it; counts are told by their two leading binary digits."""
    digit = F.floor(F.log2(F.col("n").cast("double")) * 2)
    by = sorted(((r.k, r.pairs, r.least) for r in counts.groupBy(digit.alias("k")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect()), reverse=True)  # a row a digit: some 130 at most
    total, least = 0, 2**62
    for _, pairs, n in by:
        total += pairs
        if total > most:
            break
        least = n
    return least


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", common: int = 1_000_000) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    rows = materialise(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = materialise(pair_counts(rows), "pairs")
    a_of = F.shiftright("pair", IDS.bit_length() - 1)
    highest = F.broadcast(counts.groupBy(a_of.alias("a")).agg(F.max("n").alias("highest")))  # a row an A id of the vocabulary
    told = counts.join(highest, a_of == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    least = _frequent(counts, common)
    top = told.where(F.col("n") >= least).toArrow()  # ``common`` rows at most
    order = np.argsort(top["pair"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))
    kind = rows.schema["id"].dataType.simpleString()

    def meet(own: Iterator[tuple]) -> Iterator[tuple]:
        pair, n, best = known.value
        for row, pairs, times in own:
            p, t = unpack(pairs, times)
            at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
            hit = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            yield row, int(t[hit][best[at[hit]]].sum()), int((t[hit] * n[at[hit]]).sum()), [{"pair": x, "times": y} for x, y in zip(p[~hit].tolist(), t[~hit].tolist(), strict=True)]

    met = materialise(by_rows(rows.select("row", "pairs", "times"), meet, "row long, n_best long, count_sum long, rare array<struct<pair:long,times:long>>", chunk=256, out=512), "met")
    rest = met.select("row", F.inline("rare")).join(told.where(F.col("n") < least), "pair")
    rare = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    out = rows.drop("pairs", "times").join(met.select("row", "n_best", "count_sum"), "row").join(rare, "row", "left")
    return out.select(
        F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
