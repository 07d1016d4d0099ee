"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k+1 pieces.  If a text holds the item with at most k edits, at least
one piece stands in it unchanged, so an Aho-Corasick scan for all pieces finds every candidate place; each place is
verified with Myers' bit-parallel distance (approximate search of the whole item in the window around the hit).

Both sides are compared lower-cased with runs of white space as one space.  The budget is ``rate`` of an item's length, but
never so large that pieces get shorter than ``min_piece``.  An item too short for any edit is found where it stands exactly
and between word borders; one of fewer than ``min_words`` words says nothing inside a text and is found only where it is the
whole text.  Items are found as wholes, within their budget; a text that holds a part of an item isn't one of its hits.  The
scan is over whole texts.  The benchmark is broadcast in blocks of at most ``block_chars`` characters each (or one item, if it
is longer), however large it is; the documents are scanned once per block.

Defined results: null or empty texts have no hits, nor have items that are null or blank; an empty table of either gives no
rows; very long texts and items are compared whole; repeated rows repeat their hits; items with equal texts are all found; an
item that occurs several times in a text gives one row with its best distance, at the first end of that distance; extra columns
are ignored, whatever their names; item ids may be of any type, and an item with a null id is left out by ``find`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.words import beside, by_rows


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float, min_piece: int) -> int:
    return max(0, min(int(length * rate), length // min_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces that cover the item, with their offsets."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any substring of the text and the first end of such a place, if <= limit.

    One column of the edit matrix is two bit vectors of the pattern's length, held in one integer each.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for at, ch in enumerate(text, 1):
        eq = masks.get(ch, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diag | up)), up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (full & ~(diag | right)), right & diag
        if score < best[0]:
            best = (score, at)
    return best if best[0] <= limit else None


class Matcher:
    """Pieces of one block of items and their verification."""

    def __init__(self, items: list[tuple], rate: float, min_piece: int, min_words: int):
        import ahocorasick

        self.whole: dict[str, list] = {}
        self.items: list[tuple] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            if text.count(" ") + 1 < min_words:
                self.whole.setdefault(text, []).append(key)
                continue
            k = budget(len(text), rate, min_piece)
            for offset, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((key, text, k))
        self.scan = ahocorasick.Automaton()
        for piece, places in found.items():
            self.scan.add_word(piece, (len(piece), places))
        if found:
            self.scan.make_automaton()

    def hits(self, text: str) -> list[tuple]:
        """(item key, distance, end of the place) for each item in the normalised text."""
        if not text:
            return []
        out = [(key, 0, len(text)) for key in self.whole.get(text, ())]
        if not self.items:
            return out
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for end, (size, places) in self.scan.iter(text):
            for i, offset in places:
                _, item, k = self.items[i]
                start = end + 1 - size - offset
                if not k:
                    if i not in exact and not text[max(0, start - 1) : start].isalnum() and not text[end + 1 : end + 2].isalnum():
                        exact[i] = end + 1
                    continue
                lo, hi = max(0, start - k), min(len(text), start + len(item) + k)
                own = windows.setdefault(i, [])
                if own and lo <= own[-1][1] and hi - own[-1][0] <= 8 * len(item):
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        out += [(self.items[i][0], 0, end) for i, end in exact.items()]
        for i, spans in windows.items():
            key, item, k = self.items[i]
            best = None
            for lo, hi in spans:
                if hi - lo >= len(item) - k and (got := myers(item, text[lo:hi], k)) and (best is None or (got[0], lo + got[1]) < best):
                    best = (got[0], lo + got[1])
            if best:
                out.append((key, *best))
        return out


def blocks(benchmark: DataFrame, block_chars: int, id_col: str | None = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The benchmark's normalised items in blocks of bounded size, streamed one partition at a time."""
    held, size = [], 0
    named = benchmark.select((F.lit(0) if id_col is None else F.col(id_col)).alias("k"), F.col(text_col).alias("t"))
    for row in named.where("k IS NOT NULL AND t IS NOT NULL").orderBy("k", "t").toLocalIterator():
        text = normal(row.t)
        if not text:
            continue
        if held and size + len(text) > block_chars:
            yield held
            held, size = [], 0
        held.append((row.k, text))
        size += len(text)
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, min_piece: int = 12, min_words: int = 3, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and item it holds: id, item_id, distance, end (in the normalised text)."""
    kind, item = docs.select(id_col).schema[0].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item}, distance int, end_at long"
    out = None
    for block in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(rows: Iterator[tuple], shared=shared) -> Iterator[tuple]:
            matcher = Matcher(shared.value, rate, min_piece, min_words)
            for key, text in rows:
                for item, distance, end in matcher.hits(normal(text)):
                    yield key, item, distance, end

        part = by_rows(docs.select(id_col, text_col), run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = 0.1, min_piece: int = 12, min_words: int = 3, block_chars: int = 4_000_000) -> DataFrame:
    """The rows that hold no item, all columns; each block of items is one pass over what the last one left, and ids
    play no part."""
    for block in blocks(benchmark, block_chars, None):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def held(texts: list[str | None], shared=shared, made: list[Matcher] = []) -> list[tuple]:  # noqa: B006
            if not made:  # once a task: building it costs more than a slice of texts
                made.append(Matcher(shared.value, rate, min_piece, min_words))
            return [(bool(made[0].hits(normal(t))),) for t in texts]

        docs = beside(docs, text_col, held, "held boolean").where("NOT held").select("_row.*")
    return docs
