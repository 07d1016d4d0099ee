"""Rank correlations of very many signed combinations of signals from one matrix of cross moments a date.

On a date, the names with every signal and an outcome are ranked per signal; ranks less their mean are the columns of Z, and the
outcome's are y.  A candidate, a signed sum of signals, then has covariance s'Z'y and variance s'Z'Zs, so all of its dates' rank correlations
come from the Gram matrices of [Z y].  Candidates are numbers: ``Grid`` turns a number into its signals and signs, so no table of them exists.
Dates lie in blocks; every block's matrices meet all candidates, chunk by chunk, and leave sums a block and candidate, from
which means over any set of blocks, replicas of the whole search and splits follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Combinations of 1 to ``depth`` of ``k`` signals with signs, the first positive; numbered by depth, then by signals in
    lexicographic order, then by signs (bit a set: the sign of part a + 2 is negative)."""

    k: int
    depth: int
    chunk: int = 16_384

    def count(self, d: int) -> int:
        return comb(self.k, d) << (d - 1)

    @property
    def total(self) -> int:
        return sum(self.count(d) for d in range(1, self.depth + 1))

    def chunks(self) -> list[tuple[int, int, int]]:
        """(first number, how many, depth) of chunks of one depth each."""
        out, base = [], 0
        for d in range(1, self.depth + 1):
            n = self.count(d)
            out += [(base + at, min(self.chunk, n - at), d) for at in range(0, n, self.chunk)]
            base += n
        return out

    def _before(self, d: int) -> np.ndarray:
        """How many combinations of d begin with a signal before each."""
        return np.concatenate([[0], np.cumsum([comb(self.k - 1 - a, d - 1) for a in range(self.k)])]).astype(np.int64)

    def unrank(self, numbers: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Signals and signs (a row a candidate) of numbers of one depth."""
        numbers = np.asarray(numbers, np.int64) - sum(self.count(x) for x in range(1, d))
        signs = np.ones((len(numbers), d), np.int64)
        for a in range(d - 1):
            signs[:, a + 1] -= 2 * ((numbers >> a) & 1)
        rest, out, least = numbers >> (d - 1), np.empty((len(numbers), d), np.int64), np.zeros(len(numbers), np.int64)
        for a in range(d):  # the rest is a rank among combinations of signals from ``least`` on
            before = self._before(d - a)
            rest = rest + before[least]
            out[:, a] = np.searchsorted(before, rest, side="right") - 1
            rest = rest - before[out[:, a]]
            least = out[:, a] + 1
        return out, signs

    def rank(self, signals: tuple[int, ...], signs: tuple[int, ...]) -> int:
        d, at, least = len(signals), 0, 0
        for a, s in enumerate(signals):
            before = self._before(d - a)
            at += int(before[s] - before[least])
            least = s + 1
        bits = sum(1 << a for a, s in enumerate(signs[1:]) if s < 0)
        return sum(self.count(x) for x in range(1, d)) + (at << (d - 1)) + bits


def centred_ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks of each column less their mean."""
    n = len(values)
    order = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, order, 0)
    new = np.concatenate([np.ones((1, values.shape[1]), bool), ordered[1:] != ordered[:-1]])
    at = np.arange(n)[:, None]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    last = np.minimum.accumulate(np.where(np.concatenate([new[1:], np.ones((1, values.shape[1]), bool)]), at, n)[::-1], axis=0)[::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last) / 2 - (n - 1) / 2, 0)
    return out


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of one key from batches in key order."""
    own, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            if held and keys[a] != own:
                yield own, pa.Table.from_batches(held)
                held = []
            own = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield own, pa.Table.from_batches(held)


def ranked(panel: DataFrame, signals: list[str], outcome: str, least: int, date: str = "d", name: str = "id") -> DataFrame:
    """date, names (array), z (a row a name, a column a signal, then the outcome): centred ranks on the date's common cross-section.

    A date's names are one group: the listed names of a market, not rows of a table.  Dates of fewer names than ``least`` are left out.
    """
    kind = panel.select(name).schema[0].dataType.simpleString()
    ordered = panel.dropna(subset=[*signals, outcome]).select(date, name, *(F.col(c).cast("double").alias(c) for c in (*signals, outcome))).repartition(date).sortWithinPartitions(date, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_key(batches, date):
            if own.num_rows >= least:
                z = centred_ranks(np.stack([own.column(c).to_numpy() for c in (*signals, outcome)], 1))
                yield pa.RecordBatch.from_pydict({date: own.column(date)[:1].combine_chunks(), "names": [own.column(name).to_pylist()], "z": [np.ascontiguousarray(z).tobytes()]})

    return ordered.mapInArrow(run, f"{date} date, names array<{kind}>, z binary")


def grams(ranks: DataFrame, date: str = "d") -> DataFrame:
    """date, n, gram: the cross moments of all signals and the outcome (last), as a matrix of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = len(batch.column("names")[i])
                z = np.frombuffer(batch.column("z")[i].as_buffer(), float).reshape(n, -1)
                yield pa.RecordBatch.from_pydict({date: batch.column(date).slice(i, 1), "n": [n], "gram": [(z.T @ z).tobytes()]})

    return ranks.mapInArrow(run, f"{date} date, n long, gram binary")


def correlations(gram: np.ndarray, signals: np.ndarray, signs: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Dates x candidates; NaN where the candidate or the outcome doesn't vary.  ``gram``: dates x (k + 1) x (k + 1).

    Moments of ranks are exact, so a variance of none is 0; where moments carry rounding errors, one up to the share ``least`` of its parts' is none."""
    d = signals.shape[1]
    covariance = sum(gram[:, signals[:, a], -1] * signs[:, a] for a in range(d))
    parts = sum(gram[:, signals[:, a], signals[:, a]] for a in range(d))
    variance = parts
    for a in range(d):
        for b in range(a):
            variance = variance + gram[:, signals[:, a], signals[:, b]] * (2 * signs[:, a] * signs[:, b])
    known = np.where(variance > least * parts, variance, 0.0) * gram[:, -1, -1][:, None]
    return np.divide(covariance, np.sqrt(np.maximum(known, 0)), out=np.full(known.shape, np.nan), where=known > 0)


def pseudo_inverse(m: np.ndarray, cut: float = 1e-10) -> np.ndarray:
    """Of symmetric matrices (dates x f x f): eigenvalues below ``cut`` of the greatest count as none."""
    values, vectors = np.linalg.eigh(m)
    keep = values > cut * np.maximum(values.max(axis=-1, keepdims=True), 1e-300)
    inverse = np.divide(1.0, values, out=np.zeros_like(values), where=keep)
    return np.einsum("tij,tj,tkj->tik", vectors, inverse, vectors)


def net_of(gram: np.ndarray, factors: list[int], cut: float = 1e-10) -> np.ndarray:
    """Gram matrices after every signal and the outcome lose their projection on the factors, which may repeat each other or not
    vary: what the factors don't span on a date stays, and no date is lost."""
    on = gram[:, :, factors]
    return gram - on @ pseudo_inverse(gram[:, factors][:, :, factors], cut) @ np.swapaxes(on, 1, 2)


def blocks_against_grid(matrices: DataFrame, grid: Grid, size: int, block: str, factors: list[int] | None = None, squares: bool = False, least: float = 0.0) -> DataFrame:
    """block, first (number of the chunk's first candidate), sums, squares, counts: per candidate, as arrays of doubles, over the block's dates.

    A block's matrices are held (dates of a block x signals squared), candidates stream past them.  ``least``: variances up to this share of their
    unprojected ones count as none (for projections, which leave rounding errors).
    """
    ordered = matrices.select(block, "d", "gram").repartition(block).sortWithinPartitions(block, "d")
    schema = pa.schema([(block, pa.int64()), ("first", pa.int64()), ("sums", pa.binary()), ("squares", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in _by_key(batches, block):
            gram = np.frombuffer(b"".join(own.column("gram").to_pylist()), float).reshape(own.num_rows, size, size)
            if factors:
                whole = np.einsum("tii->ti", gram)
                gram = net_of(gram, factors)
                none = np.einsum("tii->ti", gram) <= least * whole
                gram = np.where(none[:, :, None] | none[:, None, :], 0.0, gram)
            for first, n, d in grid.chunks():
                ic = correlations(gram, *grid.unrank(np.arange(first, first + n), d), least=least)
                known = ~np.isnan(ic)
                held = np.where(known, ic, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((int(key), first, held.sum(0).tobytes(), (held * held).sum(0).tobytes() if squares else None, known.sum(0).astype(float).tobytes()), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run, f"{block} long, first long, sums binary, squares binary, counts binary")


def per_chunk(sums: DataFrame, block: str, fn: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` of each chunk: first number, block numbers, sums and counts (blocks x candidates); it yields columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    ordered = sums.select("first", block, "sums", "counts").repartition("first").sortWithinPartitions("first", block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, own in _by_key(batches, "first"):
            s, n = (np.frombuffer(b"".join(own.column(c).to_pylist()), float).reshape(own.num_rows, -1) for c in ("sums", "counts"))
            for out in fn(int(first), own.column(block).to_numpy(), s, n):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return ordered.mapInArrow(run, schema)


def means(sums: np.ndarray, counts: np.ndarray, weights: np.ndarray, signs: np.ndarray | None = None) -> np.ndarray:
    """Mean of each candidate (columns) over sets of blocks (rows of ``weights``, 0 or 1); ``signs`` turn blocks, for each set."""
    total, n = (weights if signs is None else weights * signs) @ sums, weights @ counts
    return np.divide(total, n, out=np.full(total.shape, np.nan), where=n > 0)


def first_of(values: np.ndarray, n: int, digits: int = 9) -> np.ndarray:
    """Places of the n greatest in size, of equal ones (rounded) the first."""
    size = np.round(np.abs(values), digits)
    if n < len(size):
        edge = np.partition(size, len(size) - n)[len(size) - n]
        rest = np.flatnonzero(size >= edge)
    else:
        rest = np.arange(len(size))
    return rest[np.argsort(-size[rest], kind="stable")][:n]
