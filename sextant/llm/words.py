"""ASCII word and row helpers shared by the text operators."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes.split() cuts at exactly these bytes, so words are ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"


def crc_of_id(column: Column | str) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary"))


def by_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, chunk: int = 512, out: int = 4096) -> DataFrame:
    """Run ``fn`` over the tuples of each partition; rows reach it in Arrow slices of ``chunk``, and leave it in batches of ``out``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, chunk).columns), strict=True)

        held: list[tuple] = []
        size = 0
        for row in fn(rows()):
            held.append(row)
            size += 1
            if size >= out:
                yield _batch(held, target)
                held, size = [], 0
        if held:
            yield _batch(held, target)

    return df.mapInArrow(run, schema)


def beside(df: DataFrame, text_col: str, fn: Callable[[list[str | None]], list[tuple]], schema: str, chunk: int = 512) -> DataFrame:
    """``_row``, the whole input row, with the columns that ``fn`` derives from the texts of a slice of rows.

    Filtering on them and selecting ``_row.*`` keeps or drops rows where they are: nothing is shuffled, ids may be null
    or repeat, and no input column can clash with a derived one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    rows = df.select(F.struct(*df.columns).alias("_row"))
    derived = _parse_datatype_string(schema)
    target, at = to_arrow_schema(derived), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                held = batch.column(0).slice(start, chunk)
                got = fn(held.field(at).to_pylist())
                yield pa.RecordBatch.from_arrays([held, *_batch(got, target).columns], names=["_row", *target.names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *derived.fields]))


def least_hashed(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """A bounded sample: at most ``n`` rows, those of least hash of ``by``, one for each hash.  Only hashes are ordered; other
    columns are read of the chosen rows alone."""
    h = F.xxhash64(*by)
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if last is None:
        return df.limit(0)
    chosen = df.where(h <= last).groupBy(h.alias("_h")).agg(F.first(F.struct(*df.columns)).alias("_row"))
    return chosen.orderBy("_h").limit(n).select("_row.*")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What single spaces separate in the texts: the different parts, the number of each in order, and how many a text has."""
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), pc.list_value_length(cut).to_numpy().astype(np.int64)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches that begin there and are so long, one stretch after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Memory:
    """The ids of words, in flat arrays.  When more than ``most`` words are known, the half that was met most often stays."""

    def __init__(self, most: int):
        self.most = most
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, "<u4")
        self.begin, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words, their ids one after another, and how many each has."""
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, ids.astype("<u4")])
        self.size = np.concatenate([self.size, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def forget(self) -> None:
        stay = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        words = list(self.place)
        self.place = {words[i]: at for at, i in enumerate(stay.tolist())}
        self.flat = self.flat[spread(self.begin[stay], self.size[stay])]
        self.size, self.met = self.size[stay], self.met[stay] >> 1
        self.begin = np.cumsum(self.size) - self.size

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))

    def meet(self, words: list[str], times: np.ndarray, learn: Callable[[list[str]], None]) -> np.ndarray:
        """The places of different words that were met so often (not at all: -1 if unknown); ``learn`` adds those not known."""
        at = self.places(words)
        fresh = np.flatnonzero((at < 0) & (times > 0))
        if len(self.place) + len(fresh) > self.most < self.most // 2 + len(self.place):
            self.forget()
            at = self.places(words)
            fresh = np.flatnonzero((at < 0) & (times > 0))
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            learn(new)
            at[fresh] = self.places(new)
        self.met[at[times > 0]] += times[times > 0]  # words differ, and so do their places
        return at

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.begin[at], self.size[at])]
