"""N-gram Jaccard self-join by chosen paths.

Texts become sets of hashed word 5-grams (a shorter text is one n-gram of all its words).  Texts with equal sets fold
into one representative with a count of copies.  Each run splits the representatives on a sampled token: the least of
the set's tokens under the run's hash, which two sets share with a probability equal to their similarity.  A bucket
over the limit splits again, up to DEPTH times, on further sampled tokens (one byte of the sketch for each run and depth,
used by no other), so unrelated texts that share a passage part quickly.  Small buckets are compared by brute force on
the sketches.  Runs repeat until a pair at the threshold that has to pass every split is missed by all of them with a
probability below 1 - recall.  At the last depth buckets up to LAST are still compared by brute force; what stays larger
are mostly near copies of each other, and every member becomes a candidate of the bucket's least set, so no bucket is cut,
no pair in it is lost and none is expanded into its pairs.

Sketch links are only candidates, so that chains of them give candidate classes.  Inside each candidate class all pairs
are compared exactly on whole sets, in block pairs of bounded size, which yields every link's end points' counts and a
spanning forest of the true links; the classes of the result are the components of these exact links.

Defined results: null and empty texts have no n-gram, no links and a class of their own; equal sets are links even if
the texts differ in case or white space; repeated rows are copies; a null id takes part, and ids need not be unique
(texts are fetched by id and digest of the text, ``at``);
``class_id`` is the least id of the class; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.llm.graph import components
from sextant.llm.words import by_rows

SKETCH = 64
DEPTH = 4
LAST = 1024


class _Hashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams of lower-case words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(width, n)
    out = np.full(n - k + 1, n if n < width else width, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def multipliers(n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def least_tokens(tokens: np.ndarray, by: np.ndarray, columns: int = 512) -> np.ndarray:
    """Per multiplier the least of the tokens' products: the sampled token under that hash."""
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), columns):
        p = by[:, None] * tokens[None, at : at + columns]
        p ^= p >> np.uint64(32)
        p *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(out, p.min(1), out=out)
    return out


def runs_for(threshold: float, recall: float, depth: int = DEPTH + 1) -> int:
    """Runs after which a pair at the threshold has met with the wanted probability, if it has to pass ``depth`` splits."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def signatures(docs: DataFrame, runs: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, key (hash of the text), set (128-bit digest of the shingle set, null when empty), tokens (one a run), sketch (a byte for each split of
    each run, SKETCH bytes at least; its hashes are not the tokens')."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import xxhash

        hashes, by = _Hashes(), multipliers(runs + max(SKETCH, runs * DEPTH))
        for own, key, text in rows:
            tokens = shingles(text, width, hashes)
            if not len(tokens):
                yield own, key, None, None, None
                continue
            least = least_tokens(tokens, by)
            sketch = (least[runs:] >> np.uint64(40)).astype(np.uint8).tobytes()
            yield own, key, xxhash.xxh3_128_digest(tokens.tobytes()), least[:runs].view(np.int64).tolist(), sketch

    keyed = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(text_col))
    return by_rows(keyed, run, f"id {kind}, key long, set binary, tokens array<long>, sketch binary")


def _agreement(chance: float, threshold: float) -> int:
    """Least number of equal sketch bytes that a pair at the threshold has, but for ``chance`` in a normal tail."""
    same = threshold + (1 - threshold) / 256
    return int(SKETCH * same - chance * math.sqrt(SKETCH * same * (1 - same)))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def split_buckets(rows: DataFrame, limit: int, least: int) -> DataFrame:
    """One pass over (run, key) buckets in key order: a, b are candidate links inside small buckets, as stars; rows of
    buckets over the limit come back with run, key, set, sketch, as they stream by."""
    ordered = rows.select("run", "key", "set", "sketch").repartition("run", "key").sortWithinPartitions("run", "key", "set")

    def links(sets: list, sketches: list) -> Iterator[tuple]:
        m = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sets), -1)
        same = np.zeros((len(sets), len(sets)), np.uint8)
        for i in range(SKETCH):
            same += m[:, i, None] == m[None, :, i]
        a, b = np.nonzero(np.triu(same >= least, 1))
        if len(a):
            for i, r in enumerate(_local_roots(len(sets), a, b)):
                if i != r:
                    yield sets[i], sets[r]

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("run", pa.int32()), ("key", pa.int64()), ("set", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, sets, sketches = None, [], []
        over = False  # the open bucket has passed the limit
        out: list[tuple] = []

        def close() -> None:
            if over:
                out.extend((None, None, *open_key, s, k) for s, k in zip(sets, sketches, strict=True))
            elif len(sets) > 1:
                out.extend((a, b, None, None, None, None) for a, b in links(sets, sketches))

        for batch in batches:
            run_of, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            if not n:
                continue
            starts = np.flatnonzero(np.concatenate([[True], (run_of[1:] != run_of[:-1]) | (key[1:] != key[:-1])]))
            ends = np.concatenate([starts[1:], [n]])
            set_col, sketch_col = batch.column(2), batch.column(3)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                own = (int(run_of[s]), int(key[s]))
                if own != open_key:
                    close()
                    open_key, sets, sketches, over = own, [], [], False
                    if e - s == 1 and e != n:
                        continue
                sets.extend(set_col.slice(s, e - s).to_pylist())
                sketches.extend(sketch_col.slice(s, e - s).to_pylist())
                if len(sets) > limit:
                    over = True
                    close()
                    sets, sketches = [], []
            if len(out) > 2000:
                yield _columns(out, schema)
                out.clear()
        close()
        if out:
            yield _columns(out, schema)

    return ordered.mapInArrow(run, "a binary, b binary, run int, key long, set binary, sketch binary")


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def candidate_links(sets: DataFrame, threshold: float, limit: int, hot: int = 5_000) -> DataFrame:
    """Candidate links between representatives (set, tokens, sketch) from all runs.

    Buckets of more than ``hot`` rows are found by counting and never dealt by their key: they split (or meet their
    least set) where their rows lie.  Other buckets over ``limit`` come out of the pass over the buckets.
    """
    pending = sets.select(F.posexplode("tokens").alias("run", "key"), "set", "sketch")
    least = _agreement(4.5, threshold)
    out: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        most = limit if depth < DEPTH else max(limit, LAST)
        hottest = materialise(pending.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(hot, most)), "hot")
        if hottest.isEmpty():
            passed = materialise(split_buckets(pending, most, least), "split")
            big = passed.where("run IS NOT NULL").select("run", "key", "set", "sketch")
        else:
            passed = materialise(split_buckets(pending.join(hottest, ["run", "key"], "left_anti"), most, least), "split")
            big = passed.where("run IS NOT NULL").select("run", "key", "set", "sketch").unionByName(pending.join(hottest, ["run", "key"], "left_semi"))
        out.append(passed.where("a IS NOT NULL").select("a", "b"))
        if big.isEmpty():
            break
        if depth < DEPTH:
            pending = big.withColumn("key", F.xxhash64("key", F.expr(f"substring(sketch, run * {DEPTH} + {depth} + 1, 1)")))
        else:
            first = big.groupBy("run", "key").agg(F.min("set").alias("b"))
            out.append(materialise(big.join(first, ["run", "key"]).where(F.col("set") != F.col("b")).select(F.col("set").alias("a"), "b"), "largest"))
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


def exact_links(docs: DataFrame, members: DataFrame, threshold: float, block: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per block pair of each candidate class: a, b (forest links, null in count rows) and a's weight of links.

    ``members``: at (id and key of one row with the set), set, copies, root.  A class of m sets is dealt to ceil(m / block) chunks by hash; each pair of
    chunks is one group.
    """
    chunks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    placed = members.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int"))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = keyed.join(placed.hint("merge"), (F.col("key") == F.col("at.key")) & F.col("id").eqNullSafe(F.col("at.id")))

    def tokens_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        import xxhash

        hashes, last = _Hashes(), None
        for text, own, copies, root, n, chunk in rows:
            if own == last:  # repeated rows follow each other
                continue
            tokens = shingles(text, width, hashes).tobytes()
            if xxhash.xxh3_128_digest(tokens) == own:
                last = own
                yield own, copies, root, n, chunk, tokens

    whole = by_rows(texts.select("text", "set", "copies", "root", "chunks", "chunk"), tokens_of, "set binary, copies long, root binary, chunks int, chunk int, tokens binary", chunk=64)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    paired = whole.select("*", other).withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    ordered = paired.select("root", "lo", "hi", "chunk", "set", "copies", "tokens").repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "set")

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, held = None, []
        for root, lo, hi, chunk, own, copies, tokens in rows:
            if (root, lo, hi) != key:
                yield from links_of(key, held, threshold)
                key, held = (root, lo, hi), []
            if not held or held[-1][1] != own:
                held.append((chunk, own, copies, np.frombuffer(tokens, np.uint64)))
        yield from links_of(key, held, threshold)

    return by_rows(ordered, compare, "a binary, b binary, weight long", chunk=64)


def links_of(key: tuple | None, held: list[tuple], threshold: float, columns: int = 16384) -> Iterator[tuple]:
    """Exact similarities of one block pair; only tokens that two sets share become matrix columns."""
    n = len(held)
    if n < 2:
        return
    sizes = np.array([len(h[3]) for h in held])
    row = np.repeat(np.arange(n), sizes)
    every = np.concatenate([h[3] for h in held])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    first = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(first) - 1
    keep = np.bincount(column)[column] > 1
    row, column = row[keep], column[keep]
    shared = np.zeros((n, n), np.float32)
    if len(row):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for at in range(0, int(column[-1]) + 1, columns):
            lo, hi = np.searchsorted(column, [at, at + columns])
            m = np.zeros((n, min(columns, int(column[-1]) + 1 - at)), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            shared += m @ m.T
    together = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= threshold * together - 1e-6 * together
    np.fill_diagonal(linked, False)
    if key[1] != key[2]:
        side = np.array([h[0] for h in held])
        linked &= side[:, None] != side[None, :]
    copies = np.array([h[2] for h in held])
    for i, w in enumerate((linked @ copies).tolist()):
        if w:
            yield held[i][1], None, w
    a, b = np.nonzero(np.triu(linked, 1))
    for i, r in enumerate(_local_roots(n, a, b)):
        if i != r:
            yield held[i][1], held[r][1], 0


def classified(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, limit: int = 128, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, set) and sets (set, root, class_id, at, copies, weight)."""
    runs = runs_for(threshold, recall)
    rows = materialise(signatures(docs, runs, id_col, text_col, width), "signatures")
    at = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("at")
    sets = materialise(rows.where("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("id"), at, F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "sets")
    maybe = components(candidate_links(sets, threshold, limit))
    members = sets.select("set", "at", "copies").join(maybe.select(F.col("node").alias("set"), "root"), "set")
    links = materialise(exact_links(docs, materialise(members, "members"), threshold, block, id_col, text_col, width), "links")
    classes = components(links.where("b IS NOT NULL").select("a", "b"))
    weights = links.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("weight").alias("weight"))
    known = sets.select("set", "id", "at", "copies").join(classes.select(F.col("node").alias("set"), "root"), "set", "left").join(weights, "set", "left")
    least = known.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    return rows.select("id", "key", "set"), known.join(least, "root", "left").select("set", F.coalesce("root", "set").alias("root"), F.coalesce("least", "id").alias("class_id"), "at", "copies", F.coalesce("weight", F.lit(0)).alias("weight"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """id, class_id (least id of the class), n_links (other rows at the threshold, copies included), n_copies."""
    rows, final = classified(docs, id_col, text_col, **limits)
    one = rows.join(final, "set", "left")
    return one.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce("weight", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row of each class, all columns: one with the least id, null ids last.  Rows without an n-gram all stay.

    Rows are found by id and hash of the text; only those that repeat both are grouped, to keep one."""
    rows, final = classified(docs, id_col, text_col, **limits)
    first = final.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.id").alias("_id"), F.col("at.key").alias("_key"))
    equal = rows.where("set IS NOT NULL").groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = first.join(equal, (F.col("_key") == F.col("k")) & F.col("_id").eqNullSafe(F.col("i")), "left").select("_id", "_key", F.col("n").isNotNull().alias("_repeats"))
    bare = rows.where("set IS NULL").select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.lit(False).alias("_repeats")).distinct()
    wanted = materialise(repeats.unionByName(bare), "kept")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.col(text_col)).alias("_hash"))
    same = (F.col("_hash") == F.col("_key")) & F.col(f"_row.{id_col}").eqNullSafe(F.col("_id"))
    once = keyed.join(wanted.where("NOT _repeats"), same, "left_semi").select("_row")
    again = keyed.join(wanted.where("_repeats"), same).groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")
