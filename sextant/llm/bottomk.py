"""Near-duplicate groups by bottom-k sketches of one hash function.

A text's set are its distinct word pairs, hashed once; a text with fewer words is one shingle of them all.  Equal sets fold into one
representative.  A sketch holds the K least hashes of a set (their upper 32 bits), rarest first: values are ordered by the
number of sketches that hold them, counted over all.  Every representative is entered in the inverted lists of its LISTED
rarest values that another sketch holds too.  Of the sketch of a set in a pair at the threshold some K / 9 values are not the
other's, so one of them would have to hold LISTED such values, all rarer than every shared one, for the pair to meet in no list (a
chance of 1e-4 if all that differs were rare and known elsewhere; what differs is mostly rare and known nowhere).  Lists of at most ``limit`` sets generate all overlaps in numpy, and a pair becomes a candidate if the estimate from the
union of the two sketches could be that of a pair at the threshold.

A longer list is walked once beside at most LEADERS of its sets, each the first that was near none before: sets about as similar to
a leader as near copies leave the list as its candidates, sets that could be linked to such a set become its candidates too, and
what is near no leader stays, as leaders do.  What stays of a list of at most ``hot`` rows is compared in the task like a short list, so
it makes no rows of its own.  Lists of over ``hot`` rows are dealt in chunks, each with leaders of its own; what stays of a chunk is split
by its NEXT retained values, at most DEPTH times (a pair shares most of its lists, so it has many ways to meet).  What is still in chunks
at the last depth becomes a candidate of the list's least set.  So no list is cut, no pair of a long list is emitted, and a common word
pair is the last by which a set is listed.

Candidates form classes, and inside a class links are confirmed on whole sets, recomputed from the texts.  Classes of at most
``block`` sets are compared pair by pair.  A larger class is compared with its first set, then what is not linked with more and more sets that are (pivots); sets
that no pivot links are then compared, in blocks, with every set of the class that the triangle inequality of the Jaccard distance
leaves open.  Components of the confirmed links are the result.

Defined results: null and empty texts have an empty set, no links and their own id; a null id takes part but never names a
component that has another id; repeated rows and ids are copies and all of one id are kept or dropped alike; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.llm.graph import components
from sextant.llm.jaccard import _columns, _Hashes, _local_roots, links_of, shingles
from sextant.llm.words import by_rows

K, LISTED, NEXT, DEPTH = 32, 12, 2, 3
#: Estimates: a set of NEAR leaves a long list with a leader, one of OPEN becomes a candidate of it.
NEAR, OPEN, LEADERS = 0.7, 0.25, 16
#: Values and rows that are compared at once.
COLUMNS, TILE = 4096, 256


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, key (hash of the text), n (size of the set), set (128-bit digest, null when empty), sketch."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import xxhash

        hashes = _Hashes()
        for own, key, text in rows:
            tokens = shingles(text, width, hashes)
            if not len(tokens):
                yield own, key, 0, None, None
                continue
            sketch = (tokens[:K] >> np.uint64(32)).astype("<u4").tobytes()
            yield own, key, len(tokens), xxhash.xxh3_128_digest(tokens.tobytes()), sketch

    return by_rows(docs.select(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(text_col)), run, f"id {kind}, key long, n long, set binary, sketch binary")


def _sketch(raw: bytes) -> np.ndarray:
    """The values in their own order; ``raw`` has them rarest first."""
    return np.sort(np.frombuffer(raw, "<u4"))


def rarest_first(sets: DataFrame) -> DataFrame:
    """set, n, sketch (rarest values first), known (how many of them another sketch holds too), held (by how many, each of the LISTED first)."""

    def values(rows: Iterator[tuple]) -> Iterator[tuple]:
        for own, raw in rows:
            yield from ((v, own) for v in np.frombuffer(raw, "<u4").tolist())

    entries = by_rows(sets.select("set", "sketch"), values, "value long, set binary", out=20_000)
    held = entries.groupBy("value").agg(F.count(F.lit(1)).alias("held"))
    counted = entries.join(held, "value").groupBy("set").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("held") == 1, 2**62).otherwise(F.col("held")).alias("held"), "value"))).alias("v"))  # K values a set

    def order(rows: Iterator[tuple]) -> Iterator[tuple]:
        for own, v in rows:
            known = sum(x["held"] < 2**62 for x in v)
            yield own, np.array([x["value"] for x in v], "<u4").tobytes(), known, [x["held"] for x in v[: min(known, LISTED)]]

    ordered = by_rows(counted, order, "set binary, sketch binary, known int, held array<long>")
    return sets.select("set", "n").join(ordered, "set")


def estimates(sketches: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared values and sample size of the union for each pair: all values up to the lesser of the two sketches' ends are known."""
    m = len(sketches)
    lengths = np.array([len(s) for s in sketches])
    row, every = np.repeat(np.arange(m), lengths), np.concatenate(sketches)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    held, column = np.unique(column[keep], return_inverse=True)
    row, shared = row[keep], np.zeros((m, m), np.float32)
    for lo in range(0, len(held), COLUMNS):
        part = (column >= lo) & (column < lo + COLUMNS)
        one = np.zeros((m, min(COLUMNS, len(held) - lo)), np.float32)
        one[row[part], column[part] - lo] = 1
        shared += one @ one.T
    ends = np.where(sizes > lengths, np.array([s[-1] for s in sketches], np.int64), np.int64(2) ** 32)
    upto = np.stack([np.searchsorted(s, np.minimum(e, ends), side="right").astype(np.int32) for s, e in zip(sketches, ends, strict=True)])
    return shared, upto + upto.T - shared


def pair_estimate(a: bytes, n: int, b: bytes, m: int) -> tuple[int, int]:
    """``estimates`` of two sketches, for short lists."""
    x, y = set(np.frombuffer(a, "<u4").tolist()), set(np.frombuffer(b, "<u4").tolist())
    end = min(max(x) if n > len(x) else 2**32, max(y) if m > len(y) else 2**32)
    shared = len(x & y)
    return shared, sum(v <= end for v in x) + sum(v <= end for v in y) - shared


def beside_first(first: tuple[bytes, int], raws: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Estimated similarity of each sketch with the first one."""
    own = _sketch(first[0])
    lengths = np.array([len(r) // 4 for r in raws])
    row, values = np.repeat(np.arange(len(raws)), lengths), np.frombuffer(b"".join(raws), "<u4")
    ends = np.maximum.reduceat(values, np.cumsum(lengths) - lengths).astype(np.int64)
    end = np.minimum(np.where(sizes > lengths, ends, np.int64(2) ** 32), int(own[-1]) if first[1] > len(own) else 2**32)
    shared = np.bincount(row[own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values], minlength=len(raws))
    union = np.bincount(row[values <= end[row]], minlength=len(raws)) + np.searchsorted(own, end, side="right") - shared
    return shared / np.maximum(union, 1)


def could_be(shared: np.ndarray, union: np.ndarray, similarity: float, deviations: float = 4.5) -> np.ndarray:
    """Whether the sample allows the similarity, but for a chance in the tail of ``deviations``."""
    return shared >= similarity * union - deviations * np.sqrt(similarity * (1 - similarity) * union)


def walk_lists(lists: DataFrame, limit: int, threshold: float) -> DataFrame:
    """One pass over lists in key order: a, b are candidates; rows that go on come back with their columns and ``next`` (key, at)."""
    ordered = lists.select("key", "chunk", "set", "n", "sketch", "known", "at").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "set")
    onward = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("set", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("known", pa.int32()), ("next", onward)])

    def short(rows: list[tuple]) -> Iterator[tuple]:
        sizes = np.array([r[3] for r in rows])
        shared, union = estimates([_sketch(r[4]) for r in rows], sizes)
        found = []
        for lo in range(0, len(rows), TILE):
            own = sizes[lo : lo + TILE, None]
            fits = np.minimum(own, sizes) >= threshold * np.maximum(own, sizes) - 1e-6
            a, b = np.nonzero(np.triu(fits & could_be(shared[lo : lo + TILE], union[lo : lo + TILE], threshold), lo + 1))
            found.append((a + lo, b))
        a, b = map(np.concatenate, zip(*found, strict=True))
        for i, r in enumerate(_local_roots(len(rows), a, b) if len(a) else ()):
            if i != r:
                yield rows[i][2], rows[r][2], *[None] * 6

    def stays(row: tuple) -> tuple:
        key, _, own, n, raw, known, at = row
        after = np.frombuffer(raw, "<u4")[at + 1 : min(known, at + 1 + NEXT)].tolist()
        return None, None, key, own, n, raw, known, [{"key": hash((key, v)), "at": at + 1 + i} for i, v in enumerate(after)]

    def two(a: tuple, b: tuple) -> Iterator[tuple]:
        if min(a[3], b[3]) >= threshold * max(a[3], b[3]) - 1e-6:
            shared, union = pair_estimate(a[4], a[3], b[4], b[3])
            if shared >= threshold * union - 4.5 * (threshold * (1 - threshold) * union) ** 0.5:
                yield b[2], a[2], *[None] * 6

    def long(leaders: list[tuple], rows: list[tuple], rest: list[tuple]) -> Iterator[tuple]:
        raws, sizes, near = [r[4] for r in rows], np.array([r[3] for r in rows]), np.zeros(len(rows), bool)
        at, leads = 0, np.zeros(len(rows), bool)
        first, met = np.full(len(rows), -1), []  # a row's first leader; leaders that a row joins
        while True:
            if at == len(leaders):
                free = np.flatnonzero(~near & ~leads)
                if at == LEADERS or not len(free):
                    break
                leads[free[0]] = True
                leaders.append(rows[free[0]])
            leader = leaders[at]
            similar = beside_first((leader[4], leader[3]), raws, sizes)
            open_to = np.flatnonzero(similar >= OPEN)
            met.extend((int(k), at) for k in np.unique(first[open_to]) if k >= 0)
            first[open_to[first[open_to] < 0]] = at
            near |= similar >= NEAR
            at += 1
        for i in np.flatnonzero(first >= 0).tolist():  # one link a row, and the links among leaders that rows make
            if rows[i][2] != leaders[first[i]][2]:
                yield rows[i][2], leaders[first[i]][2], *[None] * 6
        if met:
            for i, r in enumerate(_local_roots(len(leaders), *np.array(met).T)):
                if i != r:
                    yield leaders[i][2], leaders[r][2], *[None] * 6
        left = [rows[i] for i in np.flatnonzero(~near | leads).tolist()]
        if rows[0][1] is None:
            rest.extend(left)
        else:
            yield from map(stays, left)

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        own, held, over, leaders, rest = None, [], False, [], []

        def close() -> Iterator[tuple]:
            if over:
                if held:
                    yield from long(leaders, held, rest)
                if len(rest) > 1:  # of a whole list of at most ``hot`` rows
                    yield from short(rest)
            elif len(held) == 2:
                yield from two(*held)
            elif len(held) > 2:
                yield from short(held)

        for row in rows:
            if row[:2] != own:
                yield from close()
                own, held, over, leaders, rest = row[:2], [], row[1] is not None, [], []
            held.append(row)
            if len(held) > (1024 if over else limit):
                over = True
                yield from long(leaders, held, rest)
                held = []
        yield from close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in walk(r for batch in batches for at in range(0, batch.num_rows, 512) for r in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)):
            out.append(row)
            if len(out) == 4096:
                yield _columns(out, schema)
                out.clear()
        if out:
            yield _columns(out, schema)

    return ordered.mapInArrow(run, "a binary, b binary, key long, set binary, n long, sketch binary, known int, next array<struct<key:long,at:int>>")


def candidates(sets: DataFrame, threshold: float, limit: int, hot: int) -> DataFrame:
    """a, b: candidate links between representatives (set, n, sketch)."""

    def entries(rows: Iterator[tuple]) -> Iterator[tuple]:
        for own, n, raw, known, held in rows:
            for at, (v, rows_of) in enumerate(zip(np.frombuffer(raw[: 4 * len(held)], "<u4").tolist(), held, strict=True)):
                yield v, at, own, n, raw, known, rows_of

    pending = by_rows(rarest_first(sets), entries, "key long, at int, set binary, n long, sketch binary, known int, rows long")
    out: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        chunk = F.when(F.col("rows") > hot, F.pmod(F.xxhash64("set"), F.ceil(F.col("rows") * 2 / hot)))
        passed = materialise(walk_lists(pending.withColumn("chunk", chunk), limit, threshold), "walked")
        out.append(passed.where("a IS NOT NULL").select("a", "b"))
        more = passed.where("a IS NULL").drop("a", "b")
        if more.isEmpty():
            break
        if depth < DEPTH:
            pending = materialise(more.select("set", "n", "sketch", "known", F.inline("next")), "lists")
            pending = pending.join(pending.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot), "key", "left")
        else:
            least = more.groupBy("key").agg(F.min("set").alias("b"))
            out.append(more.join(least, "key").where(F.col("set") != F.col("b")).select(F.col("set").alias("a"), "b"))
    links = out[0]
    for one in out[1:]:
        links = links.unionByName(one)
    return links.select(short_name("a").alias("a"), short_name("b").alias("b"))


def short_name(column: str):
    """8 bytes of a set's digest; two sets of one short name share a candidate class, which is then compared exactly."""
    return F.xxhash64(column)


def whole_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """set, root, n, size (of the class), tokens of the class members, from their texts."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = keyed.join(members.hint("merge"), (F.col("key") == F.col("at.key")) & F.col("id").eqNullSafe(F.col("at.id")))

    def tokens_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        import xxhash

        hashes, last = _Hashes(), None
        for text, own, root, size in rows:
            if own == last:  # repeated rows follow each other
                continue
            tokens = shingles(text, width, hashes)
            if xxhash.xxh3_128_digest(tokens.tobytes()) == own:
                last = own
                yield own, root, len(tokens), size, tokens.tobytes()

    return by_rows(texts.select("text", "set", "root", "size"), tokens_of, "set binary, root binary, n long, size long, tokens binary", chunk=64, out=256)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared tokens of two ordered sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def small_classes(whole: DataFrame, threshold: float) -> DataFrame:
    """a, b: a forest of the confirmed links of each class, all pairs compared."""
    ordered = whole.select("root", "set", "tokens").repartition("root").sortWithinPartitions("root", "set")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        root, held = None, []
        for own_root, own, tokens in rows:
            if own_root != root:
                yield from ((a, b) for a, b, _ in links_of((root, 0, 0), held, threshold) if b is not None)
                root, held = own_root, []
            if not held or held[-1][1] != own:
                held.append((0, own, 1, np.frombuffer(tokens, np.uint64)))
        yield from ((a, b) for a, b, _ in links_of((root, 0, 0), held, threshold) if b is not None)

    return by_rows(ordered, run, "a binary, b binary", chunk=64)


def beside_pivots(asked: DataFrame, pivots: DataFrame, threshold: float, chunk: int = 512) -> DataFrame:
    """set, root, pivot, shared, together: every asked set (with size) beside the first pivot (root, set, tokens) of its class that links it,
    else beside the last.  A class is dealt in chunks that each get a copy of its pivots."""
    chunks = F.ceil(F.col("size") / chunk)
    rows = asked.select("root", F.pmod(F.xxhash64("set"), chunks).alias("chunk"), F.lit(1).alias("side"), "set", "tokens")
    copies = pivots.select("root", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(0).alias("side"), "set", "tokens")
    ordered = rows.unionByName(copies).repartition("root", "chunk").sortWithinPartitions("root", "chunk", "side")

    def run(own: Iterator[tuple]) -> Iterator[tuple]:
        of, held = None, []
        for root, part, side, name, raw in own:
            if (root, part) != of:
                of, held = (root, part), []
            tokens = np.frombuffer(raw, np.uint64)
            if not side:
                held.append((name, tokens))
                continue
            best = None
            for pivot, other in held:
                if min(len(other), len(tokens)) < threshold * max(len(other), len(tokens)) - 1e-6 and len(held) > 1:
                    continue
                shared = _overlap(other, tokens)
                best = name, root, pivot, shared, len(other) + len(tokens) - shared
                if shared >= threshold * best[4] - 1e-6:
                    break
            yield best or (name, root, None, 0, 1)

    return by_rows(ordered, run, "set binary, root binary, pivot binary, shared long, together long", chunk=64)


def large_classes(whole: DataFrame, threshold: float, block: int, rounds: tuple[int, ...] = (8, 32), stretch: int = 4096) -> list[DataFrame]:
    """a, b: confirmed links that join all the links' components of each class.  ``rounds``: how many linked sets are pivots next."""
    far = 1 - threshold
    linked = F.col("shared") >= threshold * F.col("together") - 1e-6
    first = materialise(beside_pivots(whole, whole.where("set = root"), threshold).withColumn("apart", 1 - F.col("shared") / F.col("together")), "beside")
    edges = [first.where(linked & (F.col("set") != F.col("pivot"))).select(F.col("set").alias("a"), F.col("pivot").alias("b"))]
    open_sets = first.where(~linked).select("set")
    joined = first.where(linked).select("set", "root")
    for k in rounds:
        some = joined.withColumn("part", F.pmod(F.xxhash64("set"), F.lit(64))).groupBy("root", "part").agg(F.min(F.struct(F.xxhash64("set", F.lit(k)).alias("h"), "set")).alias("m"))  # 64 a class
        chosen = some.groupBy("root").agg(F.slice(F.array_sort(F.collect_list("m")), 1, k).alias("m")).select(F.explode("m.set").alias("set"))
        got = materialise(beside_pivots(whole.join(open_sets, "set", "left_semi"), whole.join(chosen, "set", "left_semi"), threshold), "beside")
        edges.append(got.where(linked).select(F.col("set").alias("a"), F.col("pivot").alias("b")))
        joined = joined.unionByName(got.where(linked).select("set", "root"))
        open_sets = got.where(~linked).select("set")
    left = materialise(whole.join(first.select("set", "apart"), "set").join(open_sets, "set", "left_semi"), "open")
    if left.isEmpty():
        return edges
    # blocks of open sets about as far from the first pivot, and the sets that each block has to meet
    cell = F.floor(F.col("apart") * 20)
    parts = left.groupBy("root", cell.alias("cell")).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    placed = materialise(left.withColumn("cell", cell).join(parts, ["root", "cell"]).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts"))), "placed")
    blocks = placed.groupBy("root", "cell", "part").agg(F.min("apart").alias("from"), F.max("apart").alias("to"), F.min("n").alias("least"), F.max("n").alias("most"))
    others = whole.join(first.select("set", "apart"), "set").join(blocks, "root")
    others = others.where((F.col("apart") >= F.col("from") - far - 1e-9) & (F.col("apart") <= F.col("to") + far + 1e-9) & (F.col("n") >= F.col("least") * threshold - 1e-6) & (F.col("n") * threshold <= F.col("most") + 1e-6))
    salts = F.ceil(F.col("size") / stretch)
    met = others.select("root", "cell", "part", F.pmod(F.xxhash64("set"), salts).alias("salt"), F.lit(1).alias("side"), "set", "tokens")
    held = placed.select("root", "cell", "part", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"), "set", "tokens")
    keys = ["root", "cell", "part", "salt"]
    ordered = held.unionByName(met).select(*keys, "side", "set", "tokens").repartition(*keys).sortWithinPartitions(*keys, "side", "set")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own, base, beside = None, [], []

        def compare() -> Iterator[tuple]:
            names = {b[1] for b in base}
            yield from ((a, b) for a, b, _ in links_of((own, 0, 0), base + [x for x in beside if x[1] not in names], threshold) if b is not None)

        for root, cell_, part, salt, side, name, raw in rows:
            if (root, cell_, part, salt) != own:
                if base:
                    yield from compare()
                own, base, beside = (root, cell_, part, salt), [], []
            row = (side, name, 1, np.frombuffer(raw, np.uint64))
            if not side:
                base.append(row)
            else:
                beside.append(row)
                if len(beside) == block:
                    yield from compare()
                    beside = []
        if base:
            yield from compare()

    return [*edges, by_rows(ordered, run, "a binary, b binary", chunk=64)]


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 2, limit: int = 128, hot: int = 2_000, block: int = 128) -> DataFrame:
    """id, n_shingles, component_id (least id reachable by links), kept (whether that is the row's own id)."""
    rows = materialise(signatures(docs, id_col, text_col, width), "signatures")
    at = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("at")
    sets = materialise(rows.where("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("id"), at, F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    found = components(candidates(sets, threshold, limit, hot))
    classes = materialise(sets.select("set", "at", short_name("set").alias("node")).join(found, "node").drop("node"), "classes")
    sizes = classes.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("set").alias("first"))
    members = classes.join(sizes, "root").drop("root").withColumnRenamed("first", "root")
    whole = materialise(whole_sets(docs, members, id_col, text_col, width), "whole")
    links = small_classes(whole.where(F.col("size") <= block), threshold)
    if not (large := whole.where(F.col("size") > block)).isEmpty():
        for more in large_classes(large, threshold, 4 * block):
            links = links.unionByName(more)
    final = sets.select("set", "id").join(components(links).select(F.col("node").alias("set"), "root"), "set", "left")
    least = final.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    known = final.join(least, "root", "left").select("set", F.coalesce("least", "id").alias("component_id"))
    one = rows.join(known, "set", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return one.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
