"""The candidate grid over all base signals: ranks, moments, correlations, the search and its nulls (G09-G16, D48-D50).

Queries take all candidates to depth 2 of all signals, so that SQL can follow; ``g14_full_grid`` takes all to depth 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise, once
from sextant.core.tables import deal_tables
from sextant.functions.numbers import half_up_sql, half_up_text, r6
from sextant.operators import gram as G
from sextant.operators import ranks
from sextant.operators import rows as R
from sextant.plans.catalog import register
from sextant.plans.experiments import hashed_sql
from sextant.plans.signals import FAMILIES, PANEL_SQL, Spans, panel
from sextant.plans.slice import FWD_SQL

MIN_NAMES, BLOCK = 5, 21
DEPTH = 2
FACTORS = ("mom_252_skip21", "vol_126")
TOP, FOLDS, REPS = (5, 10, 25), 6, 50
GROUPS, HELD = 6, 2


def _all(spans: Spans) -> dict:
    out: dict = {}
    for make in FAMILIES.values():
        out |= make(spans)
    return out


_SQL_OF = {name: s.sql for name, s in _all(Spans()).items()}
SIGNALS = list(_SQL_OF)
K = len(SIGNALS)
GRID = G.Grid(K, DEPTH)


def label(signals, signs) -> str:
    return "".join(("+" if s > 0 else "-") + SIGNALS[i] for i, s in zip(signals, signs, strict=True))


def labels(numbers: np.ndarray, d: int, grid: G.Grid = GRID) -> list[str]:
    return [label(i, s) for i, s in zip(*(x.tolist() for x in grid.unrank(numbers, d)), strict=True)]


def signal_panel(spark: SparkSession, p: str) -> DataFrame:
    """``_signal_panel``, written once for all queries of a session."""
    return once(spark, "signals", deal_tables(p), lambda: _signal_panel(spark, p))


def _signal_panel(spark: SparkSession, p: str) -> DataFrame:
    """id, d, every signal (rounded, so that values equal but for rounding errors tie) and the forward return y."""
    spans = Spans()
    columns = [f"{half_up_text(s.col(), 9)} AS {k}" for k, s in _all(spans).items()]
    return spans.columns(R.forward_return(panel(spark, p), 5, 20)).selectExpr("id", "d", *columns, "fwd AS y")


def market_ranks(spark: SparkSession, p: str) -> DataFrame:
    return once(spark, "ranks", deal_tables(p), lambda: G.ranked(signal_panel(spark, p), SIGNALS, "y", MIN_NAMES))


def market_grams(spark: SparkSession, p: str) -> DataFrame:
    """d, i (session number of the scored dates), block, n, gram.  Numbers run over dates only."""
    m = once(spark, "grams", deal_tables(p), lambda: G.grams(market_ranks(spark, p)))
    i = m.select("d", (F.row_number().over(Window.orderBy("d")) - 1).cast("long").alias("i"))
    return m.join(F.broadcast(i), "d").withColumn("block", F.floor(F.col("i") / BLOCK))  # a row a session


def block_sums(spark: SparkSession, p: str, **how) -> DataFrame:
    return once(spark, f"blocks-{'-'.join(map(str, how))}", deal_tables(p), lambda: G.blocks_against_grid(market_grams(spark, p), GRID, K + 1, "block", **how))


_SIG = ", ".join(f"{half_up_sql(sql, 9)} AS s{k}" for k, sql in enumerate(_SQL_OF.values()))
_COLS = ", ".join(f"s{k}" for k in range(K))
_Z_SQL = f"""{PANEL_SQL}, {FWD_SQL}, sig AS MATERIALIZED (SELECT id, d, {_SIG} FROM panel),
ok AS MATERIALIZED (SELECT * FROM (SELECT id, d, {_COLS}, fwd AS s{K} FROM sig JOIN f USING (id, d) WHERE fwd IS NOT NULL AND {" AND ".join(f"s{k} IS NOT NULL" for k in range(K))}) QUALIFY count(*) OVER (PARTITION BY d) >= {MIN_NAMES}),
long AS (SELECT id, d, CAST(substr(s, 2) AS INT) AS k, v FROM (UNPIVOT ok ON {_COLS}, s{K} INTO NAME s VALUE v)),
z AS MATERIALIZED (SELECT id, d, k, rank() OVER (PARTITION BY d, k ORDER BY v) + (count(*) OVER (PARTITION BY d, k, v) - 1) / 2 - (count(*) OVER (PARTITION BY d, k) + 1) / 2 AS z FROM long),
dates AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM ok)), names(k, name) AS (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(SIGNALS))})"""
_MOM_SQL = f"""{_Z_SQL}, zl AS MATERIALIZED (SELECT d, k, list(z::DOUBLE ORDER BY id) AS z FROM z GROUP BY ALL),
mom AS MATERIALIZED (SELECT a.d, a.k AS i, b.k AS j, list_inner_product(a.z, b.z) AS m FROM zl a JOIN zl b ON a.d = b.d AND a.k <= b.k)"""
_IC = f"""own AS MATERIALIZED (SELECT v.d, v.i AS k, v.m AS vv, y.m AS ky FROM {{m}} v JOIN {{m}} y ON y.d = v.d AND y.i = v.i AND y.j = {K} WHERE v.i = v.j AND v.i < {K}), yy AS (SELECT d, m AS yy FROM {{m}} WHERE i = {K} AND j = {K}),
pairs AS (SELECT {{m}}.d, i, j, s, a.vv + b.vv AS base, a.vv + b.vv + 2 * s * m AS v, a.ky + s * b.ky AS c FROM {{m}} JOIN own a ON a.d = {{m}}.d AND a.k = i JOIN own b ON b.d = {{m}}.d AND b.k = j, (VALUES (1), (-1)) t(s) WHERE i < j),
every AS (SELECT d, k AS c, vv AS base, vv AS v, ky AS cov FROM own UNION ALL SELECT d, {K} + 2 * (i * {K} - i * (i + 1) // 2 + j - i - 1) + (s < 0)::INT, base, v, c FROM pairs),
ic AS MATERIALIZED (SELECT d, c, cov / sqrt(v * yy) AS ic FROM every JOIN yy USING (d) WHERE v > {{least}} * base AND yy > {{floor}}),
cand AS (SELECT k AS c, '+' || name AS candidate FROM names UNION ALL SELECT {K} + 2 * (a.k * {K} - a.k * (a.k + 1) // 2 + b.k - a.k - 1) + (s < 0)::INT, '+' || a.name || CASE WHEN s > 0 THEN '+' ELSE '-' END || b.name FROM names a JOIN names b ON a.k < b.k, (VALUES (1), (-1)) t(s))"""
IC_SQL = f"{_MOM_SQL}, {_IC.format(m='mom', least=0, floor=0)}"
_BLOCK_SQL = f"{IC_SQL}, bs AS MATERIALIZED (SELECT c, i // {BLOCK} AS block, sum(ic) AS s, count(*) AS n FROM ic JOIN dates USING (d) GROUP BY ALL), nb AS (SELECT max(i) // {BLOCK} + 1 AS nb FROM dates)"


def _summary(sums: DataFrame) -> DataFrame:
    """candidate, n, mean, se, t from a chunk's sums, squares and counts over all blocks, added up as they stream by."""
    ordered = sums.select("first", "block", "sums", "squares", "counts").repartition("first").sortWithinPartitions("first", "block")
    depth_of = {first: d for first, _, d in GRID.chunks()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, own in G._by_key(batches, "first"):
            s, q, n = (sum(np.frombuffer(x, float) for x in own.column(c).to_pylist()) for c in ("sums", "squares", "counts"))
            some = np.flatnonzero(n > 0)
            s, q, n = s[some], q[some], n[some]
            mean = s / n
            spread = np.sqrt(np.maximum(q - n * mean * mean, 0) / np.maximum(n - 1, 1))
            se = np.where(n > 1, spread / np.sqrt(n), np.nan)
            t = np.divide(mean, se, out=np.full(len(n), np.nan), where=se > 1e-12)
            some_or_none = lambda x: pa.array(x, mask=np.isnan(x))
            yield pa.RecordBatch.from_arrays([pa.array(labels(first + some, depth_of[int(first)]), pa.string()), pa.array(n.astype(np.int64)), pa.array(mean), some_or_none(se), some_or_none(t)], names=["candidate", "n", "mean", "se", "t"])

    out = ordered.mapInArrow(run, "candidate string, n long, mean double, se double, t double")
    return out.select("candidate", "n", r6(F.col("mean")).alias("mean"), r6(F.col("se")).alias("se"), F.round("t", 4).alias("t"))


_SUMMARY_SQL = "SELECT candidate, count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic) / sqrt(count(*)), 6) AS se, CASE WHEN stddev_samp(ic) / sqrt(count(*)) > 1e-12 THEN round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 4) END AS t FROM ic JOIN cand USING (c) GROUP BY 1"


@register(
    "g09_candidates",
    f"""{PANEL_SQL}, sig AS (SELECT {_SIG} FROM panel), known AS MATERIALIZED (SELECT CAST(substr(s, 2) AS INT) AS k, n FROM (UNPIVOT (SELECT {", ".join(f"count(s{k}) AS s{k}" for k in range(K))} FROM sig) ON {_COLS} INTO NAME s VALUE n)),
    names(k, name) AS (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(SIGNALS))}),
    e AS (SELECT k AS a, 1 AS depth, 1 AS many, n AS rows FROM known UNION ALL SELECT a.k, 2, 2, least(a.n, b.n) FROM known a JOIN known b ON a.k < b.k UNION ALL SELECT a.k, 3, 4, least(a.n, b.n, c.n) FROM known a JOIN known b ON a.k < b.k JOIN known c ON b.k < c.k)
    SELECT name AS first, depth, sum(many)::BIGINT AS candidates, min(rows) AS least_rows, max(rows) AS most_rows FROM e JOIN names ON k = a GROUP BY ALL""",
)
def g09(spark, p):
    """Candidates to depth 3 by first signal and depth, with the least and most rows on which all of a candidate's signals are known.

    Candidates are unranked from their numbers in the tasks; what is broadcast is a count a signal."""
    grid = G.Grid(K, 3)
    counts = signal_panel(spark, p).agg(*(F.count(k).alias(k) for k in SIGNALS)).first()
    known = np.array([counts[k] for k in SIGNALS])
    starts = np.cumsum([0, *(grid.count(d) for d in (1, 2, 3))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for d in (1, 2, 3):
                own = numbers[(numbers >= starts[d - 1]) & (numbers < starts[d])]
                if len(own):
                    signals, _ = grid.unrank(own, d)
                    first, at = np.unique(signals[:, 0], return_inverse=True)
                    rows = known[signals].min(1)
                    least, most = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
                    np.minimum.at(least, at, rows)
                    np.maximum.at(most, at, rows)
                    yield pa.RecordBatch.from_pydict({"first": [SIGNALS[i] for i in first], "depth": pa.array([d] * len(first), pa.int32()), "n": np.bincount(at), "least": least, "most": most})

    parts = spark.range(grid.total).mapInArrow(run, "first string, depth int, n long, least long, most long")
    return parts.groupBy("first", "depth").agg(F.sum("n").alias("candidates"), F.min("least").alias("least_rows"), F.max("most").alias("most_rows"))


@register(
    "g10_composites",
    f"""{_Z_SQL}, zb AS MATERIALIZED (SELECT id, k, sum(z) / count(*) AS m, count(*) AS n FROM z WHERE k < {K} GROUP BY ALL),
    every AS (SELECT id, '+' || name AS candidate, m AS score FROM zb JOIN names USING (k) UNION ALL SELECT a.id, '+' || x.name || CASE WHEN s > 0 THEN '+' ELSE '-' END || y.name, (a.m + s * b.m) / 2 FROM zb a JOIN zb b ON a.id = b.id AND a.k < b.k JOIN names x ON x.k = a.k JOIN names y ON y.k = b.k, (VALUES (1), (-1)) t(s))
    SELECT candidate, count(*) AS names, arg_min(id, (-round(score, 8), id)) AS best, round(max(score), 6) AS top, round(min(score), 6) AS bottom FROM every GROUP BY 1""",
)
def g10(spark, p, together: int = 1024):
    """Names by the mean of each candidate's rank composite over all dates: the best name and both ends.

    A composite is linear in its ranks, so its mean comes from a name's mean ranks: a vector a name, ``together`` names a matrix."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for names, z in zip(batch.column("names").to_pylist(), batch.column("z").to_pylist(), strict=True):
                m = np.frombuffer(z, float).reshape(len(names), -1)
                for name, row in zip(names, m, strict=True):
                    if name in held:
                        held[name][0] += 1
                        held[name][1] += row
                    else:
                        held[name] = [1, row.copy()]
        if held:
            yield pa.RecordBatch.from_pydict({"id": list(held), "n": [n for n, _ in held.values()], "z": [v.tolist() for _, v in held.values()]})

    parts = market_ranks(spark, p).mapInArrow(folded, "id string, n long, z array<double>")
    means = materialise(parts.groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(F.col("z")[k]).alias(f"s{k}") for k in range(K))), "means")
    dealt = means.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-means.count() // together)))))
    ordered = dealt.repartition("part").sortWithinPartitions("part", "id")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in G._by_key(batches, "part"):
            ids = own.column("id").to_pylist()
            m = np.stack([own.column(f"s{k}").to_numpy() for k in range(K)], 1) / own.column("n").to_numpy()[:, None]
            for first, n, d in GRID.chunks():
                signals, signs = GRID.unrank(np.arange(first, first + n), d)
                score = sum(m[:, signals[:, a]] * signs[:, a] for a in range(d)) / d
                size = np.floor(score * 1e8 + 0.5) / 1e8
                at = size.argmax(0)  # ids ascend, so the first of equals is the least
                yield pa.RecordBatch.from_pydict({"candidate": labels(np.arange(first, first + n), d), "names": np.full(n, len(ids)), "best": [ids[i] for i in at], "size": size[at, np.arange(n)], "top": score.max(0), "bottom": score.min(0)})

    each = ordered.mapInArrow(best, "candidate string, names long, best string, size double, top double, bottom double")
    first = F.min(F.struct((-F.col("size")).alias("size"), "best"))["best"]
    return each.groupBy("candidate").agg(F.sum("names").alias("names"), first.alias("best"), r6(F.max("top")).alias("top"), r6(F.min("bottom")).alias("bottom"))


@register("g12_ic_summary", f"{IC_SQL} {_SUMMARY_SQL}")
def g12(spark, p):
    return _summary(block_sums(spark, p, squares=True))


@register("g13_moments", f"{_MOM_SQL} SELECT i, j, count(*) AS dates, sum(m) AS total, sum(m * dates.i0) AS dated FROM mom JOIN (SELECT d, i AS i0 FROM dates) dates USING (d) GROUP BY ALL")
def g13(spark, p):
    """Per pair of signals (the outcome last) the moments of all dates: how many, their sum and their sum by session number; all exact."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, dated = 0, np.zeros((K + 1, K + 1)), np.zeros((K + 1, K + 1))
        for batch in batches:
            for i, raw in zip(batch.column("i").to_pylist(), batch.column("gram").to_pylist(), strict=True):
                m = np.frombuffer(raw, float).reshape(K + 1, K + 1)
                n, total, dated = n + 1, total + m, dated + m * i
        if n:
            a, b = np.triu_indices(K + 1)
            yield pa.RecordBatch.from_pydict({"i": pa.array(a, pa.int32()), "j": pa.array(b, pa.int32()), "dates": np.full(len(a), n), "total": total[a, b], "dated": dated[a, b]})

    parts = market_grams(spark, p).select("i", "gram").mapInArrow(folded, "i int, j int, dates long, total double, dated double")
    return parts.groupBy("i", "j").agg(F.sum("dates").alias("dates"), F.sum("total").alias("total"), F.sum("dated").alias("dated"))


def daily(matrices: DataFrame, grid: G.Grid) -> DataFrame:
    """d, n, mean, size (mean absolute) and the best candidate of each date (greatest absolute correlation, the first of equals)."""
    ordered = matrices.select("block", "d", "gram").repartition("block").sortWithinPartitions("block", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in G._by_key(batches, "block"):
            m = np.frombuffer(b"".join(own.column("gram").to_pylist()), float).reshape(own.num_rows, K + 1, K + 1)
            t = len(m)
            n, total, size = np.zeros(t, np.int64), np.zeros(t), np.zeros(t)
            top, best, value = np.full(t, -1.0), [""] * t, np.zeros(t)
            for first, many, d in grid.chunks():
                ic = G.correlations(m, *grid.unrank(np.arange(first, first + many), d))
                known = ~np.isnan(ic)
                n += known.sum(1)
                held = np.where(known, ic, 0.0)
                total += held.sum(1)
                size += np.abs(held).sum(1)
                most = np.where(known, np.round(np.abs(held), 9), -1.0)
                at = most.argmax(1)
                for row in np.flatnonzero(most[np.arange(t), at] > top):
                    top[row], value[row] = most[row, at[row]], ic[row, at[row]]
                    best[row] = labels(np.array([first + at[row]]), d, grid)[0]
            some = n > 0
            yield pa.RecordBatch.from_pydict({"d": own.column("d").combine_chunks(), "n": n, "mean": pa.array(total / np.maximum(n, 1), mask=~some), "size": pa.array(size / np.maximum(n, 1), mask=~some), "best": pa.array(best, mask=~some), "ic": pa.array(value, mask=~some)})

    return ordered.mapInArrow(run, "d date, n long, mean double, size double, best string, ic double").select("d", "n", r6(F.col("mean")).alias("mean"), r6(F.col("size")).alias("size"), "best", r6(F.col("ic")).alias("ic"))


@register(
    "g14_batch_ic",
    f"""{IC_SQL}, t AS (SELECT d, count(*) AS n, avg(ic) AS mean, avg(abs(ic)) AS size, arg_min(c, (-round(abs(ic), 9), c)) AS c FROM ic GROUP BY 1)
    SELECT d, n, round(mean, 6) AS mean, round(size, 6) AS size, candidate AS best, round(ic, 6) AS ic FROM t JOIN cand USING (c) JOIN ic USING (d, c)""",
)
def g14(spark, p):
    """Every candidate's correlation on every date, told per date."""
    return daily(market_grams(spark, p), GRID)


@register("g14_full_grid")
def g14_full(spark, p):
    """The same for all candidates to depth 3."""
    return daily(market_grams(spark, p), G.Grid(K, 3))


_F1, _F2 = (SIGNALS.index(f) for f in FACTORS)
_PARTIAL_SQL = f"""fx AS MATERIALIZED (SELECT d, k, max(m) FILTER (f = {_F1}) AS f1, max(m) FILTER (f = {_F2}) AS f2 FROM (SELECT d, i AS k, j AS f, m FROM mom WHERE j IN ({_F1}, {_F2}) UNION ALL SELECT d, j, i, m FROM mom WHERE i IN ({_F1}, {_F2}) AND i <> j) GROUP BY ALL),
ff AS (SELECT a.d, a.f1 AS a, a.f2 AS b, c.f2 AS c FROM fx a JOIN fx c ON c.d = a.d AND c.k = {_F2} WHERE a.k = {_F1}),
inv AS MATERIALIZED (SELECT d, CASE WHEN a * c - b * b > 1e-10 * pow(a + c, 2) THEN c / (a * c - b * b) WHEN a + c > 0 THEN a / pow(a + c, 2) ELSE 0 END AS p, CASE WHEN a * c - b * b > 1e-10 * pow(a + c, 2) THEN -b / (a * c - b * b) WHEN a + c > 0 THEN b / pow(a + c, 2) ELSE 0 END AS q,
  CASE WHEN a * c - b * b > 1e-10 * pow(a + c, 2) THEN a / (a * c - b * b) WHEN a + c > 0 THEN c / pow(a + c, 2) ELSE 0 END AS r FROM ff),
raw AS (SELECT mom.d, i, j, m, m - (x.f1 * (p * y.f1 + q * y.f2) + x.f2 * (q * y.f1 + r * y.f2)) AS net FROM mom JOIN fx x ON x.d = mom.d AND x.k = i JOIN fx y ON y.d = mom.d AND y.k = j JOIN inv ON inv.d = mom.d),
none AS MATERIALIZED (SELECT d, i AS k FROM raw WHERE i = j AND net <= 1e-9 * m), rm AS MATERIALIZED (SELECT raw.d, i, j, CASE WHEN a.k IS NULL AND b.k IS NULL THEN net ELSE 0 END AS m FROM raw LEFT JOIN none a ON a.d = raw.d AND a.k = i LEFT JOIN none b ON b.d = raw.d AND b.k = j)"""


@register("g15_partial_ic", f"{_MOM_SQL}, {_PARTIAL_SQL}, {_IC.format(m='rm', least=1e-9, floor=0)} {_SUMMARY_SQL}")
def g15(spark, p):
    """Every candidate's correlation net of two factors, by a pseudo-inverse of the factors' moments on each date."""
    return _summary(block_sums(spark, p, squares=True, factors=[_F1, _F2], least=1e-9))


@register(
    "g16_block_means",
    f"{_BLOCK_SQL} SELECT candidate, round(sum(s) FILTER (block % 2 = 0) / sum(n) FILTER (block % 2 = 0), 6) AS even, round(sum(s) FILTER (block % 2 = 1) / sum(n) FILTER (block % 2 = 1), 6) AS odd, round(sum(s) FILTER (block >= nb - 12) / sum(n) FILTER (block >= nb - 12), 6) AS recent FROM bs JOIN cand USING (c), nb GROUP BY 1",
)
def g16(spark, p):
    """Means over three sets of blocks (even, odd, the last twelve): a set is a row of weights, all candidates are one product."""
    sums = block_sums(spark, p)
    last = sums.agg(F.max("block")).first()[0]
    depth_of = {first: d for first, _, d in GRID.chunks()}

    def own(first, block, s, n):
        m = G.means(s, n, np.stack([block % 2 == 0, block % 2 == 1, block > (last or 0) - 12]).astype(float))
        some = np.flatnonzero(n.sum(0) > 0)
        yield {"candidate": labels(first + some, depth_of[first])} | {k: [None if np.isnan(x) else x for x in v.tolist()] for k, v in zip(("even", "odd", "recent"), m[:, some], strict=True)}

    got = G.per_chunk(sums, "block", own, "candidate string, even double, odd double, recent double")
    return got.select("candidate", *(r6(F.col(c)).alias(c) for c in ("even", "odd", "recent")))


# The search: train and test sets of blocks


def walk_forward(n_blocks: int, folds: int = FOLDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, test) weights over blocks: the blocks fall into folds + 2 stretches; a fold tests one from the third on and trains on
    all before but for one block."""
    at = np.arange(n_blocks)
    stretch = at * (folds + 2) // max(n_blocks, 1)
    out = []
    for k in range(2, folds + 2):
        test = stretch == k
        if test.any():
            out.append(((at + 1 < at[test][0]).astype(float), test.astype(float)))
    return out


def purged(n_blocks: int, groups: int = GROUPS, held: int = HELD) -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, test) weights of every choice of ``held`` groups of blocks for the test; training leaves out the blocks beside a test block."""
    at = np.arange(n_blocks)
    group = at * groups // max(n_blocks, 1)
    out = []
    for chosen in combinations(range(groups), held):
        test = np.isin(group, chosen)
        near = test | np.append(test[1:], False) | np.insert(test[:-1], 0, False)
        out.append(((~near).astype(float), test.astype(float)))
    return out


def block_signs(reps: int, blocks: np.ndarray) -> np.ndarray:
    """reps x blocks of +1 and -1, from hashes; replica 0 turns nothing."""
    import hashlib

    out = np.ones((reps + 1, len(blocks)))
    for r in range(1, reps + 1):
        out[r] = [int(hashlib.md5(f"{r}|{b}".encode()).hexdigest()[:8], 16) % 2 * 2 - 1 for b in blocks.tolist()]
    return out


def selections(sums: DataFrame, n_blocks: int, folds: list, most: int, reps: int) -> DataFrame:
    """rep, fold, usable, and the ``most`` candidates of greatest absolute train mean (candidate number, train, test), merged over chunks.

    A replica turns the signs of whole blocks.  Its candidates are a product of matrices in the chunk's task, and only the chunk's best
    leave it."""

    def own(first, block, s, n):
        signs = block_signs(reps, block)
        for f, (train, test) in enumerate(folds):
            a = G.means(s, n, np.tile(train[block], (reps + 1, 1)), signs)
            b = G.means(s, n, np.tile(test[block], (reps + 1, 1)), signs)
            for r in range(reps + 1):
                usable = np.flatnonzero(~np.isnan(a[r]) & ~np.isnan(b[r]))
                at = usable[G.first_of(a[r][usable], most)]
                yield {"rep": [r], "fold": [f], "usable": [len(usable)], "best": [[{"size": round(-abs(x), 9), "c": c, "train": x, "test": y} for c, x, y in zip((first + at).tolist(), a[r][at].tolist(), b[r][at].tolist(), strict=True)]]}

    parts = G.per_chunk(sums, "block", own, "rep int, fold int, usable long, best array<struct<size:double,c:long,train:double,test:double>>")
    both = parts.groupBy("rep", "fold").agg(F.sum("usable").alias("usable"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most).alias("best"))  # ``most`` a chunk
    return both.where(F.col("usable") >= most)


def hits(chosen: DataFrame) -> DataFrame:
    """top_n, rep, fold, train (mean absolute) and test (mean in the train mean's direction) of the selections."""
    n = chosen.select("rep", "fold", "best", F.explode(F.array(*(F.lit(x) for x in TOP))).alias("top_n"))
    own = n.select("top_n", "rep", "fold", F.inline(F.slice("best", 1, F.col("top_n"))))
    return own.groupBy("top_n", "rep", "fold").agg(F.avg(F.abs("train")).alias("train"), F.avg(F.signum("train") * F.col("test")).alias("test"))


def rank_decay(sums: DataFrame, folds: list) -> DataFrame:
    """fold, decay: Spearman correlation of all candidates' train and test means; ranks are numbered over ranges, not in one task."""

    def own(first, block, s, n):
        for f, (train, test) in enumerate(folds):
            a, b = (G.means(s, n, w[block][None])[0] for w in (train, test))
            usable = np.flatnonzero(~np.isnan(a) & ~np.isnan(b))
            yield {"fold": np.full(len(usable), f), "train": np.round(a[usable], 12), "test": np.round(b[usable], 12)}

    pairs = materialise(G.per_chunk(sums, "block", own, "fold int, train double, test double"), "pairs")
    both = ranks.average_ranks(ranks.average_ranks(pairs, "train", ["fold"], "x"), "test", ["fold"], "y")
    return both.groupBy("fold").agg(F.corr("x", "y").alias("decay"))


_FOLD_SQL = f"""seg AS (SELECT block, block * {FOLDS + 2} // nb AS seg FROM (SELECT unnest(range(0, nb)) AS block, nb FROM nb)), fold AS (SELECT seg AS k, min(block) AS lo, max(block) AS hi FROM seg WHERE seg >= 2 GROUP BY 1),
tt AS MATERIALIZED (SELECT k, c, rep, sum(CASE WHEN block + 1 < lo THEN g * s END) / sum(CASE WHEN block + 1 < lo THEN n END) AS train, sum(CASE WHEN block >= lo THEN g * s END) / sum(CASE WHEN block >= lo THEN n END) AS test
  FROM bs JOIN fold ON block + 1 < lo OR block BETWEEN lo AND hi JOIN (SELECT block, rep, CASE WHEN rep = 0 THEN 1 ELSE {hashed_sql('rep', 'block')} % 2 * 2 - 1 END AS g FROM seg, (SELECT unnest(range(0, {REPS + 1})) AS rep)) USING (block) GROUP BY ALL HAVING train IS NOT NULL AND test IS NOT NULL),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rep, k ORDER BY round(-abs(train), 9), c) AS rn, count(*) OVER (PARTITION BY rep, k) AS usable FROM tt QUALIFY rn <= {max(TOP)} AND usable >= {max(TOP)}),
h AS (SELECT top_n, rep, k, avg(abs(train)) AS train, avg(sign(train) * test) AS test FROM top, (SELECT unnest([{', '.join(map(str, TOP))}]) AS top_n) WHERE rn <= top_n GROUP BY ALL), hr AS (SELECT top_n, rep, avg((test > 0)::INT) AS hit_rate FROM h GROUP BY ALL)"""


@register(
    "d48_search_procedure",
    f"""{_BLOCK_SQL}, {_FOLD_SQL}, rk AS (SELECT k, {", ".join(f"rank() OVER (PARTITION BY k ORDER BY round({c}, 12)) + (count(*) OVER (PARTITION BY k, round({c}, 12)) - 1) / 2 AS {r}" for c, r in (("train", "x"), ("test", "y")))} FROM tt WHERE rep = 0), de AS (SELECT avg(r) AS rank_decay FROM (SELECT corr(x, y) AS r FROM rk GROUP BY k)),
    o AS (SELECT top_n, count(*) AS folds, avg((test > 0)::INT) AS hit_rate, avg(train) AS train, avg(test) AS test FROM h WHERE rep = 0 GROUP BY 1), nu AS (SELECT hr.top_n, avg(hr.hit_rate) AS null_mean, (1 + count(*) FILTER (hr.hit_rate >= o.hit_rate)) / (1 + count(*)) AS p FROM hr JOIN o USING (top_n) WHERE rep > 0 GROUP BY 1)
    SELECT top_n, folds, round(hit_rate, 6) AS hit_rate, round(train, 6) AS train, round(test, 6) AS test, round(train - test, 6) AS degradation, round(rank_decay, 6) AS rank_decay, round(null_mean, 6) AS null_mean, round(p, 6) AS p FROM o JOIN nu USING (top_n), de""",
)
def d48(spark, p):
    """The search itself: in walk-forward folds the N best of the train blocks, scored in their own direction on the test blocks; its hit
    rate against the hit rates of replicas with turned blocks, and how the ranks of all candidates decay."""
    sums = block_sums(spark, p)
    n = (sums.agg(F.max("block")).first()[0] or 0) + 1
    folds = walk_forward(n)
    h = materialise(hits(selections(sums, n, folds, max(TOP), REPS)), "hits")  # folds x replicas x N rows
    own = h.where("rep = 0").groupBy("top_n").agg(F.count(F.lit(1)).alias("folds"), F.avg((F.col("test") > 0).cast("int")).alias("hit_rate"), F.avg("train").alias("train"), F.avg("test").alias("test"))
    null = h.where("rep > 0").groupBy("top_n", "rep").agg(F.avg((F.col("test") > 0).cast("int")).alias("null")).join(own.select("top_n", "hit_rate"), "top_n")
    null = null.groupBy("top_n").agg(F.avg("null").alias("null_mean"), ((1 + F.count_if(F.col("null") >= F.col("hit_rate"))) / (1 + F.count(F.lit(1)))).alias("p"))
    decay = F.broadcast(rank_decay(sums, folds).agg(F.avg("decay").alias("rank_decay")))  # one row
    got = own.join(null, "top_n").join(decay, F.lit(True)).withColumn("degradation", F.col("train") - F.col("test"))
    return got.select("top_n", "folds", *(r6(F.col(c)).alias(c) for c in ("hit_rate", "train", "test", "degradation", "rank_decay", "null_mean", "p")))


@register("d49_sign_flip_null", f"{_BLOCK_SQL}, {_FOLD_SQL} SELECT top_n, rep, count(*) AS folds, round(avg((test > 0)::INT), 6) AS hit_rate, round(avg(test), 6) AS test FROM h GROUP BY ALL")
def d49(spark, p):
    """Hit rate of the search in every replica (0: the data): signs of whole blocks turn together for all candidates."""
    sums = block_sums(spark, p)
    n = (sums.agg(F.max("block")).first()[0] or 0) + 1
    h = hits(selections(sums, n, walk_forward(n), max(TOP), REPS))
    return h.groupBy("top_n", "rep").agg(F.count(F.lit(1)).alias("folds"), r6(F.avg((F.col("test") > 0).cast("int"))).alias("hit_rate"), r6(F.avg("test")).alias("test"))


_SPLITS = list(combinations(range(GROUPS), HELD))


@register(
    "d50_overfitting_probability",
    f"""{_BLOCK_SQL}, gr AS (SELECT block, block * {GROUPS} // nb AS g FROM (SELECT unnest(range(0, nb)) AS block, nb FROM nb)), sp(split, g) AS (VALUES {", ".join(f"({i}, {g})" for i, own in enumerate(_SPLITS) for g in own)}),
    te AS (SELECT split, block FROM gr JOIN sp USING (g)), tr AS (SELECT split, block FROM gr, (SELECT DISTINCT split FROM sp) WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.split = split_of(split) AND te.block BETWEEN gr.block - 1 AND gr.block + 1)),
    x AS MATERIALIZED (SELECT split, c, a / an AS train, b / bn AS test FROM (SELECT split, c, sum(s) AS a, sum(n) AS an FROM bs JOIN tr USING (block) GROUP BY ALL) JOIN (SELECT split, c, sum(s) AS b, sum(n) AS bn FROM bs JOIN te USING (block) GROUP BY ALL) USING (split, c)),
    best AS (SELECT split, c, train, test * sign(train) AS own, sign(train) AS sg FROM x QUALIFY row_number() OVER (PARTITION BY split ORDER BY round(-abs(train), 9), c) = 1),
    w AS (SELECT split, best.c, best.train, own, (count(*) FILTER (round(x.test * sg, 12) < round(own, 12)) + 0.5) / count(*) AS w FROM best JOIN x USING (split) GROUP BY ALL)
    SELECT split, candidate AS best, round(train, 6) AS train, round(own, 6) AS test, round(w, 8) AS w, round(avg((ln(w / (1 - w)) <= 0)::INT) OVER (), 6) AS pbo FROM w JOIN cand USING (c)""".replace("split_of(split)", "s.split").replace("gr, (SELECT DISTINCT split FROM sp) WHERE", "gr, (SELECT DISTINCT split FROM sp) s WHERE"),
)
def d50(spark, p):
    """Probability of overfitting over combinatorial purged splits: where the best of the train blocks stands among all on the test blocks."""
    sums = block_sums(spark, p)
    n = (sums.agg(F.max("block")).first()[0] or 0) + 1
    splits = purged(n)
    top = selections(sums, n, splits, 1, 0).select("fold", F.col("best")[0].alias("b")).select("fold", "b.*").collect()  # a row a split
    best = {r.fold: (r.c, r.train, r.test * np.sign(r.train)) for r in top}

    def own(first, block, s, n_):
        for f, (train, test) in enumerate(splits):
            if f in best:
                a, b = (G.means(s, n_, w[block][None])[0] for w in (train, test))
                oos = b[~np.isnan(a) & ~np.isnan(b)] * np.sign(best[f][1])
                yield {"split": [f], "n": [len(oos)], "below": [int((np.round(oos, 12) < round(best[f][2], 12)).sum())]}

    counts = G.per_chunk(sums, "block", own, "split int, n long, below long").groupBy("split").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
    depth_of = {first: (n_, d) for first, n_, d in GRID.chunks()}
    name = lambda c: next(labels(np.array([c]), d)[0] for first, (n_, d) in depth_of.items() if first <= c < first + n_)
    told = spark.createDataFrame([(f, name(c), float(a), float(b)) for f, (c, a, b) in best.items()], "split int, best string, train double, test double")
    w = told.join(counts, "split").withColumn("w", (F.col("below") + 0.5) / F.col("n"))
    pbo = F.broadcast(w.agg(F.avg((F.log(F.col("w") / (1 - F.col("w"))) <= 0).cast("int")).alias("pbo")))  # one row
    return w.join(pbo, F.lit(True)).select("split", "best", r6(F.col("train")).alias("train"), r6(F.col("test")).alias("test"), F.round("w", 8).alias("w"), r6(F.col("pbo")).alias("pbo"))
