"""The candidate grid against direct computation: numbering, ranks, moments, projections, blocks, selections; ranks over ranges."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import gram as G
from sextant.operators import ranks
from sextant.operators import rows as R
from sextant.plans import grid


def average_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize(("k", "depth"), [(1, 1), (5, 3), (7, 4)])
def test_numbers_name_every_candidate_once(k, depth):
    g = G.Grid(k, depth, chunk=10)
    seen = []
    for first, n, d in g.chunks():
        signals, signs = g.unrank(np.arange(first, first + n), d)
        for number, i, s in zip(range(first, first + n), signals.tolist(), signs.tolist(), strict=True):
            assert g.rank(tuple(i), tuple(s)) == number
            seen.append((tuple(i), tuple(s)))
    want = [(c, (1, *s)) for d in range(1, depth + 1) for c in itertools.combinations(range(k), d) for s in itertools.product((1, -1), repeat=d - 1)]
    assert len(seen) == g.total == len(set(seen)) and set(seen) == set(want)


def test_the_whole_grid_has_the_known_size():
    assert grid.K == 143 and G.Grid(143, 3).total == 1_929_213


def panel(rng, dates=70, names=12, k=4):
    rows = []
    for t in range(dates):
        for i in range(rng.integers(3, names)):
            v = rng.integers(0, 5, k + 1).astype(float)  # many ties
            if t % 7 == 0:
                v[1] = v[0]  # two signals alike
            if t % 11 == 0:
                v[2] = 1.0  # a signal that doesn't vary
            rows.append((f"n{i}", t, *(None if rng.random() < 0.02 else float(x) for x in v)))
    return rows


@pytest.fixture(scope="module")
def ranked(spark):
    rows = panel(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "id string, t int, a double, b double, c double, e double, y double").withColumn("d", F.date_add(F.lit("2001-01-01").cast("date"), F.col("t")))
    return rows, G.ranked(df.repartition(5), ["a", "b", "c", "e"], "y", 5)


def direct(rows):
    """date number -> (names x signals, outcome) ranks less their means."""
    out = {}
    for t in sorted({r[1] for r in rows}):
        own = np.array([r[2:] for r in rows if r[1] == t and None not in r], float)
        if len(own) >= 5:
            z = np.stack([average_ranks(c) for c in own.T], 1)
            out[t] = z - z.mean(0)
    return out


def correlation(x, y):
    return float(x @ y / math.sqrt((x @ x) * (y @ y))) if (x @ x) > 1e-9 and (y @ y) > 1e-9 else None


def test_correlations_and_partial_correlations_equal_a_direct_computation(spark, ranked):
    rows, z = ranked
    want = direct(rows)
    g = G.Grid(4, 3, chunk=7)
    grams = G.grams(z).withColumn("block", F.floor(F.datediff("d", F.lit("2001-01-01").cast("date")) / 10))
    for factors, least in ((None, 0.0), ([0, 1], 1e-9), ([0, 1, 2], 1e-9)):  # 0 and 1 alike on some dates, 2 without variance on others
        got = {(r.block, r["first"]): (np.frombuffer(r.sums), np.frombuffer(r.counts)) for r in G.blocks_against_grid(grams, g, 5, "block", factors=factors, least=least).collect()}
        for first, n, d in g.chunks():
            signals, signs = g.unrank(np.arange(first, first + n), d)
            for block in {t // 10 for t in want}:
                for at in range(n):
                    values = []
                    for t, m in want.items():
                        if t // 10 != block:
                            continue
                        x, y = m[:, signals[at]] @ signs[at], m[:, -1]
                        if factors:
                            f = m[:, factors]
                            x, y = (v - f @ np.linalg.lstsq(f, v, rcond=1e-9)[0] for v in (x, y))
                        c = correlation(x, y)
                        values += [] if c is None else [c]
                    sums, counts = got[block, first]
                    assert counts[at] == len(values) and abs(sums[at] - sum(values)) < 1e-6


def test_selection_in_replicas_equals_a_loop(spark):
    """Signs of blocks, train and test sets, the best N over several chunks, and the rank decay."""
    rng = np.random.default_rng(6)
    blocks, g = 24, G.Grid(6, 2, chunk=11)
    sums, counts = rng.normal(size=(blocks, g.total)), rng.integers(0, 22, (blocks, g.total)).astype(float)
    sums[counts == 0] = 0
    rows = [(b, first, sums[b, first : first + n].tobytes(), counts[b, first : first + n].tobytes()) for b in range(blocks) for first, n, _ in g.chunks()]
    df = spark.createDataFrame([(b, f, bytearray(s), bytearray(c)) for b, f, s, c in rows], "block long, first long, sums binary, counts binary").repartition(3)
    folds = grid.walk_forward(blocks)
    assert len(folds) == grid.FOLDS and all(not (a * b).any() and a[: int(np.argmax(b)) - 1].all() and not a[int(np.argmax(b)) - 1] for a, b in folds)
    signs = grid.block_signs(4, np.arange(blocks))
    assert set(np.unique(signs)) == {-1.0, 1.0} and (signs[0] == 1).all()
    chosen = {(r.rep, r.fold): [x.c for x in r.best] for r in grid.selections(df, blocks, folds, 5, 4).collect()}
    decay = {r.fold: r.decay for r in grid.rank_decay(df, folds).collect()}
    for rep in range(5):
        for f, (train, test) in enumerate(folds):
            mean = lambda w: ((w * signs[rep])[:, None] * sums).sum(0) / (w[:, None] * counts).sum(0)  # noqa: E731, B023
            a, b = mean(train), mean(test)
            assert chosen[rep, f] == sorted(range(g.total), key=lambda c: (round(-abs(a[c]), 9), c))[:5]
            if rep == 0:
                assert abs(decay[f] - np.corrcoef(average_ranks(a), average_ranks(b))[0, 1]) < 1e-9


def test_purged_splits_keep_a_block_between():
    splits = grid.purged(24)
    assert len(splits) == 15
    for train, test in splits:
        assert test.sum() == 8 and not any(train[i] and (test[max(i - 1, 0)] or test[min(i + 1, 23)] or test[i]) for i in range(24))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_ranks_and_tiles_over_several_ranges(spark, by):
    """Ties over borders, null keys, groups smaller than the tiles."""
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 50 == 7 else int(i) % 3, int(rng.integers(0, 4))) for i in range(600)] + [(1000, 9, 1), (1001, 9, 1)]
    df = spark.createDataFrame(rows, "i long, g int, v int").repartition(7)
    got = ranks.numbered(df, [F.desc("v"), F.col("i")], by, total="n").withColumn("tile", ranks.tile("rn", "n", 7)).collect()
    assert df.rdd.getNumPartitions() > 1
    for key in {r.g for r in got} if by else {0}:
        own = sorted((r for r in got if not by or r.g == key), key=lambda r: (-r.v, r.i))
        assert [r.rn for r in own] == list(range(1, len(own) + 1)) and {r.n for r in own} == {len(own)}
        sizes = [len(own) // 7 + (t < len(own) % 7) for t in range(7)]
        assert [r.tile for r in own] == [t + 1 for t, n in enumerate(sizes) for _ in range(n)]
    ranked = ranks.average_ranks(df, "v", by).collect()
    for r in ranked:
        own = np.array([x[2] for x in rows if not by or x[1] == r.g])
        assert r["rank"] == (own < r.v).sum() + ((own == r.v).sum() + 1) / 2


@pytest.mark.parametrize("how", ["min", "max", "sum"])
def test_running_extremes_over_blocks(spark, how):
    rng = np.random.default_rng(9)
    values = [None if rng.random() < 0.1 else int(x) for x in rng.integers(-50, 50, 100)]
    df = spark.createDataFrame(list(enumerate(values, 1)), "k long, v int").repartition(5)
    got = {r.k: r.o for r in ranks.running(df, "k", "v", how, "o", span=8).collect()}
    for k in range(1, 101):
        own = [v for v in values[:k] if v is not None]
        assert got[k] == ({"min": min, "max": max, "sum": sum}[how](own) if own else None)


def test_exponential_mean_of_a_long_history(spark):
    """Weights restart before they overflow, and nothing of the stretch before is lost."""
    n = 15_000
    df = spark.range(n).select(F.lit("a").alias("id"), (F.col("id") + 1).cast("double").alias("t"), (F.col("id") % 7).cast("double").alias("x"))
    got = {int(r.t): r.e for r in df.withColumn("e", R.ewm("x", "t", 10, ["id"])).collect()}
    top = below = 0.0
    for t in range(1, n + 1):
        top, below = top * 2**-0.1 + (t - 1) % 7, below * 2**-0.1 + 1
        assert abs(got[t] - top / below) < 1e-9
    assert ranks.tile("a", "b", 3) is not None
