"""Bottom-k groups against all exact similarities: near copies, hot lists, large classes, nulls."""

import random

import numpy as np
import pytest

from sextant.llm import bottomk


def words(text):
    return (text or "").encode().lower().split()


def pairs_of(text):
    w = words(text)
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def brute(rows):
    """id, n_shingles, component_id, kept by comparing all pairs on word pairs themselves."""
    sets = [pairs_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(top(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        known = [k for k in least[top(i)] if k is not None]
        component = min(known) if known else None
        out.append((key, len(sets[i]), component, key == component))
    return out


def word(rng, letters="abcdefghij", k=6):
    return "".join(rng.choices(letters, k=k))


def corpus(seed):
    rng = random.Random(seed)
    common = [word(rng) for _ in range(12)]
    passage = [word(rng) for _ in range(60)]
    rows = []
    for i in range(120):  # pairs around the threshold, many of common words, a third with a shared passage
        own = [rng.choice(common) if rng.random() < 0.5 else word(rng) for _ in range(rng.randint(1, 120))]
        other = own.copy()
        for _ in range(rng.randint(0, 1 + len(own) // 12)):
            other[rng.randrange(len(other))] = rng.choice([word(rng), rng.choice(common)])
        shared = passage if i % 3 == 0 else []
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + other))]
    rows += [(1000 + i, " ".join(rng.choice(common) for _ in range(rng.randint(2, 12)))) for i in range(150)]
    rows += [(None, "A b"), (None, "a  B"), (5, None), (6, ""), (7, "one"), (8, "One"), (9, " \n"), (3, rows[4][1]), (3, rows[4][1]), (None, rows[8][1])]
    return rows


def result(spark, rows, **limits):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string").repartition(3)
    return sorted(map(repr, map(tuple, bottomk.grouped(docs, **limits).collect())))


@pytest.mark.parametrize("limits", [{}, {"limit": 4, "hot": 12, "block": 6}])
def test_components_equal_brute_force(spark, limits):
    rows = corpus(4)
    assert result(spark, rows, **limits) == sorted(map(repr, brute(rows)))


def test_a_large_class_with_members_beyond_the_pivot(spark):
    """Near copies of one text with many or few edits, a chain of them, and others of the same words: pivots, then open blocks."""
    rng = random.Random(9)
    base = [word(rng) for _ in range(100)]
    rows = []
    for i in range(150):
        own = base.copy()
        for _ in range(rng.choice([1, 2, 6, 9, 14])):
            own[rng.randrange(100)] = word(rng)
        rows.append((i, " ".join(own)))
    step = base.copy()
    for i in range(30):
        step = step.copy()
        step[3 * i] = word(rng)
        step[3 * i + 1] = word(rng)
        rows.append((200 + i, " ".join(step)))
    assert result(spark, rows, limit=16, hot=40, block=16) == sorted(map(repr, brute(rows)))
    assert result(spark, rows) == sorted(map(repr, brute(rows)))


def test_a_long_list_that_is_no_chunk_makes_no_rows(spark):
    """600 unlike sets with one value in common and a pair at the threshold: before, all of them went on in lists of their next values."""
    rng = np.random.default_rng(5)
    sketches = [np.concatenate([[7], rng.integers(10, 2**32, 31)]).astype("<u4") for _ in range(600)]
    sketches[411][1:] = np.concatenate([sketches[20][1:30], sketches[411][30:]])
    rows = [(7, None, i.to_bytes(16, "big"), 32, s.tobytes(), 32, 0) for i, s in enumerate(sketches)]
    lists = lambda chunk: spark.createDataFrame([(k, chunk, *r) for k, _, *r in rows], "key long, chunk long, set binary, n long, sketch binary, known int, at int")
    got = bottomk.walk_lists(lists(None), 128, 0.8).collect()
    assert all(r.a is not None for r in got)
    assert {int.from_bytes(x, "big") for r in got for x in (r.a, r.b)} == {20, 411}
    assert sum(r.a is None for r in bottomk.walk_lists(lists(1), 128, 0.8).collect()) == 600  # a chunk's sets meet others in theirs


def test_estimates_are_the_same_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, 40)).astype(np.uint32)[: bottomk.K] for _ in range(30)]
    sizes = np.array([len(s) + 5 for s in sets])
    whole = bottomk.estimates(sets, sizes)
    monkeypatch.setattr(bottomk, "COLUMNS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, bottomk.estimates(sets, sizes), strict=True))


def test_empty_table(spark):
    assert bottomk.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_are_exact_on_small_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, bottomk.K))).astype(np.uint32) for _ in range(40)]
    shared, union = bottomk.estimates(sets, np.array([len(s) for s in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert shared[i, j] == len(np.intersect1d(a, b)) and union[i, j] == len(np.union1d(a, b))


def test_the_ways_of_estimating_agree():
    rng = np.random.default_rng(3)
    whole = [np.unique(rng.integers(0, 400, rng.integers(1, 250))).astype(np.uint32) for _ in range(50)]
    sizes, sketches = np.array([len(w) for w in whole]), [w[: bottomk.K] for w in whole]
    shared, union = bottomk.estimates(sketches, sizes)
    near = bottomk.beside_first((sketches[0].tobytes(), int(sizes[0])), [s.tobytes() for s in sketches], sizes)
    for i, a in enumerate(sketches):
        assert i == 0 or near[i] == shared[0, i] / union[0, i]
        for j, b in enumerate(sketches):
            assert i == j or bottomk.pair_estimate(a.tobytes(), int(sizes[i]), b.tobytes(), int(sizes[j])) == (shared[i, j], union[i, j])
