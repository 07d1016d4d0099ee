"""Chosen-path join: recall by brute force over the whole range of similarities, hot buckets, several chunks, components."""

import random
from collections import Counter

import numpy as np
import pytest

from sextant.llm import graph, jaccard


def word(rng):
    return "".join(rng.choices("abcdefghij", k=7))


def sets_of(rows):
    return [set(jaccard.shingles(t, 5, jaccard._Hashes()).tolist()) for _, t in rows]


def brute(rows, threshold=0.8):
    """Links of each row and its class's least id."""
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links, pairs = Counter(), 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                pairs += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {rows[i][0]: (links[i], rows[top(i)][0]) for i in range(len(rows))}, pairs


@pytest.mark.parametrize("limit", [4, 128])
def test_recall_over_all_similarities(spark, limit, capsys):
    """Pairs from 0.7 to 1.0, a third of them inside a passage that all share, so that buckets split to the last depth."""
    rng = random.Random(7)
    passage, rows = [word(rng) for _ in range(110)], []
    for i in range(150):
        own = [word(rng) for _ in range(rng.randint(60, 130))]
        other = own.copy()
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(len(other))] = word(rng)
        shared = passage if i % 3 == 0 else []
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + other))]
    want, pairs = brute(rows)
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()}
    found = sum(n for n, _ in got.values()) / 2
    with capsys.disabled():
        print(f" recall {found / pairs:.4f} of {pairs} pairs (limit {limit})", end="")
    assert found >= 0.99 * pairs and all(got[k][0] <= want[k][0] for k in want)
    if found == pairs:
        assert got == want


def test_a_class_of_several_chunks_and_hot_buckets(spark, monkeypatch):
    """Near copies of one text: one class in chunks of 8, buckets hotter than the bound, links as brute force counts them."""
    rng = random.Random(8)
    base = [word(rng) for _ in range(90)]
    rows = []
    for i in range(60):
        own = base.copy()
        own[rng.randrange(90)] = word(rng)
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(word(rng) for _ in range(40))) for i in range(20)] + [(200, rows[0][1]), (201, rows[0][1])]
    want, _ = brute(rows)
    whole = jaccard.candidate_links
    monkeypatch.setattr(jaccard, "candidate_links", lambda sets, threshold, limit: whole(sets, threshold, limit, hot=10))
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), limit=16, block=8).collect()}
    assert got == want


def test_runs_reach_the_target_at_the_last_depth():
    for recall in (0.9, 0.99, 0.9999):
        runs = jaccard.runs_for(0.8, recall)
        assert (1 - 0.8 ** (jaccard.DEPTH + 1)) ** runs <= 1 - recall + 1e-12


def test_components_of_a_star_and_a_chain(spark):
    star, chain = [(0, i) for i in range(1, 400)], [(1000 + i, 1001 + i) for i in range(300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(star + chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(400)}, **{1000 + i: 1000 for i in range(301)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(chain, "a long, b long"), rounds=2)


def test_shingles():
    h = jaccard._Hashes()
    assert len(jaccard.shingles("a b c", 5, h)) == 1 and len(jaccard.shingles("a b c d e f", 5, h)) == 2 and not len(jaccard.shingles(None, 5, h))
    assert np.array_equal(jaccard.shingles("A b\tC d  e", 5, h), jaccard.shingles("a b c d e", 5, h))
