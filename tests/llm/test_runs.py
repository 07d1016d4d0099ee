"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sextant.llm import runs


def brute(words):
    """Every run: for each period the maximal stretches of equal words, those of the smallest period only."""
    n, out = len(words), {}
    for q in range(1, n // runs.TIMES + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(runs.LEAST, runs.TIMES * q):
                out.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j
    return sorted((a, b, q) for (a, b), q in out.items() if not any(all(words[k] == words[k + p] for k in range(a, a + b - p)) for p in range(1, q)))


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        words = []
        while len(words) < rng.choice([0, 3, 20, 80, 250]):
            part = [rng.choice(b"abcdefgh"[: rng.choice([2, 3, 8])].decode()) for _ in range(rng.choice([1, 2, 3, 5, 9, 16, 17]))]
            words += part * rng.choice([1, 1, 3, 4, 5, 8])
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    own = texts(seed)
    got = runs.runs_of([[w.encode() for w in t] for t in own])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t) for t in own]


def test_range_successor_equals_a_scan():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    w = runs.Wavelet(values)
    begin = rng.integers(0, 300, 500)
    end = np.minimum(300, begin + rng.integers(0, 300, 500))
    least = rng.integers(0, 301, 500)
    want = [min((int(v) for v in values[a:b] if v >= x), default=300) for a, b, x in zip(begin, end, least, strict=True)]
    assert w.successor(begin, end, least).tolist() == want


def test_long_and_hostile_texts():
    one = runs.runs_of([[b"x"] * 50_000, [b"a", b"b"] * 20_000 + [b"c"], [b"%d" % i for i in range(30_000)]])
    assert [g.tolist() for g in one] == [[[0, 50_000, 1]], [[0, 40_000, 2]], []]
    fib = [[b"a"], [b"a", b"b"]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    assert [tuple(r) for r in runs.runs_of([fib[-1][:700]])[0].tolist()] == brute(fib[-1][:700])


def test_query_digests(spark):
    own = [(i, " ".join(t)) for i, t in enumerate(texts(99))] + [(None, "a a a a a a a"), (7, None), (7, ""), (8, "é é b\nb b\tb  b b"), (1, "same same"), (1, "same same")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in own], "doc_id long, text string, runs string").repartition(3)
    got = runs.digests(docs, rewrite=runs.plant).collect()

    def want(key, text):
        words = (text or "").encode().split()
        words = words if key is None else planted(key, words)
        found = brute(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for a, b, q in found for i in range(a + q, a + b)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        return key, len(found), *top, sha("".join(f"{a},{b},{q}\n" for a, b, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))

    assert sorted(map(repr, map(tuple, got))) == sorted(repr(want(*r)) for r in own)
    assert runs.digests(docs.limit(0)).count() == 0
    texts_of = {r.doc_id: (r.collapsed, len(r.runs)) for r in runs.detect(docs).where("doc_id IS NULL").collect()}
    assert texts_of == {None: ("a", 1)}
