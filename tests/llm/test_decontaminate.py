"""Benchmark matching against full dynamic programming, short items, string ids, repeats, empty tables and long texts."""

import random
from collections import Counter

import pytest

from sextant.llm import decontaminate as d


def nearest(item, text, limit):
    """Least edit distance of the item to any substring and the first end of such a place, by the full matrix."""
    column = list(range(len(item) + 1))
    best = (column[-1], 0)
    for at, ch in enumerate(text, 1):
        new = [0]
        for i, c in enumerate(item, 1):
            new.append(min(column[i - 1] + (c != ch), column[i] + 1, new[-1] + 1))
        column = new
        best = min(best, (column[-1], at))
    return best if best[0] <= limit else None


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[at] = rng.choice("abxyz ")
        elif kind < 0.7:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abxyz"))
    return "".join(chars)


def word(rng):
    return "".join(rng.choices("abcdefg", k=rng.randint(2, 6)))


def test_hits_equal_dynamic_programming():
    rng = random.Random(2)
    items = [(i, d.normal(" ".join(word(rng) for _ in range(rng.randint(6, 30))))) for i in range(25)]
    matcher = d.Matcher(items, 0.1, 12, 3)
    for _ in range(120):
        i, item = rng.choice(items)
        k = d.budget(len(item), 0.1, 12)
        text = d.normal(" ".join([*(word(rng) for _ in range(20)), edited(rng, item, rng.randint(0, k + 1)), *(word(rng) for _ in range(20))]))
        got = {key: (distance, end) for key, distance, end in matcher.hits(text)}
        for key, other in items:
            limit = d.budget(len(other), 0.1, 12)
            want = nearest(other, text, limit)
            if limit or want is None:
                assert got.get(key) == want, (key, want, got.get(key))


def test_short_items_between_word_borders(spark):
    docs = spark.createDataFrame([(1, "So the Answer is  forty two. Yes"), (2, "answer is forty two"), (3, "thisanswer is forty two."), (4, "The answer"), (5, "the answer, they say"), (None, "xx answer is forty two. yy"), (1, "So the Answer is  forty two. Yes"), (6, None), (7, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("q1", "answer is forty two.", 0), ("q2", "the answer", 0), ("q3", None, 0), ("q4", "  ", 0), (None, "answer is forty two.", 0), ("q5", "answer is forty two.", 0)], "item_id string, text string, distance int")
    got = Counter((r.doc_id, r.item_id, r.distance, r.end_at) for r in d.find(docs, bench).collect())
    want = Counter({(4, "q2", 0, 10): 1})
    for q in ("q1", "q5"):
        want.update({(1, q, 0, 27): 2, (None, q, 0, 23): 1})
    assert got == want
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [2, 3, 5, 6, 7]
    assert d.find(docs, bench.limit(0)).count() == 0 == d.find(docs.limit(0), bench).count()
    assert d.clean(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_chars", [1, 4_000_000])
def test_tables_equal_brute_force(spark, block_chars):
    rng = random.Random(3)
    items = [(i, " ".join(word(rng) for _ in range(rng.randint(8, 25)))) for i in range(6)]
    rows = [(j, " ".join([*(word(rng) for _ in range(rng.randint(0, 40))), edited(rng, rng.choice(items)[1], rng.randint(0, 12)) if j % 2 else "", *(word(rng) for _ in range(10))])) for j in range(40)]
    rows.append((99, "pad " * 60_000 + items[0][1] + " pad" * 10))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for j, text in rows:
        text = d.normal(text) if j != 99 else d.normal(text)[-1000:]
        for i, item in items:
            best = nearest(d.normal(item), text, d.budget(len(d.normal(item)), 0.1, 12))
            if best:
                want.add((j, i, best[0]))
    assert {(r.doc_id, r.item_id, r.distance) for r in d.find(docs, bench, block_chars=block_chars).collect()} == want
    assert {r.doc_id for r in d.clean(docs, bench, block_chars=block_chars).collect()} == {j for j, _ in rows} - {j for j, _, _ in want}
