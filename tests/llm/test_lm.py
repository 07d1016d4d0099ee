"""Language model: base scores by formula, normalisation, gradients by differences, held-out gain, edge tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import lm

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def test_scores_by_formula(spark):
    texts = ["a b a c", "A B\x1fx b", None, "", "zz zz qq " * 3000, "a b a c", "É a É b", "long" * 40, "c " * 70]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "a new b", 1.0), (3, "b b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base_score double")
    train = docs.where("doc_id % 2 = 0")
    c = Counter(w for i, t, _ in rows if i is not None and i % 2 == 0 for w in words(t))
    n, v = sum(c.values()), len(c)
    for head in (2, 1000):
        got = lm.score(docs, lm.train(train, head=head, share=0.02, classes=4)).collect()
        want = Counter()
        for i, t, _ in rows:
            w = words(t)
            want[i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_tables_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(docs, lm.train(docs.limit(0), classes=4)).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got] == [(0, 0, 0), (0, 0, 0)] and all(math.isfinite(r.score) for r in got)
    assert lm.score(docs.limit(0), lm.train(docs, classes=4)).count() == 0


def test_whole_contexts_are_learnt_from_every_text(spark):
    """More texts than the sample of 1,500 that was learnt from before, in tasks of their own."""
    docs = spark.range(1_700).select(F.col("id").alias("doc_id"), F.format_string("a%d b c%d a%d", F.col("id"), F.col("id") % 7, F.col("id") % 50).alias("text")).repartition(5)
    model = lm.train(docs, share=0.02, classes=4)
    assert model.learnt == model.vocabulary.n == 5 * 1_700 and np.isfinite(model.flat).all()
    score, base = lm.score(docs, model).agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_texts_of_few_batches_are_gone_over_again_and_others_once():
    known = lm.Vocabulary({}, {lm.END: 0, b"a": 1, b"b": 2}, 2, 60, 3, np.ones(2), np.array([20.0, 20, 20, 0, 0]))
    rows, start = [(np.array([1, 2, 0], known.kind).tobytes(),)] * 20, lm.LogBilinear(known.often).flat
    once, twice = (lm.learn(iter(rows), known, start, steps=k) for k in (1, 2))
    assert once[0] == twice[0] == 60 and not np.array_equal(once[1], twice[1])


@pytest.mark.parametrize("m", [1, 2, 7, 30])
def test_log_probs_are_normalised(m):
    rng = np.random.default_rng(m)
    model = lm.LogBilinear(rng.integers(0, 50, m).astype(float))
    model.flat += rng.normal(0, 0.5, len(model.flat)).astype(np.float32)
    assert np.allclose(np.exp(model.table(rng.integers(0, m, (20, lm.CONTEXT)))).sum(1), 1, atol=1e-5)


def test_contexts_end_where_texts_begin():
    assert lm.contexts(np.array([5, 6, 7, 0, 8, 0]), np.array([0, 4])).tolist() == [[0, 0, 0], [5, 0, 0], [6, 5, 0], [7, 6, 5], [0, 0, 0], [8, 0, 0]]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = lm.LogBilinear(rng.integers(1, 100, 30).astype(float))
    h, w, noise = rng.integers(0, 30, (60, lm.CONTEXT)), rng.integers(0, 30, 60), model.draw(rng)
    grad = model.gradients(h, w, *noise)

    def loss(i, by):
        model.flat[i] += by
        parts: list[float] = []
        model.gradients(h, w, *noise, parts)
        model.flat[i] -= by
        return sum(parts) / len(w)

    for i in rng.integers(0, len(grad), 40):
        assert grad[i] == pytest.approx((loss(i, 1e-2) - loss(i, -1e-2)) / 2e-2, abs=2e-4)


def test_held_out_text_is_likelier_than_under_the_base_and_with_one_position(spark, monkeypatch):
    docs = spark.read.parquet(DOCUMENTS)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    total = lambda model: lm.score(docs.where(held_out), model).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    model = lm.train(docs.where(~held_out))
    score, base = total(model)
    one = lm.Model(model.vocabulary, model.counts, model.flat.copy())
    one.bilinear().views(one.flat)["c"][1:] = 0
    assert score > base + 0.2 and score > total(one)[0] + 0.01
