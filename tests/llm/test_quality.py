"""PU classifier: gradients of the risk by differences, the prior, training on tables with edge rows, held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import quality, queries
from sextant.llm.words import crc_of_id, least_hashed

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = quality.Network(5, 4, 3)
    x, g = rng.normal(size=(7, 5)), rng.normal(size=7)
    value = lambda: float((net.forward(x)[2] * g).sum())
    z, h, _ = net.forward(x)
    for w, got in zip(net.w, net.gradient(z, h, g), strict=True):
        for i in np.ndindex(w.shape):
            old, step = w[i], 1e-6
            w[i] = old + step
            up = value()
            w[i] = old - step
            down = value()
            w[i] = old
            assert got[i] == pytest.approx((up - down) / (2 * step), abs=1e-6)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_and_fit_without_negatives(share):
    rng = np.random.default_rng(4)
    draw = lambda n, at: rng.normal(at, 0.5, (n, 6))
    p, n = draw(2000, 1), draw(4000, -1)
    u = np.concatenate([draw(int(4000 * share), 1), n[: int(4000 * (1 - share))]])
    prior = quality.prior_without_negatives(p, u)
    assert abs(prior - share) < 0.08
    net = quality.fit_pu(p, u, prior, steps=200)
    assert (net.score(draw(500, 1)) > 0.3).mean() > 0.95 and (net.score(draw(500, -1)) < 0.3).mean() > 0.95


def test_content_speaks_where_shapes_are_equal(spark):
    """Good and bad texts differ in nothing but their words."""
    rng = np.random.default_rng(5)
    made = lambda kind, i: " ".join(f"{kind if rng.random() < 0.5 else 'x'}{rng.integers(100, 200)}" for _ in range(60))
    rows = [(i, made("g" if i % 3 else "b", i)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = quality.train(docs, docs.where("doc_id % 3 > 0 AND doc_id < 450").select("doc_id"), docs.where("doc_id < 700").select("doc_id"))
    got = {r.doc_id: r.score for r in quality.score(docs.where("doc_id >= 700"), net).collect()}
    assert np.mean([(s >= 0.3) == bool(i % 3) for i, s in got.items()]) > 0.95


def test_edge_tables(spark):
    rows = [(1, "good words here and there", 0), (1, "other text of the same id", 0), (2, "", 0), (None, None, 0), (3, "bad !!! $$$", 0), (3, "bad !!! $$$", 0), (4, "long " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    net = quality.train(docs, ids(1, 4), ids(1, 2, 3, 4))
    again = quality.train(docs.repartition(5), ids(4, 1), ids(4, 3, 2, 1))
    got = quality.score(docs, net).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert all(np.allclose(a, b) for a, b in zip(net.w, again.w, strict=True))
    assert {r.score for r in quality.score(docs, quality.train(docs, ids(99), ids(1, 2))).collect()} == {0.5}
    assert quality.train(docs.limit(0), ids(1), ids(2)) is None and quality.score(docs.limit(0), net).count() == 0


def test_held_out_labels(spark):
    got = queries.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got[got.quality == 1].score.min() > got[got.quality == 0].score.max()
    nulls = spark.createDataFrame([(None,)], "doc_id long").select(F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("h")).first()
    assert nulls.h is False


def test_least_hashed_is_bounded_and_stable(spark):
    rows = spark.createDataFrame([("a",)] * 500 + [(f"t{i}",) for i in range(300)], "text string")
    first = {r.text for r in least_hashed(rows, ["text"], 40).collect()}
    assert 1 <= len(first) <= 40 and first == {r.text for r in least_hashed(rows.repartition(9), ["text"], 40).collect()}
    assert least_hashed(rows.limit(0), ["text"], 40).count() == 0
