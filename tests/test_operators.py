import datetime as dt
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sextant.operators import rows as R  # noqa: E402
from sextant.operators import timejoin as T  # noqa: E402

day = dt.date


def test_asof_takes_the_equal_time_unless_strict(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y")], "k string, rt int, v string")
    got = {(r.k, r.t): r.v for r in T.asof_join(left, right, ["k"], "t", "rt").collect()}
    assert got == {("a", 5): "x", ("a", 1): None, ("b", 9): None}
    strict = {(r.k, r.t): r.v for r in T.asof_join(left, right, ["k"], "t", "rt", strict=True).collect()}
    assert strict[("a", 5)] == "y"
    forward = {(r.k, r.t): r.v for r in T.asof_join(left, right, ["k"], "t", "rt", direction="forward", strict=True).collect()}
    assert forward == {("a", 5): None, ("a", 1): "y", ("b", 9): None}


def test_islands_and_interval_union(spark):
    x = spark.createDataFrame([("k", 1, "A"), ("k", 2, "A"), ("k", 3, "B"), ("k", 4, "A")], "k string, i int, s string")
    got = sorted((r.s, r.valid_from, r.valid_to) for r in T.islands(x, ["k"], "i", "s").collect())
    assert got == [("A", 1, 3), ("A", 4, None), ("B", 3, 4)]
    spans = spark.createDataFrame([("k", 1, 5), ("k", 2, 3), ("k", 5, 8), ("k", 10, 11)], "k string, s int, e int")
    assert sorted((r.s, r.e) for r in T.merge_overlaps(spans, ["k"], "s", "e").collect()) == [(1, 8), (10, 11)]


def test_decluster_is_greedy(spark):
    x = spark.createDataFrame([("k", i) for i in (0, 10, 20, 30, 41, 50)], "k string, i long")
    assert sorted(r.i for r in R.decluster(x, ["k"], "i", 21, ["k", "i"]).collect()) == [0, 30]


def test_roots_follow_chains_and_leave_cycles(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (8, 9), (9, 8)], "c long, p long")
    got = {r.c: r.root for r in R.transitive_roots(e, "c", "p").collect()}
    assert got == {5: 1, 4: 1, 3: 1, 8: None, 9: None}


def test_leave_one_out_is_null_alone(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "c string, v double")
    assert {(r.c, r.v): r.peer_mean for r in R.leave_one_out(x, ["c"], "v").collect()} == {("a", 1.0): 3.0, ("a", 3.0): 1.0, ("b", 7.0): None}


def test_same_tokens_counts_each_token(spark):
    names = ["small blue box", "blue small box", "blue small box", "blue blue box", "blue box box", "box", None]
    got = R.same_tokens(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert [tuple(r) for r in got.collect()] == [("blue small box", "small blue box")]


def test_decluster_streams_and_keeps_rows_of_one_index(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("a", 5, 3), ("a", 21, 4), ("a", 41, 5), ("a", 42, 6), ("b", 7, 7), (None, 3, 8), (None, 4, 9), ("c", None, 10)]
    x = spark.createDataFrame(rows, "k string, i long, v long")
    got = sorted((r.k or "", r.i, r.v) for r in R.decluster(x, ["k"], "i", 21, ["k", "i", "v"]).collect())
    assert got == [("", 3, 8), ("a", 0, 1), ("a", 0, 2), ("a", 21, 4), ("a", 42, 6), ("b", 7, 7)]


def test_trailing_distinct(spark):
    rows = [("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 4, 3), ("a", 9, 1), ("b", 1, 1)]
    got = sorted((r.k, r.i, r.n) for r in R.trailing_distinct(spark.createDataFrame(rows, "k string, i long, who long"), ["k"], "i", "who", 4).collect())
    assert got == [("a", 1, 2), ("a", 2, 2), ("a", 4, 3), ("a", 9, 1), ("b", 1, 1)]


def test_correlation_without_variance_is_null(spark):
    from sextant.functions.numbers import correlation, half_up

    x = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 4.0), (3, None, 9.0), (4, None, 1.0)], "k long, a double, b double")
    got = {r.k: r.c for r in x.groupBy("k").agg(correlation("a", "b").alias("c")).collect()}
    assert got[1] is None and got[2] is None and got[4] is None and abs(got[3] - 1) < 1e-12
    assert [r.h for r in spark.createDataFrame([(0.125,), (-0.125,), (2.0,)], "x double").select(half_up(F.col("x"), 2).alias("h")).collect()] == [0.13, -0.12, 2.0]


def test_expire_removes_old_intermediates(spark):
    from sextant.core import shared

    kept = shared.materialise(spark.range(3), "kept")
    gone = shared.materialise(spark.range(3), "gone")
    shared.release(gone)
    assert kept.count() == 3 and kept._sextant_path.rsplit("/", 1)[1] not in shared.expire(spark, 1.0)
    assert kept._sextant_path.rsplit("/", 1)[1] in shared.expire(spark, -1.0)
