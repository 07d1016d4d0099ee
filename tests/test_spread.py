"""Operators that split a hot key, closures and replaced sets, each against a loop or its plain form."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sextant.core.shared import new_path
from sextant.operators import rows as R
from sextant.operators import timejoin as T
from sextant.sources import files as S
from sextant.streaming import increments


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_one_key_in_many_ranges_equals_the_whole_window(spark, direction, strict):
    rng = random.Random(5)
    left = spark.createDataFrame([(k, rng.randint(0, 400), i) for i in range(500) for k in ("hot", "hot", rng.choice(["a", "b", None]))], "k string, t int, row int")
    right = spark.createDataFrame([("hot", t, f"r{t}") for t in rng.sample(range(400), 25)] + [("a", 3, "a3"), (None, 7, "n7")], "k string, at int, what string")
    how = {"direction": direction, "strict": strict}
    plain = T.asof_join(left, right, ["k"], "t", "at", **how)
    split = T.asof_join(left, right, ["k"], "t", "at", spread=True, **how)
    assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))
    parts = left.where("k = 'hot'").repartitionByRange(4, "k", "t").select(F.spark_partition_id()).distinct().count()
    assert parts == 4
    inner = T.asof_join(left, right, ["k"], "t", "at", how="inner", spread=True, **how)
    assert inner.count() == plain.where("at IS NOT NULL").count()


@pytest.mark.parametrize("spread", [False, True])
def test_declustering_equals_the_greedy_loop(spark, spread):
    rng = random.Random(6)
    rows = [(k, rng.randint(0, 3000), rng.choice("xy")) for k, n in (("hot", 400), ("a", 7), (None, 30), ("one", 1)) for _ in range(n)] + [("hot", None, "x")]
    got = R.decluster(spark.createDataFrame(rows, "k string, i long, v string").repartition(5), ["k"], "i", 21, ["k", "i", "v"], spread=spread).collect()
    want = set()
    for key in {r[0] for r in rows}:
        last = None
        for i in sorted({r[1] for r in rows if r[0] == key and r[1] is not None}):
            if last is None or i - last >= 21:
                last = i
                want |= {r for r in rows if r[0] == key and r[1] == i}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_names_two_edits_apart_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["maria hansen", "mario hanson", "a", "ab", "", "abc", "prefix one", "prefix two", "prefix six"]
    for _ in range(60):
        x = list(rng.choice(base) or "q")
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.choice([0, 1])] = rng.choice(["", "e", "zz"])
        base.append("".join(x))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    names = sorted(set(base))
    got = {(r.a, r.b): r.distance for r in R.within_two_edits(spark.createDataFrame([(n,) for n in [*base, None]], "name string"), "name").collect()}
    assert got == {(a, b): distance(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if distance(a, b) <= 2}


def test_a_diamond_counts_an_ancestor_once_and_cycles_end(spark):
    edges = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "root"), ("x", "p"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "s"), (None, "a"), ("d", "b")]
    got = {(r.child, r.ancestor): r.steps for r in R.closure(spark.createDataFrame(edges, "child string, parent string"), "child", "parent").collect()}
    of = lambda k: {a: n for (c, a), n in got.items() if c == k}
    assert of("d") == {"b": 1, "c": 1, "a": 2, "root": 3}
    assert of("x") == {"p": 1, "q": 2, "r": 3} and of("p") == {"q": 1, "r": 2, "p": 3} and of("s") == {"s": 1}
    down = {(r.parent, r.ancestor) for r in R.closure(spark.createDataFrame(edges, "child string, parent string"), "parent", "child").collect()}
    assert down == {(a, c) for c, a in got}
    ladder = [(f"{i}{x}", f"{i + 1}{y}") for i in range(25) for x in "ab" for y in "ab"]  # 2 ** 25 paths
    assert R.closure(spark.createDataFrame(ladder, "child string, parent string"), "child", "parent").count() == 2 * sum(2 * (25 - i) for i in range(25))
    with pytest.raises(RuntimeError):
        R.closure(spark.createDataFrame([(i, i + 1) for i in range(6)], "child int, parent int"), "child", "parent", rounds=3).count()


def test_a_failed_step_leaves_the_set_that_stands(spark, monkeypatch):
    path, schema = new_path(spark, "set"), "k string, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    held = lambda: sorted((r.k, r.v) for r in S.read_replaced(spark, path, rows().schema).collect())
    assert held() == []
    S.replace_partitioned(rows(("a", 1), ("b", 2)), path, ["k"])
    monkeypatch.setattr(S, "point_to", lambda *a: (_ for _ in ()).throw(OSError("rename failed")))
    with pytest.raises(OSError, match="rename"):
        S.replace_partitioned(rows(("c", 3)), path, ["k"])
    monkeypatch.undo()
    assert held() == [("a", 1), ("b", 2)]
    S.replace_partitioned(S.read_replaced(spark, path, rows().schema).where("v = 2"), path, ["k"])  # reads the set that it replaces
    assert held() == [("b", 2)]
    S.replace_partitioned(rows(), path, ["k"])
    assert held() == []


def test_an_append_reads_no_history(spark):
    """Rows of batches before may be gone; the list of days is what an append needs."""
    path = new_path(spark, "sessions")
    day = lambda *ns: spark.createDataFrame([(datetime.date(2024, 1, n), float(n)) for n in ns], "d date, x double")
    increments.append_sessions(day(1, 2), path, 0)
    fs, target = S._fs(spark, f"{path}/_batch=0")
    fs.delete(target, True)
    increments.append_sessions(day(2, 3), path, 1)
    assert [r.d.day for r in spark.read.parquet(f"{path}/_batch=1").collect()] == [3]
    with pytest.raises(increments.LateSession):
        increments.append_sessions(spark.createDataFrame([(datetime.date(2023, 12, 31), 0.0)], "d date, x double"), path, 2)
