"""Findings of a review: each case failed before."""

import datetime
import random
from pathlib import Path

import duckdb

from sextant.operators import ranks
from sextant.plans import catalog, load  # noqa: F401
from sextant.plans import basics, formats


def files(path: str) -> list[Path]:
    return [p for p in Path(path.removeprefix("file://")).rglob("part-*") if p.is_file()]


def test_json_files_follow_rows_not_users(spark, tmp_path, monkeypatch):
    """40 users with 3 events each, far ids: files of 50 events at most, both forms, not one a user."""
    rows = [(None if i == 7 else 10**6 * i, None if i == 9 else i % 40, "ab"[i % 2], float(i)) for i in range(120)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(formats, "JSON_ROWS", 50)
    made = []
    monkeypatch.setattr(formats, "new_path", lambda s, what: made.append(f"file://{tmp_path}/{what}") or made[-1])
    got = {r.event_type: (r.n, r.total, r.users) for r in catalog.queries()["s04_json_arrays"](spark, str(tmp_path)).collect()}
    of = {k: [r for r in rows if r[2] == k] for k in "ab"}
    assert got == {k: (len(v), sum(r[3] for r in v), len({r[1] for r in v if r[1] is not None})) for k, v in of.items()}
    assert 2 <= len(files(made[0])) <= 6


def test_odd_balances_equal_sql(spark, tmp_path):
    name = "f13_number_text"
    odd = [-0.0, 0.0, -0.001, 0.125, 2.675, 1.2345678901234568e21, -1e15 - 0.375, float("nan"), float("inf"), float("-inf"), None, -999.85, 12.5]
    rows = [(5 * i + k, x) for i, x in enumerate(odd) for k in range(5)] + [(None, 3.5)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in catalog.queries()[name](spark, str(tmp_path)).collect())


def test_equal_newest_deals_give_the_same_row_in_any_order(spark, tmp_path, monkeypatch):
    """Deals of one participant, day, order and line: whatever order they come in."""
    tied = [(1, s, datetime.date(2000, 1, 1), q, 9, 1) for s, q in ((7, 5.0), (3, 8.0), (3, 2.0), (5, 1.0))]
    got = set()
    for rows in (tied, tied[::-1], tied[2:] + tied[:2]):
        x = spark.createDataFrame(rows, "participant long, security long, d date, qty double, deal_key long, deal_line int").coalesce(1)
        monkeypatch.setattr(basics, "deals", lambda *a, x=x: x)
        got |= {tuple(r) for r in catalog.queries()["w11_newest_per_key"](spark, "").collect()}
    assert got == {tied[2]}


def test_quantiles_are_exact_and_no_task_holds_all_values(spark):
    rng = random.Random(8)
    many = [round(rng.uniform(-100, 100), 2) for _ in range(3000)]
    for values in (many, many + [7.5] * 4000 + [None] * 9, [3.0], [1.0, 2.0], [float("inf")] * 3 + [0.0], [None]):
        x = spark.createDataFrame([(v,) for v in values], "v double")
        at = {"a": 0.01, "b": 0.99, "c": 0.5, "z": 0.0, "m": 1.0}
        got = ranks.quantiles(x, "v", at).collect()
        held = duckdb.connect()
        held.execute("CREATE TABLE t (v DOUBLE)")
        held.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
        want = held.execute(f"SELECT {', '.join(f'quantile_cont(v, {q})' for q in at.values())} FROM t").fetchone()
        assert len(got) == 1 and all(a == b or abs(a - b) < 1e-9 for a, b in zip(got[0], want, strict=True)), (got, want)
    plan = catalog.queries()["p19_winsorise"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_mistyped_keys_meet_few_others_and_count_like_sql(spark, tmp_path):
    """4,000 customers of one nation, one of them twice, orders of a repeated key: as SQL counts, and few rows leave the join."""
    rows = [(k, -3 if k % 9 == 0 else 1) for k in range(4000)] + [(17, 1), (5000, None)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(o, o % 4000) for o in range(3000)] + [(5, 5), (6, 77), (9000, 5000), (9001, 17), (9002, 17)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["j28_mistyped_keys"]).fetchall()
    got = catalog.queries()["j28_mistyped_keys"](spark, str(tmp_path))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    node, joined = got._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            p = p.executedPlan()
        if "QueryStage" in p.nodeName():
            p = p.plan()
        if "Join" in p.nodeName():
            joined.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(node)
    assert joined and max(joined) < 20_000


def test_deals_are_written_once_and_joined_in_no_later_plan(spark):
    """Disk: the result's plan reads what was written by security or key, lineitem is not joined in it again."""
    for name, exchanges in (("d13_clean_mart", 1), ("d18_exit_pricing", 1)):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and plan.count("RepartitionByExpression") == exchanges, plan


def test_a_materialisation_leaves_no_shuffle_files(spark):
    """Of a command's shuffles nothing stays, and the session's setting is as before."""
    from sextant.core.shared import SHUFFLE_CLEANUP, materialise

    before, tracker = spark.conf.get(SHUFFLE_CLEANUP, None), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in (files.apply(i) for files in [tracker.getAllFiles()] for i in range(files.size())) if f.getName().startswith("shuffle")}
    known = held()
    out = materialise(spark.range(10_000).repartition(7, "id"), "trial")
    assert not held() - known
    assert out.count() == 10_000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
