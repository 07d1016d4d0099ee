import datetime

import pytest

from sextant.core.shared import new_path
from sextant.core.tables import deals
from sextant.plans import catalog, load  # noqa: F401
from sextant.streaming import increments

SF = "/root/testdata/sf0.001"


def test_stateful_decluster_equals_a_loop(spark):
    days = deals(spark, SF).where("side = 'BUY' AND qty >= 40").select("brand", "d").distinct().orderBy("brand", "d").collect()
    want, last = set(), {}
    for r in days:
        if r.brand not in last or (r.d - last[r.brand]).days >= 10:
            want.add((r.brand, r.d))
            last[r.brand] = r.d
    got = [tuple(r) for r in catalog.queries()["t10_stateful_decluster"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_append_is_idempotent_and_refuses_holes(spark):
    path = new_path(spark, "sessions")
    day = lambda *ns: spark.createDataFrame([(datetime.date(2024, 1, n), float(n)) for n in ns], "d date, x double")
    increments.append_sessions(day(1, 2, 4), path, 0)
    increments.append_sessions(day(4, 5), path, 1)
    increments.append_sessions(day(4, 5), path, 1)
    held = spark.read.schema("d date, x double, _batch long").parquet(path)
    assert sorted(r.d.day for r in held.collect()) == [1, 2, 4, 5]
    with pytest.raises(increments.LateSession):
        increments.append_sessions(day(3, 6), path, 2)


def test_grouped_map_interval_holds_the_mean(spark):
    rows = catalog.queries()["x03_grouped_map"](spark, SF).collect()
    assert rows and all(r.lo <= r.mean <= r.hi for r in rows)


def test_a_content_lands_once_whatever_time_lies_between(spark):
    source, path, checkpoint = (new_path(spark, w) for w in ("arrivals", "landed", "state"))
    schema, start = "k long, ts timestamp", datetime.datetime(2024, 1, 1)
    for rows in ([(1, 200)], [(2, 0), (None, 0)], [(3, 500)], [(4, 501)], [(1, 502), (2, 503), (5, 504), (5, 504)], [(None, 505)]):
        spark.createDataFrame([(k, start + datetime.timedelta(days=n)) for k, n in rows], schema).coalesce(1).write.mode("append").parquet(source)
        increments.land_once(spark, source, schema, ["k"], "ts", path, checkpoint)
    landed = lambda: sorted((r.k or 0, (r.ts - start).days) for r in spark.read.parquet(path).collect())
    want = [(0, 0), (1, 200), (2, 0), (3, 500), (4, 501), (5, 504)]
    assert landed() == want
    increments.land_batch(spark.createDataFrame([(4, start + datetime.timedelta(days=501))], schema), ["k"], "ts", path, 3)
    assert landed() == want
