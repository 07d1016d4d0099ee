"""Null calibration: month bootstrap, stepdown p-values over several blocks and the arms, against loops."""

import numpy as np
from pyspark.sql import functions as F

from sextant.plans import calibration as C


def loop_t(values, weights):
    out = np.zeros((len(weights), len(values)))
    for b, w in enumerate(weights):
        for i, v in enumerate(values):
            drawn = [x - np.nanmean(v) for x, k in zip(v, w, strict=True) for _ in range(int(k)) if not np.isnan(x)]
            different = sum(1 for x, k in zip(v, w, strict=True) if k and not np.isnan(x))
            if different >= 2 and np.var(drawn, ddof=1) > 0:
                out[b, i] = np.mean(drawn) / np.sqrt(np.var(drawn, ddof=1) / len(drawn))
    return out


def test_resampled_statistics_equal_a_loop():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(9, 12))
    v[rng.random(v.shape) < 0.4] = np.nan
    v[0] = np.nan
    v[1, 1:] = np.nan
    w = C.month_weights(20, 12)
    assert (w.sum(1) == 12).all() and np.allclose(C.resampled_t(v, w), loop_t(v, w))


def test_stepdown_over_blocks_equals_one_matrix(spark):
    rng = np.random.default_rng(2)
    rows, months, draws = [], 15, 60
    for arm in (0, 1):
        for i in range(50):
            v = rng.normal(0.8 if i < 5 else 0, 1, months)
            own = [(m, float(x)) for m, x in enumerate(v) if rng.random() < 0.8]
            xs = [x for _, x in own]
            rows.append((arm, i, float(np.mean(xs) / (np.std(xs, ddof=1) / np.sqrt(len(xs)))), own))
    df = spark.createDataFrame(rows, "arm int, name long, t double, v array<struct<m:long,x:double>>").repartition(4)
    got = {(r.arm, r.name): r.p for r in C.stepdown(df, months, draws, together=7).collect()}
    for arm in (0, 1):
        own = sorted((r for r in rows if r[0] == arm), key=lambda r: (-round(abs(r[2]), 9), r[1]))
        v = np.full((50, months), np.nan)
        for i, r in enumerate(own):
            for m, x in r[3]:
                v[i, m] = x
        t = np.abs(C.resampled_t(v, C.month_weights(draws, months)))
        p = 0.0
        for k, r in enumerate(own):
            p = max(p, (1 + (t[:, k:].max(1) >= abs(r[2])).sum()) / (1 + draws))
            assert abs(got[arm, r[1]] - p) < 1e-12
    assert min(got.values()) < 0.4


def test_arms_keep_each_names_events_and_each_dates_outcomes(spark):
    rows = [(i % 7, f"2001-01-{1 + i % 9:02d}", f"k{i}", float(i)) for i in range(90)]
    e = spark.createDataFrame(rows, "participant int, d string, key string, x double").withColumn("d", F.to_date("d"))
    got = C.arms(e, 2).collect()
    want = sorted((r[0], r[1]) for r in rows)
    for arm in (0, 1, 2):
        own = [r for r in got if r.arm == arm]
        assert sorted((r.participant, str(r.d)) for r in own) == want and sorted((str(r.d), r.x) for r in own) == sorted((r[1], r[3]) for r in rows)
    assert {(r.participant, r.x) for r in got if r.arm == 1} != {(r.participant, r.x) for r in got if r.arm == 0}
