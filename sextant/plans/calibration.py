"""Null calibration (D46): does a whole procedure find names when nothing is there?

Participants' monthly mean outcomes are studentised, their multiplicity-adjusted p-values come from a bootstrap of whole months, and the
same is done after outcomes have been dealt anew among the deals of each date.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.core.tables import DEALS_SQL, bars_sql, deals
from sextant.functions.numbers import r6
from sextant.operators import ranks
from sextant.operators.gram import _by_key
from sextant.plans.catalog import register
from sextant.plans.experiments import hashed, hashed_sql, outcomes
from sextant.plans.slice import FWD_SQL

ARMS, BOOT, LEAST, ALPHA = 3, 200, 20, 0.05


def month_weights(draws: int, months: int) -> np.ndarray:
    """draws x months: how often each month is drawn; the draws are shared by all names, which keeps their dependence."""
    out = np.zeros((draws, months))
    for b in range(draws):
        for k in range(months):
            out[b, int(hashlib.md5(f"{b}|{k}".encode()).hexdigest()[:8], 16) % months] += 1
    return out


def resampled_t(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """draws x names: studentised means of the names' (rows of ``values``, NaN where absent) months less their own mean; 0 where fewer
    than two different months are drawn."""
    has = ~np.isnan(values)
    n_own = has.sum(1, keepdims=True)
    x = np.where(has, values - np.where(has, values, 0).sum(1, keepdims=True) / np.maximum(n_own, 1), 0.0)
    h = has.astype(float)
    n, s, q = weights @ h.T, weights @ x.T, weights @ (x * x).T
    two = ((weights > 0).astype(float) @ h.T) >= 2
    n = np.where(two, n, 2.0)
    variance = (q - s * s / n) / (n - 1)
    good = two & (variance > 0)
    return np.where(good, s / n / np.sqrt(np.where(good, variance, 1.0) / n), 0.0)


def deal_events(spark, p) -> DataFrame:
    """participant (here a supplier, who has deals enough for a monthly series), d, key, x: log outcomes of large buys (a single ratio must not carry a mean)."""
    x = deals(spark, p)
    e = x.where("side = 'BUY' AND qty >= 40").select(F.col("security").alias("participant"), F.col("brand").alias("id"), "d", F.concat_ws("-", "deal_key", "deal_line").alias("key"))
    return e.join(outcomes(x), ["id", "d"]).select("participant", "d", "key", F.log(1 + F.col("fwd")).alias("x"))


def arms(events: DataFrame, n: int) -> DataFrame:
    """arm, participant, d, x: the events, and n times with the participants of a date dealt anew, so that all keep their number of events."""
    each = events.withColumn("arm", F.explode(F.sequence(F.lit(1), F.lit(n))))
    day = Window.partitionBy("arm", "d")
    at = each.select("arm", "d", "x", F.row_number().over(day.orderBy("key")).alias("k"))
    who = each.select("arm", "d", "participant", F.row_number().over(day.orderBy(hashed("arm", "key"), "key")).alias("k"))
    return events.select(F.lit(0).alias("arm"), "participant", "d", "x").unionByName(at.join(who, ["arm", "d", "k"]).select("arm", "participant", "d", "x"))


def stepdown(panel: DataFrame, months: int, draws: int, together: int = 1024) -> DataFrame:
    """arm, name, t, p of panels (arm, name, t, v: array of (month, x)): Romano-Wolf p-values by the maximum over this and all weaker names.

    Names are numbered by size of t over ranges; ``together`` of them are a matrix in a task.  A block of names leaves its maximum a draw,
    from which every block learns the maximum of all weaker ones, and then counts its own exceedances.
    """
    order = [F.round(F.abs("t"), 9).desc(), F.col("name")]
    n = ranks.numbered(panel, order, ["arm"], "k").withColumn("block", F.floor((F.col("k") - 1) / together))
    n = materialise(n.withColumn("g", F.col("arm") * F.lit(1 << 32) + F.col("block")), "stepdown")

    def matrix(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = np.full((own.num_rows, months), np.nan)
        for i, row in enumerate(own.column("v").to_pylist()):
            for x in row:
                v[i, x["m"]] = x["x"]
        return np.abs(own.column("t").to_numpy()), np.abs(resampled_t(v, month_weights(draws, months)))

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, own in _by_key(batches, "g"):
            _, t = matrix(own)
            yield pa.RecordBatch.from_pydict({"g": np.full(draws, g), "draw": np.arange(draws, dtype=np.int32), "most": t.max(1)})

    sorted_blocks = n.select("g", "k", "name", "t", "v").repartition("g").sortWithinPartitions("g", "k")
    own_most = sorted_blocks.mapInArrow(most, "g long, draw int, most double")
    arm = F.shiftright("g", 32)
    weaker = own_most.select("g", "draw", F.max("most").over(Window.partitionBy(arm, "draw").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)).alias("weaker"))  # a row a block
    carried = weaker.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", F.coalesce("weaker", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("weaker"))  # draws a block
    dealt = n.select("g", "k", "name", "t", "v").join(carried, "g").repartition("g").sortWithinPartitions("g", "k")
    kind = panel.schema["name"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, own in _by_key(batches, "g"):
            seen, t = matrix(own)
            t[:, -1] = np.maximum(t[:, -1], np.array(own.column("weaker")[0].as_py()))
            t = np.maximum.accumulate(t[:, ::-1], 1)[:, ::-1]
            raw = (1 + (t >= seen).sum(0)) / (1 + draws)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), int(g) >> 32)), own.column("k").combine_chunks(), own.column("name").combine_chunks(), own.column("t").combine_chunks(), pa.array(raw)], names=["arm", "k", "name", "t", "raw"])

    raw = materialise(dealt.mapInArrow(count, f"arm long, k long, name {kind}, t double, raw double"), "raw")
    every = ranks.numbered(raw, [F.col("arm"), F.col("k")], to="row")
    # p never falls along the order; arms follow each other, so the arm's number leads the running maximum
    out = ranks.running(materialise(every.withColumn("lead", F.struct("arm", "raw")), "lead"), "row", "lead", "max", "top")
    return out.select("arm", "name", "t", F.col("top.raw").alias("p"))


_SQL = f"""WITH {DEALS_SQL}, {bars_sql()}, {FWD_SQL}, ev AS MATERIALIZED (SELECT security AS participant, deals.d, deal_key || '-' || deal_line AS key, ln(1 + fwd) AS x FROM deals JOIN f ON f.id = brand AND f.d = deals.d WHERE side = 'BUY' AND qty >= 40 AND fwd IS NOT NULL),
ea AS (SELECT ev.*, arm FROM ev, (SELECT unnest(range(1, {ARMS + 1})) AS arm)), a1 AS (SELECT arm, d, x, row_number() OVER (PARTITION BY arm, d ORDER BY key) AS k FROM ea), a2 AS (SELECT arm, d, participant, row_number() OVER (PARTITION BY arm, d ORDER BY {hashed_sql('arm', 'key')}, key) AS k FROM ea),
al AS MATERIALIZED (SELECT 0 AS arm, participant, d, x FROM ev UNION ALL SELECT arm, participant, d, x FROM a1 JOIN a2 USING (arm, d, k)), mo AS MATERIALIZED (SELECT m, row_number() OVER (ORDER BY m) - 1 AS mi, count(*) OVER () AS months FROM (SELECT DISTINCT date_trunc('month', d) AS m FROM ev)),
c AS MATERIALIZED (SELECT arm, participant, mi, avg(x) AS x FROM al JOIN mo ON m = date_trunc('month', d) GROUP BY ALL), o AS MATERIALIZED (SELECT arm, participant, avg(x) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(x) > 0 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) ELSE 0 END AS t FROM c GROUP BY ALL HAVING participant IN (SELECT participant FROM ev GROUP BY 1 HAVING count(*) >= {LEAST})),
w AS MATERIALIZED (SELECT b, {hashed_sql('b', 'k')} % months AS mi, count(*) AS w FROM (SELECT unnest(range(0, {BOOT})) AS b), (SELECT mi AS k, months FROM mo) GROUP BY ALL),
bt AS (SELECT arm, participant, b, CASE WHEN count(*) >= 2 AND s2 - s1 * s1 / n > 0 THEN s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1) / n) ELSE 0 END AS t FROM (SELECT c.arm, c.participant, b, sum(w) AS n, sum(w * (x - mean)) AS s1, sum(w * (x - mean) * (x - mean)) AS s2, count(*) AS months FROM c JOIN o USING (arm, participant) JOIN w USING (mi) GROUP BY ALL) WHERE months >= 2 GROUP BY arm, participant, b, s1, s2, n),
r AS MATERIALIZED (SELECT arm, participant, t, row_number() OVER (PARTITION BY arm ORDER BY round(abs(t), 9) DESC, participant) AS k FROM o),
mx AS (SELECT r.arm, r.k, b.b, max(coalesce(abs(bt.t), 0)) OVER (PARTITION BY r.arm, b.b ORDER BY r.k DESC) AS mx, abs(r.t) AS t FROM r CROSS JOIN (SELECT unnest(range(0, {BOOT})) AS b) b LEFT JOIN bt ON bt.arm = r.arm AND bt.participant = r.participant AND bt.b = b.b),
raw AS (SELECT arm, k, (1 + count(*) FILTER (mx >= t)) / (1 + count(*)) AS p FROM mx GROUP BY ALL), pp AS (SELECT arm, k, max(p) OVER (PARTITION BY arm ORDER BY k) AS p FROM raw)"""


@register(
    "d46_null_calibration",
    _SQL.replace("CASE WHEN count(*) >= 2 AND s2 - s1", "CASE WHEN s2 - s1") + f" SELECT arm, count(*) AS names, count(*) FILTER (p < {ALPHA}) AS supported, count(*) FILTER (p < 0.5) AS below_half, round(min(p), 6) AS least_p, arg_min(participant, k) AS strongest, round(arg_min(r.t, k), 6) AS strongest_t, round(avg(p), 6) AS mean_p FROM pp JOIN r USING (arm, k) GROUP BY 1",
)
def d46(spark, p):
    """Per arm (0: the data; others: participants of a date dealt anew) how many names the procedure supports."""
    events = materialise(deal_events(spark, p), "events")
    months = events.select(F.trunc("d", "month").alias("m")).distinct()
    months = materialise(months.select("m", (F.row_number().over(Window.orderBy("m")) - 1).alias("mi")), "months")  # a row a month
    eligible = events.groupBy("participant").agg(F.count(F.lit(1)).alias("events")).where(F.col("events") >= LEAST).select("participant")
    c = arms(events, ARMS).withColumn("m", F.trunc("d", "month")).join(F.broadcast(months), "m").groupBy("arm", "participant", "mi").agg(F.avg("x").alias("x"))
    spread = F.stddev_samp("x")
    panel = c.join(eligible, "participant").groupBy("arm", F.col("participant").alias("name")).agg(
        F.when((F.count(F.lit(1)) >= 2) & (spread > 0), F.avg("x") / (spread / F.sqrt(F.count(F.lit(1))))).otherwise(0.0).alias("t"), F.collect_list(F.struct(F.col("mi").alias("m"), "x")).alias("v")
    )  # a month a name at most
    got = stepdown(panel, months.count(), BOOT)
    first = F.min_by(F.struct("name", "t"), F.struct((-F.round(F.abs("t"), 9)).alias("t"), "name"))
    told = got.groupBy("arm").agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("p") < ALPHA).alias("supported"), F.count_if(F.col("p") < 0.5).alias("below_half"), r6(F.min("p")).alias("least_p"), first.alias("s"), r6(F.avg("p")).alias("mean_p"))
    return told.select("arm", "names", "supported", "below_half", "least_p", F.col("s.name").alias("strongest"), r6(F.col("s.t")).alias("strongest_t"), "mean_p")
