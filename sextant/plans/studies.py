"""Study operators: event populations, confounds, folds, costs and power, on the rows of other plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.core.tables import CALENDAR_SQL, DEALS_SQL, bars, bars_sql, calendar, deals
from sextant.functions.numbers import correlation, correlation_sql, r6
from sextant.operators import ranks
from sextant.operators import rows as R
from sextant.plans.catalog import register
from sextant.plans.experiments import COST
from sextant.plans.panels import _PRE, pre_post
from sextant.plans.slice import FWD_SQL

D, B = f"WITH {DEALS_SQL}", f"WITH {DEALS_SQL}, {bars_sql()}"


@register(
    "d21_sell_events",
    f"{D} SELECT brand, d, count(*) AS n, sum(qty) AS q, round(sum(value) / sum(qty), 4) AS vwap FROM deals WHERE side = 'SELL' AND qty >= 40 GROUP BY ALL",
)
def d21(spark, p):
    x = deals(spark, p).where("side = 'SELL' AND qty >= 40")
    return x.groupBy("brand", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("q"), F.round(F.sum("value") / F.sum("qty"), 4).alias("vwap"))


@register(
    "d24_seasonal_eligibility",
    f"""{D}, q AS (SELECT DISTINCT security, year(d) * 4 + quarter(d) AS qi FROM deals WHERE qty > 48), s AS (SELECT a.security, a.qi, (b.qi IS NOT NULL)::INT AS has FROM q a LEFT JOIN q b ON b.security = a.security AND b.qi = a.qi - 4)
    SELECT security, qi, has = 1 AND coalesce(sum(has) OVER (PARTITION BY security ORDER BY qi RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) >= 4 AS eligible FROM s""",
)
def d24(spark, p):
    """A seasonal difference exists now and in at least four of the eight quarters before."""
    q = deals(spark, p).where("qty > 48").select("security", (F.year("d") * 4 + F.quarter("d")).cast("long").alias("qi")).distinct()
    s = q.join(q.select("security", (F.col("qi") + 4).alias("qi"), F.lit(1).alias("has")), ["security", "qi"], "left").fillna(0, ["has"])
    before = F.coalesce(F.sum("has").over(Window.partitionBy("security").orderBy("qi").rangeBetween(-8, -1)), F.lit(0))
    return s.select("security", "qi", ((F.col("has") == 1) & (before >= 4)).alias("eligible"))


@register(
    "d29_momentum_confound",
    f"{B}, {_PRE}, q AS (SELECT fwd, pre, ntile(5) OVER (PARTITION BY year(d) ORDER BY pre, id, d) AS q, year(d) AS y FROM ok), r AS (SELECT y, round({correlation_sql('pre', 'fwd')}, 6) AS rho FROM q GROUP BY 1) SELECT y, q, count(*) AS n, round(avg(pre), 6) AS pre, round(avg(fwd), 6) AS mean, any_value(rho) AS rho FROM q JOIN r USING (y) GROUP BY ALL",
)
def d29(spark, p):
    """By year, outcomes by fifths of the return before the event, and the correlation of both; numbers run over ranges of (year, return)."""
    ok = materialise(pre_post(spark, p).select("id", "d", "pre", "fwd", F.year("d").cast("long").alias("y")), "events")
    q = ranks.numbered(ok, [F.col("pre"), F.col("id"), F.col("d")], ["y"], to="k", total="n").withColumn("q", ranks.tile("k", "n", 5).cast("long"))
    rho = F.broadcast(ok.groupBy("y").agg(r6(correlation("pre", "fwd")).alias("rho")))  # a row a year
    return q.groupBy("y", "q").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("pre")).alias("pre"), r6(F.avg("fwd")).alias("mean")).join(rho, "y")


@register(
    "d31_avoidance_book",
    f"""{B}, {CALENDAR_SQL}, ev AS (SELECT DISTINCT brand AS id, i FROM deals JOIN cal USING (d) WHERE side = 'SELL' AND qty >= 48), r AS (SELECT id, d, i, lead(open) OVER (PARTITION BY id ORDER BY d) / open - 1 AS ret FROM bars JOIN cal USING (d)),
    k AS (SELECT r.*, EXISTS (SELECT 1 FROM ev WHERE ev.id = r.id AND ev.i < r.i AND ev.i >= r.i - 10) AS hit FROM r WHERE ret IS NOT NULL)
    , t AS (SELECT *, hit IS DISTINCT FROM lag(hit, 1, false) OVER (PARTITION BY id ORDER BY i) AS changed FROM k)
    SELECT d, count(*) AS names, count(*) FILTER (hit) AS avoided, round(avg(ret) FILTER (NOT hit) - avg(ret), 6) AS gain, round(avg(changed::INT), 6) AS turnover, round(avg(ret) FILTER (NOT hit) - avg(ret) - 0.002 * avg(changed::INT), 6) AS net FROM t GROUP BY 1""",
)
def d31(spark, p):
    """Each event marks its ten following sessions; a marked (id, session) leaves the filtered book.  Names that enter or leave it are the
    turnover that the filter adds, at COST each."""
    x = deals(spark, p)
    cal = calendar(x).select("d", "i")
    marked = x.where("side = 'SELL' AND qty >= 48").select(F.col("brand").alias("id"), "d").distinct().join(cal, "d")
    marked = marked.select("id", F.explode(F.sequence(F.col("i") + 1, F.col("i") + 10)).alias("i")).distinct().withColumn("hit", F.lit(True))
    r = bars(x).select("id", "d", (F.lead("open").over(Window.partitionBy("id").orderBy("d")) / F.col("open") - 1).alias("ret")).where("ret IS NOT NULL").join(cal, "d")
    k = r.join(marked, ["id", "i"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    changed = k.withColumn("changed", (F.col("hit") != F.lag("hit", 1, False).over(Window.partitionBy("id").orderBy("i"))).cast("int"))
    gain = F.avg(F.when(~F.col("hit"), F.col("ret"))) - F.avg("ret")
    told = changed.groupBy("d").agg(F.count(F.lit(1)).alias("names"), F.count_if("hit").alias("avoided"), r6(gain).alias("gain"), r6(F.avg("changed")).alias("turnover"), r6(gain - COST * F.avg("changed")).alias("net"))
    return told


@register(
    "d34_entity_persistence",
    f"""{B}, {FWD_SQL}, e AS (SELECT DISTINCT participant, brand AS id, d FROM deals WHERE side = 'BUY'), s AS (SELECT participant, avg(fwd) FILTER (year(d) < 1999) AS formed, avg(fwd) FILTER (year(d) >= 1999) AS later FROM e JOIN f USING (id, d) WHERE fwd IS NOT NULL GROUP BY 1),
    t AS (SELECT *, ntile(3) OVER (ORDER BY round(formed, 9), participant) AS tier FROM s WHERE formed IS NOT NULL AND later IS NOT NULL)
    , rk AS (SELECT rank() OVER (ORDER BY round(formed, 9)) + (count(*) OVER (PARTITION BY round(formed, 9)) - 1) / 2 AS x, rank() OVER (ORDER BY round(later, 9)) + (count(*) OVER (PARTITION BY round(later, 9)) - 1) / 2 AS y FROM t), ri AS (SELECT round({correlation_sql("x", "y")}, 6) AS rank_ic FROM rk)
    SELECT tier, count(*) AS n, round(avg(later), 6) AS later, round(avg((later > 0)::INT), 6) AS hit_rate, any_value(rank_ic) AS rank_ic FROM t, ri GROUP BY 1""",
)
def d34(spark, p):
    """Tiers are cut from row numbers over ranges; ``rank_ic`` is the rank correlation of formed and later means over all entities."""
    x = deals(spark, p)
    f = R.forward_return(bars(x), 5, 20).where("fwd IS NOT NULL").select("id", "d", "fwd")
    e = x.where("side = 'BUY'").select("participant", F.col("brand").alias("id"), "d").distinct().join(f, ["id", "d"])
    s = e.groupBy("participant").agg(F.avg(F.when(F.year("d") < 1999, F.col("fwd"))).alias("formed"), F.avg(F.when(F.year("d") >= 1999, F.col("fwd"))).alias("later")).dropna()
    s = materialise(s.withColumns({"formed": F.round("formed", 9), "later9": F.round("later", 9)}), "entities")
    t = ranks.numbered(s, [F.col("formed"), F.col("participant")], to="k", total="n").withColumn("tier", ranks.tile("k", "n", 3).cast("long"))
    both = ranks.average_ranks(ranks.average_ranks(s.select("formed", "later9"), "formed", to="x"), "later9", to="y")
    ic = F.broadcast(both.agg(r6(correlation("x", "y")).alias("rank_ic")))  # one row
    told = t.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("later")).alias("later"), r6(F.avg((F.col("later") > 0).cast("int"))).alias("hit_rate"))
    return told.join(ic, F.lit(True))


@register(
    "d37_high_low_spread",
    f"""{B}, h AS (SELECT id, d, ln(high / low) ^ 2 + ln(lag(high) OVER w / lag(low) OVER w) ^ 2 AS beta, ln(greatest(high, lag(high) OVER w) / least(low, lag(low) OVER w)) ^ 2 AS gamma FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)),
    a AS (SELECT id, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM h WHERE beta IS NOT NULL)
    SELECT id, count(*) AS n, round(avg(greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0)), 6) AS spread FROM a GROUP BY 1""",
)
def d37(spark, p):
    w = Window.partitionBy("id").orderBy("d")
    high, low = F.lag("high").over(w), F.lag("low").over(w)
    square = lambda c: F.pow(F.log(c), F.lit(2.0))
    h = bars(deals(spark, p)).select("id", (square(F.col("high") / F.col("low")) + square(high / low)).alias("beta"), square(F.greatest("high", high) / F.least("low", low)).alias("gamma")).where("beta IS NOT NULL")
    k = 3 - 2 * 2**0.5
    alpha = (F.sqrt(2 * F.col("beta")) - F.sqrt("beta")) / k - F.sqrt(F.col("gamma") / k)
    a = h.select("id", alpha.alias("alpha"))
    return a.groupBy("id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.greatest(2 * (F.exp("alpha") - 1) / (1 + F.exp("alpha")), F.lit(0.0)))).alias("spread"))


LAGS = range(1, 7)


@register(
    "d39_minimum_detectable_effect",
    f"""{B}, {FWD_SQL}, e AS (SELECT DISTINCT brand AS id, d, kind FROM deals WHERE side = 'BUY' AND qty >= 40), c AS (SELECT kind, date_trunc('month', d)::DATE AS m, avg(fwd) AS x FROM e JOIN f USING (id, d) WHERE fwd IS NOT NULL GROUP BY ALL),
    l AS (SELECT kind, x, {', '.join(f'lag(x, {k}) OVER w AS x{k}' for k in LAGS)} FROM c WINDOW w AS (PARTITION BY kind ORDER BY m)),
    s AS (SELECT kind, count(*) AS n, stddev_samp(x) AS sd, {' + '.join(f'{2 * (1 - k / (len(LAGS) + 1))!r}::DOUBLE * coalesce({correlation_sql("x", f"x{k}")}, 0)' for k in LAGS)} AS serial FROM l GROUP BY 1)
    SELECT kind, n, round(2.8 * sd / sqrt(n), 6) AS mde, round(2.8 * sd / sqrt(n) * sqrt(greatest(1 + serial, 0)), 6) AS mde_serial FROM s""",
)
def d39(spark, p):
    """2.8 standard errors of the monthly cohorts' mean; the serial form adds Bartlett's terms of LAGS."""
    x = deals(spark, p)
    f = R.forward_return(bars(x), 5, 20).where("fwd IS NOT NULL").select("id", "d", "fwd")
    e = x.where("side = 'BUY' AND qty >= 40").select(F.col("brand").alias("id"), "d", "kind").distinct().join(f, ["id", "d"])
    c = e.groupBy("kind", F.trunc("d", "month").alias("m")).agg(F.avg("fwd").alias("x"))
    month = Window.partitionBy("kind").orderBy("m")
    lagged = c.withColumns({f"x{k}": F.lag("x", k).over(month) for k in LAGS})
    serial = sum((2 * (1 - k / (len(LAGS) + 1)) * F.coalesce(correlation("x", f"x{k}"), F.lit(0.0)) for k in LAGS), F.lit(0.0))
    s = lagged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), serial.alias("serial"))
    mde = 2.8 * F.col("sd") / F.sqrt("n")
    return s.select("kind", "n", r6(mde).alias("mde"), r6(mde * F.sqrt(F.greatest(1 + F.col("serial"), F.lit(0.0)))).alias("mde_serial"))


@register(
    "d47_walk_forward_folds",
    f"""{D}, {CALENDAR_SQL}, y AS (SELECT year(d) AS fold, min(i) AS lo, max(i) AS hi FROM cal GROUP BY 1), k AS (SELECT fold, i, CASE WHEN i BETWEEN lo AND hi THEN 'TEST' WHEN i < lo - 21 THEN 'TRAIN' WHEN i < lo THEN 'EMBARGO' END AS part FROM y, cal WHERE i <= hi)
    SELECT fold, part, count(*) AS sessions, min(i) AS first, max(i) AS last FROM k GROUP BY ALL""",
)
def d47(spark, p):
    """Anchored yearly folds with 21 sessions of embargo; a fold is a range of session numbers, never a list of rows."""
    cal = calendar(deals(spark, p))
    y = cal.groupBy(F.year("d").cast("long").alias("fold")).agg(F.min("i").cast("long").alias("lo"), F.max("i").cast("long").alias("hi"))
    parts = F.array(
        F.struct(F.lit("TEST").alias("part"), F.col("lo").alias("first"), F.col("hi").alias("last")),
        F.struct(F.lit("EMBARGO").alias("part"), F.greatest(F.col("lo") - 21, F.lit(0)).alias("first"), (F.col("lo") - 1).alias("last")),
        F.struct(F.lit("TRAIN").alias("part"), F.lit(0).cast("long").alias("first"), (F.col("lo") - 22).alias("last")),
    )
    k = y.select("fold", F.inline(parts)).where("last >= first")
    return k.select("fold", "part", (F.col("last") - F.col("first") + 1).alias("sessions"), "first", "last")
