"""Time joins, windows, panels and statistics on deals and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.core.tables import CALENDAR_SQL, DEALS_SQL, bars, bars_sql, calendar, deals, table
from sextant.functions.numbers import correlation, correlation_sql
from sextant.operators import ranks
from sextant.operators import rows as R
from sextant.operators import timejoin as T
from sextant.plans.catalog import register
from sextant.plans.relational import r6

D, B, C = f"WITH {DEALS_SQL}", f"WITH {DEALS_SQL}, {bars_sql()}", f"WITH {DEALS_SQL}, {CALENDAR_SQL}"
BC = f"WITH {DEALS_SQL}, {bars_sql()}, {CALENDAR_SQL}"

def by():
    return Window.partitionBy("id").orderBy("d")


def b(spark: SparkSession, p: str) -> DataFrame:
    return bars(deals(spark, p))


_SNAP = "snap AS (SELECT id, d AS rd, turnover AS rt FROM bars WHERE day(d) = 1)"


@register("j06_asof_inner", f"{B}, {_SNAP} SELECT bars.id, bars.d, rd, rt FROM bars ASOF JOIN snap ON bars.id = snap.id AND bars.d >= snap.rd")
def j06(spark: SparkSession, p: str) -> DataFrame:
    x = b(spark, p)
    snap = x.where("day(d) = 1").select("id", F.col("d").alias("rd"), F.col("turnover").alias("rt"))
    return T.asof_join(x.select("id", "d"), snap, ["id"], "d", "rd", how="inner", spread=True)


@register("j07_asof_left", f"{B}, {_SNAP} SELECT bars.id, bars.d, rd, rt FROM bars ASOF LEFT JOIN snap ON bars.id = snap.id AND bars.d >= snap.rd")
def j07(spark, p):
    x = b(spark, p)
    snap = x.where("day(d) = 1").select("id", F.col("d").alias("rd"), F.col("turnover").alias("rt"))
    return T.asof_join(x.select("id", "d"), snap, ["id"], "d", "rd")


@register("j16_first_after", f"{B}, {_SNAP} SELECT snap.id, rd, min(d) AS entry FROM snap LEFT JOIN bars ON bars.id = snap.id AND bars.d > rd GROUP BY ALL")
def j16(spark, p):
    x = b(spark, p)
    snap = x.where("day(d) = 1").select("id", F.col("d").alias("rd"))
    return T.asof_join(snap, x.select("id", F.col("d").alias("entry")), ["id"], "rd", "entry", direction="forward", strict=True)


@register("j09_snapshot_membership", f"{D}, m AS (SELECT DISTINCT date_trunc('month', d)::DATE AS snap, security FROM deals WHERE kind = 'R' AND qty > 45), q AS (SELECT DISTINCT d FROM deals WHERE day(d) = 15) SELECT d, count(*) AS members FROM q JOIN m ON snap = (SELECT max(snap) FROM m WHERE snap <= d) GROUP BY 1")
def j09(spark, p):
    x = deals(spark, p)
    m = x.where("kind = 'R' AND qty > 45").select(F.trunc("d", "month").alias("snap"), "security").distinct()
    q = x.where("day(d) = 15").select("d").distinct().withColumn("one", F.lit(1))
    newest = T.asof_join(q, m.select("snap").distinct().withColumn("one", F.lit(1)), ["one"], "d", "snap", how="inner")
    return newest.join(m, "snap").groupBy("d").agg(F.count(F.lit(1)).alias("members"))


_VALID = "v AS (SELECT o_custkey AS k, o_orderkey AS vid, CAST(o_orderdate AS DATE) AS valid_from, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"


def validity(spark, p):
    o = table(spark, p, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("vid"), F.to_date("o_orderdate").alias("valid_from"), "o_orderdate")
    return o.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("k").orderBy("o_orderdate", "vid"))).drop("o_orderdate")


@register("j11_validity_join", f"{D}, {_VALID}, q AS (SELECT DISTINCT participant AS k, d FROM deals) SELECT q.k, d, vid FROM q LEFT JOIN v ON q.k = v.k AND d >= valid_from AND (valid_to IS NULL OR d < valid_to)")
def j11(spark, p):
    q = deals(spark, p).select(F.col("participant").alias("k"), "d").distinct()
    return T.interval_join(q, validity(spark, p).where("valid_to IS NULL OR valid_from < valid_to"), ["k"], "d", disjoint=True).select("k", "d", "vid")


@register("j12_nearest_interval", f"{D}, {_VALID}, q AS (SELECT DISTINCT participant AS k, d FROM deals), g AS (SELECT q.k, d, vid, CASE WHEN valid_from IS NULL THEN NULL WHEN d < valid_from THEN date_diff('day', d, valid_from) WHEN valid_to IS NOT NULL AND d > valid_to THEN date_diff('day', valid_to, d) ELSE 0 END AS gap FROM q LEFT JOIN v ON q.k = v.k), r AS (SELECT *, sum(CASE WHEN gap = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k, d) AS nv, row_number() OVER (PARTITION BY k, d ORDER BY gap NULLS FIRST, vid) AS rn FROM g) SELECT k, d, vid, CAST(gap AS INTEGER) AS gap_days, CASE WHEN vid IS NULL THEN 'UNRESOLVED' WHEN nv = 1 THEN 'HIGH' WHEN nv > 1 THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM r WHERE rn = 1")
def j12(spark, p):
    q = deals(spark, p).select(F.col("participant").alias("k"), "d").distinct()
    return T.nearest_span(q, validity(spark, p), ["k"], ["k", "d"], "d", "vid")


@register("j14_five_session_round_trip", f"{C}, x AS (SELECT DISTINCT participant AS a, brand AS s, side, i FROM deals JOIN cal USING (d)) SELECT DISTINCT a, s, side, i FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.a = x.a AND y.s = x.s AND y.side <> x.side AND y.i <> x.i AND abs(y.i - x.i) <= 5)")
def j14(spark, p):
    """Band self-join as a window over the session index: the nearest opposite deals on both sides."""
    x0 = deals(spark, p)
    x = x0.join(F.broadcast(calendar(x0).select("d", "i")), "d").select(F.col("participant").alias("a"), F.col("brand").alias("s"), "side", F.col("i").cast("long").alias("i")).distinct()
    over = Window.partitionBy("a", "s").orderBy("i")
    near = lambda lo, hi: F.collect_set("side").over(over.rangeBetween(lo, hi))
    other = F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")
    return x.withColumn("near", F.array_union(near(-5, -1), near(1, 5))).where(F.array_contains("near", other)).drop("near")


@register("j17_row_offset", f"{B}, r AS (SELECT id, d, close, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM bars) SELECT a.id, a.d, z.d AS exit_d, z.close AS exit_close FROM r a JOIN r z ON a.id = z.id AND z.rn = a.rn + 10")
def j17(spark, p):
    x = b(spark, p)
    return x.select("id", "d", F.lead("d", 10).over(by()).alias("exit_d"), F.lead("close", 10).over(by()).alias("exit_close")).where("exit_d IS NOT NULL")


@register("j21_match_ladder", f"{D}, e AS (SELECT participant, security, brand, kind, min(value) AS v FROM deals WHERE side = 'BUY' GROUP BY ALL), c1 AS (SELECT security, brand, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL), c2 AS (SELECT security, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL), c3 AS (SELECT kind, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL) SELECT participant, security, brand, e.kind, CASE WHEN c1.n >= 8 THEN 'fine' WHEN c2.n >= 120 THEN 'mid' WHEN c3.n >= 20 THEN 'coarse' END AS level, round(ln(CASE WHEN c1.n >= 8 THEN c1.m WHEN c2.n >= 120 THEN c2.m WHEN c3.n >= 20 THEN c3.m END), 8) AS log_matched FROM e LEFT JOIN c1 USING (security, brand) LEFT JOIN c2 USING (security) LEFT JOIN c3 ON e.kind = c3.kind")
def j21(spark, p):
    e = deals(spark, p).where("side = 'BUY'").groupBy("participant", "security", "brand", "kind").agg(F.min("value").alias("v"))
    cell = lambda *k: e.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    # floors differ a rung, so the ladder's cells are filtered before it picks the first
    out = R.match_ladder(e, [("fine", cell("security", "brand").where("n >= 8"), ["security", "brand"]), ("mid", cell("security").where("n >= 120"), ["security"]), ("coarse", cell("kind").where("n >= 20"), ["kind"])], 1)
    return out.select("participant", "security", "brand", "kind", "level", F.round(F.log("matched"), 8).alias("log_matched"))


@register("j25_forward_adjustment", f"{B}, a AS (SELECT id, d AS ex, 0.9 AS f FROM bars WHERE day(d) = 7 AND month(d) = 6), k AS (SELECT b.id, b.d, exp(coalesce(sum(ln(f)), 0)) AS factor FROM bars b LEFT JOIN a ON a.id = b.id AND a.ex > b.d GROUP BY ALL) SELECT id, d, round(factor, 8) AS factor FROM k")
def j25(spark, p):
    """Product of all later factors as a reverse running sum of logarithms: no inequality join."""
    x = b(spark, p).withColumn("lf", F.when((F.dayofmonth("d") == 7) & (F.month("d") == 6), F.log(F.lit(0.9))).otherwise(F.lit(0.0)))
    later = F.coalesce(F.sum("lf").over(by().rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return x.select("id", "d", F.round(F.exp(later), 8).alias("factor"))


@register("w02_one_step_return", f"{B} SELECT id, d, round(close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1, 8) AS ret FROM bars")
def w02(spark, p):
    return b(spark, p).select("id", "d", F.round(F.col("close") / F.lag("close").over(by()) - 1, 8).alias("ret"))


@register("w04_rolling_median", f"{B} SELECT id, d, CASE WHEN count(*) OVER w = 20 THEN round(median(turnover) OVER w, 3) END AS adv FROM bars WINDOW w AS (PARTITION BY id ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def w04(spark, p):
    over = by().rowsBetween(-19, 0)
    return b(spark, p).select("id", "d", F.when(F.count(F.lit(1)).over(over) == 20, F.round(F.percentile("turnover", 0.5).over(over), 3)).alias("adv"))


@register("w05_w06_w07_volatility_momentum", f"{B}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1 AS ret FROM bars) SELECT id, d, round(stddev_samp(ret) OVER (PARTITION BY id ORDER BY d ROWS 20 PRECEDING), 8) AS vol21, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1, 8) AS mom12_1, count(*) OVER (PARTITION BY id ORDER BY d ROWS 251 PRECEDING) >= 252 AS seasoned FROM r WINDOW w AS (PARTITION BY id ORDER BY d)")
def w05(spark, p):
    x = b(spark, p).withColumn("ret", F.col("close") / F.lag("close").over(by()) - 1)
    return x.select("id", "d", F.round(F.stddev_samp("ret").over(by().rowsBetween(-20, 0)), 8).alias("vol21"), F.round(F.lag("close", 21).over(by()) / F.lag("close", 252).over(by()) - 1, 8).alias("mom12_1"), (F.count(F.lit(1)).over(by().rowsBetween(-251, 0)) >= 252).alias("seasoned"))


@register("w08_quintiles", f"{B} SELECT id, d, ntile(5) OVER (PARTITION BY d ORDER BY turnover, id) AS q FROM bars")
def w08(spark, p):
    return b(spark, p).select("id", "d", F.ntile(5).over(Window.partitionBy("d").orderBy("turnover", "id")).cast("long").alias("q"))


@register("w09_excursions", f"{B} SELECT id, d, round(max(high) OVER w / close - 1, 8) AS mfe, round(min(low) OVER w / close - 1, 8) AS mae FROM bars WINDOW w AS (PARTITION BY id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)")
def w09(spark, p):
    over = by().rowsBetween(1, 10)
    return b(spark, p).select("id", "d", F.round(F.max("high").over(over) / F.col("close") - 1, 8).alias("mfe"), F.round(F.min("low").over(over) / F.col("close") - 1, 8).alias("mae"))


@register("w13_w14_consensus", f"{C}, x AS (SELECT DISTINCT security, i, participant FROM deals JOIN cal USING (d) WHERE side = 'BUY' AND qty > 30), k AS (SELECT DISTINCT security, i FROM x), n AS (SELECT k.security, k.i, count(DISTINCT x.participant) AS n FROM k JOIN x ON x.security = k.security AND x.i BETWEEN k.i - 20 AND k.i GROUP BY ALL), c AS (SELECT *, lag(n) OVER (PARTITION BY security ORDER BY i) AS prev FROM n) SELECT security, i, n FROM c WHERE n >= 3 AND (prev IS NULL OR prev < 3)")
def w14(spark, p):
    """Distinct buyers in 21 sessions, reported at the crossing of three, not while above it."""
    x0 = deals(spark, p)
    x = x0.where("side = 'BUY' AND qty > 30").join(F.broadcast(calendar(x0).select("d", F.col("i").cast("long").alias("i"))), "d")
    n = R.trailing_distinct(x, ["security"], "i", "participant", 21)
    over = Window.partitionBy("security").orderBy("i")
    return n.withColumn("prev", F.lag("n").over(over)).where("n >= 3 AND (prev IS NULL OR prev < 3)").select("security", "i", "n")


@register("w19_average_rank", f"{B} SELECT id, d, round((rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY d), 8) AS pr FROM bars")
def w19(spark, p):
    return b(spark, p).select("id", "d", F.round(R.average_rank("volume", ["d"]) / F.count(F.lit(1)).over(Window.partitionBy("d")), 8).alias("pr"))


@register("w22_islands", "WITH x AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderstatus AS s FROM orders), c AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END AS new FROM x), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY i) AS isl FROM c), r AS (SELECT k, isl, min(s) AS s, min(i) AS valid_from, count(*) AS n_rows FROM g GROUP BY ALL) SELECT k, s, valid_from, n_rows, lead(valid_from) OVER (PARTITION BY k ORDER BY valid_from) AS valid_to FROM r")
def w22(spark, p):
    x = table(spark, p, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.col("o_orderstatus").alias("s"))
    return T.islands(x, ["k"], "i", "s")


@register("w24_interval_union", "WITH x AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) AS e FROM orders), b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM x), g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM b) SELECT k, min(s) AS s, max(e) AS e, count(*) AS n_spans FROM g GROUP BY k, isl")
def w24(spark, p):
    o = table(spark, p, "orders")
    x = o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("s"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 200 as int))").alias("e"))
    return T.merge_overlaps(x, ["k"], "s", "e")


_W25 = f"""WITH RECURSIVE {DEALS_SQL}, {CALENDAR_SQL}, x AS (SELECT DISTINCT security, i, d FROM deals JOIN cal USING (d) WHERE side = 'BUY'),
kept(security, i) AS (SELECT security, min(i) FROM x GROUP BY 1 UNION ALL SELECT k.security, n.i FROM kept k JOIN LATERAL (SELECT min(x.i) AS i FROM x WHERE x.security = k.security AND x.i >= k.i + 21) n ON n.i IS NOT NULL)
SELECT security, i, d FROM kept JOIN x USING (security, i)"""


@register("w25_decluster", _W25)
def w25(spark, p):
    """Buys of a security at least 21 sessions after the last one kept."""
    x0 = deals(spark, p)
    x = x0.where("side = 'BUY'").join(F.broadcast(calendar(x0).select("d", "i")), "d").select("security", F.col("i").cast("long").alias("i"), "d")
    return R.decluster(x, ["security"], "i", 21, ["security", "i", "d"])


@register("w26_next_session", f"{C} SELECT d, i, next_d FROM cal")
def w26(spark, p):
    return calendar(deals(spark, p)).select("d", F.col("i").cast("long").alias("i"), "next_d")


@register("w28_month_ends", f"{D} SELECT max(d) AS d FROM deals GROUP BY date_trunc('month', d)")
def w28(spark, p):
    return deals(spark, p).groupBy(F.trunc("d", "month")).agg(F.max("d").alias("d")).select("d")


@register("w30_rolling_beta", f"{B}, r AS (SELECT id, d, close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1 AS ret FROM bars), m AS (SELECT d, avg(ret) AS mk FROM r GROUP BY 1) SELECT id, d, CASE WHEN count(ret) OVER w >= 50 THEN round(covar_samp(ret, mk) OVER w / nullif(var_samp(mk) OVER w, 0), 5) END AS beta FROM (SELECT * FROM r JOIN m USING (d) WHERE ret IS NOT NULL) WINDOW w AS (PARTITION BY id ORDER BY d ROWS 62 PRECEDING)")
def w30(spark, p):
    r = b(spark, p).withColumn("ret", F.col("close") / F.lag("close").over(by()) - 1).select("id", "d", "ret")
    x = r.join(r.groupBy("d").agg(F.avg("ret").alias("mk")), "d").where("ret IS NOT NULL")
    over = by().rowsBetween(-62, 0)
    return x.select("id", "d", F.when(F.count("ret").over(over) >= 50, F.round(F.try_divide(F.covar_samp("ret", "mk").over(over), F.var_samp("mk").over(over)), 5)).alias("beta"))


@register("w33_tumbling_blocks", f"{BC} SELECT id, i // 21 AS block, round(sum(turnover), 2) AS total, count(*) AS n FROM bars JOIN cal USING (d) GROUP BY ALL")
def w33(spark, p):
    x = deals(spark, p)
    return bars(x).join(F.broadcast(calendar(x).select("d", "i")), "d").groupBy("id", F.expr("i div 21").alias("block")).agg(F.round(F.sum("turnover"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@register("a14_monthly_cohorts", f"{D} SELECT date_trunc('month', d)::DATE AS month, round(avg(qty), 6) AS mean, count(*) AS n FROM deals GROUP BY 1")
def a14(spark, p):
    return deals(spark, p).groupBy(F.trunc("d", "month").alias("month")).agg(r6(F.avg("qty"), "mean"), F.count(F.lit(1)).alias("n"))


@register("a16_leave_one_out", f"{B} SELECT id, d, count(volume) OVER (PARTITION BY d) - 1 AS peer_n, CASE WHEN count(volume) OVER (PARTITION BY d) > 1 THEN round((sum(volume) OVER (PARTITION BY d) - volume) / (count(volume) OVER (PARTITION BY d) - 1), 5) END AS peer_mean FROM bars")
def a16(spark, p):
    return R.leave_one_out(b(spark, p), ["d"], "volume").select("id", "d", "peer_n", F.round("peer_mean", 5).alias("peer_mean"))


@register("d44_bh_q_values", f"{D}, s AS (SELECT security, abs(avg(qty) - 25.5) / nullif(stddev_samp(qty) / sqrt(count(*)), 0) AS t FROM deals GROUP BY 1), q AS (SELECT security, exp(-0.717 * t - 0.416 * t * t) AS p FROM s), r AS (SELECT *, row_number() OVER (ORDER BY p, security) AS k, count(*) OVER () AS m FROM q) SELECT security, round(least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def d44(spark, p):
    """Hypotheses are numbered over ranges; the running minimum from the end runs over blocks of numbers."""
    t = F.try_divide(F.abs(F.avg("qty") - 25.5), F.stddev_samp("qty") / F.sqrt(F.count(F.lit(1))))
    q = deals(spark, p).groupBy("security").agg(t.alias("t")).select("security", F.exp(-0.717 * F.col("t") - 0.416 * F.col("t") * F.col("t")).alias("p"))
    r = ranks.numbered(q, [F.col("p").asc_nulls_last(), F.col("security")], to="k", total="m")
    r = materialise(r.select("security", (F.col("p") * F.col("m") / F.col("k")).alias("x"), (F.col("m") + 1 - F.col("k")).alias("back")), "hypotheses")
    return ranks.running(r, "back", "x", "min", "low").select("security", r6(F.least(F.lit(1.0), "low"), "q"))


@register("g11_rank_ic", f"{B}, f AS (SELECT id, d, volume AS s, lead(close, 5) OVER w / lead(open, 1) OVER w - 1 AS y FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)), r AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY s) + (count(*) OVER (PARTITION BY d, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y) - 1) / 2.0 AS ry FROM f WHERE y IS NOT NULL) SELECT d, count(*) AS n, round({correlation_sql("rs", "ry")}, 6) + 0.0 AS ic FROM r GROUP BY d HAVING count(*) >= 15")
def g11(spark, p):
    f = b(spark, p).select("id", "d", F.col("volume").alias("s"), (F.lead("close", 5).over(by()) / F.lead("open", 1).over(by()) - 1).alias("y")).where("y IS NOT NULL")
    r = f.select("d", R.average_rank("s", ["d"]).alias("rs"), R.average_rank("y", ["d"]).alias("ry"))
    return r.groupBy("d").agg(F.count(F.lit(1)).alias("n"), (F.round(correlation("rs", "ry"), 6) + 0.0).alias("ic")).where("n >= 15")


@register("t04_revisions", f"{D} SELECT security, d, count(*) - 1 AS revision FROM deals GROUP BY ALL")
def t04(spark, p):
    x = deals(spark, p)
    order = Window.partitionBy("security", "d").orderBy("deal_key", "deal_line", "qty", "price")
    return x.withColumn("revision", F.row_number().over(order).cast("long") - 1).groupBy("security", "d").agg(F.max("revision").alias("revision"))


@register("t07_tumbling_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def t07(spark, p):
    e = table(spark, p, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return e.select(F.to_date("window.start").alias("day"), "event_type", "n", "v")


@register("t09_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS started FROM s GROUP BY user_id, k")
def t09(spark, p):
    e = table(spark, p, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return e.select("user_id", "n", F.unix_timestamp("first").alias("started"))
