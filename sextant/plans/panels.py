"""Snapshot joins, grouped profiles, window kernels and rankings on deals and bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.core.tables import CALENDAR_SQL, DEALS_SQL, bars, bars_sql, calendar, deals
from sextant.functions.numbers import correlation, correlation_sql, r6
from sextant.operators import rows as R
from sextant.operators import timejoin as T
from sextant.plans.catalog import register

D, B = f"WITH {DEALS_SQL}", f"WITH {DEALS_SQL}, {bars_sql()}"


def b(spark: SparkSession, p: str) -> DataFrame:
    return bars(deals(spark, p))


def by(*order: str):
    return Window.partitionBy("id").orderBy(*(order or ("d",)))


# Joins on snapshots and identities


@register(
    "j10_latest_rebalance_member",
    f"""{B}, r AS (SELECT last_day(d) AS rd, id, sum(volume) AS t FROM bars GROUP BY ALL), m AS (SELECT rd, id FROM r QUALIFY row_number() OVER (PARTITION BY rd ORDER BY t DESC, id) <= 10),
    q AS (SELECT bars.id, bars.d, s.rd FROM bars ASOF JOIN (SELECT DISTINCT rd FROM m) s ON bars.d >= s.rd) SELECT q.id, q.d, q.rd FROM q SEMI JOIN m ON q.id = m.id AND q.rd = m.rd""",
)
def j10(spark, p):
    """The dates, not the bars, look up their rebalance; bars then meet the members by equality."""
    x = b(spark, p)
    monthly = x.groupBy(F.last_day("d").alias("rd"), "id").agg(F.sum("volume").alias("t"))
    members = R.top(monthly, ["rd"], [F.desc("t"), "id"], 10).select("rd", "id")
    one = F.lit(1).alias("one")
    dates = T.asof_join(x.select("d", one).distinct(), members.select("rd", one).distinct(), ["one"], "d", "rd", how="inner").select("d", "rd")
    return x.select("id", "d").join(dates, "d").join(members, ["id", "rd"], "left_semi").select("id", "d", "rd")


@register(
    "j13_one_to_one_identity",
    f"""{D}, s AS (SELECT brand, security, d, sum(qty) AS q FROM deals GROUP BY ALL), one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY brand, d ORDER BY q DESC, security) = 1)
    SELECT brand, security, d, q FROM one QUALIFY row_number() OVER (PARTITION BY security, d ORDER BY q DESC, brand) = 1""",
)
def j13(spark, p):
    sums = deals(spark, p).groupBy("brand", "security", "d").agg(F.sum("qty").alias("q"))
    return R.top(R.top(sums, ["brand", "d"], [F.desc("q"), "security"]), ["security", "d"], [F.desc("q"), "brand"])


@register(
    "j18_two_point_benchmark",
    f"""{B}, level AS (SELECT d, avg(close) AS lvl FROM bars GROUP BY 1), e AS (SELECT id, d, close, lead(d, 5) OVER w AS x, lead(close, 5) OVER w AS xc FROM bars WINDOW w AS (PARTITION BY id ORDER BY d))
    SELECT id, e.d, x, round((xc / close - 1) - (b2.lvl / b1.lvl - 1), 6) AS rel FROM e JOIN level b1 ON b1.d = e.d JOIN level b2 ON b2.d = e.x""",
)
def j18(spark, p):
    x = b(spark, p)
    level = x.groupBy("d").agg(F.avg("close").alias("lvl"))
    e = x.select("id", "d", "close", F.lead("d", 5).over(by()).alias("x"), F.lead("close", 5).over(by()).alias("xc"))
    e = e.join(level, "d").join(level.select(F.col("d").alias("x"), F.col("lvl").alias("lvl_x")), "x")
    return e.select("id", "d", "x", r6((F.col("xc") / F.col("close") - 1) - (F.col("lvl_x") / F.col("lvl") - 1)).alias("rel"))


@register(
    "j22_month_offset",
    f"""{D}, h AS (SELECT DISTINCT participant, brand, last_day(d) AS m FROM deals)
    SELECT h.m, count(*) AS held, count(o.m) AS held_before FROM h LEFT JOIN h o ON o.participant = h.participant AND o.brand = h.brand AND o.m = last_day(h.m - INTERVAL 1 MONTH) GROUP BY 1""",
)
def j22(spark, p):
    h = deals(spark, p).select("participant", "brand", F.last_day("d").alias("m")).distinct()
    before = h.select("participant", "brand", F.last_day(F.add_months("m", 1)).alias("m"), F.lit(1).alias("was"))
    return h.join(before, ["participant", "brand", "m"], "left").groupBy("m").agg(F.count(F.lit(1)).alias("held"), F.count("was").alias("held_before"))


@register(
    "j23_successor",
    f"""{D}, s AS (SELECT participant, brand, min(d) AS f, max(d) AS t FROM deals GROUP BY ALL)
    SELECT a.participant, a.brand, min(c.brand) AS successor FROM s a JOIN s c ON c.participant = a.participant AND c.brand <> a.brand AND abs(date_diff('day', a.t, c.f)) <= 60
    WHERE EXISTS (SELECT 1 FROM deals x WHERE x.participant = a.participant AND x.brand = c.brand AND x.d > a.t AND x.d <= a.t + 10) GROUP BY ALL""",
)
def j23(spark, p):
    x = deals(spark, p).select("participant", "brand", "d")
    s = x.groupBy("participant", "brand").agg(F.min("d").alias("f"), F.max("d").alias("t"))
    c = s.select("participant", F.col("brand").alias("successor"), F.col("f").alias("from"))
    pairs = s.join(c, "participant").where((F.col("successor") != F.col("brand")) & (F.abs(F.datediff("from", "t")) <= 60))
    traded = x.select("participant", F.col("brand").alias("successor"), F.col("d").alias("seen")).distinct()
    alive = pairs.join(traded, ["participant", "successor"]).where((F.col("seen") > F.col("t")) & (F.datediff("seen", "t") <= 10))
    return alive.groupBy("participant", "brand").agg(F.min("successor").alias("successor"))


@register(
    "j29_holder_moves",
    f"""{D}, h AS (SELECT DISTINCT brand, participant, date_trunc('quarter', d)::DATE AS q FROM deals), s AS (SELECT brand, q, lag(q) OVER w AS before, lead(q) OVER w AS after FROM (SELECT DISTINCT brand, q FROM h) WINDOW w AS (PARTITION BY brand ORDER BY q)),
    e AS (SELECT h.brand, h.q, h.participant, 'ENTER' AS kind FROM h JOIN s USING (brand, q) ANTI JOIN h o ON o.brand = h.brand AND o.participant = h.participant AND o.q = s.before WHERE before IS NOT NULL),
    x AS (SELECT h.brand, s.after AS q, h.participant, 'EXIT' AS kind FROM h JOIN s USING (brand, q) ANTI JOIN h o ON o.brand = h.brand AND o.participant = h.participant AND o.q = s.after WHERE after IS NOT NULL)
    SELECT brand, q, kind, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM x) GROUP BY ALL""",
)
def j29(spark, p):
    h = deals(spark, p).select("brand", "participant", F.trunc("d", "quarter").alias("q")).distinct()
    w = Window.partitionBy("brand").orderBy("q")
    s = h.select("brand", "q").distinct().select("brand", "q", F.lag("q").over(w).alias("before"), F.lead("q").over(w).alias("after"))
    now = h.join(s, ["brand", "q"])
    entered = now.where("before IS NOT NULL").join(h.select("brand", "participant", F.col("q").alias("before")), ["brand", "participant", "before"], "left_anti")
    left = now.where("after IS NOT NULL").join(h.select("brand", "participant", F.col("q").alias("after")), ["brand", "participant", "after"], "left_anti")
    moves = entered.select("brand", "q", F.lit("ENTER").alias("kind")).unionByName(left.select("brand", F.col("after").alias("q"), F.lit("EXIT").alias("kind")))
    return moves.groupBy("brand", "q", "kind").agg(F.count(F.lit(1)).alias("n"))


# Aggregates


_PRE = "pre AS (SELECT id, d, close / lag(close, 5) OVER w - 1 AS pre, lead(close, 5) OVER w / lead(open, 1) OVER w - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)), ok AS (SELECT * FROM pre WHERE pre IS NOT NULL AND fwd IS NOT NULL)"


def pre_post(spark: SparkSession, p: str) -> DataFrame:
    x = b(spark, p).select("id", "d", (F.col("close") / F.lag("close", 5).over(by()) - 1).alias("pre"), (F.lead("close", 5).over(by()) / F.lead("open", 1).over(by()) - 1).alias("fwd"))
    return x.where("pre IS NOT NULL AND fwd IS NOT NULL")


@register(
    "a11_correlation_and_quintiles",
    f"""{B}, {_PRE}, c AS (SELECT id, round({correlation_sql("pre", "fwd")}, 6) AS corr FROM ok GROUP BY 1), q AS (SELECT id, fwd, ntile(5) OVER (PARTITION BY id ORDER BY pre, d) AS q FROM ok)
    SELECT id, corr, q, count(*) AS n, round(avg(fwd), 6) AS mean FROM q JOIN c USING (id) GROUP BY ALL""",
)
def a11(spark, p):
    ok = pre_post(spark, p)
    c = ok.groupBy("id").agg(r6(correlation("pre", "fwd")).alias("corr"))
    q = ok.select("id", "fwd", F.ntile(5).over(by("pre", "d")).alias("q")).groupBy("id", "q").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd")).alias("mean"))
    return q.join(c, "id").select("id", "corr", "q", "n", "mean")


@register("a21_presence", f"{D} SELECT security, min(d) AS first, max(d) AS last, count(DISTINCT d) AS sessions FROM deals GROUP BY 1")
def a21(spark, p):
    return deals(spark, p).groupBy("security").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.countDistinct("d").alias("sessions"))


@register(
    "a23_group_profile",
    f"""{D}, days AS (SELECT participant, brand, d, count(DISTINCT side) = 2 AS rt FROM deals GROUP BY ALL), dd AS (SELECT participant, count(*) AS stock_days, round(avg(rt::INT), 6) AS round_trip FROM days GROUP BY 1),
    t AS (SELECT participant, string_agg(brand, ',' ORDER BY n DESC, brand) AS top3 FROM (SELECT participant, brand, count(*) AS n FROM deals GROUP BY participant, brand QUALIFY row_number() OVER (PARTITION BY participant ORDER BY n DESC, brand) <= 3) GROUP BY 1)
    SELECT participant, count(*) AS n, count(*) FILTER (side = 'BUY') AS buys, stock_days, round_trip, top3 FROM deals JOIN dd USING (participant) JOIN t USING (participant) GROUP BY ALL""",
)
def a23(spark, p):
    x = deals(spark, p)
    days = x.groupBy("participant", "brand", "d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "BUY").alias("buys"))
    both = ((F.col("buys") > 0) & (F.col("buys") < F.col("n"))).cast("int")
    base = days.groupBy("participant").agg(F.sum("n").alias("n"), F.sum("buys").alias("buys"), F.count(F.lit(1)).alias("stock_days"), r6(F.avg(both)).alias("round_trip"))
    top = R.top(days.groupBy("participant", "brand").agg(F.sum("n").alias("n")), ["participant"], [F.desc("n"), "brand"], 3)
    names = top.groupBy("participant").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "brand"))), lambda s: s["brand"]), ",").alias("top3"))
    return base.join(names, "participant")


@register(
    "a24_year_group_pivot",
    f"{D} SELECT year(d) AS y, brand, coalesce(sum(qty) FILTER (kind = 'A'), 0) AS a, coalesce(sum(qty) FILTER (kind = 'N'), 0) AS n, coalesce(sum(qty) FILTER (kind = 'R'), 0) AS r FROM deals GROUP BY ALL",
)
def a24(spark, p):
    wide = deals(spark, p).groupBy(F.year("d").cast("long").alias("y"), "brand").pivot("kind", ["A", "N", "R"]).agg(F.sum("qty")).fillna(0.0)
    return wide.select("y", "brand", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@register(
    "a25_session_summary",
    f"""{D}, k AS (SELECT participant, brand, d, count(DISTINCT side) AS sides, count(*) AS n, count(*) FILTER (kind = 'R') AS r, sum(qty) AS q FROM deals GROUP BY ALL)
    SELECT d, sum(n)::BIGINT AS n, sum(r)::BIGINT AS n_r, round(avg((sides = 2)::INT), 6) AS round_trip, sum(q) AS q FROM k GROUP BY 1""",
)
def a25(spark, p):
    k = deals(spark, p).groupBy("participant", "brand", "d").agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "R").alias("r"), F.sum("qty").alias("q"))
    return k.groupBy("d").agg(F.sum("n").alias("n"), F.sum("r").alias("n_r"), r6(F.avg((F.col("lo") != F.col("hi")).cast("int"))).alias("round_trip"), F.sum("q").alias("q"))


@register(
    "a28_trailing_share",
    f"""{D}, s AS (SELECT brand, d, sum(qty) AS q, coalesce(sum(qty) FILTER (side = 'BUY'), 0) AS bq FROM deals GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY d DESC) AS rn FROM s)
    SELECT brand, round(sum(bq) FILTER (rn <= 20) / sum(q) FILTER (rn <= 20), 6) AS share20, round(sum(bq) / sum(q), 6) AS share250 FROM r WHERE rn <= 250 GROUP BY 1""",
)
def a28(spark, p):
    s = deals(spark, p).groupBy("brand", "d").agg(F.sum("qty").alias("q"), F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(0)).alias("bq"))
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("d")))).where("rn <= 250")
    near = F.col("rn") <= 20
    return r.groupBy("brand").agg(r6(F.sum(F.when(near, F.col("bq"))) / F.sum(F.when(near, F.col("q")))).alias("share20"), r6(F.sum("bq") / F.sum("q")).alias("share250"))


# Windows


@register(
    "w10_index_level",
    f"""{B}, r AS (SELECT d, close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1 AS ret FROM bars), m AS (SELECT d, median(ret) AS ret FROM r WHERE ret IS NOT NULL GROUP BY 1)
    SELECT d, round(exp(sum(ln(1 + ret)) OVER (ORDER BY d)) * 1000, 4) AS level FROM m""",
)
def w10(spark, p):
    """The running sum orders one row a date, so it may run in one task."""
    r = b(spark, p).select("d", (F.col("close") / F.lag("close").over(by()) - 1).alias("ret")).where("ret IS NOT NULL")
    m = r.groupBy("d").agg(F.median("ret").alias("ret"))
    return m.select("d", F.round(F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("d"))) * 1000, 4).alias("level"))


@register(
    "w12_filtered_count",
    f"{B}, g AS (SELECT id, d, date_diff('day', lag(d) OVER (PARTITION BY id ORDER BY d), d) AS gap FROM bars) SELECT id, d, gap, count(*) FILTER (gap = 1) OVER (PARTITION BY id) AS n_next_day FROM g",
)
def w12(spark, p):
    g = b(spark, p).select("id", "d", F.datediff("d", F.lag("d").over(by())).cast("long").alias("gap"))
    return g.withColumn("n_next_day", F.count_if(F.col("gap") == 1).over(Window.partitionBy("id")))


@register(
    "w15_liquidity_tiers",
    f"""{B}, m AS (SELECT last_day(d) AS rd, id, median(volume) AS med FROM bars GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY rd ORDER BY med DESC, id) AS rank FROM m)
    SELECT rd, id, med, rank, rank <= 5 AS top5, rank > 5 AND rank <= 15 AS mid10 FROM k""",
)
def w15(spark, p):
    m = b(spark, p).groupBy(F.last_day("d").alias("rd"), "id").agg(F.median("volume").alias("med"))
    k = m.withColumn("rank", F.row_number().over(Window.partitionBy("rd").orderBy(F.desc("med"), "id")).cast("long"))
    return k.select("rd", "id", "med", "rank", (F.col("rank") <= 5).alias("top5"), F.col("rank").between(6, 15).alias("mid10"))


@register(
    "w16_level_shift",
    f"""{B}, r AS (SELECT id, d, ln(close / lag(close) OVER w) AS jump, ln(lead(close, 3) OVER w / lag(close) OVER w) AS later FROM bars WINDOW w AS (PARTITION BY id ORDER BY d))
    SELECT id, d, round(jump, 6) AS jump, abs(later) > 0.15 AND sign(later) = sign(jump) AS held FROM r WHERE abs(jump) > 0.3 AND later IS NOT NULL""",
)
def w16(spark, p):
    before = F.lag("close").over(by())
    r = b(spark, p).select("id", "d", F.log(F.col("close") / before).alias("jump"), F.log(F.lead("close", 3).over(by()) / before).alias("later"))
    return r.where((F.abs("jump") > 0.3) & F.col("later").isNotNull()).select("id", "d", r6(F.col("jump")).alias("jump"), ((F.abs("later") > 0.15) & (F.signum("later") == F.signum("jump"))).alias("held"))


@register(
    "w17_print_test",
    f"""{B}, r AS (SELECT id, d, close, lag(close) OVER w AS before, median(close) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS med FROM bars WINDOW w AS (PARTITION BY id ORDER BY d))
    SELECT id, d, round(med / before - 1, 6) AS settled FROM r WHERE abs(close / before - 1) > 0.3 AND med IS NOT NULL""",
)
def w17(spark, p):
    r = b(spark, p).select("id", "d", "close", F.lag("close").over(by()).alias("before"), F.percentile("close", 0.5).over(by().rowsBetween(1, 5)).alias("med"))
    return r.where((F.abs(F.col("close") / F.col("before") - 1) > 0.3) & F.col("med").isNotNull()).select("id", "d", r6(F.col("med") / F.col("before") - 1).alias("settled"))


@register("w18_last_rows", f"{B} SELECT id, d, close FROM bars QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC) <= 250")
def w18(spark, p):
    return R.top(b(spark, p).select("id", "d", "close"), ["id"], [F.desc("d")], 250)


@register(
    "w20_half_life_mean",
    f"""{B}, i AS (SELECT id, d, close, row_number() OVER (PARTITION BY id ORDER BY d) AS i FROM bars)
    SELECT id, d, round(sum(close * pow(2, i / 10.0)) OVER w / sum(pow(2, i / 10.0)) OVER w, 6) AS ewm FROM i WINDOW w AS (PARTITION BY id ORDER BY d)""",
)
def w20(spark, p):
    i = b(spark, p).select("id", "d", "close", F.row_number().over(Window.partitionBy("id").orderBy("d")).alias("i"))
    return i.select("id", "d", r6(R.ewm("close", "i", 10, ["id"])).alias("ewm"))


@register(
    "w21_gap_reclassify",
    f"{B}, g AS (SELECT id, d, close, lag(close) OVER w AS before, date_diff('day', lag(d) OVER w, d) AS gap FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)) SELECT id, d, gap, CASE WHEN gap > 7 THEN 'LONG_GAP' WHEN abs(close / before - 1) > 0.3 THEN 'JUMP' ELSE 'OK' END AS kind FROM g WHERE gap IS NOT NULL",
)
def w21(spark, p):
    g = b(spark, p).select("id", "d", "close", F.lag("close").over(by()).alias("before"), F.datediff("d", F.lag("d").over(by())).cast("long").alias("gap")).where("gap IS NOT NULL")
    kind = F.coalesce(R.ladder([("LONG_GAP", F.col("gap") > 7), ("JUMP", F.abs(F.col("close") / F.col("before") - 1) > 0.3)]), F.lit("OK"))
    return g.select("id", "d", "gap", kind.alias("kind"))


@register(
    "w23_snapshot_spells",
    f"""{D}, h AS (SELECT DISTINCT brand, participant, date_trunc('quarter', d)::DATE AS q FROM deals), s AS (SELECT brand, q, row_number() OVER w AS i, lead(q) OVER w AS after FROM (SELECT DISTINCT brand, q FROM h) WINDOW w AS (PARTITION BY brand ORDER BY q)),
    g AS (SELECT brand, participant, q, after, i, i - row_number() OVER (PARTITION BY brand, participant ORDER BY q) AS island FROM h JOIN s USING (brand, q))
    SELECT brand, participant, min(q) AS valid_from, arg_max(coalesce(after, DATE '9999-12-31'), i) AS valid_to, count(*) AS n FROM g GROUP BY brand, participant, island""",
)
def w23(spark, p):
    """A spell opens at the first snapshot that lists the entity and closes at the one that omits it."""
    h = deals(spark, p).select("brand", "participant", F.trunc("d", "quarter").alias("q")).distinct()
    w = Window.partitionBy("brand").orderBy("q")
    s = h.select("brand", "q").distinct().select("brand", "q", F.row_number().over(w).alias("i"), F.lead("q").over(w).alias("after"))
    g = h.join(s, ["brand", "q"]).withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("brand", "participant").orderBy("q")))
    open_end = F.coalesce("after", F.lit("9999-12-31").cast("date"))
    return g.groupBy("brand", "participant", "island").agg(F.min("q").alias("valid_from"), F.max_by(open_end, "i").alias("valid_to"), F.count(F.lit(1)).alias("n")).drop("island")


_RET = "ret AS (SELECT id, d, ln(close / lag(close) OVER (PARTITION BY id ORDER BY d)) AS x FROM bars)"


def log_returns(spark: SparkSession, p: str) -> DataFrame:
    return b(spark, p).withColumn("x", F.log(F.col("close") / F.lag("close").over(by())))


@register(
    "w29_rolling_kernel",
    f"""{B}, {_RET} SELECT id, d, round(sum(x) OVER w, 4) AS sum, round(stddev_samp(x) OVER w, 4) AS std, round(min(x) OVER w, 4) AS min, round(max(x) OVER w, 4) AS max, round(median(x) OVER w, 4) AS median,
    round(skewness(x) OVER w, 3) AS skew, round(kurtosis(x) OVER w, 3) AS kurt FROM ret WINDOW w AS (PARTITION BY id ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) QUALIFY count(x) OVER w >= 16""",
)
def w29(spark, p):
    """All moments of one frame share its sort; skew and kurtosis carry the sample-bias factors."""
    w = by().rowsBetween(-20, 0)
    n = F.count("x").over(w)
    skew = F.skewness("x").over(w) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("x").over(w) + 6)
    rolled = log_returns(spark, p).select(
        "id", "d", n.alias("n"), F.round(F.sum("x").over(w), 4).alias("sum"), F.round(F.stddev_samp("x").over(w), 4).alias("std"), F.round(F.min("x").over(w), 4).alias("min"),
        F.round(F.max("x").over(w), 4).alias("max"), F.round(F.percentile("x", 0.5).over(w), 4).alias("median"), F.round(skew, 3).alias("skew"), F.round(kurt, 3).alias("kurt"),
    )
    return rolled.where("n >= 16").drop("n")


@register(
    "w31_gapped_forward_sum",
    f"{B}, {_RET} SELECT id, d, CASE WHEN count(x) OVER w = 5 THEN round(sum(x) OVER w, 6) END AS fwd FROM ret WINDOW w AS (PARTITION BY id ORDER BY d ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)",
)
def w31(spark, p):
    w = by().rowsBetween(2, 6)
    return log_returns(spark, p).select("id", "d", F.when(F.count("x").over(w) == 5, r6(F.sum("x").over(w))).alias("fwd"))


@register(
    "w32_change_with_cap",
    f"""{D}, s AS (SELECT security, d, sum(qty) AS held FROM deals WHERE kind = 'R' GROUP BY ALL), g AS (SELECT security, d, held - lag(held) OVER w AS change, date_diff('day', lag(d) OVER w, d) AS span FROM s WINDOW w AS (PARTITION BY security ORDER BY d))
    SELECT security, d, span, CASE WHEN span <= 10 THEN change END AS change, span > 10 AS too_long FROM g WHERE span IS NOT NULL""",
)
def w32(spark, p):
    s = deals(spark, p).where("kind = 'R'").groupBy("security", "d").agg(F.sum("qty").alias("held"))
    w = Window.partitionBy("security").orderBy("d")
    g = s.select("security", "d", (F.col("held") - F.lag("held").over(w)).alias("change"), F.datediff("d", F.lag("d").over(w)).cast("long").alias("span")).where("span IS NOT NULL")
    return g.select("security", "d", "span", F.when(F.col("span") <= 10, F.col("change")).alias("change"), (F.col("span") > 10).alias("too_long"))


@register(
    "w34_same_window",
    f"""{B}, {_RET}, r AS (SELECT id, d, sum(x) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS s, month(d) <> month(lead(d) OVER (PARTITION BY id ORDER BY d)) AS turn FROM ret)
    SELECT id, d, turn, round((lag(s, 231) OVER w + lag(s, 483) OVER w) / 2, 6) AS seasonal FROM r WINDOW w AS (PARTITION BY id ORDER BY d) QUALIFY seasonal IS NOT NULL""",
)
def w34(spark, p):
    """Mean of the 21 rows ahead as they ran one and two years (252 rows each) ago."""
    r = log_returns(spark, p).select("id", "d", F.sum("x").over(by().rowsBetween(-20, 0)).alias("s"), (F.month("d") != F.month(F.lead("d").over(by()))).alias("turn"))
    mean = (F.lag("s", 252 - 21).over(by()) + F.lag("s", 2 * 252 - 21).over(by())) / 2
    return r.select("id", "d", "turn", r6(mean).alias("seasonal")).where("seasonal IS NOT NULL")


# Rankings


@register(
    "k03_top_by_absolute",
    f"{B}, r AS (SELECT id, d, close - lag(close) OVER (PARTITION BY id ORDER BY d) AS x FROM bars) SELECT d, id, round(x, 6) AS x, row_number() OVER (PARTITION BY d ORDER BY abs(round(x, 6)) DESC NULLS LAST, id) AS place FROM r QUALIFY place <= 3",
)
def k03(spark, p):
    r = b(spark, p).select("d", "id", r6(F.col("close") - F.lag("close").over(by())).alias("x"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("d").orderBy(F.abs("x").desc_nulls_last(), "id")).cast("long")).where("place <= 3")


@register(
    "k05_quantile_legs",
    f"""{B}, n AS (SELECT d, id, volume, row_number() OVER (PARTITION BY d ORDER BY volume, id) AS lo, row_number() OVER (PARTITION BY d ORDER BY volume DESC, id DESC) AS hi, floor(0.2 * count(*) OVER (PARTITION BY d) + 0.5) AS k FROM bars)
    SELECT d, id, CASE WHEN hi <= k THEN 'LONG' ELSE 'SHORT' END AS leg FROM n WHERE (hi <= k OR lo <= k) AND k > 0""",
)
def k05(spark, p):
    """One sort serves both legs: the place from the top is the group's size less the place from below."""
    x = b(spark, p).select("d", "id", F.row_number().over(Window.partitionBy("d").orderBy("volume", "id")).alias("lo"), F.count(F.lit(1)).over(Window.partitionBy("d")).alias("n"))
    x = x.withColumn("hi", F.col("n") - F.col("lo") + 1).withColumn("k", F.floor(0.2 * F.col("n") + 0.5))
    return x.where("(hi <= k OR lo <= k) AND k > 0").select("d", "id", F.when(F.col("hi") <= F.col("k"), "LONG").otherwise("SHORT").alias("leg"))


@register(
    "k06_last_sessions",
    f"""{B}, {CALENDAR_SQL}, m AS (SELECT max(i) AS ri, max(d) AS rd FROM cal GROUP BY date_trunc('month', d))
    SELECT rd, id, count(*) AS n, median(volume) AS med FROM m JOIN cal ON cal.i <= ri AND cal.i > ri - 63 JOIN bars USING (d) GROUP BY ALL""",
)
def k06(spark, p):
    """The range join is of dates with month-ends only; bars meet its result by date."""
    x = b(spark, p)
    cal = calendar(x).select("d", "i")
    ends = cal.groupBy(F.trunc("d", "month")).agg(F.max("i").alias("ri"), F.max("d").alias("rd"))
    near = ends.select("rd", F.explode(F.sequence(F.col("ri") - 62, F.col("ri"))).alias("i")).join(cal, "i")
    return x.join(near, "d").groupBy("rd", "id").agg(F.count(F.lit(1)).alias("n"), F.median("volume").alias("med"))


@register(
    "k08_preferred_versions",
    f"""{D}, v AS (SELECT brand, date_trunc('quarter', d)::DATE AS q, kind, d, sum(qty) AS value FROM deals GROUP BY ALL),
    one AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY brand, q ORDER BY CASE kind WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, d DESC) = 1)
    SELECT brand, q, kind, d, value FROM one QUALIFY row_number() OVER (PARTITION BY brand ORDER BY q DESC) <= 4""",
)
def k08(spark, p):
    v = deals(spark, p).groupBy("brand", F.trunc("d", "quarter").alias("q"), "kind", "d").agg(F.sum("qty").alias("value"))
    order = F.when(F.col("kind") == "R", 0).when(F.col("kind") == "A", 1).otherwise(2)
    return R.top(R.top(v, ["brand", "q"], [order, F.desc("d")]), ["brand"], [F.desc("q")], 4)
