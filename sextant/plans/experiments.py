"""Study operators: outcomes of events, books, resampled nulls and decisions.

Draws are rows: a resampling table (draw, block) is joined to data that were aggregated first, so a study costs draws
times groups and never draws times deals.  Random choices are md5 hashes of their keys, hence repeatable on any
cluster and equal in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.core.tables import CALENDAR_SQL, DEALS_SQL, bars, bars_sql, calendar, deals
from sextant.functions.numbers import correlation, correlation_sql, half_up, half_up_sql, r6
from sextant.operators import ranks
from sextant.operators import rows as R
from sextant.operators.timejoin import asof_join
from sextant.plans.catalog import register
from sextant.plans.slice import FWD_SQL

D, B = f"WITH {DEALS_SQL}", f"WITH {DEALS_SQL}, {bars_sql()}"
HORIZONS = (1, 3, 5, 10, 21, 42, 63, 126, 252)
COST = 0.002


def hashed(*parts: str | Column) -> Column:
    """32 bits of the md5 of the parts' texts joined by ``|``."""
    text = F.concat_ws("|", *(F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hashed_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({x} AS VARCHAR)' for x in parts)})), 1, 8) AS BIGINT)"


def by(*keys: str):
    return Window.partitionBy(*(keys or ("id",))).orderBy("d")


def events(x: DataFrame) -> DataFrame:
    return x.where("side = 'BUY' AND qty >= 40").select(F.col("brand").alias("id"), "d").distinct()


EVENTS_SQL = "e AS (SELECT DISTINCT brand AS id, d FROM deals WHERE side = 'BUY' AND qty >= 40)"


def outcomes(x: DataFrame) -> DataFrame:
    return R.forward_return(bars(x), 5, 20).where("fwd IS NOT NULL").select("id", "d", "fwd")


def cohorts(x: DataFrame, *keys: str) -> DataFrame:
    """m, keys, x: mean outcome of the buys of a month."""
    e = x.where("side = 'BUY' AND qty >= 40").select(F.col("brand").alias("id"), "d", *keys).distinct()
    return e.join(outcomes(x), ["id", "d"]).groupBy(F.trunc("d", "month").alias("m"), *keys).agg(F.avg("fwd").alias("x"))


def cohorts_sql(*keys: str) -> str:
    k = "".join(f", {c}" for c in keys)
    return f"{FWD_SQL}, ek AS (SELECT DISTINCT brand AS id, d{k} FROM deals WHERE side = 'BUY' AND qty >= 40), c AS (SELECT date_trunc('month', d)::DATE AS m{k}, avg(fwd) AS x FROM ek JOIN f USING (id, d) WHERE fwd IS NOT NULL GROUP BY ALL)"


@register(
    "d14_eligible_buys",
    f"""{D}, day AS (SELECT participant, d, bool_or(side = 'BUY') AND bool_or(side = 'SELL') AS rt FROM deals GROUP BY ALL), prop AS (SELECT participant FROM day GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (rt) >= 0.02 * count(*))
    SELECT participant, brand, d, count(*) AS n, {half_up_sql("sum(CAST(round(value * 100) AS BIGINT)) / (100 * sum(qty))", 4)} AS vwap FROM deals ANTI JOIN prop USING (participant) WHERE side = 'BUY' AND qty >= 30 GROUP BY ALL""",
)
def d14(spark, p):
    """Buys of participants that don't trade both ways, one row a participant, name and day with its VWAP."""
    x = deals(spark, p)
    day = x.groupBy("participant", "d").agg((F.bool_or(F.col("side") == "BUY") & F.bool_or(F.col("side") == "SELL")).cast("int").alias("rt"))
    prop = day.groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.sum("rt").alias("rt")).where("n >= 10 AND rt >= 0.02 * n")
    kept = x.where("side = 'BUY' AND qty >= 30").join(prop, "participant", "left_anti")
    return kept.groupBy("participant", "brand", "d").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / (100 * F.sum("qty")), 4).alias("vwap"))


@register(
    "d15_exit_reason",
    f"""WITH {DEALS_SQL}, {bars_sql('security')}, last AS (SELECT max(d) AS last_d FROM bars), x AS (SELECT id, d, lead(d, 5) OVER w AS out_d, max(d) OVER (PARTITION BY id) AS id_last FROM bars WINDOW w AS (PARTITION BY id ORDER BY d))
    SELECT CASE WHEN out_d IS NOT NULL AND date_diff('day', d, out_d) <= 60 THEN 'HORIZON' WHEN out_d IS NOT NULL THEN 'SUSPENDED' WHEN date_diff('day', id_last, last_d) <= 30 THEN 'CENSORED' ELSE 'DELISTED' END AS reason, year(d) AS y, count(*) AS n FROM x, last GROUP BY ALL""",
)
def d15(spark, p):
    b = bars(deals(spark, p), "security")
    x = b.select("id", "d", F.lead("d", 5).over(by()).alias("out_d"), F.max("d").over(Window.partitionBy("id")).alias("id_last"))
    x = x.crossJoin(F.broadcast(b.agg(F.max("d").alias("last_d"))))  # one row
    reason = R.ladder([("HORIZON", F.datediff("out_d", "d") <= 60), ("SUSPENDED", F.col("out_d").isNotNull()), ("CENSORED", F.datediff("last_d", "id_last") <= 30)]).otherwise("DELISTED")
    return x.groupBy(reason.alias("reason"), F.year("d").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "d16_outcome_variants",
    f"""{B}, {EVENTS_SQL}, hs AS (SELECT unnest([{', '.join(map(str, HORIZONS))}]) AS h), rs AS (SELECT unnest([0.0, 0.5, 1.0]) AS recovery),
    x AS (SELECT id, d, h, lead(open, 1) OVER w AS entry, lead(close, h) OVER w AS leave, max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS top, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS bottom, last_value(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close FROM bars, hs WINDOW w AS (PARTITION BY id, h ORDER BY d))
    SELECT h, recovery, count(*) AS n, count(*) FILTER (leave IS NULL) AS stopped, round(avg(coalesce(leave, recovery * last_close) / entry - 1), 6) AS gross, round(avg(coalesce(leave, recovery * last_close) / entry - 1 - {COST}), 6) AS net, round(avg(top / entry - 1), 6) AS mfe, round(avg(bottom / entry - 1), 6) AS mae FROM e JOIN x USING (id, d), rs WHERE entry IS NOT NULL GROUP BY ALL""",
)
def d16(spark, p):
    """Nine horizons from one window; what stops early leaves at a share of its last close.  Excursions are over 21 sessions."""
    x = deals(spark, p)
    last = F.last("close").over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leaves = F.array(*(F.struct(F.lit(h).alias("h"), F.lead("close", h).over(by()).alias("leave")) for h in HORIZONS))
    b = bars(x).select("id", "d", F.lead("open", 1).over(by()).alias("entry"), last.alias("last_close"), leaves.alias("leaves"), F.max("high").over(by().rowsBetween(1, 21)).alias("top"), F.min("low").over(by().rowsBetween(1, 21)).alias("bottom")).where("entry IS NOT NULL")
    y = events(x).join(b, ["id", "d"]).select("entry", "last_close", "top", "bottom", F.inline("leaves")).withColumn("recovery", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    ret = F.coalesce("leave", F.col("recovery") * F.col("last_close")) / F.col("entry") - 1
    return y.groupBy("h", "recovery").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("leave").isNull()).alias("stopped"), r6(F.avg(ret)).alias("gross"), r6(F.avg(ret - COST)).alias("net"), r6(F.avg(F.col("top") / F.col("entry") - 1)).alias("mfe"), r6(F.avg(F.col("bottom") / F.col("entry") - 1)).alias("mae"))


@register(
    "d17_relative_outcome",
    f"""{B}, {FWD_SQL}, {EVENTS_SQL}, t AS (SELECT id, m, ntile(3) OVER (PARTITION BY m ORDER BY t, id) AS tier FROM (SELECT id, date_trunc('month', d)::DATE AS m, sum(turnover) AS t FROM bars GROUP BY ALL)),
    g AS (SELECT f.id, f.d, fwd, tier FROM f JOIN t ON t.id = f.id AND t.m = date_trunc('month', f.d)::DATE WHERE fwd IS NOT NULL),
    k AS (SELECT *, count(*) OVER c AS n, sum(fwd) OVER c AS s, count(*) OVER a AS na, sum(fwd) OVER a AS sa FROM g WINDOW c AS (PARTITION BY d, tier), a AS (PARTITION BY d))
    SELECT year(d) AS y, CASE WHEN n > 3 THEN 'TIER' WHEN na > 3 THEN 'MARKET' ELSE 'NONE' END AS level, count(*) AS n, round(avg(fwd - CASE WHEN n > 3 THEN (s - fwd) / (n - 1) WHEN na > 3 THEN (sa - fwd) / (na - 1) END), 6) AS relative FROM k JOIN e USING (id, d) GROUP BY ALL""",
)
def d17(spark, p):
    """Outcome less the mean of the other names of its size tier and day, else of the day; no pair of names is made."""
    x = deals(spark, p)
    b = bars(x)
    t = b.groupBy("id", F.trunc("d", "month").alias("m")).agg(F.sum("turnover").alias("t")).withColumn("tier", F.ntile(3).over(Window.partitionBy("m").orderBy("t", "id"))).drop("t")
    g = R.forward_return(b, 5, 20).where("fwd IS NOT NULL").select("id", "d", "fwd", F.trunc("d", "month").alias("m")).join(t, ["id", "m"])
    k = R.leave_one_out(g, ["d", "tier"], "fwd", "tier_mean").withColumnRenamed("peer_n", "tier_n")
    k = R.leave_one_out(k, ["d"], "fwd", "day_mean").join(events(x), ["id", "d"])
    level = R.ladder([("TIER", F.col("tier_n") >= 3), ("MARKET", F.col("peer_n") >= 3)]).otherwise("NONE")
    base = F.when(F.col("tier_n") >= 3, F.col("tier_mean")).when(F.col("peer_n") >= 3, F.col("day_mean"))
    return k.groupBy(F.year("d").alias("y"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("fwd") - base)).alias("relative"))


@register(
    "d20_consensus_events",
    f"""{D}, {CALENDAR_SQL}, b AS (SELECT DISTINCT security, participant, i, strict FROM deals JOIN cal USING (d), (SELECT unnest([true, false]) AS strict) WHERE side = 'BUY' AND qty >= CASE WHEN strict THEN 45 ELSE 35 END),
    days AS (SELECT DISTINCT security, strict, i FROM b), n AS (SELECT days.security, days.strict, days.i, count(DISTINCT participant) AS n FROM days JOIN b ON b.security = days.security AND b.strict = days.strict AND b.i BETWEEN days.i - 20 AND days.i GROUP BY ALL),
    x AS (SELECT *, lag(n) OVER w AS before, lag(i) OVER w AS before_i FROM n WINDOW w AS (PARTITION BY security, strict ORDER BY i))
    SELECT strict, security, d, n FROM x JOIN cal USING (i) WHERE n >= 3 AND (before IS NULL OR before < 3 OR i - before_i > 20)""",
)
def d20(spark, p):
    """Distinct buyers of the last 21 sessions; an event is where they reach three."""
    x = deals(spark, p)
    cal = calendar(x).select("d", "i")
    bought = x.where("side = 'BUY' AND qty >= 35").join(cal, "d")
    b = bought.select("security", "participant", "i", F.explode(F.when(F.col("qty") >= 45, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("strict"))
    n = R.trailing_distinct(b, ["security", "strict"], "i", "participant", 21)
    own = Window.partitionBy("security", "strict").orderBy("i")
    x = n.withColumn("before", F.lag("n").over(own)).withColumn("gap", F.col("i") - F.lag("i").over(own)).where("n >= 3 AND (before IS NULL OR before < 3 OR gap > 20)")
    return x.join(cal, "i").select("strict", "security", "d", "n")


@register(
    "d27_random_names",
    f"""{B}, {FWD_SQL}, {EVENTS_SQL}, o AS (SELECT id, d, fwd, row_number() OVER (PARTITION BY d ORDER BY {hashed_sql('id', 'd')}, id) AS k FROM f ANTI JOIN e USING (id, d) WHERE fwd IS NOT NULL),
    ev AS (SELECT d, fwd, row_number() OVER (PARTITION BY d ORDER BY id) AS k FROM f JOIN e USING (id, d) WHERE fwd IS NOT NULL)
    SELECT year(ev.d) AS y, count(*) AS n, count(o.fwd) AS matched, round(avg(ev.fwd), 6) AS event_mean, round(avg(o.fwd), 6) AS random_mean FROM ev LEFT JOIN o USING (d, k) GROUP BY ALL""",
)
def d27(spark, p):
    """As many other names, in hash order, as a day has events."""
    x = deals(spark, p)
    f, e = outcomes(x), events(x)
    o = f.join(e, ["id", "d"], "left_anti").select("d", F.col("fwd").alias("other"), F.row_number().over(Window.partitionBy("d").orderBy(hashed("id", "d"), "id")).alias("k"))
    ev = f.join(e, ["id", "d"]).select("d", "fwd", F.row_number().over(Window.partitionBy("d").orderBy("id")).alias("k"))
    return ev.join(o, ["d", "k"], "left").groupBy(F.year("d").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count("other").alias("matched"), r6(F.avg("fwd")).alias("event_mean"), r6(F.avg("other")).alias("random_mean"))


@register(
    "d28_volatility_peers",
    f"""{B}, {FWD_SQL}, {EVENTS_SQL}, r AS (SELECT id, d, turnover, close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1 AS r FROM bars), v AS (SELECT id, d, round(stddev_samp(r) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 9) AS v, round(avg(turnover) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 4) AS t FROM r),
    q AS (SELECT id, d, unnest(['volatility', 'size']) AS match, unnest([ntile(5) OVER (PARTITION BY d ORDER BY v, id), ntile(5) OVER (PARTITION BY d ORDER BY t, id)]) AS q FROM v WHERE v IS NOT NULL)
    SELECT match, q, count(*) FILTER (e.id IS NOT NULL) AS n_events, count(*) FILTER (e.id IS NULL) AS n_peers, round(avg(fwd) FILTER (e.id IS NOT NULL) - avg(fwd) FILTER (e.id IS NULL), 6) AS gap FROM q JOIN f USING (id, d) LEFT JOIN e USING (id, d) WHERE fwd IS NOT NULL GROUP BY ALL""",
)
def d28(spark, p):
    """Events against the day's other names of the same volatility quintile, and of the same size quintile."""
    x = deals(spark, p)
    span = by().rowsBetween(-20, 0)
    r = bars(x).select("id", "d", "turnover", (F.col("close") / F.lag("close").over(by()) - 1).alias("r"))
    v = r.select("id", "d", F.round(F.stddev_samp("r").over(span), 9).alias("v"), F.round(F.avg("turnover").over(span), 4).alias("t")).where("v IS NOT NULL AND NOT isnan(v)")
    day = Window.partitionBy("d")
    both = F.array(F.struct(F.lit("volatility").alias("match"), F.ntile(5).over(day.orderBy("v", "id")).alias("q")), F.struct(F.lit("size").alias("match"), F.ntile(5).over(day.orderBy("t", "id")).alias("q")))
    q = v.select("id", "d", both.alias("both")).select("id", "d", F.inline("both"))
    j = q.join(outcomes(x), ["id", "d"]).join(events(x).withColumn("hit", F.lit(1)), ["id", "d"], "left")
    event, peer = F.when(F.col("hit").isNotNull(), F.col("fwd")), F.when(F.col("hit").isNull(), F.col("fwd"))
    return j.groupBy("match", "q").agg(F.count(event).alias("n_events"), F.count(peer).alias("n_peers"), r6(F.avg(event) - F.avg(peer)).alias("gap"))


@register(
    "d30_era_and_survivors",
    f"""{B}, {FWD_SQL}, {EVENTS_SQL}, l AS (SELECT id, max(d) >= (SELECT max(d) FROM bars) - 30 AS survivor FROM bars GROUP BY 1)
    , se AS (SELECT DISTINCT brand AS id, d AS sold FROM deals WHERE side = 'SELL' AND qty >= 40), rt AS (SELECT e.id, e.d, min(sold) AS sold FROM e LEFT JOIN se ON se.id = e.id AND sold > e.d GROUP BY ALL)
    SELECT CASE WHEN year(d) < 1995 THEN 'EARLY' WHEN year(d) < 2000 THEN 'MIDDLE' ELSE 'LATE' END AS era, survivor, count(*) AS n, round(avg(fwd), 6) AS mean, count(*) FILTER (date_diff('day', d, sold) <= 90) AS round_trips, round(avg(fwd) FILTER (sold IS NULL OR date_diff('day', d, sold) > 90), 6) AS mean_without FROM e JOIN f USING (id, d) JOIN l USING (id) JOIN rt USING (id, d) WHERE fwd IS NOT NULL GROUP BY ALL""",
)
def d30(spark, p):
    """By era and survival: events, their mean, how many a large sale of the name follows within 90 days, and the mean without those."""
    x = deals(spark, p)
    lasts = bars(x).groupBy("id").agg(F.max("d").alias("last"))
    survivors = lasts.crossJoin(F.broadcast(lasts.agg(F.max("last").alias("end")))).select("id", (F.datediff("end", "last") <= 30).alias("survivor"))
    era = R.ladder([("EARLY", F.year("d") < 1995), ("MIDDLE", F.year("d") < 2000)]).otherwise("LATE")
    sold = x.where("side = 'SELL' AND qty >= 40").select(F.col("brand").alias("id"), F.col("d").alias("sold")).distinct()
    e = asof_join(events(x), sold, ["id"], "d", "sold", direction="forward", strict=True).withColumn("trip", F.coalesce(F.datediff("sold", "d") <= 90, F.lit(False)))
    told = e.join(outcomes(x), ["id", "d"]).join(survivors, "id").groupBy(era.alias("era"), "survivor")
    return told.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd")).alias("mean"), F.count_if("trip").alias("round_trips"), r6(F.avg(F.when(~F.col("trip"), F.col("fwd")))).alias("mean_without"))


@register(
    "d32_split_half",
    f"""{B}, {FWD_SQL}, {EVENTS_SQL}, s AS (SELECT id, date_trunc('quarter', d)::DATE AS q, sum(fwd) AS s, count(*) AS n FROM e JOIN f USING (id, d) WHERE fwd IS NOT NULL GROUP BY ALL), k AS (SELECT draw, q, {hashed_sql('id', 'draw')} % 2 AS half, sum(s) / sum(n) AS x FROM s, (SELECT unnest(range(0, 50)) AS draw) GROUP BY ALL),
    p AS (SELECT draw, q, max(x) FILTER (half = 0) AS a, max(x) FILTER (half = 1) AS b FROM k GROUP BY ALL) SELECT draw, count(*) AS n, round({correlation_sql("a", "b")}, 6) AS corr FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
)
def d32(spark, p):
    """Names are split by hash 50 times; what is crossed with the draws are sums per name and quarter."""
    x = deals(spark, p)
    s = events(x).join(outcomes(x), ["id", "d"]).groupBy("id", F.trunc("d", "quarter").alias("q")).agg(F.sum("fwd").alias("s"), F.count(F.lit(1)).alias("n"))
    k = s.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("half", hashed("id", "draw") % 2)
    mean = lambda h: F.sum(F.when(F.col("half") == h, F.col("s"))) / F.sum(F.when(F.col("half") == h, F.col("n")))
    pairs = k.groupBy("draw", "q").agg(mean(0).alias("a"), mean(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return pairs.groupBy(F.col("draw").cast("long").alias("draw")).agg(F.count(F.lit(1)).alias("n"), r6(correlation("a", "b")).alias("corr"))


@register(
    "d33_long_short_book",
    f"""{B}, c AS (SELECT id, date_trunc('month', d)::DATE AS m, arg_max(close, d) AS close, sum(turnover) AS turnover, avg(high / low) AS span FROM bars GROUP BY ALL),
    r AS (SELECT id, m, close / lag(close) OVER w - 1 AS past, turnover / lag(turnover) OVER w AS turn, -span AS calm, lead(close) OVER w / close - 1 AS next FROM c WINDOW w AS (PARTITION BY id ORDER BY m)), u AS (SELECT * FROM (UNPIVOT r ON past, turn, calm INTO NAME signal VALUE v)),
    q AS (SELECT *, ntile(5) OVER (PARTITION BY signal, m ORDER BY round(v, 9), id) AS q FROM u), h AS (SELECT *, CASE WHEN q = 5 THEN 1 WHEN q = 1 THEN -1 ELSE 0 END AS side FROM q),
    t AS (SELECT h.*, coalesce(b.side, 0) AS before FROM h LEFT JOIN h b ON b.signal = h.signal AND b.id = h.id AND b.m = h.m - INTERVAL 1 MONTH)
    SELECT signal, m, count(*) FILTER (side <> 0) AS names, round(avg(next) FILTER (side = 1) - avg(next) FILTER (side = -1), 6) AS gross, count(*) FILTER (side <> 0 AND side <> before) AS entered, round(avg(next) FILTER (side = 1) - avg(next) FILTER (side = -1) - {COST} * count(*) FILTER (side <> 0 AND side <> before) / nullif(count(*) FILTER (side <> 0), 0), 6) AS net FROM t GROUP BY ALL""",
)
def d33(spark, p):
    """Monthly quintile books of three signals (past return, growth of turnover, calm); a leg's cost is charged on the names that were not in
    it a month before."""
    w, own = Window.partitionBy("id").orderBy("m"), Window.partitionBy("signal", "id").orderBy("m")
    c = bars(deals(spark, p)).groupBy("id", F.trunc("d", "month").alias("m")).agg(F.max_by("close", "d").alias("close"), F.sum("turnover").alias("turnover"), F.avg(F.col("high") / F.col("low")).alias("span"))
    r = c.select("id", "m", (F.col("close") / F.lag("close").over(w) - 1).alias("past"), (F.col("turnover") / F.lag("turnover").over(w)).alias("turn"), (-F.col("span")).alias("calm"), (F.lead("close").over(w) / F.col("close") - 1).alias("next"))
    u = r.unpivot(["id", "m", "next"], ["past", "turn", "calm"], "signal", "v").where("v IS NOT NULL")
    q = u.withColumn("q", F.ntile(5).over(Window.partitionBy("signal", "m").orderBy(F.round("v", 9), "id")))
    h = q.withColumn("side", F.when(F.col("q") == 5, 1).when(F.col("q") == 1, -1).otherwise(0))
    adjacent = F.lag("m").over(own) == F.add_months("m", -1)
    t = h.withColumn("before", F.when(adjacent, F.lag("side").over(own)).otherwise(0))
    leg = lambda s: F.avg(F.when(F.col("side") == s, F.col("next")))
    out = t.groupBy("signal", "m").agg(F.count_if(F.col("side") != 0).alias("names"), (leg(1) - leg(-1)).alias("raw"), F.count_if((F.col("side") != 0) & (F.col("side") != F.coalesce("before", F.lit(0)))).alias("entered"))
    return out.select("signal", "m", "names", r6(F.col("raw")).alias("gross"), "entered", r6(F.col("raw") - COST * F.col("entered") / F.nullif(F.col("names"), F.lit(0))).alias("net"))


#: Sample rates (valid_from, valid_to, component, kind, rate): of turnover, per 10 million, or percent of the fees named before it.
FEES = [("1990-01-01", "1998-01-01", "exchange", "TURNOVER", 0.0000345), ("1998-01-01", None, "exchange", "TURNOVER", 0.0000297), ("1990-01-01", None, "regulator", "PER_CRORE", 10.0), ("1996-01-01", None, "tax", "PERCENT_OF_BASE", 18.0)]
_FEES_SQL = "fees(valid_from, valid_to, component, kind, rate) AS (VALUES " + ", ".join(f"(DATE '{a}', {f'DATE {b!r}' if b else 'NULL::DATE'}, '{c}', '{k}', {r!r}::DOUBLE)" for a, b, c, k, r in FEES) + ")"


@register(
    "d35_statutory_cost",
    f"""{D}, {_FEES_SQL}, day AS (SELECT d, side, sum(value) AS turnover FROM deals GROUP BY ALL),
    b AS (SELECT d, side, turnover, sum(CASE kind WHEN 'TURNOVER' THEN rate * turnover WHEN 'PER_CRORE' THEN rate * turnover / 1e7 ELSE 0 END) AS base, sum(CASE kind WHEN 'PERCENT_OF_BASE' THEN rate ELSE 0 END) AS pct FROM day JOIN fees ON d >= valid_from AND (valid_to IS NULL OR d < valid_to) GROUP BY ALL)
    SELECT year(d) AS y, side, round(sum(turnover), 2) AS turnover, round(sum(base * (1 + pct / 100)), 4) AS cost, round(1e4 * sum(base * (1 + pct / 100)) / sum(turnover), 6) AS bps FROM b GROUP BY ALL""",
)
def d35(spark, p):
    """Turnover folds to days before the fee table, a parameter of a few rows, is joined on its dates."""
    day = deals(spark, p).groupBy("d", "side").agg(F.sum("value").alias("turnover"))
    fees = F.broadcast(spark.createDataFrame(FEES, "valid_from string, valid_to string, component string, kind string, rate double").withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")}))
    j = day.join(fees, (F.col("d") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("d") < F.col("valid_to"))))
    part = F.when(F.col("kind") == "TURNOVER", F.col("rate") * F.col("turnover")).when(F.col("kind") == "PER_CRORE", F.col("rate") * F.col("turnover") / 1e7).otherwise(0.0)
    b = j.groupBy("d", "side", "turnover").agg(F.sum(part).alias("base"), F.sum(F.when(F.col("kind") == "PERCENT_OF_BASE", F.col("rate")).otherwise(0.0)).alias("pct"))
    cost = F.sum(F.col("base") * (1 + F.col("pct") / 100))
    return b.groupBy(F.year("d").alias("y"), "side").agg(F.round(F.sum("turnover"), 2).alias("turnover"), F.round(cost, 4).alias("cost"), r6(1e4 * cost / F.sum("turnover")).alias("bps"))


@register(
    "d36_cost_scenarios",
    f"""{B}, r AS (SELECT id, d, turnover, close / lag(close) OVER w - 1 AS r FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)), s AS (SELECT id, avg(turnover) AS adv, stddev_samp(r) AS sigma FROM r GROUP BY 1), z(scenario, fixed, y) AS (VALUES ('gross', 0.0, 0.0), ('base', 0.001, 0.7), ('pessimistic', 0.002, 1.2))
    SELECT scenario, side, count(*) AS n, round(avg(fixed + y * sigma * sqrt(value / adv)), 6) AS cost FROM deals JOIN s ON s.id = brand, z WHERE sigma IS NOT NULL GROUP BY ALL""",
)
def d36(spark, p):
    x = deals(spark, p)
    r = bars(x).select("id", "turnover", (F.col("close") / F.lag("close").over(by()) - 1).alias("r"))
    s = r.groupBy(F.col("id").alias("brand")).agg(F.avg("turnover").alias("adv"), F.stddev_samp("r").alias("sigma")).where("sigma IS NOT NULL")
    j = x.join(s, "brand").select("side", (F.col("sigma") * F.sqrt(F.col("value") / F.col("adv"))).alias("impact"))
    total = j.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("impact").alias("impact"))
    z = F.array(*(F.struct(F.lit(a).alias("scenario"), F.lit(f).alias("fixed"), F.lit(y).alias("y")) for a, f, y in (("gross", 0.0, 0.0), ("base", 0.001, 0.7), ("pessimistic", 0.002, 1.2))))
    return total.select("side", "n", "impact", F.inline(z)).select("scenario", "side", "n", r6(F.col("fixed") + F.col("y") * F.col("impact")).alias("cost"))


@register(
    "d38_regime_multiplier",
    f"""{B}, r AS (SELECT d, abs(close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1) AS r FROM bars), v AS (SELECT d, round(avg(r), 9) AS v FROM r WHERE r IS NOT NULL GROUP BY 1),
    t AS (SELECT d, v, quantile_cont(v, 0.5) OVER w AS med, quantile_cont(v, 0.9) OVER w AS p90, count(*) OVER w AS n FROM v WINDOW w AS (ORDER BY d ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))
    SELECT d, round(CASE WHEN n < 20 OR v <= med THEN 1 WHEN v >= p90 THEN 2 ELSE 1 + (v - med) / (p90 - med) END, 5) AS multiplier FROM t""",
)
def d38(spark, p):
    """One row a session reaches the global window."""
    r = bars(deals(spark, p)).select("d", F.abs(F.col("close") / F.lag("close").over(by()) - 1).alias("r")).where("r IS NOT NULL")
    v = r.groupBy("d").agg(F.round(F.avg("r"), 9).alias("v"))
    w = Window.orderBy("d").rowsBetween(-63, -1)
    t = v.select("d", "v", F.percentile("v", 0.5).over(w).alias("med"), F.percentile("v", 0.9).over(w).alias("p90"), F.count(F.lit(1)).over(w).alias("n"))
    m = F.when((F.col("n") < 20) | (F.col("v") <= F.col("med")), 1.0).when(F.col("v") >= F.col("p90"), 2.0).otherwise(1 + (F.col("v") - F.col("med")) / (F.col("p90") - F.col("med")))
    return t.select("d", F.round(m, 5).alias("multiplier"))


@register(
    "d40_power_grid",
    f"""{B}, hs AS (SELECT unnest([5, 21, 63]) AS h), x AS (SELECT id, d, h, lead(close, h) OVER w / lead(open, 1) OVER w - 1 AS fwd FROM bars, hs WINDOW w AS (PARTITION BY id, h ORDER BY d)),
    pops AS (SELECT DISTINCT brand AS id, d, pop FROM deals, (SELECT unnest(['large_buy', 'large_sell', 'any']) AS pop) WHERE (pop = 'large_buy' AND side = 'BUY' AND qty >= 40) OR (pop = 'large_sell' AND side = 'SELL' AND qty >= 40) OR pop = 'any'),
    c AS (SELECT pop, h, date_trunc('month', d)::DATE AS m, avg(fwd) AS x FROM pops JOIN x USING (id, d) WHERE fwd IS NOT NULL GROUP BY ALL)
    SELECT pop, h, count(*) AS months, round(avg(x), 6) AS mean, round(2.8 * stddev_samp(x) / sqrt(count(*)), 6) AS mde FROM c GROUP BY ALL""",
)
def d40(spark, p):
    x = deals(spark, p)
    fwd = F.array(*(F.struct(F.lit(h).alias("h"), (F.lead("close", h).over(by()) / F.lead("open", 1).over(by()) - 1).alias("fwd")) for h in (5, 21, 63)))
    f = bars(x).select("id", "d", fwd.alias("fs"))
    pops = F.array_compact(F.array(F.when((F.col("side") == "BUY") & (F.col("qty") >= 40), "large_buy"), F.when((F.col("side") == "SELL") & (F.col("qty") >= 40), "large_sell"), F.lit("any")))
    e = x.select(F.col("brand").alias("id"), "d", F.explode(pops).alias("pop")).distinct()
    c = e.join(f, ["id", "d"]).select("pop", F.trunc("d", "month").alias("m"), F.inline("fs")).where("fwd IS NOT NULL").groupBy("pop", "h", "m").agg(F.avg("fwd").alias("x"))
    return c.groupBy("pop", "h").agg(F.count(F.lit(1)).alias("months"), r6(F.avg("x")).alias("mean"), r6(2.8 * F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))).alias("mde"))


DRAWS, BLOCK = 200, 3


@register(
    "d41_block_bootstrap",
    f"""{B}, {cohorts_sql('kind')}, s AS (SELECT kind, x, row_number() OVER (PARTITION BY kind ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM c),
    t AS (SELECT kind, max(n) AS n FROM s GROUP BY 1), k AS (SELECT kind, n, draw, b * {BLOCK} + o AS pos, ({hashed_sql('kind', 'draw', 'b')} + o) % n AS i FROM t, (SELECT unnest(range(0, {DRAWS})) AS draw), (SELECT unnest(range(0, 100)) AS b), (SELECT unnest(range(0, {BLOCK})) AS o) WHERE b * {BLOCK} + o < n),
    m AS (SELECT k.kind, draw, avg(x) AS x FROM k JOIN s ON s.kind = k.kind AND s.i = k.i GROUP BY ALL)
    SELECT kind, round(quantile_cont(x, 0.025), 6) AS lo, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.975), 6) AS hi FROM m GROUP BY 1""",
)
def d41(spark, p):
    """Circular blocks of months: the starts are hashes of (population, draw, block)."""
    s = cohorts(deals(spark, p), "kind").withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("m")) - 1).select("kind", "x", F.col("i").cast("long").alias("i"))
    t = s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    starts = t.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    k = starts.withColumn("start", hashed("kind", "draw", "b")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).where(f"b * {BLOCK} + o < n")
    m = k.select("kind", "draw", ((F.col("start") + F.col("o")) % F.col("n")).alias("i")).join(s, ["kind", "i"]).groupBy("kind", "draw").agg(F.avg("x").alias("x"))
    return m.groupBy("kind").agg(r6(F.percentile("x", 0.025)).alias("lo"), r6(F.avg("x")).alias("mean"), r6(F.percentile("x", 0.975)).alias("hi"))


@register(
    "d42_permutation",
    f"""{B}, {FWD_SQL}, {EVENTS_SQL}, g AS (SELECT f.id, d, fwd, (e.id IS NOT NULL)::INT AS hit, date_trunc('month', d)::DATE AS m FROM f LEFT JOIN e USING (id, d) WHERE fwd IS NOT NULL),
    w AS (SELECT m, id, avg(fwd) AS fwd, max(hit) AS hit FROM g GROUP BY ALL), n AS (SELECT m, sum(hit) AS k, count(*) AS n FROM w GROUP BY 1 HAVING sum(hit) BETWEEN 1 AND count(*) - 1),
    d AS (SELECT draw, m, k, fwd, row_number() OVER (PARTITION BY draw, m ORDER BY {hashed_sql('draw', 'm', 'id')}, id) AS pos FROM w JOIN n USING (m), (SELECT unnest(range(0, 100)) AS draw)),
    x AS (SELECT draw, avg(fwd) FILTER (pos <= k) - avg(fwd) FILTER (pos > k) AS x FROM d GROUP BY 1), o AS (SELECT avg(fwd) FILTER (hit = 1) - avg(fwd) FILTER (hit = 0) AS obs FROM w JOIN n USING (m))
    SELECT round(any_value(obs), 6) AS observed, count(*) AS draws, round((1 + count(*) FILTER (abs(x) >= abs(obs))) / (1 + count(*)), 6) AS p FROM x, o""",
)
def d42(spark, p):
    """Labels are dealt anew within each month by hash order; names and months, not deals, are crossed with the draws."""
    x = deals(spark, p)
    g = outcomes(x).join(events(x).withColumn("hit", F.lit(1)), ["id", "d"], "left").fillna(0, ["hit"])
    w = g.groupBy(F.trunc("d", "month").alias("m"), "id").agg(F.avg("fwd").alias("fwd"), F.max("hit").alias("hit"))
    month = Window.partitionBy("m")
    w = w.withColumn("k", F.sum("hit").over(month)).withColumn("n", F.count(F.lit(1)).over(month)).where("k BETWEEN 1 AND n - 1")
    d = w.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("pos", F.row_number().over(Window.partitionBy("draw", "m").orderBy(hashed("draw", "m", "id"), "id")))
    gap = lambda c: F.avg(F.when(c, F.col("fwd"))) - F.avg(F.when(~c, F.col("fwd")))
    draws = d.groupBy("draw").agg(gap(F.col("pos") <= F.col("k")).alias("x"))
    obs = w.agg(gap(F.col("hit") == 1).alias("obs"))
    j = draws.crossJoin(F.broadcast(obs))  # one row
    return j.agg(r6(F.any_value("obs")).alias("observed"), F.count(F.lit(1)).alias("draws"), r6((1 + F.count_if(F.abs("x") >= F.abs("obs"))) / (1 + F.count(F.lit(1)))).alias("p"))


@register(
    "d43_null_spread",
    f"""{B}, {FWD_SQL}, w AS (SELECT date_trunc('month', d)::DATE AS m, id, avg(fwd) AS fwd FROM f WHERE fwd IS NOT NULL GROUP BY ALL), r AS (SELECT draw, m, fwd, ntile(5) OVER (PARTITION BY draw, m ORDER BY {hashed_sql('draw', 'm', 'id')}, id) AS q FROM w, (SELECT unnest(range(0, 100)) AS draw)),
    s AS (SELECT draw, m, avg(fwd) FILTER (q = 5) - avg(fwd) FILTER (q = 1) AS s FROM r GROUP BY ALL), k AS (SELECT draw, avg(s) AS s FROM s GROUP BY 1) SELECT count(*) AS draws, round(stddev_samp(s), 6) AS null_se, round(2.8 * stddev_samp(s), 6) AS mde FROM k""",
)
def d43(spark, p):
    w = outcomes(deals(spark, p)).groupBy(F.trunc("d", "month").alias("m"), "id").agg(F.avg("fwd").alias("fwd"))
    r = w.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("q", F.ntile(5).over(Window.partitionBy("draw", "m").orderBy(hashed("draw", "m", "id"), "id")))
    s = r.groupBy("draw", "m").agg((F.avg(F.when(F.col("q") == 5, F.col("fwd"))) - F.avg(F.when(F.col("q") == 1, F.col("fwd")))).alias("s"))
    k = s.groupBy("draw").agg(F.avg("s").alias("s"))
    return k.agg(F.count(F.lit(1)).alias("draws"), r6(F.stddev_samp("s")).alias("null_se"), r6(2.8 * F.stddev_samp("s")).alias("mde"))


_STUDENT_SQL = f"""{B}, {cohorts_sql('brand')}, o AS (SELECT brand, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) AS t, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 6),
    bs AS (SELECT draw, brand, sum((({hashed_sql('draw', 'm')}) % 2 * 2 - 1) * (x - mean)) / any_value(n) / nullif(any_value(se), 0) AS t FROM c JOIN o USING (brand), (SELECT unnest(range(0, {DRAWS})) AS draw) GROUP BY ALL)"""


def studentised(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observed t per name, and per draw the t of centred months whose signs are flipped for all names at once."""
    c = cohorts(x, "brand")
    se = F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))
    o = c.groupBy("brand").agg(F.try_divide(F.avg("x"), se).alias("t"), F.avg("x").alias("mean"), se.alias("se"), F.count(F.lit(1)).alias("n")).where("n >= 6")
    flips = c.join(o.drop("t"), "brand").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    sign = hashed("draw", "m") % 2 * 2 - 1
    return o, flips.groupBy("draw", "brand").agg(F.try_divide(F.sum(sign * (F.col("x") - F.col("mean"))) / F.any_value("n"), F.any_value("se")).alias("t"))


@register(
    "d45_stepdown_p_values",
    f"""{_STUDENT_SQL}, r AS (SELECT brand, t, row_number() OVER (ORDER BY abs(t) DESC, brand) AS k FROM o), mx AS (SELECT draw, k, max(abs(bs.t)) OVER (PARTITION BY draw ORDER BY k DESC) AS mx FROM bs JOIN r USING (brand)),
    p AS (SELECT r.brand, r.k, r.t, (1 + count(*) FILTER (mx >= abs(r.t))) / (1 + count(*)) AS p FROM mx JOIN r USING (k) GROUP BY ALL) SELECT brand, round(t, 5) AS t, round(max(p) OVER (ORDER BY k), 6) AS p FROM p""",
)
def d45(spark, p):
    """The maximum over this and all weaker hypotheses, per draw; hypotheses are numbered over ranges."""
    o, bs = studentised(deals(spark, p))
    r = ranks.numbered(o.select("brand", F.col("t").alias("obs")), [F.abs("obs").desc(), F.col("brand")], to="k")
    mx = bs.join(r, "brand").select("brand", "k", "obs", F.max(F.abs("t")).over(Window.partitionBy("draw").orderBy(F.desc("k"))).alias("mx"))
    raw = mx.groupBy("brand", "k", "obs").agg(((1 + F.count_if(F.col("mx") >= F.abs("obs"))) / (1 + F.count(F.lit(1)))).alias("p"))
    return ranks.running(materialise(raw, "raw"), "k", "p", "max", "top").select("brand", F.round("obs", 5).alias("t"), r6(F.col("top")).alias("p"))


@register(
    "d51_forward_score",
    f"""{B}, {cohorts_sql('brand')}, sel AS (SELECT brand, sign(avg(x)) AS s FROM c WHERE year(m) < 1999 GROUP BY 1 HAVING count(*) >= 6 ORDER BY abs(round(avg(x), 9)) DESC, brand LIMIT 10),
    k AS (SELECT date_trunc('quarter', m)::DATE AS q, count(DISTINCT m) AS months, avg(s * x) AS x FROM c JOIN sel USING (brand) WHERE year(m) >= 1999 GROUP BY 1), w AS (SELECT x, lag(x) OVER (ORDER BY q) AS before FROM k WHERE months = 3)
    SELECT count(*) AS blocks, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(*)), 6) AS se, round(coalesce({correlation_sql("x", "before")}, 0), 5) AS rho FROM w""",
)
def d51(spark, p):
    """A selection frozen before 1999, scored in its own sign over complete quarters only."""
    c = cohorts(deals(spark, p), "brand")
    sel = c.where(F.year("m") < 1999).groupBy("brand").agg(F.avg("x").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 6").orderBy(F.abs(F.round("a", 9)).desc(), "brand").limit(10).select("brand", F.signum("a").alias("s"))
    k = c.where(F.year("m") >= 1999).join(sel, "brand").groupBy(F.trunc("m", "quarter").alias("q")).agg(F.count_distinct("m").alias("months"), F.avg(F.col("s") * F.col("x")).alias("x")).where("months = 3")
    w = k.select("x", F.lag("x").over(Window.orderBy("q")).alias("before"))
    return w.agg(F.count(F.lit(1)).alias("blocks"), r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.round(F.coalesce(correlation("x", "before"), F.lit(0.0)), 5).alias("rho"))


@register(
    "d52_multiplicity_bar",
    f"""{D}, t AS (SELECT kind AS family, date_trunc('quarter', d)::DATE AS since, count(DISTINCT brand) AS trials FROM deals GROUP BY ALL), s AS (SELECT family, since, trials, sum(trials) OVER (PARTITION BY family ORDER BY since) AS charged FROM t)
    SELECT family, since, trials, charged::BIGINT AS charged, round(1 - (1 - 0.05) ^ (1.0 / charged), 9) AS alpha, round(sqrt(2 * ln(charged)), 6) AS expected_max FROM s""",
)
def d52(spark, p):
    """Running charge of trials per family, its Sidak level and the leading term of the expected null maximum."""
    t = deals(spark, p).groupBy(F.col("kind").alias("family"), F.trunc("d", "quarter").alias("since")).agg(F.count_distinct("brand").alias("trials"))
    s = t.withColumn("charged", F.sum("trials").over(Window.partitionBy("family").orderBy("since")))
    return s.select("family", "since", "trials", "charged", F.round(1 - F.pow(F.lit(0.95), 1 / F.col("charged")), 9).alias("alpha"), r6(F.sqrt(2 * F.log("charged"))).alias("expected_max"))


@register(
    "d53_decision_ladder",
    f"""{B}, {cohorts_sql('kind', 'brand')}, l AS (SELECT kind, brand, x, lag(x) OVER (PARTITION BY kind, brand ORDER BY m) AS before FROM c), s AS (SELECT kind, brand, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, greatest(coalesce({correlation_sql("x", "before")}, 0), 0) AS rho FROM l GROUP BY ALL),
    t AS (SELECT *, mean / nullif(sd / sqrt(n) * sqrt(1 + rho), 0) AS t FROM s)
    SELECT kind, brand, n, round(t, 4) AS t, CASE WHEN n < 12 THEN 'TOO_FEW' WHEN t <= -1.645 THEN 'KILL' WHEN t < 1.645 THEN 'NOT_SHOWN' WHEN mean < 0.005 THEN 'TOO_SMALL' ELSE 'PASS' END AS verdict FROM t""",
)
def d53(spark, p):
    c = cohorts(deals(spark, p), "kind", "brand")
    l = c.withColumn("before", F.lag("x").over(Window.partitionBy("kind", "brand").orderBy("m")))  # noqa: E741
    rho = F.greatest(F.coalesce(correlation("x", "before"), F.lit(0.0)), F.lit(0.0))
    s = l.groupBy("kind", "brand").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), rho.alias("rho"))
    t = s.withColumn("t", F.try_divide("mean", F.col("sd") / F.sqrt("n") * F.sqrt(1 + F.col("rho"))))
    verdict = R.ladder([("TOO_FEW", F.col("n") < 12), ("KILL", F.col("t") <= -1.645), ("NOT_SHOWN", F.col("t") < 1.645), ("TOO_SMALL", F.col("mean") < 0.005)]).otherwise("PASS")
    return t.select("kind", "brand", "n", F.round("t", 4).alias("t"), verdict.alias("verdict"))


@register(
    "d07_characteristic_panel",
    f"""{B}, r AS (SELECT id, d, turnover, close, close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1 AS r FROM bars),
    v AS (SELECT id, d, date_trunc('month', d)::DATE AS m, median(turnover) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS adv20, round(lag(close, 21) OVER (PARTITION BY id ORDER BY d) / lag(close, 252) OVER (PARTITION BY id ORDER BY d) - 1, 9) AS mom, round(stddev_samp(r) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 9) AS vol21 FROM r),
    l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY d DESC) = 1)
    SELECT id, m, d, ntile(5) OVER (PARTITION BY m ORDER BY round(adv20, 6), id) AS size_q, ntile(5) OVER (PARTITION BY m ORDER BY vol21, id) AS vol_q, CASE WHEN mom IS NOT NULL THEN ntile(5) OVER (PARTITION BY m, mom IS NULL ORDER BY mom, id) END AS mom_q FROM l WHERE vol21 IS NOT NULL""",
)
def d07(spark, p):
    """Size, volatility and momentum (12-1) quintiles at each name's last session of a month, from the rows up to it."""
    r = bars(deals(spark, p)).select("id", "d", "turnover", F.round(F.lag("close", 21).over(by()) / F.lag("close", 252).over(by()) - 1, 9).alias("mom"), (F.col("close") / F.lag("close").over(by()) - 1).alias("r"))
    v = r.select("id", "d", F.trunc("d", "month").alias("m"), F.percentile("turnover", 0.5).over(by().rowsBetween(-19, 0)).alias("adv20"), F.round(F.stddev_samp("r").over(by().rowsBetween(-20, 0)), 9).alias("vol21"), "mom")
    last = v.groupBy("id", "m").agg(F.max_by(F.struct("d", "adv20", "vol21", "mom"), "d").alias("s")).select("id", "m", "s.*").where("vol21 IS NOT NULL")
    month = Window.partitionBy("m")
    return last.select("id", "m", "d", F.ntile(5).over(month.orderBy(F.round("adv20", 6), "id")).alias("size_q"), F.ntile(5).over(month.orderBy("vol21", "id")).alias("vol_q"),
        F.when(F.col("mom").isNotNull(), F.ntile(5).over(Window.partitionBy("m", F.col("mom").isNull()).orderBy("mom", "id"))).alias("mom_q"))
