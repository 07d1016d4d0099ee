"""Warehouse and identity operators: price spine, jumps, universe, benchmarks, sectors, masters, flags and the clean mart.

The tables stand in for the domain's: a security is a supplier, its symbol a brand, a participant a customer.  Prices are
daily bars; a second source is the day's volume-weighted price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise, release
from sextant.core.tables import CALENDAR_SQL, DEALS_SQL, bars, bars_sql, calendar, deals, table, written_deals
from sextant.functions.numbers import half_up, half_up_sql, r6
from sextant.operators import ranks
from sextant.operators import rows as R
from sextant.operators import timejoin as T
from sextant.plans.catalog import register

D, B = f"WITH {DEALS_SQL}", f"WITH {DEALS_SQL}, {bars_sql()}"
S, SC = f"WITH {DEALS_SQL}, {bars_sql('security')}", f"WITH {DEALS_SQL}, {bars_sql('security')}, {CALENDAR_SQL}"

# Ratios by which a split or consolidation moves a price.
STRICT = (0.1, 0.2, 0.25, 0.5, 2.0, 4.0, 5.0, 10.0)
JUMP, PERSIST, PERSIST_TOL, ACTION_TOL, STRICT_TOL, FLAT, SAME = 0.35, 5, 0.25, 0.08, 0.06, 0.05, 0.1


def by(*keys: str):
    return Window.partitionBy(*(keys or ("id",))).orderBy("d")


# D01-D04: spine, adjustment, jumps, audit

_SPINE_SQL = f"""{S}, seed AS (SELECT * FROM bars WHERE d <= DATE '1997-06-30'), inc AS (SELECT * FROM bars WHERE d >= DATE '1997-04-01'),
spine AS (SELECT *, 'seed' AS part FROM seed UNION ALL SELECT *, 'increment' FROM inc WHERE NOT EXISTS (SELECT 1 FROM seed WHERE seed.id = inc.id AND seed.d = inc.d))"""


def spine(x: DataFrame) -> DataFrame:
    """The seed up to June 1997 and of the increment since April what the seed lacks; ``part`` says where a row is from."""
    every = bars(x, "security")
    seed, inc = every.where("d <= DATE'1997-06-30'"), every.where("d >= DATE'1997-04-01'")
    return seed.withColumn("part", F.lit("seed")).unionByName(inc.join(seed.select("id", "d"), ["id", "d"], "left_anti").withColumn("part", F.lit("increment")))


@register(
    "d01_price_spine",
    f"""{_SPINE_SQL}, gone AS (SELECT year(d) AS y, count(*) AS lost FROM bars ANTI JOIN spine USING (id, d) GROUP BY 1), n AS (SELECT year(d) AS y, part, count(*) AS n, count(DISTINCT id) AS names, min(d) AS first, max(d) AS last, count(*) - count(DISTINCT (id, d)) AS repeated FROM spine GROUP BY ALL)
    SELECT n.*, coalesce(lost, 0) AS lost FROM n LEFT JOIN gone USING (y)""",
)
def d01(spark, p):
    """Per year and part: rows and names, keys that stand there twice, and source keys that are lost (both have to be 0)."""
    x = deals(spark, p)
    made = spine(x)
    keyed = made.groupBy("id", "d", "part").agg(F.count(F.lit(1)).alias("k"))
    y = F.year("d").cast("long").alias("y")
    out = keyed.groupBy(y, "part").agg(F.sum("k").alias("n"), F.count_distinct("id").alias("names"), F.min("d").alias("first"), F.max("d").alias("last"), F.sum(F.col("k") - 1).alias("repeated"))
    lost = bars(x, "security").select("id", "d").join(made.select("id", "d"), ["id", "d"], "left_anti").groupBy(y).agg(F.count(F.lit(1)).alias("lost"))
    return out.join(lost, "y", "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))


_VW = "turnover / volume"
_RATIOS_SQL = ", ".join(f"({s}::DOUBLE)" for s in STRICT)
_JUMPS_SQL = f"""o AS (SELECT id, d, close, lag(close) OVER w AS prev, {_VW} AS vw, lag({_VW}) OVER w AS vw_prev, lead(d) OVER w AS next_d, lead(close) OVER w AS next_close,
  median(close) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {PERSIST} FOLLOWING) AS later FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)),
j AS (SELECT *, close / prev AS r, later / prev AS held, vw / vw_prev AS rk FROM o WHERE abs(close / prev - 1) > {JUMP}),
near AS (SELECT id, d, arg_min(q, abs(ln(r / q))) AS q FROM j, (VALUES {_RATIOS_SQL}) s(q) GROUP BY ALL),
k AS (SELECT j.*, near.q, abs(r / q - 1) AS off, day(d) <= 3 AS recorded FROM j JOIN near USING (id, d)),
jumps AS (SELECT id, d, r, q, prev, next_close, next_d, CASE WHEN held IS NOT NULL AND abs(ln(held) - ln(r)) >= {PERSIST_TOL} THEN 'REVERTED' WHEN recorded AND off < {ACTION_TOL} THEN 'T1' WHEN abs(ln(rk)) < {FLAT} AND off < {STRICT_TOL} THEN 'T2'
  WHEN abs(ln(r) - ln(rk)) < {SAME} THEN 'REAL' WHEN abs(ln(rk)) < {FLAT} THEN 'UNEXPLAINED_FLAT' WHEN rk IS NOT NULL THEN 'UNEXPLAINED_BOTH_MOVE' WHEN off < {STRICT_TOL} THEN 'UNCONFIRMED_RATIO' ELSE 'UNEXPLAINED' END AS class FROM k)"""


def nearest_ratio(r: Column) -> Column:
    """The strict ratio nearest on a log scale; the list is part of the expression, so no row is multiplied."""
    near = F.array_min(F.array(*(F.struct(F.abs(F.log(r / F.lit(q))).alias("off"), F.lit(q).alias("q")) for q in STRICT)))
    return near["q"]


def jumps(b: DataFrame) -> DataFrame:
    """Moves of more than JUMP against the session before, each with its class; a day's first three dates are taken as recorded
    action days, the volume-weighted price as the second source."""
    w = by()
    later = F.percentile("close", 0.5).over(w.rowsBetween(1, PERSIST))
    vw = F.col("turnover") / F.col("volume")
    o = b.select("id", "d", F.lag("close").over(w).alias("prev"), F.lead("close").over(w).alias("next_close"), F.lead("d").over(w).alias("next_d"), "close", later.alias("later"), (vw / F.lag(vw).over(w)).alias("rk"))
    j = o.where(F.abs(F.col("close") / F.col("prev") - 1) > JUMP).select("id", "d", "prev", "next_close", "next_d", (F.col("close") / F.col("prev")).alias("r"), (F.col("later") / F.col("prev")).alias("held"), "rk")
    k = j.withColumn("q", nearest_ratio(F.col("r"))).withColumn("off", F.abs(F.col("r") / F.col("q") - 1))
    held, flat = F.abs(F.log("held") - F.log("r")), F.abs(F.log("rk"))
    kind = R.ladder([
        ("REVERTED", F.col("held").isNotNull() & (held >= PERSIST_TOL)), ("T1", (F.dayofmonth("d") <= 3) & (F.col("off") < ACTION_TOL)), ("T2", (flat < FLAT) & (F.col("off") < STRICT_TOL)), ("REAL", F.abs(F.log("r") - F.log("rk")) < SAME),
        ("UNEXPLAINED_FLAT", flat < FLAT), ("UNEXPLAINED_BOTH_MOVE", F.col("rk").isNotNull()), ("UNCONFIRMED_RATIO", F.col("off") < STRICT_TOL),
    ]).otherwise("UNEXPLAINED")
    return k.select("id", "d", "r", "q", "prev", "next_close", "next_d", kind.alias("class"))


@register("d03_jump_classes", f"{S}, {_JUMPS_SQL} SELECT id, d, round(r, 6) AS r, q, class FROM jumps")
def d03(spark, p):
    return jumps(bars(deals(spark, p), "security")).select("id", "d", r6(F.col("r")).alias("r"), "q", "class")


_BAD_SQL = "bad AS (SELECT id, d FROM jumps WHERE class = 'REVERTED' AND abs(ln(next_close / prev)) < 0.15 AND date_diff('day', d, next_d) <= 7)"
_ADJ_SQL = f"""{S}, {_JUMPS_SQL}, {_BAD_SQL}, act AS (SELECT id, d, q FROM jumps WHERE class IN ('T1', 'T2') AND q IN (0.25, 0.5, 2, 4)),
good AS (SELECT * FROM bars ANTI JOIN bad USING (id, d)), fac AS (SELECT id, d, coalesce(sum(log2(q)) OVER (PARTITION BY id ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM good LEFT JOIN act USING (id, d)),
adj AS (SELECT id, d, close, close * pow(2, k) AS adj_close, volume / pow(2, k) AS adj_volume, k FROM good JOIN fac USING (id, d))"""


def adjusted(b: DataFrame) -> DataFrame:
    """Bars without single-day prints, each multiplied by the factors of all later actions; volumes by the inverse.  Factors
    are powers of two, so their running product is an exact sum of exponents."""
    j = jumps(b)
    bad = j.where((F.col("class") == "REVERTED") & (F.abs(F.log(F.col("next_close") / F.col("prev"))) < 0.15) & (F.datediff("next_d", "d") <= 7)).select("id", "d")
    act = j.where(F.col("class").isin("T1", "T2") & F.col("q").isin(0.25, 0.5, 2.0, 4.0)).select("id", "d", F.log2("q").alias("e"))
    good = b.join(bad, ["id", "d"], "left_anti").join(act, ["id", "d"], "left")
    k = F.coalesce(F.sum("e").over(Window.partitionBy("id").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return good.withColumn("k", k).select("id", "d", "close", (F.col("close") * F.pow(F.lit(2.0), "k")).alias("adj_close"), (F.col("volume") / F.pow(F.lit(2.0), "k")).alias("adj_volume"), "k")


@register(
    "d02_adjusted_spine",
    f"""{_ADJ_SQL}, u AS (SELECT id, count(*) FILTER (class LIKE 'UNEXPLAINED%') AS unexplained FROM jumps GROUP BY 1), n AS (SELECT id, count(*) AS n FROM bars GROUP BY 1)
    SELECT id, d, {half_up_sql('adj_close', 4)} AS adj_close, {half_up_sql('adj_volume', 4)} AS adj_volume, CAST(k AS INT) AS k, coalesce(unexplained, 0) > 0.25 * n AS stopped FROM adj LEFT JOIN u USING (id) JOIN n USING (id)""",
)
def d02(spark, p):
    """``stopped``: more than a quarter of a name's sessions are unexplained jumps, so its series may not be used."""
    b = bars(deals(spark, p), "security")
    u = jumps(b).groupBy("id").agg(F.count_if(F.col("class").like("UNEXPLAINED%")).alias("unexplained"))
    limit = b.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(u, "id", "left").select("id", (F.coalesce("unexplained", F.lit(0)) > 0.25 * F.col("n")).alias("stopped"))
    return adjusted(b).join(limit, "id").select("id", "d", half_up(F.col("adj_close"), 4).alias("adj_close"), half_up(F.col("adj_volume"), 4).alias("adj_volume"), F.col("k").cast("int").alias("k"), "stopped")


@register(
    "d04_price_audit",
    f"""{_ADJ_SQL}, v AS (SELECT id, d, {_VW} AS vw FROM bars), t AS (SELECT id, d, ln(close / lag(close) OVER w) AS raw, ln(adj_close / lag(adj_close) OVER w) AS adj, ln(vw / lag(vw) OVER w) AS other FROM adj JOIN v USING (id, d) WINDOW w AS (PARTITION BY id ORDER BY d)),
    s AS (SELECT id, count(*) AS n, avg((abs(raw - other) < 0.3)::INT) AS raw_share, avg((abs(adj - other) < 0.3)::INT) AS adj_share, count(*) FILTER (abs(adj - other) >= 1) AS steps FROM t WHERE raw IS NOT NULL GROUP BY 1)
    SELECT id, n, round(raw_share, 6) AS raw_share, round(adj_share, 6) AS adj_share, steps, CASE WHEN raw_share >= 0.5 AND adj_share >= 0.5 THEN 'both' WHEN adj_share >= 0.5 THEN 'adjusted' WHEN raw_share >= 0.5 THEN 'raw' ELSE 'neither' END AS verdict FROM s""",
)
def d04(spark, p):
    """Share of sessions whose raw (adjusted) return agrees with the second source's; more than half of them decide."""
    b = bars(deals(spark, p), "security")
    t = adjusted(b).join(b.select("id", "d", (F.col("turnover") / F.col("volume")).alias("vw")), ["id", "d"])
    move = lambda c: F.log(F.col(c) / F.lag(c).over(by()))
    t = t.select("id", move("close").alias("raw"), move("adj_close").alias("adj"), move("vw").alias("other")).where("raw IS NOT NULL")
    agree = lambda c: F.avg((F.abs(F.col(c) - F.col("other")) < 0.3).cast("int"))
    s = t.groupBy("id").agg(F.count(F.lit(1)).alias("n"), agree("raw").alias("raw_share"), agree("adj").alias("adj_share"), F.count_if(F.abs(F.col("adj") - F.col("other")) >= 1).alias("steps"))
    raw, adj = F.col("raw_share") >= 0.5, F.col("adj_share") >= 0.5
    return s.select("id", "n", r6(F.col("raw_share")).alias("raw_share"), r6(F.col("adj_share")).alias("adj_share"), "steps", R.ladder([("both", raw & adj), ("adjusted", adj), ("raw", raw)]).otherwise("neither").alias("verdict"))


# D05, D06, D08: universe, benchmarks, sectors

SPAN, MIN_DAYS = 60, 10
_ENDS_SQL = "ends AS (SELECT max(i) AS e, max(d) AS rebal FROM cal GROUP BY date_trunc('month', d))"
_UNIVERSE_SQL = f"""{SC}, {_ENDS_SQL}, m AS (SELECT rebal, id, count(*) AS n_days, median(round(turnover * 100)) / 100 AS med FROM bars JOIN cal USING (d) JOIN ends ON i BETWEEN e - {SPAN - 1} AND e GROUP BY ALL),
universe AS (SELECT rebal, id, n_days, med, row_number() OVER (PARTITION BY rebal ORDER BY med DESC, id) AS adv_rank FROM m WHERE n_days >= {MIN_DAYS})"""


def month_ends(cal: DataFrame) -> DataFrame:
    return cal.groupBy(F.trunc("d", "month")).agg(F.max("i").alias("e"), F.max("d").alias("rebal")).select("e", "rebal")


def universe(x: DataFrame) -> DataFrame:
    """Members of every month-end in one job: each session is dealt to the month-ends whose span holds it (three or four), by
    a table of dates, and names are ranked by their median turnover in the span."""
    cal = calendar(x).select("d", "i")
    spans = month_ends(cal).select("rebal", F.explode(F.sequence(F.col("e") - SPAN + 1, F.col("e"))).alias("i"))
    dated = F.broadcast(spans.join(cal, "i").select("rebal", "d"))  # dates only: SPAN rows a month
    m = bars(x, "security").join(dated, "d").groupBy("rebal", "id").agg(F.count(F.lit(1)).alias("n_days"), (F.percentile(F.round(F.col("turnover") * 100), 0.5) / 100).alias("med")).where(F.col("n_days") >= MIN_DAYS)
    return m.withColumn("adv_rank", F.row_number().over(Window.partitionBy("rebal").orderBy(F.desc("med"), "id")).cast("long"))


@register("d05_universe", f"{_UNIVERSE_SQL} SELECT rebal, id, n_days, {half_up_sql('med', 2)} AS med, adv_rank, adv_rank <= 20 AS top20, adv_rank <= 50 AS top50, med >= 40000 AS liquid FROM universe")
def d05(spark, p):
    u = universe(deals(spark, p))
    return u.select("rebal", "id", "n_days", half_up(F.col("med"), 2).alias("med"), "adv_rank", (F.col("adv_rank") <= 20).alias("top20"), (F.col("adv_rank") <= 50).alias("top50"), (F.col("med") >= 40000).alias("liquid"))


BANDS = {"EW_1_20": (1, 20), "EW_21_50": (21, 50), "EW_ALL": (1, 10**9)}


@register(
    "d06_benchmarks",
    f"""{_UNIVERSE_SQL}, r AS (SELECT id, d, close / lag(close) OVER (PARTITION BY id ORDER BY d) - 1 AS ret FROM bars), dated AS (SELECT d, (SELECT max(rebal) FROM ends WHERE rebal <= cal.d) AS rebal FROM cal),
    mem AS (SELECT benchmark_id, d, avg(ret) AS ret, count(*) AS names FROM r JOIN dated USING (d) JOIN universe u ON u.rebal = dated.rebal AND u.id = r.id JOIN (VALUES {', '.join(f"('{k}', {a}, {z})" for k, (a, z) in BANDS.items())}) b(benchmark_id, lo, hi) ON adv_rank BETWEEN lo AND hi WHERE ret IS NOT NULL GROUP BY ALL)
    SELECT benchmark_id, d, names, round(ln(1000) + sum(ln(1 + ret)) OVER (PARTITION BY benchmark_id ORDER BY d), 6) AS log_level FROM mem""",
)
def d06(spark, p):
    """Equal-weight indices by rank band: the day's mean return of the names of the newest month-end that traded on both
    sessions, chained from 1,000 on a log scale.  A name that stops trading leaves with its last return."""
    x = deals(spark, p)
    cal = calendar(x).select("d", "i")
    dates = cal.select("d").withColumn("k", F.lit(1))
    asof = T.asof_join(dates, month_ends(cal).select(F.lit(1).alias("k"), F.col("rebal").alias("rd"), "rebal"), ["k"], "d", "rd").select("d", "rebal")
    r = bars(x, "security").select("id", "d", (F.col("close") / F.lag("close").over(by()) - 1).alias("ret")).where("ret IS NOT NULL")
    bands = F.array_compact(F.array(*(F.when(F.col("adv_rank").between(a, z), F.lit(k)) for k, (a, z) in BANDS.items())))
    member = r.join(F.broadcast(asof), "d").join(universe(x).select("rebal", "id", "adv_rank"), ["rebal", "id"]).select("d", "ret", F.explode(bands).alias("benchmark_id"))
    daily = member.groupBy("benchmark_id", "d").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("names"))
    level = F.log(F.lit(1000.0)) + F.sum(F.log(1 + F.col("ret"))).over(by("benchmark_id"))
    return daily.select("benchmark_id", "d", "names", r6(level).alias("log_level"))


_LABEL_SQL = f"""{D}, v AS (SELECT security, date_trunc('month', d)::DATE AS m, CASE WHEN CAST(substr(brand, 7) AS INT) <= 8 THEN 'A' WHEN CAST(substr(brand, 7) AS INT) <= 16 THEN 'B' ELSE 'C' END AS label, count(*) AS n FROM deals GROUP BY ALL),
lab AS (SELECT security, m, label, n FROM v QUALIFY row_number() OVER (PARTITION BY security, m ORDER BY n DESC, label) = 1)"""


def monthly_sectors(x: DataFrame) -> DataFrame:
    """security, m, label: the month's most frequent sector of a security, ties by label."""
    number = F.substring("brand", 7, 4).cast("int")
    v = x.groupBy("security", F.trunc("d", "month").alias("m"), F.when(number <= 8, "A").when(number <= 16, "B").otherwise("C").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("security", "m").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


@register(
    "d08_sector_history",
    f"""{_LABEL_SQL}, c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS new FROM lab WINDOW w AS (PARTITION BY security ORDER BY m)), g AS (SELECT *, sum(new) OVER (PARTITION BY security ORDER BY m) AS k FROM c),
    h AS (SELECT security, k, any_value(label) AS label, min(m) AS valid_from, count(*) AS n_rows FROM g GROUP BY ALL) SELECT security, label, valid_from, lead(valid_from) OVER (PARTITION BY security ORDER BY valid_from) AS valid_to, n_rows FROM h""",
)
def d08(spark, p):
    return T.islands(monthly_sectors(deals(spark, p)), ["security"], "m", "label").select("security", "label", "valid_from", "valid_to", "n_rows")


@register(
    "d08_sector_panel",
    f"""{_LABEL_SQL}, t AS (SELECT security, date_trunc('month', d)::DATE AS m, sum(qty) AS q FROM deals GROUP BY ALL) SELECT security, m, label, q, ntile(3) OVER (PARTITION BY m, label ORDER BY q, security) AS size_q FROM t JOIN lab USING (security, m)""",
)
def d08_panel(spark, p):
    """Size terciles inside the sector of the month."""
    x = deals(spark, p)
    t = x.groupBy("security", F.trunc("d", "month").alias("m")).agg(F.sum("qty").alias("q")).join(monthly_sectors(x), ["security", "m"])
    return t.select("security", "m", "label", "q", F.ntile(3).over(Window.partitionBy("m", "label").orderBy("q", "security")).cast("long").alias("size_q"))


# D09-D13: masters, exits, flags, mart

_HELD_SQL = f"{D}, held AS (SELECT security, brand AS symbol, min(d) AS first, max(d) AS last, count(DISTINCT d) AS days FROM deals GROUP BY ALL)"


def held(x: DataFrame) -> DataFrame:
    return x.groupBy("security", F.col("brand").alias("symbol")).agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count_distinct("d").alias("days"))


@register(
    "d09_security_master",
    f"""{_HELD_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY security ORDER BY date_diff('day', first, last) DESC, symbol) AS rn, count(*) OVER (PARTITION BY security) AS symbols FROM held)
    SELECT row_number() OVER (ORDER BY security) AS security_id, security, symbol AS canonical, s_name AS name, first, last, symbols FROM one JOIN supplier ON s_suppkey = security WHERE rn = 1""",
)
def d09(spark, p):
    """The symbol held longest is canonical; ids are dense in key order, numbered over ranges."""
    h = held(deals(spark, p))
    best = h.groupBy("security").agg(F.min_by(F.struct("symbol", "first", "last"), F.struct(-F.datediff("last", "first"), "symbol")).alias("s"), F.count(F.lit(1)).alias("symbols"))
    named = best.join(table(spark, p, "supplier").select(F.col("s_suppkey").alias("security"), F.col("s_name").alias("name")), "security")
    return ranks.numbered(named, [F.col("security")], to="security_id").select("security_id", "security", F.col("s.symbol").alias("canonical"), "name", "s.first", "s.last", "symbols")


@register("d09_symbol_history", f"{_HELD_SQL} SELECT security, symbol, first AS valid_from, CASE WHEN date_diff('day', last, max(last) OVER ()) > 60 THEN last + 1 END AS valid_to, days FROM held")
def d09_history(spark, p):
    """Windows of a symbol; one that was used within 60 days of the end stays open."""
    h = held(deals(spark, p))
    end = F.broadcast(h.agg(F.max("last").alias("end")))  # one row
    return h.crossJoin(end).select("security", "symbol", F.col("first").alias("valid_from"), F.when(F.datediff("end", "last") > 60, F.date_add("last", 1)).alias("valid_to"), "days")


STALE = 10
_EXIT_SQL = f"""{_HELD_SQL}, {CALENDAR_SQL}, stale AS (SELECT d AS line FROM cal ORDER BY d DESC LIMIT 1 OFFSET {STALE - 1}), other AS (SELECT brand AS symbol, max(d) AS any_last FROM deals WHERE kind = 'R' GROUP BY 1),
succ AS (SELECT a.security, a.symbol, min(b.security) AS successor FROM held a JOIN held b ON a.symbol = b.symbol AND b.security <> a.security AND b.first > a.last AND date_diff('day', a.last, b.first) <= 10 GROUP BY ALL)"""


@register(
    "d10_exit_classes",
    f"""{_EXIT_SQL} SELECT security, symbol, last, successor, CASE WHEN last >= line THEN 'ACTIVE' WHEN successor IS NOT NULL THEN 'ISIN_CHANGE' WHEN any_last > last AND days <= 2 THEN 'LEFT_UNIVERSE' WHEN days = 1 THEN 'NEVER_TRADED' WHEN date_diff('day', last, line) <= 365 THEN 'SUSPENSION' ELSE 'UNKNOWN' END AS reason
    FROM held CROSS JOIN stale LEFT JOIN succ USING (security, symbol) LEFT JOIN other USING (symbol)""",
)
def d10(spark, p):
    """A listing (security and symbol) has left if it is older than the stale line, the calendar's tenth session from the end;
    its successor is another security that takes the symbol up within ten days."""
    x = deals(spark, p)
    h = held(x)
    line = F.broadcast(calendar(x).select("d").orderBy(F.desc("d")).limit(STALE).agg(F.min("d").alias("line")))  # one row
    # the ten days after an end are named one by one, so the successor is found by equality
    after = h.select("symbol", "security", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 10))).alias("first"))
    taken = h.select("symbol", F.col("security").alias("successor"), "first")
    succ = after.join(taken, ["symbol", "first"]).where("successor <> security").groupBy("security", "symbol").agg(F.min("successor").alias("successor"))
    other = x.where("kind = 'R'").groupBy(F.col("brand").alias("symbol")).agg(F.max("d").alias("any_last"))
    full = h.join(succ, ["security", "symbol"], "left").join(other, "symbol", "left").crossJoin(line)
    reason = R.ladder([
        ("ACTIVE", F.col("last") >= F.col("line")), ("ISIN_CHANGE", F.col("successor").isNotNull()), ("LEFT_UNIVERSE", (F.col("any_last") > F.col("last")) & (F.col("days") <= 2)),
        ("NEVER_TRADED", F.col("days") == 1), ("SUSPENSION", F.datediff("line", "last") <= 365),
    ]).otherwise("UNKNOWN")
    return full.select("security", "symbol", "last", "successor", reason.alias("reason"))


@register(
    "d11_participant_master",
    f"""{D}, day AS (SELECT participant, d, bool_or(side = 'BUY') AND bool_or(side = 'SELL') AS rt FROM deals GROUP BY ALL), beh AS (SELECT participant, count(*) AS days, count(*) FILTER (rt) AS mixed FROM day GROUP BY 1),
    c AS (SELECT c_custkey AS participant, c_name, c_acctbal, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 500) AS BIGINT)) AS parent FROM customer)
    SELECT participant, parent, CASE WHEN c_acctbal < -900 THEN 'MANUAL' WHEN days >= 10 AND mixed >= 0.02 * days THEN 'PROP' WHEN c_name LIKE '%00' THEN 'FUND' WHEN c_name LIKE '%5' THEN 'BANK' ELSE 'UNKNOWN' END AS kind,
    CASE WHEN c_acctbal < -900 THEN 'RULED' WHEN days >= 10 AND mixed >= 0.02 * days AND (c_name LIKE '%00' OR c_name LIKE '%5') THEN 'CONFLICT' WHEN parent <> participant THEN 'MERGE_PROPOSED' ELSE 'NONE' END AS review, coalesce(days, 0) AS days FROM c LEFT JOIN beh USING (participant)""",
)
def d11(spark, p):
    """Kind by precedence: manual ruling, behaviour (trades both ways), name pattern; parent is the least key of an equal profile."""
    day = deals(spark, p).groupBy("participant", "d").agg((F.bool_or(F.col("side") == "BUY") & F.bool_or(F.col("side") == "SELL")).cast("int").alias("rt"))
    beh = day.groupBy("participant").agg(F.count(F.lit(1)).alias("days"), F.sum("rt").alias("mixed"))
    profile = Window.partitionBy("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500))
    c = table(spark, p, "customer").select(F.col("c_custkey").alias("participant"), "c_name", "c_acctbal", F.min("c_custkey").over(profile).alias("parent")).join(beh, "participant", "left")
    manual, prop = F.col("c_acctbal") < -900, (F.col("days") >= 10) & (F.col("mixed") >= 0.02 * F.col("days"))
    fund, bank = F.col("c_name").like("%00"), F.col("c_name").like("%5")
    kind = R.ladder([("MANUAL", manual), ("PROP", prop), ("FUND", fund), ("BANK", bank)]).otherwise("UNKNOWN")
    review = R.ladder([("RULED", manual), ("CONFLICT", prop & (fund | bank)), ("MERGE_PROPOSED", F.col("parent") != F.col("participant"))]).otherwise("NONE")
    return c.select("participant", "parent", kind.alias("kind"), review.alias("review"), F.coalesce("days", F.lit(0)).alias("days"))


_PROMOTER_SQL = """promoters AS (SELECT security, participant AS promoter, min(d) AS valid_from, min(d) + 720 AS valid_to FROM deals WHERE qty >= 48 GROUP BY ALL),
valid AS (SELECT DISTINCT deal_key, deal_line, x.security, x.d, side, participant, promoter FROM deals x JOIN promoters q ON q.security = x.security AND x.d >= valid_from AND x.d < valid_to),
known AS (SELECT DISTINCT deal_key, deal_line FROM valid), prom AS (SELECT DISTINCT deal_key, deal_line, security, d, side, participant FROM valid WHERE participant = promoter),
internal AS (SELECT DISTINCT a.deal_key, a.deal_line FROM prom a JOIN prom b ON a.security = b.security AND a.d = b.d AND a.side <> b.side AND a.participant <> b.participant),
flags AS (SELECT x.deal_key, x.deal_line, p.deal_key IS NOT NULL AS promoter_related, i.deal_key IS NOT NULL AS internal_transfer, k.deal_key IS NOT NULL AS list_in_force FROM (SELECT DISTINCT deal_key, deal_line FROM deals) x
  LEFT JOIN (SELECT DISTINCT deal_key, deal_line FROM prom) p USING (deal_key, deal_line) LEFT JOIN internal i USING (deal_key, deal_line) LEFT JOIN known k USING (deal_key, deal_line))"""


def promoter_flags(x: DataFrame) -> DataFrame:
    """Per deal: its participant is a promoter in force, two promoters trade it between them, any promoter list is in force.

    A security's list is in force over the union of its promoters' spans, so that test is one carried span a deal, and the own
    span is found by an equi-join on (security, participant): deals are never paired with all promoters of their security.
    """
    spans = x.where("qty >= 48").groupBy("security", "participant").agg(F.min("d").alias("valid_from")).withColumn("valid_to", F.date_add("valid_from", 720))
    union = T.merge_overlaps(spans.select("security", "valid_from", "valid_to"), ["security"], "valid_from", "valid_to").select("security", F.col("valid_from").alias("s"), F.col("valid_to").alias("e"))
    keyed = x.select("security", "participant", "d", "side", "deal_key", "deal_line")
    own = keyed.join(spans, ["security", "participant"], "left").withColumn("promoter_related", F.coalesce((F.col("d") >= F.col("valid_from")) & (F.col("d") < F.col("valid_to")), F.lit(False))).drop("valid_from", "valid_to")
    listed = T.asof_join(own, union.select("security", "s", "e"), ["security"], "d", "s").withColumn("list_in_force", F.coalesce(F.col("d") < F.col("e"), F.lit(False))).drop("s", "e")
    # of a security's day: the promoters on either side, as their least and greatest keys, tell whether another one stands opposite
    day = listed.where("promoter_related").groupBy("security", "d").agg(*(f(F.when(F.col("side") == s, F.col("participant"))).alias(f"{n}_{s}") for s in ("BUY", "SELL") for n, f in (("lo", F.min), ("hi", F.max))))
    opposite = lambda n: F.when(F.col("side") == "BUY", F.col(f"{n}_SELL")).otherwise(F.col(f"{n}_BUY"))
    met = F.col("promoter_related") & F.coalesce((opposite("lo") != F.col("participant")) | (opposite("hi") != F.col("participant")), F.lit(False))
    rows = listed.join(day, ["security", "d"], "left").select("deal_key", "deal_line", "promoter_related", met.alias("internal_transfer"), "list_in_force")
    return rows.groupBy("deal_key", "deal_line").agg(*(F.bool_or(c).alias(c) for c in ("promoter_related", "internal_transfer", "list_in_force")))


@register("d12_promoter_flags", f"{D}, {_PROMOTER_SQL} SELECT * FROM flags")
def d12(spark, p):
    return promoter_flags(deals(spark, p))


@register(
    "d13_clean_mart",
    f"""{D}, {_PROMOTER_SQL}, day AS (SELECT security, d, median(price) AS mid, count(*) AS prints FROM deals GROUP BY ALL), rt AS (SELECT participant, brand, d, bool_or(side = 'BUY') AND bool_or(side = 'SELL') AS same_day FROM deals GROUP BY ALL),
    copies AS (SELECT deal_key, deal_line, count(*) AS copies FROM deals GROUP BY ALL)
    SELECT x.deal_key, x.deal_line, x.qty, same_day, promoter_related, internal_transfer, CASE WHEN copies > 1 THEN 'REPEATED_KEY' WHEN x.qty < 2 THEN 'TOO_SMALL' WHEN prints >= 2 AND abs(x.price / mid - 1) > 0.9 THEN 'PRICE_OUTLIER' WHEN internal_transfer THEN 'INTERNAL' END AS reason
    FROM deals x JOIN day USING (security, d) JOIN rt USING (participant, brand, d) JOIN flags USING (deal_key, deal_line) JOIN copies USING (deal_key, deal_line)""",
)
def d13(spark, p):
    """Every deal stays, with its flags and the first reason not to use it; the row count is that of the deals.

    Deals are dealt out by participant, by security and by key, one after the other: each step's groups are windows within its parts, it is written,
    and what it read goes, so disk holds two written steps and one shuffle at most.
    """
    x = written_deals(spark, p, "participant", "security", "brand", "side", "d", "qty", "price", "deal_key", "deal_line")
    buys, sells = F.bool_or(F.col("side") == "BUY"), F.bool_or(F.col("side") == "SELL")
    rt = Window.partitionBy("participant", "brand", "d")
    one = materialise(x.repartition("participant").withColumn("same_day", buys.over(rt) & sells.over(rt)), "same-day")
    release(x)
    day, spans = Window.partitionBy("security", "d"), Window.partitionBy("security", "participant")
    known = F.col("security").isNotNull() & F.col("participant").isNotNull()
    from_ = F.min(F.when(F.col("qty") >= 48, F.col("d"))).over(spans)
    f = one.repartition("security").withColumns({"_from": from_, "mid": F.percentile("price", 0.5).over(day), "prints": F.count(F.lit(1)).over(day)})
    f = f.withColumn("promoter_related", F.coalesce(known & (F.col("d") >= F.col("_from")) & (F.col("d") < F.date_add("_from", 720)), F.lit(False)))
    ends = {f"{n}_{s}": g(F.when(F.col("promoter_related") & (F.col("side") == s), F.col("participant"))).over(day) for s in ("BUY", "SELL") for n, g in (("lo", F.min), ("hi", F.max))}
    opposite = lambda n: F.when(F.col("side") == "BUY", F.col(f"{n}_SELL")).otherwise(F.col(f"{n}_BUY"))
    met = F.col("promoter_related") & F.coalesce((opposite("lo") != F.col("participant")) | (opposite("hi") != F.col("participant")), F.lit(False))
    outlier = F.coalesce((F.col("prints") >= 2) & (F.abs(F.col("price") / F.col("mid") - 1) > 0.9), F.lit(False))
    whole = known & F.col("brand").isNotNull() & F.col("d").isNotNull()  # a deal without a key of a group has no flags of it, as in a join
    two = materialise(f.withColumns(ends).select("deal_key", "deal_line", "qty", "same_day", "promoter_related", met.alias("internal_transfer"), outlier.alias("outlier"), whole.alias("whole")), "flagged")
    release(one)
    key = Window.partitionBy("deal_key", "deal_line")
    full = two.repartition("deal_key").withColumns({"copies": F.count(F.lit(1)).over(key), **{c: F.bool_or(c).over(key) for c in ("promoter_related", "internal_transfer")}}).where("whole AND deal_key IS NOT NULL AND deal_line IS NOT NULL")
    reason = R.ladder([("REPEATED_KEY", F.col("copies") > 1), ("TOO_SMALL", F.col("qty") < 2), ("PRICE_OUTLIER", F.col("outlier")), ("INTERNAL", F.col("internal_transfer"))])
    return full.select("deal_key", "deal_line", "qty", "same_day", "promoter_related", "internal_transfer", reason.alias("reason"))
