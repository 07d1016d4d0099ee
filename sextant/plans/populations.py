"""Event populations and exits: name moves, delisting sensitivity, filings, announcements, resignations and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.core.tables import CALENDAR_SQL, DEALS_SQL, bars_sql, calendar, deals, table, written_deals
from sextant.functions.numbers import half_up, half_up_sql, r6
from sextant.operators import ranks
from sextant.operators import rows as R
from sextant.operators import timejoin as T
from sextant.plans.catalog import register

D = f"WITH {DEALS_SQL}"

# A listing is a security under one symbol (brand); when it stops, the security may go on under others.
H, ALIVE = 21, 10
_LISTED_SQL = f"""WITH {DEALS_SQL}, {CALENDAR_SQL}, {bars_sql('security')},
own AS (SELECT security || '/' || brand AS listing, security, d, arg_min(price, (deal_key, deal_line, price, qty)) AS open, arg_max(price, (deal_key, deal_line, price, qty)) AS close FROM deals GROUP BY ALL),
ends AS (SELECT listing, max(d) AS last_d, arg_max(close, d) AS last_close FROM own GROUP BY 1), line AS (SELECT max(d) FILTER (i = n - {ALIVE}) AS alive FROM (SELECT d, i, max(i) OVER () AS n FROM cal)),
e AS (SELECT listing, own.security, own.d, open, i + {H} AS out_i FROM own JOIN cal USING (d) WHERE EXISTS (SELECT 1 FROM deals x WHERE x.security = own.security AND x.d = own.d AND x.side = 'BUY' AND x.qty = 50)),
t AS (SELECT e.*, cal.d AS out_d FROM e LEFT JOIN cal ON cal.i = out_i),
a AS (SELECT t.*, last_d, last_close, (SELECT close FROM own WHERE own.listing = t.listing AND own.d <= out_d AND own.d > t.d ORDER BY own.d DESC LIMIT 1) AS own_close, (SELECT close FROM bars WHERE bars.id = t.security AND bars.d <= out_d AND bars.d > t.d ORDER BY bars.d DESC LIMIT 1) AS moved_close,
  (SELECT max(d) FROM bars WHERE bars.id = t.security) AS security_last FROM t JOIN ends USING (listing)),
exits AS (SELECT listing, d, CASE WHEN out_d IS NULL THEN 'CENSORED' WHEN last_d >= out_d AND own_close IS NOT NULL THEN 'HORIZON' WHEN security_last >= out_d AND moved_close IS NOT NULL THEN 'MOVED' WHEN last_d >= alive THEN 'CENSORED' ELSE 'STOPPED' END AS reason, open, own_close, moved_close, last_close FROM a, line),
priced AS (SELECT listing, d, reason, CASE reason WHEN 'HORIZON' THEN own_close / open - 1 WHEN 'MOVED' THEN moved_close / open - 1 WHEN 'STOPPED' THEN -1 END AS ret, CASE WHEN reason = 'STOPPED' THEN last_close / open END AS last_ratio FROM exits)"""


EXIT_COLUMNS = ("security", "brand", "side", "d", "qty", "price", "deal_key", "deal_line")


def exits(x: DataFrame) -> DataFrame:
    """listing, d, reason, ret, last_ratio of every entry: its own close at the exit session, else the security's close under
    any symbol, else nothing (STOPPED, worth a share of the last close), or no outcome yet (CENSORED).

    ``x`` is written, and dealt out by security once: listings, days and windows of sessions all lie within a security.
    """
    cal = calendar(x).select("d", "i")
    order = F.struct("deal_key", "deal_line", "price", "qty")
    n = cal.agg(F.max("i").alias("n"))  # one row
    alive = F.broadcast(cal.crossJoin(F.broadcast(n)).where(F.col("i") == F.col("n") - ALIVE).agg(F.max("d").alias("alive")))  # one row
    later = cal.select((F.col("i") - H).alias("i"), F.col("d").alias("out_d"))
    sessions = F.broadcast(cal.join(later, "i", "left"))  # dates only
    own = x.where("security IS NOT NULL AND d IS NOT NULL").repartition("security").groupBy("security", "brand", "d").agg(
        F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"), F.max(order).alias("_last"), F.bool_or((F.col("side") == "BUY") & (F.col("qty") == 50)).alias("_entry"),
    ).join(sessions, "d")
    day, whole, listing = Window.partitionBy("security", "i"), Window.partitionBy("security"), Window.partitionBy("security", "brand")
    ahead = lambda w: w.orderBy("i").rangeBetween(1, H)
    t = own.withColumns({"_day_close": F.max_by("close", "_last").over(day), "_entered": F.bool_or("_entry").over(day)})
    t = t.withColumns({"own_close": F.last("close").over(ahead(listing)), "moved_close": F.last("_day_close").over(ahead(whole)), "last_d": F.max("d").over(listing), "last_close": F.max_by("close", "d").over(listing), "security_last": F.max("d").over(whole)})
    t = t.where("_entered AND brand IS NOT NULL").crossJoin(alive)
    reason = R.ladder([
        ("CENSORED", F.col("out_d").isNull()), ("HORIZON", (F.col("last_d") >= F.col("out_d")) & F.col("own_close").isNotNull()), ("MOVED", (F.col("security_last") >= F.col("out_d")) & F.col("moved_close").isNotNull()), ("CENSORED", F.col("last_d") >= F.col("alive")),
    ]).otherwise("STOPPED")
    r = t.withColumn("reason", reason).withColumn("listing", F.concat_ws("/", F.col("security").cast("string"), "brand"))
    ret = F.when(F.col("reason") == "HORIZON", F.col("own_close") / F.col("open") - 1).when(F.col("reason") == "MOVED", F.col("moved_close") / F.col("open") - 1).when(F.col("reason") == "STOPPED", F.lit(-1.0))
    return r.select("listing", "d", "reason", ret.alias("ret"), F.when(F.col("reason") == "STOPPED", F.col("last_close") / F.col("open")).alias("last_ratio"))


@register("d18_exit_pricing", f"{_LISTED_SQL} SELECT listing, d, reason, round(ret, 6) AS ret, round(last_ratio, 6) AS last_ratio FROM priced")
def d18(spark, p):
    return exits(written_deals(spark, p, *EXIT_COLUMNS)).select("listing", "d", "reason", r6(F.col("ret")).alias("ret"), r6(F.col("last_ratio")).alias("last_ratio"))


FACTORS = (0.0, 0.25, 0.5, 1.0)


@register(
    "d19_delisting_sensitivity",
    f"""{_LISTED_SQL}, adv AS (SELECT security || '/' || brand AS listing, sum(qty) AS q FROM deals GROUP BY ALL), tier AS (SELECT listing, ntile(3) OVER (ORDER BY q DESC, listing) AS tier FROM adv)
    SELECT tier, f AS factor, count(*) AS n, count(*) FILTER (reason = 'STOPPED') AS stopped, round(avg(CASE WHEN reason = 'STOPPED' THEN last_ratio * f - 1 ELSE ret END), 6) AS mean FROM priced JOIN tier USING (listing), (VALUES {', '.join(f'({f}::DOUBLE)' for f in FACTORS)}) s(f) WHERE reason <> 'CENSORED' GROUP BY ALL""",
)
def d19(spark, p):
    """Mean outcome by liquidity tier if a stopped name is worth a share of its last close; tiers are cut from numbers over ranges of listings."""
    x = written_deals(spark, p, *EXIT_COLUMNS)
    q = x.groupBy(F.concat_ws("/", F.col("security").cast("string"), "brand").alias("listing")).agg(F.sum("qty").alias("q"))
    tier = ranks.numbered(q, [F.desc("q"), F.col("listing")], to="k", total="n").select("listing", ranks.tile("k", "n", 3).cast("long").alias("tier"))
    e = exits(x).where("reason <> 'CENSORED'").join(tier, "listing").withColumn("factor", F.explode(F.array(*(F.lit(f) for f in FACTORS))))
    value = F.when(F.col("reason") == "STOPPED", F.col("last_ratio") * F.col("factor") - 1).otherwise(F.col("ret"))
    return e.groupBy("tier", "factor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "STOPPED").alias("stopped"), r6(F.avg(value)).alias("mean"))


# Filings: an event's user files on a day; its security is the one the customer of that number dealt in last before it.

_FILING_SQL = f"""{D}, fil AS (SELECT event_id, user_id AS person, (CAST(ts AS DATE) - INTERVAL 25 YEAR)::DATE AS d, event_type, value FROM events),
res AS (SELECT fil.*, (SELECT arg_max(security, (x.deal_key, x.deal_line, security)) FROM deals x WHERE x.participant = person AND x.d = (SELECT max(y.d) FROM deals y WHERE y.participant = person AND y.d <= fil.d)) AS security FROM fil)"""
POPULATIONS = {"ALL": "true", "LARGE": "value >= 60", "PURCHASE": "event_type = 'purchase'", "VIEW_LARGE": "event_type = 'view' AND value >= 30", "NOT_VIEW": "event_type <> 'view'"}


def filings(x: DataFrame, events: DataFrame) -> DataFrame:
    f = events.select("event_id", F.col("user_id").alias("person"), F.add_months(F.to_date("ts"), -300).alias("d"), "event_type", "value")
    known = x.groupBy(F.col("participant").alias("person"), F.col("d").alias("seen")).agg(F.max_by("security", F.struct("deal_key", "deal_line", "security")).alias("security"))
    return T.asof_join(f, known, ["person"], "d", "seen").drop("seen")


@register("d22_insider_filings", _FILING_SQL + ", p AS (" + " UNION ALL ".join(f"SELECT '{k}' AS pop, * FROM res WHERE {c}" for k, c in POPULATIONS.items()) + ") SELECT pop, count(*) AS n, count(security) AS resolved, count(DISTINCT security) AS names, round(sum(value), 2) AS value FROM p GROUP BY 1")
def d22(spark, p):
    """Five populations of filings, each filing with the security its person held dealings in at the filing date."""
    f = filings(deals(spark, p), table(spark, p, "events"))
    member = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in POPULATIONS.items())))
    e = f.withColumn("pop", F.explode(member))
    return e.groupBy("pop").agg(F.count(F.lit(1)).alias("n"), F.count("security").alias("resolved"), F.count_distinct("security").alias("names"), F.round(F.sum("value"), 2).alias("value"))


@register(
    "d23_announcements",
    _FILING_SQL + """, k AS (SELECT DISTINCT CASE WHEN event_type = 'purchase' THEN 'RESULTS' ELSE 'ANNOUNCEMENT' END AS pop, security, d FROM res WHERE security IS NOT NULL)
    SELECT pop, security, count(*) AS days, min(d) AS first, max(d) AS last FROM k GROUP BY ALL""",
)
def d23(spark, p):
    """One event a company and day in either population, however many filings there were."""
    f = filings(deals(spark, p), table(spark, p, "events")).where("security IS NOT NULL")
    k = f.select(F.when(F.col("event_type") == "purchase", "RESULTS").otherwise("ANNOUNCEMENT").alias("pop"), "security", "d").distinct()
    return k.groupBy("pop", "security").agg(F.count(F.lit(1)).alias("days"), F.min("d").alias("first"), F.max("d").alias("last"))


# Roles from the strongest, by the day's greatest filing of a person.
ROLES = ("AUDITOR", "CFO", "DIRECTOR", "OTHER")
_ROLE_SQL = "CASE WHEN event_type = 'purchase' AND value >= 80 THEN 1 WHEN event_type = 'purchase' THEN 2 WHEN value >= 60 THEN 3 ELSE 4 END"


@register(
    "d25_resignations",
    f"""WITH RECURSIVE day AS (SELECT user_id AS person, CAST(ts AS DATE) AS d, min({_ROLE_SQL}) AS r FROM events GROUP BY ALL),
    kept(person, d) AS (SELECT person, min(d) FROM day GROUP BY 1 UNION ALL SELECT k.person, n.d FROM kept k JOIN LATERAL (SELECT min(day.d) AS d FROM day WHERE day.person = k.person AND day.d >= k.d + 7) n ON n.d IS NOT NULL)
    SELECT person, d, CASE r WHEN 1 THEN 'AUDITOR' WHEN 2 THEN 'CFO' WHEN 3 THEN 'DIRECTOR' ELSE 'OTHER' END AS role FROM kept JOIN day USING (person, d)""",
)
def d25(spark, p):
    """The strongest role of a company's day; a day counts only seven days or more after the last one that counted."""
    role = F.when((F.col("event_type") == "purchase") & (F.col("value") >= 80), 0).when(F.col("event_type") == "purchase", 1).when(F.col("value") >= 60, 2).otherwise(3)
    day = table(spark, p, "events").groupBy(F.col("user_id").alias("person"), F.to_date("ts").alias("d")).agg(F.min(role).alias("r")).withColumn("i", F.unix_date("d").cast("long"))
    kept = R.decluster(day, ["person"], "i", 7, ["person", "i", "d", "r"])
    return kept.select("person", "d", F.element_at(F.array(*(F.lit(r) for r in ROLES)), F.col("r") + 1).alias("role"))


@register(
    "d26_holdings_changes",
    f"""{D}, q AS (SELECT participant, security, date_trunc('quarter', d)::DATE AS q, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS change FROM deals GROUP BY ALL), h AS (SELECT *, sum(change) OVER (PARTITION BY participant, security ORDER BY q) AS held FROM q),
    cap AS (SELECT security, date_trunc('quarter', d)::DATE AS q, 0.1 * sum(qty) AS cap FROM deals GROUP BY ALL)
    SELECT security, q, count(*) AS movers, count(*) FILTER (held > 0) AS holders, sum(change) AS change, {half_up_sql('sum(sign(change) * least(abs(change), cap))', 4)} AS tradeable, count(*) FILTER (abs(change) > cap) AS capped FROM h JOIN cap USING (security, q) GROUP BY ALL""",
)
def d26(spark, p):
    """Quarterly changes of holders' positions, each cut to a tenth of the quarter's volume of the name."""
    x = deals(spark, p)
    quarter = F.trunc("d", "quarter").alias("q")
    q = x.groupBy("participant", "security", quarter).agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("change"))
    h = q.withColumn("held", F.sum("change").over(Window.partitionBy("participant", "security").orderBy("q")))
    cap = x.groupBy("security", quarter).agg((0.1 * F.sum("qty")).alias("cap"))
    cut = F.signum("change") * F.least(F.abs("change"), F.col("cap"))
    return h.join(cap, ["security", "q"]).groupBy("security", "q").agg(F.count(F.lit(1)).alias("movers"), F.count_if(F.col("held") > 0).alias("holders"), F.sum("change").alias("change"), half_up(F.sum(cut), 4).alias("tradeable"), F.count_if(F.abs("change") > F.col("cap")).alias("capped"))
