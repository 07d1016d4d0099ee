"""Reporting tables: market, flow, ownership, screener and search documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.core.tables import DEALS_SQL, bars, bars_sql, deals, table
from sextant.functions.numbers import r6
from sextant.operators import rows as R
from sextant.plans.catalog import register

D, B = f"WITH {DEALS_SQL}", f"WITH {DEALS_SQL}, {bars_sql()}"


@register(
    "r01_market_micro",
    f"""{D}, s AS (SELECT last_day(d) AS m, security, sum(qty) AS q, coalesce(sum(qty) FILTER (kind = 'R'), 0) AS r FROM deals GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY q DESC, security) AS rn FROM s)
    SELECT m, count(*) AS stocks, sum(q) AS volume, round(sum(q) FILTER (rn <= 10) / sum(q), 6) AS top10, round(sum(r) / sum(q), 6) AS r_share FROM k GROUP BY 1""",
)
def r01(spark, p):
    s = deals(spark, p).groupBy(F.last_day("d").alias("m"), "security").agg(F.sum("qty").alias("q"), F.sum(F.when(F.col("kind") == "R", F.col("qty")).otherwise(0)).alias("r"))
    k = s.withColumn("rn", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("q"), "security")))
    return k.groupBy("m").agg(F.count(F.lit(1)).alias("stocks"), F.sum("q").alias("volume"), r6(F.sum(F.when(F.col("rn") <= 10, F.col("q"))) / F.sum("q")).alias("top10"), r6(F.sum("r") / F.sum("q")).alias("r_share"))


@register(
    "r02_flow_series",
    f"""{B}, n AS (SELECT d, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS net FROM deals GROUP BY 1), lv AS (SELECT d, avg(close) AS lvl FROM bars GROUP BY 1)
    SELECT last_day(d) AS m, sum(net) AS net, max(net) AS best_day, round(arg_max(lvl, d), 6) AS month_end_level FROM n JOIN lv USING (d) GROUP BY 1""",
)
def r02(spark, p):
    x = deals(spark, p)
    net = x.groupBy("d").agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("net"))
    level = bars(x).groupBy("d").agg(F.avg("close").alias("lvl"))
    return net.join(level, "d").groupBy(F.last_day("d").alias("m")).agg(F.sum("net").alias("net"), F.max("net").alias("best_day"), r6(F.max_by("lvl", "d")).alias("month_end_level"))


@register(
    "r03_insights",
    f"""{D}, t AS (SELECT max(d) AS last FROM deals), r AS (SELECT brand, participant, qty FROM deals, t WHERE d > last - 365)
    SELECT 'BRAND' AS kind, brand AS name, sum(qty) AS q FROM r GROUP BY ALL UNION ALL
    (SELECT 'PARTICIPANT', participant::VARCHAR, sum(qty) AS q FROM r GROUP BY ALL ORDER BY q DESC, 2 LIMIT 15) UNION ALL
    SELECT 'YEAR_TYPE', year(d)::VARCHAR || '/' || kind, round(sum(value), 2) FROM deals GROUP BY ALL UNION ALL
    SELECT 'ROUND_TRIP', y::VARCHAR, round(coalesce(sum(v) FILTER (sides = 2), 0) / sum(v), 6) FROM (SELECT year(d) AS y, participant, brand, count(DISTINCT side) AS sides, sum(value) AS v FROM deals GROUP BY ALL) GROUP BY y""",
)
def r03(spark, p):
    """Most-dealt names and largest participants of the last year, value by year and type, and by year the share of value of those who
    dealt on both sides of a name."""
    x = deals(spark, p)
    recent = x.join(F.broadcast(x.agg(F.max("d").alias("last"))), F.col("d") > F.date_sub("last", 365)).select("brand", F.col("participant").cast("string").alias("participant"), "qty")
    brands = recent.groupBy(F.lit("BRAND").alias("kind"), F.col("brand").alias("name")).agg(F.sum("qty").alias("q"))
    people = recent.groupBy(F.lit("PARTICIPANT").alias("kind"), F.col("participant").alias("name")).agg(F.sum("qty").alias("q")).orderBy(F.desc("q"), "name").limit(15)
    types = x.groupBy(F.concat_ws("/", F.year("d").cast("string"), "kind").alias("name")).agg(F.round(F.sum("value"), 2).alias("q")).select(F.lit("YEAR_TYPE").alias("kind"), "name", "q")
    sides = x.groupBy(F.year("d").cast("string").alias("name"), "participant", "brand").agg((F.min("side") != F.max("side")).alias("both"), F.sum("value").alias("v"))
    trips = sides.groupBy("name").agg(r6(F.sum(F.when(F.col("both"), F.col("v")).otherwise(0.0)) / F.sum("v")).alias("q")).select(F.lit("ROUND_TRIP").alias("kind"), "name", "q")
    return brands.unionByName(people).unionByName(types).unionByName(trips)


@register(
    "r04_ownership_shift",
    f"""{D}, h AS (SELECT security, date_trunc('quarter', d)::DATE AS q, sum(qty) AS held FROM deals GROUP BY ALL), c AS (SELECT q FROM h GROUP BY 1 HAVING count(*) >= 5 ORDER BY q DESC LIMIT 2),
    w AS (SELECT security, q, held FROM h WHERE q IN (SELECT q FROM c)) SELECT security, arg_max(held, q) AS now, arg_min(held, q) AS before, arg_max(held, q) - arg_min(held, q) AS shift FROM w GROUP BY 1 HAVING count(*) = 2""",
)
def r04(spark, p):
    h = deals(spark, p).groupBy("security", F.trunc("d", "quarter").alias("q")).agg(F.sum("qty").alias("held"))
    newest = h.groupBy("q").count().where("count >= 5").orderBy(F.desc("q")).limit(2).select("q")
    w = h.join(F.broadcast(newest), "q")
    now, before = F.max_by("held", "q"), F.min_by("held", "q")
    return w.groupBy("security").agg(now.alias("now"), before.alias("before"), (now - before).alias("shift"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@register(
    "r05_screener",
    f"""{D}, q AS (SELECT brand, year(d) * 4 + quarter(d) AS qi, sum(qty) AS sales, count(*) AS n, coalesce(sum(qty) FILTER (side = 'BUY'), 0) AS buys FROM deals GROUP BY ALL), l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY brand ORDER BY qi DESC) = 1)
    SELECT l.brand, l.qi, l.n, round(l.sales / o.sales - 1, 6) AS yoy, round(l.buys / l.sales, 6) AS margin FROM l LEFT JOIN q o ON o.brand = l.brand AND o.qi = l.qi - 4""",
)
def r05(spark, p):
    q = deals(spark, p).groupBy("brand", (F.year("d") * 4 + F.quarter("d")).cast("long").alias("qi")).agg(F.sum("qty").alias("sales"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(0)).alias("buys"))
    newest = R.top(q, ["brand"], [F.desc("qi")])
    year_ago = q.select("brand", (F.col("qi") + 4).alias("qi"), F.col("sales").alias("old"))
    return newest.join(year_ago, ["brand", "qi"], "left").select("brand", "qi", "n", r6(F.col("sales") / F.col("old") - 1).alias("yoy"), r6(F.col("buys") / F.col("sales")).alias("margin"))


@register(
    "r06_valuation",
    f"""{B}, q AS (SELECT brand AS id, year(d) * 4 + quarter(d) AS qi, sum(qty) AS e, max(kind) AS basis FROM deals WHERE qty > 20 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY qi DESC) AS rn FROM q),
    t AS (SELECT id, CASE WHEN count(*) = 4 AND count(DISTINCT basis) = 1 AND max(qi) - min(qi) = 3 THEN sum(e) END AS ttm FROM r WHERE rn <= 4 GROUP BY 1), px AS (SELECT id, arg_max(close, d) AS close FROM bars GROUP BY 1),
    sh AS (SELECT p_brand AS id, sum(p_size) * 1000.0 AS filed, count(*) * 25500.0 AS listed FROM part GROUP BY 1)
    SELECT id, ttm, CASE WHEN abs(filed / listed - 1) <= 0.05 THEN filed END AS shares, round(filed / listed - 1, 6) AS differs, round(close * CASE WHEN abs(filed / listed - 1) <= 0.05 THEN filed END, 2) AS cap, round(close * CASE WHEN abs(filed / listed - 1) <= 0.05 THEN filed END / nullif(ttm, 0), 6) AS pe FROM t JOIN px USING (id) JOIN sh USING (id)""",
)
def r06(spark, p):
    """Four quarters are summed only if they follow each other on one basis; filed share counts (part sizes) are used only if a second count (a
    standard size a part) agrees within 5 %, and without shares there is no market value and no price-earnings ratio."""
    x = deals(spark, p)
    q = x.where("qty > 20").groupBy(F.col("brand").alias("id"), (F.year("d") * 4 + F.quarter("d")).alias("qi")).agg(F.sum("qty").alias("e"), F.max("kind").alias("basis"))
    last4 = R.top(q, ["id"], [F.desc("qi")], 4).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("basis").alias("lo"), F.max("basis").alias("hi"), (F.max("qi") - F.min("qi")).alias("span"), F.sum("e").alias("e"))
    ttm = last4.select("id", F.when((F.col("n") == 4) & (F.col("lo") == F.col("hi")) & (F.col("span") == 3), F.col("e")).alias("ttm"))
    price = bars(x).groupBy("id").agg(F.max_by("close", "d").alias("close"))
    counts = table(spark, p, "part").groupBy(F.col("p_brand").alias("id")).agg((F.sum("p_size") * 1000.0).alias("filed"), (F.count(F.lit(1)) * 25500.0).alias("listed"))
    counts = counts.withColumn("differs", F.col("filed") / F.col("listed") - 1).select("id", "differs", F.when(F.abs("differs") <= 0.05, F.col("filed")).alias("shares"))
    cap = F.col("close") * F.col("shares")
    return ttm.join(price, "id").join(counts, "id").select("id", "ttm", "shares", r6(F.col("differs")).alias("differs"), F.round(cap, 2).alias("cap"), r6(F.try_divide(cap, "ttm")).alias("pe"))


@register(
    "r07_scale_errors",
    f"""{D}, q AS (SELECT security, d, sum(qty) AS v FROM deals GROUP BY ALL), n AS (SELECT *, log10(v / lag(v) OVER w) AS up, log10(v / lead(v) OVER w) AS down FROM q WINDOW w AS (PARTITION BY security ORDER BY d))
    SELECT security, d, v, round(up)::BIGINT AS power FROM n WHERE abs(round(up)) >= 1 AND round(up) = round(down) AND abs(up - round(up)) < 0.2 AND abs(down - round(down)) < 0.2""",
)
def r07(spark, p):
    w = Window.partitionBy("security").orderBy("d")
    q = deals(spark, p).groupBy("security", "d").agg(F.sum("qty").alias("v"))
    n = q.withColumn("up", F.log10(F.col("v") / F.lag("v").over(w))).withColumn("down", F.log10(F.col("v") / F.lead("v").over(w)))
    off = n.where("abs(round(up)) >= 1 AND round(up) = round(down) AND abs(up - round(up)) < 0.2 AND abs(down - round(down)) < 0.2")
    return off.select("security", "d", "v", F.round("up").cast("long").alias("power"))


@register(
    "r08_portfolio_changes",
    f"""{D}, fi AS (SELECT participant, date_trunc('quarter', d)::DATE AS q, deal_key, count(*) AS n FROM deals GROUP BY ALL), best AS (SELECT participant, q, deal_key FROM fi QUALIFY row_number() OVER (PARTITION BY participant, q ORDER BY n DESC, deal_key DESC) = 1),
    h AS (SELECT participant, brand, q, sum(qty) AS held FROM deals JOIN best USING (participant, deal_key) WHERE date_trunc('quarter', d)::DATE = q GROUP BY ALL), s AS (SELECT participant, q, row_number() OVER (PARTITION BY participant ORDER BY q DESC) AS rn FROM (SELECT DISTINCT participant, q FROM h)),
    a AS (SELECT h.* FROM h JOIN s USING (participant, q) WHERE rn = 1), o AS (SELECT h.* FROM h JOIN s USING (participant, q) WHERE rn = 2)
    SELECT coalesce(a.participant, o.participant) AS participant, coalesce(a.brand, o.brand) AS brand, CASE WHEN o.brand IS NULL THEN 'NEW' WHEN a.brand IS NULL THEN 'EXITED' ELSE 'HELD' END AS state, coalesce(a.held, 0) - coalesce(o.held, 0) AS change
    FROM a FULL JOIN o ON a.participant = o.participant AND a.brand = o.brand""",
)
def r08(spark, p):
    """A holder's best file of a quarter (an order, the one of most lines) is its portfolio; the two newest are ranked, so one aggregate by
    (holder, item) compares them."""
    x = deals(spark, p).withColumn("q", F.trunc("d", "quarter"))
    best = R.top(x.groupBy("participant", "q", "deal_key").agg(F.count(F.lit(1)).alias("n")), ["participant", "q"], [F.desc("n"), F.desc("deal_key")]).drop("n")
    h = x.join(best, ["participant", "q", "deal_key"]).groupBy("participant", "brand", "q").agg(F.sum("qty").alias("held"))
    ranked = h.withColumn("rn", F.dense_rank().over(Window.partitionBy("participant").orderBy(F.desc("q")))).where("rn <= 2")
    now, before = F.sum(F.when(F.col("rn") == 1, F.col("held"))), F.sum(F.when(F.col("rn") == 2, F.col("held")))
    g = ranked.groupBy("participant", "brand").agg(now.alias("now"), before.alias("before"))
    state = F.when(F.col("before").isNull(), "NEW").when(F.col("now").isNull(), "EXITED").otherwise("HELD")
    return g.select("participant", "brand", state.alias("state"), (F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("change"))


@register(
    "r09_widest_holders",
    f"""{D}, qs AS (SELECT DISTINCT date_trunc('quarter', d)::DATE AS q FROM deals ORDER BY q DESC LIMIT 2), h AS (SELECT DISTINCT participant, brand, date_trunc('quarter', d)::DATE AS q FROM deals WHERE date_trunc('quarter', d)::DATE IN (SELECT q FROM qs)),
    g AS (SELECT participant, brand, bool_or(q = (SELECT max(q) FROM qs)) AS now, bool_or(q = (SELECT min(q) FROM qs)) AS before FROM h GROUP BY ALL)
    SELECT participant, count(*) FILTER (now) AS held, count(*) FILTER (now AND NOT before) AS new, count(*) FILTER (before AND NOT now) AS exited FROM g GROUP BY 1 ORDER BY held DESC, new DESC, participant LIMIT 25""",
)
def r09(spark, p):
    """Who holds most names in the newest quarter, and how many are new or have gone since the one before."""
    x = deals(spark, p).select("participant", "brand", F.trunc("d", "quarter").alias("q")).distinct()
    newest = x.select("q").distinct().orderBy(F.desc("q")).limit(2).agg(F.max("q").alias("last"), F.min("q").alias("prior"))  # one row
    g = x.join(F.broadcast(newest), (F.col("q") == F.col("last")) | (F.col("q") == F.col("prior"))).groupBy("participant", "brand").agg(F.bool_or(F.col("q") == F.col("last")).alias("now"), F.bool_or(F.col("q") == F.col("prior")).alias("before"))
    n = g.groupBy("participant").agg(F.count_if("now").alias("held"), F.count_if(F.col("now") & ~F.col("before")).alias("new"), F.count_if(F.col("before") & ~F.col("now")).alias("exited"))
    return n.orderBy(F.desc("held"), F.desc("new"), "participant").limit(25)


@register(
    "r10_listing_state",
    f"""{D}, t AS (SELECT max(d) AS last FROM deals), s AS (SELECT participant, max(d) AS seen FROM deals GROUP BY 1)
    SELECT c_custkey AS participant, CASE WHEN seen IS NULL THEN 'NEVER' WHEN date_diff('day', seen, last) <= 30 THEN 'TRADING' ELSE 'QUIET' END AS state FROM customer LEFT JOIN s ON participant = c_custkey, t""",
)
def r10(spark, p):
    x = deals(spark, p).groupBy("participant").agg(F.max("d").alias("seen"))
    every = table(spark, p, "customer").select(F.col("c_custkey").alias("participant")).join(x, "participant", "left").join(F.broadcast(x.agg(F.max("seen").alias("last"))), F.lit(True))
    return every.select("participant", F.when(F.col("seen").isNull(), "NEVER").when(F.datediff("last", "seen") <= 30, "TRADING").otherwise("QUIET").alias("state"))


@register(
    "r11_filings_feed",
    """WITH f AS (SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1), l AS (SELECT max(ts) - INTERVAL 7 DAY AS since FROM events),
    s AS (SELECT *, value / nullif(sum(value) OVER (PARTITION BY user_id), 0) AS share FROM f)
    SELECT user_id, event_type, event_id, ts, value, round(share, 6) AS share, CASE WHEN event_type = 'view' AND ts > since THEN 'MEETING' WHEN event_type = 'purchase' AND share >= 0.3 THEN 'PLEDGE' ELSE 'FILING' END AS section,
      coalesce(c_name, s_name, p_name) AS name, CASE WHEN c_name IS NOT NULL THEN 'holder' WHEN s_name IS NOT NULL THEN 'company' WHEN p_name IS NOT NULL THEN 'item' ELSE 'unknown' END AS route
    FROM s LEFT JOIN customer ON c_custkey = user_id * 5 LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN part ON p_partkey = user_id, l""",
)
def r11(spark, p):
    """The newest filing of each kind; what lies in the last week as upcoming meetings, pledges by their share of the filer's value, and
    the filer's name from three registers in turn."""
    e = table(spark, p, "events")
    f = R.top(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", "value")
    s = f.withColumn("share", F.try_divide("value", F.sum("value").over(Window.partitionBy("user_id")))).join(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("since"))), F.lit(True))
    names = [("holder", "customer", F.col("c_custkey") / 5, "c_name", F.col("c_custkey") % 5 == 0), ("company", "supplier", F.col("s_suppkey"), "s_name", F.lit(True)), ("item", "part", F.col("p_partkey"), "p_name", F.lit(True))]
    for _, t, key, name, fits in names:
        s = s.join(table(spark, p, t).where(fits).select(key.cast("long").alias("user_id"), name), "user_id", "left")
    section = R.ladder([("MEETING", (F.col("event_type") == "view") & (F.col("ts") > F.col("since"))), ("PLEDGE", (F.col("event_type") == "purchase") & (F.col("share") >= 0.3))]).otherwise("FILING")
    route = R.ladder([(kind, F.col(name).isNotNull()) for kind, _, _, name, _ in names]).otherwise("unknown")
    return s.select("user_id", "event_type", "event_id", "ts", "value", r6(F.col("share")).alias("share"), section.alias("section"), F.coalesce("c_name", "s_name", "p_name").alias("name"), route.alias("route"))


_R12_EVENTS = {
    "NEW_HIGH": "close >= max(close) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)",
    "NEW_LOW": "close <= min(close) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)",
    "VOLUME_SURGE": "volume > 2 * avg(volume) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)",
    "GAP_UP": "open > 1.5 * lag(close) OVER (PARTITION BY id ORDER BY d)",
    "GAP_DOWN": "open < 0.5 * lag(close) OVER (PARTITION BY id ORDER BY d)",
}


@register(
    "r12_event_file",
    f"""{B.replace("WITH", "WITH RECURSIVE", 1)}, f AS (SELECT id, d, {', '.join(f'round(lead(close, {h}) OVER w / lead(open, 1) OVER w - 1, 6) AS h{h}' for h in (1, 5, 10, 21))} FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)),
    k AS (SELECT id, d, {', '.join(f'{e} AS {n}' for n, e in _R12_EVENTS.items())} FROM bars),
    e AS (SELECT DISTINCT brand AS id, d, CASE WHEN side = 'BUY' THEN 'LARGE_BUY' ELSE 'LARGE_SELL' END AS kind FROM deals WHERE qty >= 45 UNION SELECT DISTINCT brand, d, 'R_DEAL' FROM deals WHERE kind = 'R' AND qty >= 45 {' '.join(f"UNION SELECT id, d, '{n}' FROM k WHERE {n}" for n in _R12_EVENTS)}),
    g(id, kind, d) AS (SELECT id, kind, min(d) FROM e GROUP BY ALL UNION ALL SELECT g.id, g.kind, n.d FROM g JOIN LATERAL (SELECT min(e.d) AS d FROM e WHERE e.id = g.id AND e.kind = g.kind AND e.d >= g.d + 7) n ON n.d IS NOT NULL)
    SELECT id, d, g.kind, h1, h5, h10, h21 FROM g JOIN f USING (id, d) WHERE ('0x' || substr(sha256(id), 1, 8))::BIGINT % 1000 < 600""",
)
def r12(spark, p):
    """Eight kinds of events, each at least a week after the last kept one of its name and kind, with forward returns.  Only the
    exploration stratum (hash bucket below 600) leaves the job."""
    x = deals(spark, p)
    w = Window.partitionBy("id").orderBy("d")
    b = bars(x)
    f = b.select("id", "d", *(r6(F.lead("close", h).over(w) / F.lead("open", 1).over(w) - 1).alias(f"h{h}") for h in (1, 5, 10, 21)))
    large = x.where("qty >= 45").select(F.col("brand").alias("id"), "d", F.explode(F.array(F.when(F.col("side") == "BUY", "LARGE_BUY").otherwise("LARGE_SELL"), F.when(F.col("kind") == "R", "R_DEAL"))).alias("kind"))
    flags = b.select("id", "d", F.array(*(F.struct(F.lit(n).alias("kind"), F.expr(e).alias("hit")) for n, e in _R12_EVENTS.items())).alias("k"))
    events = large.where("kind IS NOT NULL").distinct().unionByName(flags.select("id", "d", F.inline("k")).where("hit").select("id", "d", "kind"))
    apart = R.decluster(events.withColumn("day", F.unix_date("d")), ["id", "kind"], "day", 7, ["id", "kind", "d", "day"]).drop("day")
    return apart.where(F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % 1000 < 600).join(f, ["id", "d"]).select("id", "d", "kind", "h1", "h5", "h10", "h21")


@register("r13_search_index", "SELECT 'CUSTOMER' AS kind, c_name AS name, c_custkey AS key FROM customer UNION ALL SELECT 'SUPPLIER', s_name, s_suppkey FROM supplier UNION ALL SELECT 'PART', p_name, p_partkey FROM part")
def r13(spark, p):
    parts = [("CUSTOMER", "customer", "c_name", "c_custkey"), ("SUPPLIER", "supplier", "s_name", "s_suppkey"), ("PART", "part", "p_name", "p_partkey")]
    frames = [table(spark, p, t).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(key).alias("key")) for kind, t, name, key in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@register(
    "s18_nested_documents",
    f"""{D}, s AS (SELECT brand, last_day(d) AS m, sum(qty)::BIGINT AS q FROM deals GROUP BY ALL)
    SELECT brand, '{{"cols":["m","q"],"rows":[' || string_agg('["' || m::VARCHAR || '",' || q || ']', ',' ORDER BY m) || ']}}' AS doc FROM s GROUP BY 1""",
)
def s18(spark, p):
    """One columnar JSON document per key; a key's rows are its months."""
    s = deals(spark, p).groupBy("brand", F.last_day("d").alias("m")).agg(F.sum("qty").cast("long").alias("q"))
    row = F.transform(F.sort_array(F.collect_list(F.struct("m", "q"))), lambda r: F.concat(F.lit('["'), r["m"].cast("string"), F.lit('",'), r["q"].cast("string"), F.lit("]")))
    return s.groupBy("brand").agg(F.concat(F.lit('{"cols":["m","q"],"rows":['), F.array_join(row, ","), F.lit("]}")).alias("doc"))
