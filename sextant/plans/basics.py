"""The inventory's elementary rows as queries of their own: scans, joins, aggregates, sets and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sextant.core.shared import new_path
from sextant.core.tables import CALENDAR_SQL, DEALS_SQL, bars, bars_sql, calendar, deals, table
from sextant.functions.numbers import r6
from sextant.operators import rows as R
from sextant.operators import timejoin as T
from sextant.plans.catalog import register
from sextant.plans.slice import FWD_SQL

D, B = f"WITH {DEALS_SQL}", f"WITH {DEALS_SQL}, {bars_sql()}"
BC = f"{B}, {CALENDAR_SQL}"

# Endings that a name loses, and words shown in capitals.
SUFFIXES = ("gear", "bolt", "ring", "nut")
ACRONYMS = ("STEEL", "USA", "UK", "ETF", "LLC")


def one(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("d")


# Scans


@register("s01_partitioned_scan", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY ALL")
def s01_partitioned(spark: SparkSession, p: str) -> DataFrame:
    """A set partitioned by year and status is read by a recursive glob: partition columns come from the paths, years
    before 1996 are never opened, and of the files' columns one is read."""
    path = new_path(spark, "orders")
    orders = table(spark, p, "orders")
    orders.withColumn("y", F.year("o_orderdate")).repartition("y", "o_orderstatus").write.partitionBy("y", "o_orderstatus").parquet(path)
    read = spark.read.option("basePath", path).schema("o_totalprice double, y int, o_orderstatus string").parquet(f"{path}/y=*/o_orderstatus=*")
    return read.where("y >= 1996").groupBy(F.col("y").cast("long").alias("y"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("p15_cutoff", f"{D}, cut AS (SELECT * FROM deals WHERE d <= DATE '1997-12-31'), s AS (SELECT security, d, sum(qty) AS q FROM cut GROUP BY ALL) SELECT security, d, q, lag(q) OVER (PARTITION BY security ORDER BY d) AS before FROM s")
def p15(spark, p):
    """Rows after the cut-off never reach the windows: the filter goes to the scan of the dates."""
    s = deals(spark, p).where("d <= DATE '1997-12-31'").groupBy("security", "d").agg(F.sum("qty").alias("q"))
    return s.withColumn("before", F.lag("q").over(one("security")))


# Names and numbers


def stripped(name: Column) -> Column:
    """Without any of SUFFIXES at the end, as often as one stands there."""
    return F.trim(F.regexp_replace(name, f"(?: (?:{'|'.join(SUFFIXES)}))+$", ""))


@register("p03_suffix_strip", f"SELECT trim(regexp_replace(p_name, '(?: (?:{'|'.join(SUFFIXES)}))+$', '')) AS stem, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY 1")
def p03(spark, p):
    return table(spark, p, "part").groupBy(stripped(F.col("p_name")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("names"))


_ACRONYM_LIST = ", ".join(f"'{a}'" for a in ACRONYMS)


@register("f03_display_names", f"SELECT DISTINCT p_type, array_to_string(list_transform(string_split(p_type, ' '), lambda w: CASE WHEN upper(w) IN ({_ACRONYM_LIST}) THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS shown FROM part")
def f03(spark, p):
    word = lambda w: F.when(F.upper(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))
    return table(spark, p, "part").select("p_type").distinct().select("p_type", F.array_join(F.transform(F.split("p_type", " "), word), " ").alias("shown"))


@F.udf(returnType=StringType(), useArrow=True)
def shown_number(x: float | None) -> str | None:
    """Thousands commas and two digits, exact to the last digit; ``format_number`` has 17 digits at most and other words for NaN and infinity."""
    return None if x is None else format(x, ",.2f")


def parsed(text: Column) -> Column:
    """A number with thousands commas, negative in parentheses, the first one in the text; NULL if there is none."""
    digits = F.regexp_extract(F.regexp_replace(text, ",", ""), r"(\d+(?:\.\d+)?)", 1)
    value = F.when(digits == "", None).otherwise(digits.cast("double"))
    return F.when(F.regexp_like(text, F.lit(r"^\s*\(|-\d")), -value).otherwise(value)


_SHOWN = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'Rs ' || format('{:,.2f}', abs(c_acctbal)) || ' cr' ELSE CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', -c_acctbal) || ')' ELSE format('{:,.2f}', c_acctbal) END END"


@register(
    "f13_number_text",
    f"""WITH t AS (SELECT c_custkey, {_SHOWN} AS shown FROM customer), v AS (SELECT *, nullif(regexp_extract(replace(shown, ',', ''), '(\\d+(?:\\.\\d+)?)', 1), '')::DOUBLE AS x FROM t)
    SELECT c_custkey, shown, CASE WHEN regexp_matches(shown, '^\\s*\\(|-\\d') THEN -x ELSE x END AS value FROM v""",
)
def f13(spark, p):
    """Balances are written as a report shows them (every digit of large ones, the sign of a negative zero), then read back."""
    money, k = shown_number(F.abs("c_acctbal")), F.col("c_custkey") % 5
    plain = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(shown_number(F.col("c_acctbal")))
    shown = F.when(k == 0, None).when(k == 1, "n/a").when(k == 2, F.concat(F.lit("Rs "), money, F.lit(" cr"))).otherwise(plain)
    return table(spark, p, "customer").select("c_custkey", shown.alias("shown")).withColumn("value", parsed(F.col("shown")))


@register(
    "f14_direction",
    f"""{D}, q AS (SELECT brand, year(d) * 4 + quarter(d) - 1 AS qi, sum(qty) AS v FROM deals GROUP BY ALL) SELECT a.brand, a.qi::BIGINT AS qi, a.v, b.v AS old, CASE WHEN b.v IS NULL THEN 'NEW' WHEN a.v > b.v * 1.05 THEN 'UP' WHEN a.v < b.v * 0.95 THEN 'DOWN' ELSE 'FLAT' END AS direction
    FROM q a LEFT JOIN q b ON a.brand = b.brand AND b.qi = a.qi - 4""",
)
def f14(spark, p):
    """Against the same quarter a year earlier, more than five per cent either way."""
    q = deals(spark, p).groupBy("brand", (F.year("d") * 4 + F.quarter("d") - 1).cast("long").alias("qi")).agg(F.sum("qty").alias("v"))
    x = q.join(q.select("brand", (F.col("qi") + 4).alias("qi"), F.col("v").alias("old")), ["brand", "qi"], "left")
    return x.withColumn("direction", R.ladder([("NEW", F.col("old").isNull()), ("UP", F.col("v") > F.col("old") * 1.05), ("DOWN", F.col("v") < F.col("old") * 0.95)]).otherwise("FLAT"))


@register("f01_strings", "SELECT p_partkey, upper(trim(p_name)) AS up, lower(p_type) AS low, p_brand[1:5] AS head, p_name LIKE 'hot%' AS hot, p_brand || '/' || p_name AS both, regexp_replace(p_name, '[aeiou]+', '-', 'g') AS marked, regexp_extract(p_brand, '#(\\d+)', 1) AS number, CAST(length(p_name) AS INT) AS n FROM part")
def f01(spark, p):
    return table(spark, p, "part").select(
        "p_partkey", F.upper(F.trim("p_name")).alias("up"), F.lower("p_type").alias("low"), F.substring("p_brand", 1, 5).alias("head"), F.col("p_name").like("hot%").alias("hot"), F.concat_ws("/", "p_brand", "p_name").alias("both"),
        F.regexp_replace("p_name", "[aeiou]+", "-").alias("marked"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("number"), F.length("p_name").alias("n"),
    )


@register("f04_dates", f"{D} SELECT DISTINCT d, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, CAST(isodow(d) AS INT) AS weekday, last_day(d) AS month_end, date_trunc('quarter', d)::DATE AS quarter_start, CAST(date_diff('day', DATE '1992-01-01', d) AS INT) AS age, (d + INTERVAL 3 MONTH)::DATE AS later, strftime(d, '%d-%m-%Y') AS shown FROM deals")
def f04(spark, p):
    return deals(spark, p).select("d").distinct().select(
        "d", F.year("d").alias("y"), F.month("d").alias("m"), (F.weekday("d") + 1).alias("weekday"), F.last_day("d").alias("month_end"), F.trunc("d", "quarter").alias("quarter_start"),
        F.datediff("d", F.lit("1992-01-01").cast("date")).alias("age"), F.add_months("d", 3).alias("later"), F.date_format("d", "dd-MM-yyyy").alias("shown"),
    )


@register("f07_math", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS distance, round(ln(l_extendedprice), 6) AS log, round(exp(l_discount), 6) AS growth, round(sqrt(l_quantity), 6) AS root, CAST(sign(l_quantity - 25) AS INT) AS side, round(power(1 + l_tax, 2), 6) AS square, round(log10(l_extendedprice), 6) AS digits, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS bucket FROM lineitem")
def f07(spark, p):
    return table(spark, p, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(F.col("l_quantity") - 25).alias("distance"), r6(F.log("l_extendedprice")).alias("log"), r6(F.exp("l_discount")).alias("growth"), r6(F.sqrt("l_quantity")).alias("root"),
        F.signum(F.col("l_quantity") - 25).cast("int").alias("side"), r6(F.pow(1 + F.col("l_tax"), F.lit(2.0))).alias("square"), r6(F.log10("l_extendedprice")).alias("digits"), F.floor(F.col("l_extendedprice") / 1000).alias("bucket"),
    )


@register("f08_arrays", "WITH a AS (SELECT o_custkey, list({'d': CAST(o_orderdate AS DATE), 'k': o_orderkey} ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1) SELECT o_custkey, CAST(len(orders) AS INT) AS n, orders[1].k AS first_key, orders[-1].d AS last_d, list_sum(list_transform(orders, lambda x: x.k % 7))::BIGINT AS code, len(list_filter(orders, lambda x: x.k % 2 = 0))::INT AS even FROM a")
def f08(spark, p):
    """A customer's orders as a sorted list of structs, then its ends, a fold and a filter."""
    a = table(spark, p, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("k")))).alias("orders"))
    code = F.aggregate("orders", F.lit(0).cast("long"), lambda acc, x: acc + x["k"] % 7)
    return a.select("o_custkey", F.size("orders").alias("n"), F.element_at("orders", 1)["k"].alias("first_key"), F.element_at("orders", -1)["d"].alias("last_d"), code.alias("code"), F.size(F.filter("orders", lambda x: x["k"] % 2 == 0)).alias("even"))


# Labels of order states.
STATES = {"F": "filled", "O": "open", "P": "partly filled"}


@register("f09_maps", f"SELECT coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in STATES.items())}}}[o_orderstatus], 'unknown') AS state, count(*) AS n FROM orders GROUP BY 1")
def f09(spark, p):
    labels = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    return table(spark, p, "orders").groupBy(F.coalesce(labels[F.col("o_orderstatus")], F.lit("unknown")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@register("f10_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS row_json FROM events")
def f10(spark, p):
    return table(spark, p, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("row_json"))


# Joins


@register("j01_inner_join", "SELECT o_orderkey, o_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, p):
    c = table(spark, p, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, p, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(c, "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment", "o_totalprice")


@register("j24_small_map", "WITH m(segment, sector) AS (VALUES ('AUTOMOBILE', 'cyclical'), ('MACHINERY', 'cyclical'), ('FURNITURE', 'household'), ('HOUSEHOLD', 'household')) SELECT coalesce(sector, c_mktsegment) AS sector, count(*) AS n FROM customer LEFT JOIN m ON upper(trim(c_mktsegment)) = segment GROUP BY 1")
def j24(spark, p):
    """Four fixed rows, so the map is broadcast; what it doesn't know keeps its own label."""
    m = spark.createDataFrame([("AUTOMOBILE", "cyclical"), ("MACHINERY", "cyclical"), ("FURNITURE", "household"), ("HOUSEHOLD", "household")], "segment string, sector string")
    c = table(spark, p, "customer").withColumn("segment", F.upper(F.trim("c_mktsegment")))
    return c.join(F.broadcast(m), "segment", "left").groupBy(F.coalesce("sector", "c_mktsegment").alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "j08_asof_value",
    f"{B}, e AS (SELECT DISTINCT brand AS id, d, participant FROM deals WHERE qty = 50) SELECT id, d, participant, (SELECT close FROM bars WHERE bars.id = e.id AND bars.d < e.d ORDER BY bars.d DESC LIMIT 1) AS before FROM e",
)
def j08(spark, p):
    """The value in force just before each event: the correlated form with LIMIT 1, as one sort per key."""
    x = deals(spark, p)
    e = x.where("qty = 50").select(F.col("brand").alias("id"), "d", "participant").distinct()
    got = T.asof_join(e, bars(x).select("id", F.col("d").alias("bd"), F.col("close").alias("before")), ["id"], "d", "bd", strict=True)
    return got.select("id", "d", "participant", "before")


@register("j19_previous_observation", f"{D}, o AS (SELECT security, d, sum(qty) AS oi FROM deals GROUP BY ALL) SELECT o.security, o.d, o.oi, b.d AS before_d, o.oi - b.oi AS change FROM o LEFT JOIN o b ON b.security = o.security AND b.d = (SELECT max(x.d) FROM o x WHERE x.security = o.security AND x.d < o.d)")
def j19(spark, p):
    o = deals(spark, p).groupBy("security", "d").agg(F.sum("qty").alias("oi"))
    return o.select("security", "d", "oi", F.lag("d").over(one("security")).alias("before_d"), (F.col("oi") - F.lag("oi").over(one("security"))).alias("change"))


@register("j30_abnormal_returns", f"{B}, {FWD_SQL}, e AS (SELECT DISTINCT brand AS id, d FROM deals WHERE side = 'BUY' AND qty >= 40) SELECT id, d, round(fwd, 6) AS fwd, round(fwd - market, 6) AS abnormal FROM e JOIN f USING (id, d) JOIN market USING (d) WHERE fwd IS NOT NULL")
def j30(spark, p):
    x = deals(spark, p)
    f = R.forward_return(bars(x), 5, 20).where("fwd IS NOT NULL").select("id", "d", "fwd")
    e = x.where("side = 'BUY' AND qty >= 40").select(F.col("brand").alias("id"), "d").distinct()
    return e.join(f.withColumn("market", F.avg("fwd").over(Window.partitionBy("d"))), ["id", "d"]).select("id", "d", r6(F.col("fwd")).alias("fwd"), r6(F.col("fwd") - F.col("market")).alias("abnormal"))


# Aggregates, windows and sets


@register("a01_grouped", f"{D} SELECT brand, side, count(*) AS n, sum(qty) AS q, min(d) AS first, max(d) AS last, min(qty) AS least, max(qty) AS most FROM deals GROUP BY ALL")
def a01(spark, p):
    return deals(spark, p).groupBy("brand", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("q"), F.min("d").alias("first"), F.max("d").alias("last"), F.min("qty").alias("least"), F.max("qty").alias("most"))


@register("a27_market_leg", f"{B}, {FWD_SQL} SELECT d, count(fwd) AS names, round(avg(fwd), 6) AS market FROM f WHERE fwd IS NOT NULL GROUP BY 1")
def a27(spark, p):
    f = R.forward_return(bars(deals(spark, p)), 5, 20).where("fwd IS NOT NULL")
    return f.groupBy("d").agg(F.count("fwd").alias("names"), r6(F.avg("fwd")).alias("market"))


@register("w01_session_index", f"{BC} SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS own, i + 1 AS session FROM bars JOIN cal USING (d)")
def w01(spark, p):
    x = deals(spark, p)
    return bars(x).select("id", "d", F.row_number().over(one("id")).cast("long").alias("own")).join(calendar(x).select("d", (F.col("i") + 1).cast("long").alias("session")), "d").select("id", "d", "own", "session")


@register("w03_forward_return", f"{B}, {FWD_SQL} SELECT id, d, round(fwd, 6) AS fwd FROM f")
def w03(spark, p):
    return R.forward_return(bars(deals(spark, p)), 5, 20).select("id", "d", r6(F.col("fwd")).alias("fwd"))


@register("w11_newest_per_key", f"{D} SELECT participant, security, d, qty, deal_key, deal_line FROM deals QUALIFY row_number() OVER (PARTITION BY participant ORDER BY d DESC, deal_key DESC, deal_line DESC) = 1")
def w11(spark, p):
    """Deals can share participant, day and key; the SQL takes any of these, here it is the one of least security and quantity in every run."""
    return R.top(deals(spark, p).select("participant", "security", "d", "qty", "deal_key", "deal_line"), ["participant"], [F.desc("d"), F.desc("deal_key"), F.desc("deal_line"), F.asc("security"), F.asc("qty")])


@register(
    "w27_session_arithmetic",
    f"""WITH {DEALS_SQL}, {CALENDAR_SQL}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), upto AS (SELECT day, (SELECT max(i) FROM cal WHERE d <= day) AS i FROM days)
    SELECT day, EXISTS (SELECT 1 FROM cal WHERE d = day) AS is_session, (SELECT d FROM cal WHERE cal.i = upto.i + 5) AS plus_5, (SELECT max(i) FROM cal) - upto.i AS sessions_after FROM upto""",
)
def w27(spark, p):
    """Of each order's day: whether it is a session, the session five on, and how many follow.  Dates only."""
    cal = calendar(deals(spark, p)).select("d", "i")
    days = table(spark, p, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("k", F.lit(1))
    upto = T.asof_join(days, cal.select(F.lit(1).alias("k"), "d", "i"), ["k"], "day", "d")
    end = cal.agg(F.max("i").alias("end"))  # one row
    five = cal.select((F.col("i") - 5).alias("i"), F.col("d").alias("plus_5"))
    return upto.join(five, "i", "left").crossJoin(F.broadcast(end)).select("day", F.coalesce(F.col("d") == F.col("day"), F.lit(False)).alias("is_session"), "plus_5", (F.col("end") - F.col("i")).cast("long").alias("sessions_after"))


@register("u01_union_all", "SELECT kind, count(*) AS n, sum(k)::BIGINT AS keys FROM (SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) GROUP BY 1")
def u01(spark, p):
    parts = [table(spark, p, t).select(F.col(k).alias("k"), F.lit(t).alias("kind")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2].select("kind", "k")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@register("u05_distinct", f"{D} SELECT DISTINCT participant, brand, side FROM deals")
def u05(spark, p):
    return deals(spark, p).select("participant", "brand", "side").distinct()


@register("t02_late_sessions", f"WITH {DEALS_SQL}, src AS (SELECT d, count(*) AS n FROM deals GROUP BY 1), tab AS (SELECT d FROM src WHERE d <= DATE '1999-06-30' AND day(d) <> 13) SELECT d, n FROM src WHERE d <= (SELECT max(d) FROM tab) AND d NOT IN (SELECT d FROM tab)")
def t02(spark, p):
    """Sessions at or before the table's newest one that the table lacks: an append with any of them has to stop.  The
    table here is what landed up to June 1999, with every 13th of a month missing."""
    from sextant.streaming.increments import late_sessions

    src = deals(spark, p).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return late_sessions(src, src.where((F.col("d") <= F.lit("1999-06-30").cast("date")) & (F.dayofmonth("d") != 13)).select("d"), "d")
