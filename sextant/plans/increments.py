"""Streams and incremental checks over the given tables, and the user-function surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise, new_path
from sextant.core.tables import DEALS_SQL, deals, table
from sextant.functions.numbers import r6
from sextant.operators import rows as R
from sextant.plans.catalog import register
from sextant.streaming import increments as I

D = f"WITH {DEALS_SQL}"
SESSION_SCHEMA = "brand string, d date, qty double, value double"


def three_files(df, path: str, day: str = "d"):
    """The rows of three successive spans of days, written in their order; a delivery is one file, as the source sends it."""
    for lo, hi in (("1900-01-01", "1997-01-01"), ("1997-01-01", "1999-06-01"), ("1999-06-01", "2100-01-01")):
        df.where((F.col(day) >= lo) & (F.col(day) < hi)).coalesce(1).write.mode("append").parquet(path)


@register("t01_append_sessions", f"{D} SELECT year(d) AS y, count(*) AS n, count(DISTINCT d) AS sessions, round(sum(value), 2) AS value FROM deals GROUP BY 1")
def t01(spark, p):
    """Three deliveries by stream, then one of them again: the table holds every session once."""
    source, path, checkpoint = (new_path(spark, w) for w in ("deliveries", "sessions", "state"))
    day = deals(spark, p).groupBy("brand", "d").agg(F.count(F.lit(1)).cast("double").alias("qty"), F.sum("value").alias("value"))
    three_files(day, source)
    I.stream_sessions(spark, source, SESSION_SCHEMA, path, checkpoint)
    day.where("d >= '1997-01-01' AND d < '1999-06-01'").coalesce(1).write.mode("append").parquet(source)
    I.stream_sessions(spark, source, SESSION_SCHEMA, path, checkpoint)
    held = spark.read.schema(f"{SESSION_SCHEMA}, _batch long").parquet(path)
    return held.groupBy(F.year("d").alias("y")).agg(F.sum("qty").cast("long").alias("n"), F.count_distinct("d").alias("sessions"), F.round(F.sum("value"), 2).alias("value"))


@register("t03_land_once", "SELECT event_type, count(DISTINCT (user_id, event_type, value)) AS n FROM events GROUP BY 1")
def t03(spark, p):
    """The whole delivery arrives twice; a content lands once."""
    source, path, checkpoint = (new_path(spark, w) for w in ("arrivals", "landed", "state"))
    e = table(spark, p, "events").select("user_id", "event_type", "value", "ts")
    e.write.parquet(source)
    e.write.mode("append").parquet(source)
    I.land_once(spark, source, "user_id long, event_type string, value double, ts timestamp", ["user_id", "event_type", "value"], "ts", path, checkpoint)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "t05_staleness",
    """WITH cal AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS d), h AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), s AS (SELECT user_id, min(d) AS first, max(d) AS last, count(*) AS held FROM h GROUP BY 1)
    SELECT user_id, date_diff('day', last, (SELECT max(d) FROM cal)) AS stale_days, (SELECT count(*) FROM cal WHERE d BETWEEN first AND last) - held AS gaps FROM s""",
)
def t05(spark, p):
    """Expected days are counted from the ends of what is held, so no calendar is joined to each source."""
    h = table(spark, p, "events").select("user_id", F.to_date("ts").alias("d")).distinct()
    s = h.groupBy("user_id").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("held"))
    end = F.broadcast(s.agg(F.max("last").alias("end")))  # one row
    return s.crossJoin(end).select("user_id", F.datediff("end", "last").cast("long").alias("stale_days"), (F.datediff("last", "first") + 1 - F.col("held")).alias("gaps"))


@register(
    "t06_publication_bracket",
    """WITH s AS (SELECT user_id, ts, event_id, max(CASE WHEN event_type = 'click' THEN ts::DATE END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events), f AS (SELECT *, lag(ts) OVER w AS before, lag(seen) OVER w AS seen_before FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, seen AS session, before AS last_without, ts AS first_with FROM f WHERE seen IS NOT NULL AND seen IS DISTINCT FROM seen_before""",
)
def t06(spark, p):
    """Every event is a poll; a session (the day of the newest click) is bracketed by the polls around its first sight."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, p, "events").withColumn("seen", F.max(F.when(F.col("event_type") == "click", F.to_date("ts"))).over(w))
    f = s.withColumn("before", F.lag("ts").over(w)).withColumn("seen_before", F.lag("seen").over(w)).where("seen IS NOT NULL AND NOT seen <=> seen_before")
    return f.select("user_id", F.col("seen").alias("session"), F.col("before").alias("last_without"), F.col("ts").alias("first_with"))


@register(
    "t08_sliding_participants",
    "WITH e AS (SELECT DISTINCT event_type, user_id, ts::DATE AS d FROM events), w AS (SELECT event_type, user_id, d - k AS start FROM e, (SELECT unnest(range(0, 21))::INT AS k)) SELECT event_type, start::DATE AS start, count(DISTINCT user_id) AS n FROM w GROUP BY ALL",
)
def t08(spark, p):
    """Windows of 21 days, one starting each day; distinct by two grouped steps."""
    e = table(spark, p, "events").select("event_type", "user_id", F.date_trunc("day", "ts").alias("day")).distinct()
    w = e.select("event_type", "user_id", F.window("day", "21 days", "1 day")["start"].alias("start")).distinct()
    return w.groupBy("event_type", F.to_date("start").alias("start")).agg(F.count(F.lit(1)).alias("n"))


_T10 = f"""WITH RECURSIVE {DEALS_SQL}, x AS (SELECT DISTINCT brand, d FROM deals WHERE side = 'BUY' AND qty >= 40),
kept(brand, d) AS (SELECT brand, min(d) FROM x GROUP BY 1 UNION ALL SELECT k.brand, n.d FROM kept k JOIN LATERAL (SELECT min(x.d) AS d FROM x WHERE x.brand = k.brand AND x.d >= k.d + 10) n ON n.d IS NOT NULL) SELECT brand, d FROM kept"""


@register("t10_stateful_decluster", _T10)
def t10(spark, p):
    """Sessions of a name kept at least 10 days apart, over three deliveries; the state is the last kept day."""
    source, path, checkpoint = (new_path(spark, w) for w in ("deliveries", "kept", "state"))
    day = deals(spark, p).where("side = 'BUY' AND qty >= 40").select("brand", F.unix_date("d").cast("long").alias("i"), "d").distinct()
    three_files(day, source)
    rows = spark.readStream.schema("brand string, i long, d date").option("maxFilesPerTrigger", 1).parquet(source)
    kept = I.last_kept(rows, "brand", "i", 10)
    kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("brand string, i long").parquet(path).select("brand", F.date_from_unix_date(F.col("i").cast("int")).alias("d"))


@register("x01_sql_functions", "SELECT regexp_replace(upper(trim(c_name)), '[^A-Z0-9]+', ' ', 'g') AS name, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' WHEN c_acctbal > 5000 THEN 'LARGE' ELSE 'OTHER' END AS role, count(*) AS n FROM customer GROUP BY ALL")
def x01(spark, p):
    """``norm`` and ``role`` in SQL: SQL functions that the optimizer inlines, so no Python runs."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm(s STRING) RETURNS STRING RETURN regexp_replace(upper(trim(s)), '[^A-Z0-9]+', ' ')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION role(b DOUBLE) RETURNS STRING RETURN CASE WHEN b < 0 THEN 'DEBTOR' WHEN b > 5000 THEN 'LARGE' ELSE 'OTHER' END")
    return spark.sql("SELECT norm(c_name) AS name, role(c_acctbal) AS role, count(*) AS n FROM {customer} GROUP BY ALL", customer=table(spark, p, "customer"))


@register("x02_registered_frames", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def x02(spark, p):
    """Frames that take part in SQL by name."""
    return spark.sql("SELECT n_name, count(*) AS n FROM {c} JOIN {n} ON n_nationkey = c_nationkey GROUP BY 1", c=table(spark, p, "customer"), n=table(spark, p, "nation"))


DRAWN = 200


@register(
    "x03_grouped_map",
    f"""{D}, mo AS (SELECT brand, x, row_number() OVER (PARTITION BY brand ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY brand) AS n FROM (SELECT brand, date_trunc('month', d) AS m, avg(price) AS x FROM deals GROUP BY ALL)),
    k AS (SELECT brand, draw, CAST('0x' || substr(md5(brand || '|' || draw || '|' || i), 1, 8) AS BIGINT) % n AS i FROM mo, (SELECT unnest(range(0, {DRAWN})) AS draw)), me AS (SELECT brand, draw, avg(x) AS mean FROM k JOIN mo USING (brand, i) GROUP BY ALL)
    SELECT brand, any_value(n) AS n, round(quantile_cont(me.mean, 0.025), 6) AS lo, round(any_value(own.mean), 6) AS mean, round(quantile_cont(me.mean, 0.975), 6) AS hi FROM me JOIN (SELECT brand, any_value(n) AS n, avg(x) AS mean FROM mo GROUP BY 1) own USING (brand) GROUP BY 1""",
)
def x03(spark, p):
    """Percentile interval of a bootstrapped mean per name, drawn by hashes; a group is the name's monthly means, never its deals."""
    monthly = deals(spark, p).groupBy("brand", F.trunc("d", "month").alias("m")).agg(F.avg("price").alias("x"))

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        import numpy as np

        x, brand = frame.sort_values("m")["x"].to_numpy(), frame["brand"].iloc[0]
        drawn = [[int(hashlib.md5(f"{brand}|{b}|{i}".encode()).hexdigest()[:8], 16) % len(x) for i in range(len(x))] for b in range(DRAWN)]
        lo, hi = np.quantile(x[np.array(drawn)].mean(1), [0.025, 0.975])
        return pd.DataFrame({"brand": [brand], "n": [len(x)], "lo": [lo], "mean": [x.mean()], "hi": [hi]})

    got = monthly.groupBy("brand").applyInPandas(interval, "brand string, n long, lo double, mean double, hi double")
    return got.select("brand", "n", *(r6(F.col(c)).alias(c) for c in ("lo", "mean", "hi")))


@register("x04_table_function", "SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) t, LATERAL (SELECT CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value)")
def x04(spark, p):
    """One document to many rows: a Python table function, called laterally."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="key string, value string")
    class JsonPairs:
        def eval(self, doc: str):
            import json

            for k, v in json.loads(doc or "{}").items():
                yield k, v if isinstance(v, str) else json.dumps(v)

    spark.udtf.register("json_pairs", JsonPairs)
    return spark.sql("SELECT event_id, j.key, j.value FROM {events}, LATERAL json_pairs(props) AS j", events=table(spark, p, "events"))


@register("x05_lineage", "WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 2), r AS (SELECT child, parent, 1 AS steps FROM e UNION SELECT r.child, e.parent, r.steps + 1 FROM r JOIN e ON e.child = r.parent), s AS (SELECT child, parent, min(steps) AS steps FROM r GROUP BY ALL) SELECT child, count(*) AS ancestors, min(parent) AS oldest, max(steps) AS depth FROM s GROUP BY 1")
def x05(spark, p):
    """Ancestors of every part in a graph of two parents each, full of diamonds: how many different ones, and the farthest by the shortest way."""
    part = table(spark, p, "part").select("p_partkey")
    e = part.where("p_partkey >= 3").selectExpr("p_partkey AS child", "p_partkey div 3 AS parent").unionByName(part.where("p_partkey >= 2").selectExpr("p_partkey AS child", "p_partkey div 2 AS parent"))
    return R.closure(e, "child", "parent").groupBy("child").agg(F.count(F.lit(1)).alias("ancestors"), F.min("ancestor").alias("oldest"), F.max("steps").alias("depth"))


_PANEL = f"""{D}, px AS (SELECT brand AS id, d, arg_max(price, (deal_key, deal_line, price, qty)) AS close, sum(value) AS turnover, sum(CASE WHEN side = 'BUY' THEN value ELSE 0 END) AS bought, sum(CASE WHEN side = 'SELL' THEN value ELSE 0 END) AS sold FROM deals GROUP BY ALL),
u AS (SELECT id, m, row_number() OVER (PARTITION BY m ORDER BY t DESC, id) <= 15 AS member FROM (SELECT id, date_trunc('month', d)::DATE AS m, sum(turnover) AS t FROM px GROUP BY ALL))"""


@register("g08_panel", f"{_PANEL} SELECT px.id, d, round(close, 6) AS close, coalesce(member, false) AS in_universe, round(bought, 2) AS bought, round(sold, 2) AS sold FROM px LEFT JOIN u ON u.id = px.id AND u.m = date_trunc('month', d)::DATE - INTERVAL 1 MONTH")
def g08(spark, p):
    """Long session by security panel; membership is last month's, so nothing later than the row is used."""
    x = deals(spark, p)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("value")).otherwise(0.0))
    px = x.groupBy(F.col("brand").alias("id"), "d").agg(F.max_by("price", F.struct("deal_key", "deal_line", "price", "qty")).alias("close"), F.sum("value").alias("turnover"), side("BUY").alias("bought"), side("SELL").alias("sold"))
    u = px.groupBy("id", F.trunc("d", "month").alias("m")).agg(F.sum("turnover").alias("t"))
    u = u.select("id", F.add_months("m", 1).alias("m"), (F.row_number().over(Window.partitionBy("m").orderBy(F.desc("t"), "id")) <= 15).alias("member"))
    return px.withColumn("m", F.trunc("d", "month")).join(u, ["id", "m"], "left").select("id", "d", r6(F.col("close")).alias("close"), F.coalesce("member", F.lit(False)).alias("in_universe"), F.round("bought", 2).alias("bought"), F.round("sold", 2).alias("sold"))
