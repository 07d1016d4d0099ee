"""The flagship slice: what buys return against the market, by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.core.tables import DEALS_SQL, bars, bars_sql, deals
from sextant.operators.rows import forward_return
from sextant.plans.catalog import register

FWD_SQL = """f AS (SELECT id, d, CASE WHEN date_diff('day', d, lead(d, 5) OVER w) <= 20 THEN lead(close, 5) OVER w / lead(open, 1) OVER w - 1 END AS fwd FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)),
market AS (SELECT d, avg(fwd) AS market FROM f WHERE fwd IS NOT NULL GROUP BY 1)"""


@register(
    "d00_monthly_abnormal_return",
    f"""WITH {DEALS_SQL}, {bars_sql()}, {FWD_SQL},
    e AS (SELECT DISTINCT brand AS id, d FROM deals WHERE side = 'BUY' AND qty >= 40)
    SELECT date_trunc('month', d)::DATE AS month, count(*) AS n_events, round(avg(fwd - market), 6) AS abnormal
    FROM e JOIN f USING (id, d) JOIN market USING (d) WHERE fwd IS NOT NULL GROUP BY 1""",
)
def monthly_abnormal_return(spark: SparkSession, p: str) -> DataFrame:
    """Large buys, entered at the next session's open and left five rows on, less the market's mean of the day, averaged
    within each month (W03, A27, J30, A14)."""
    x = deals(spark, p)
    f = forward_return(bars(x), 5, 20).where("fwd IS NOT NULL").select("id", "d", "fwd").withColumn("market", F.avg("fwd").over(Window.partitionBy("d")))
    events = x.where("side = 'BUY' AND qty >= 40").select(F.col("brand").alias("id"), "d").distinct()
    joined = events.join(f, ["id", "d"])
    return joined.groupBy(F.trunc("d", "month").alias("month")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg(F.col("fwd") - F.col("market")), 6).alias("abnormal"))
