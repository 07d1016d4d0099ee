"""Typed views over the source tables, and the same definitions as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.core.shared import materialise, release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deal_tables(sf_dir: str) -> list[str]:
    """The files that ``deals`` reads."""
    return [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")]


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosed deals: participant, security (supplier), brand, side, kind, date, quantity, price, value."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("o_custkey").alias("participant"),
            F.col("l_suppkey").alias("security"),
            F.col("p_brand").alias("brand"),
            F.when(F.col("l_linestatus") == "F", "BUY").otherwise("SELL").alias("side"),
            F.col("l_returnflag").alias("kind"),
            F.to_date("l_shipdate").alias("d"),
            F.col("l_quantity").alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_orderkey").alias("deal_key"),
            F.col("l_linenumber").alias("deal_line"),
        )
    )


def written_deals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of ``deals``, written once and in two steps: the rows lie on disk in one step's shuffle at a time, not in both, and plans that
    read deals again do not join them again."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    x = line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("security"), F.col("p_brand").alias("brand"), F.when(F.col("l_linestatus") == "F", "BUY").otherwise("SELL").alias("side"), F.col("l_returnflag").alias("kind"), F.to_date("l_shipdate").alias("d"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("value"), F.col("l_orderkey").alias("deal_key"), F.col("l_linenumber").alias("deal_line"),
    )
    needed = [c for c in x.columns if c in columns or c == "deal_key" or c in ("qty", "value") and "price" in columns]
    named = materialise(x.select(*needed), "named")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_key"), F.col("o_custkey").alias("participant"))
    full = named.join(orders, "deal_key")
    out = materialise((full.withColumn("price", F.col("value") / F.col("qty")) if "price" in columns else full).select(*columns), "deals")
    release(named)
    return out


def bars(deal_rows: DataFrame, key: str = "brand") -> DataFrame:
    """Daily bars: open and close are the prices of the first and last deal in a total order of the rows."""
    order = F.struct("deal_key", "deal_line", "price", "qty")
    return deal_rows.groupBy(F.col(key).alias("id"), "d").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("value").alias("turnover"),
    )


def calendar(rows: DataFrame, day: str = "d") -> DataFrame:
    """Observed sessions: d, i (from 0), next_d.  The numbering runs over distinct dates only, so one task is enough."""
    from pyspark.sql import Window

    dates = rows.select(F.col(day).alias("d")).where("d IS NOT NULL").distinct()
    order = Window.orderBy("d")
    return dates.select("d", (F.row_number().over(order) - 1).alias("i"), F.lead("d").over(order).alias("next_d"))


DEALS_SQL = """deals AS (
  SELECT o_custkey AS participant, l_suppkey AS security, p_brand AS brand, CASE WHEN l_linestatus = 'F' THEN 'BUY' ELSE 'SELL' END AS side,
    l_returnflag AS kind, CAST(l_shipdate AS DATE) AS d, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice AS value,
    l_orderkey AS deal_key, l_linenumber AS deal_line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def bars_sql(key: str = "brand") -> str:
    return f"""bars AS (
  SELECT {key} AS id, d, arg_min(price, (deal_key, deal_line, price, qty)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (deal_key, deal_line, price, qty)) AS close, sum(qty) AS volume, sum(value) AS turnover
  FROM deals GROUP BY ALL)"""


CALENDAR_SQL = "cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, lead(d) OVER (ORDER BY d) AS next_d FROM (SELECT DISTINCT d FROM deals))"
