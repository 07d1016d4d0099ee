"""File formats: each query writes its table in the format, to the shared folder, and reads it back as a source."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from sextant.core.shared import new_path
from sextant.core.tables import DEALS_SQL, deals, table
from sextant.operators import rows as R
from sextant.plans.catalog import register
from sextant.sources import files as S


@register("s02_csv_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s02(spark, p):
    path = new_path(spark, "csv")
    table(spark, p, "orders").write.option("header", True).csv(path)
    return S.csv_text(spark, path, {"o_orderkey": "long", "o_custkey": "long", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"})


JSON_ROWS = 10_000


@register("s04_json_arrays", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def s04(spark, p):
    """Gzip files of ten thousand events at most, those of every second user in files with an envelope; a run of rows is written as it lies, so
    the files are as many as the rows ask for, whatever the users and ids are."""
    path = new_path(spark, "json")
    events = table(spark, p, "events").select("event_id", "user_id", "event_type", "value")
    keyed = events.withColumns({"run": F.floor(F.monotonically_increasing_id() / JSON_ROWS), "wrapped": F.coalesce(F.col("user_id") % 2 == 0, F.lit(False))})
    files = keyed.groupBy("run", "wrapped").agg(F.to_json(F.collect_list(F.struct("event_id", "user_id", "event_type", "value"))).alias("rows"))
    text = F.when(F.col("wrapped"), F.concat(F.lit('{"data": '), F.col("rows"), F.lit("}"))).otherwise(F.col("rows"))
    files.select("run", "wrapped", text.alias("value")).write.partitionBy("run", "wrapped").option("compression", "gzip").text(path)
    record = StructType().add("event_id", LongType()).add("user_id", LongType()).add("event_type", StringType()).add("value", DoubleType())
    got = S.json_arrays(spark, path, record)
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


@register(
    "s06_report_files",
    "WITH k AS (SELECT o_orderkey, o_orderkey % 3 AS kind, o_orderkey // 2000 AS part FROM orders) SELECT CASE kind WHEN 2 THEN 'PARSE_FAILED' ELSE 'OK' END AS status, count(DISTINCT (kind, part))::BIGINT AS files, count(CASE WHEN kind < 2 THEN 1 END) AS n, sum(CASE WHEN kind < 2 THEN o_orderkey END)::BIGINT AS keys FROM k GROUP BY 1",
)
def s06(spark, p):
    """Three spellings of a header, one of them without the key column; a file has 2,000 keys' rows at most."""
    path = new_path(spark, "reports")
    header = F.when(F.col("kind") == 0, "Order Key,Name").when(F.col("kind") == 1, "name, KEY ").otherwise("label,title")
    line = F.when(F.col("kind") == 1, F.concat_ws(",", "o_orderstatus", "o_orderkey")).otherwise(F.concat_ws(",", "o_orderkey", "o_orderstatus"))
    k = table(spark, p, "orders").withColumns({"kind": F.col("o_orderkey") % 3, "part": F.floor(F.col("o_orderkey") / 2000)})
    k.groupBy("kind", "part").agg(F.concat(header, F.lit("\n"), F.concat_ws("\n", F.collect_list(line))).alias("value")).write.partitionBy("kind", "part").text(path)
    status, rows = S.report_files(spark, f"{path}/*/*", {"key": ["order key", "key"], "name": ["name"]}, ["key", "name"])
    counted = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").try_cast("long")).alias("keys"))
    return status.join(counted, "file", "left").groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("keys").alias("keys"))


CODES = {"A": "FUTURE", "N": "OPTION_CALL", "R": "OPTION_PUT"}
_S07 = f"""WITH {DEALS_SQL}, t AS (SELECT CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())} END AS instrument, brand, d, CASE WHEN kind <> 'A' AND qty >= 2 THEN qty END AS strike, value / 100000 AS lakh, price FROM deals),
g AS (SELECT *, CASE WHEN instrument IS NULL THEN 'UNKNOWN_CODE' WHEN instrument LIKE 'OPTION%' AND strike IS NULL THEN 'OPTION_WITHOUT_STRIKE' WHEN price <= 0 THEN 'BAD_PRICE' END AS reason, count(*) OVER (PARTITION BY instrument, brand, d, strike) > 1 AS dup FROM t)
SELECT instrument, coalesce(reason, CASE WHEN dup THEN 'DUPLICATE_KEY' ELSE 'OK' END) AS state, count(*) AS n, round(sum(lakh), 4) AS lakh FROM g GROUP BY ALL"""


@register("s07_contract_rows", _S07)
def s07(spark, p):
    """Typed contract rows; what breaks a guard is kept with its reason."""
    codes = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    x = deals(spark, p)
    t = x.select(codes[F.col("kind")].alias("instrument"), "brand", "d", F.when((F.col("kind") != "A") & (F.col("qty") >= 2), F.col("qty")).alias("strike"), (F.col("value") / 100000).alias("lakh"), "price")
    keys = ["instrument", "brand", "d", "strike"]
    reason = R.ladder([("UNKNOWN_CODE", F.col("instrument").isNull()), ("OPTION_WITHOUT_STRIKE", F.col("instrument").startswith("OPTION") & F.col("strike").isNull()), ("BAD_PRICE", F.col("price") <= 0)])
    g = t.withColumn("reason", reason).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("lakh").alias("lakh"))
    state = F.coalesce("reason", F.when(F.sum("n").over(R.Window.partitionBy(*keys)) > 1, "DUPLICATE_KEY").otherwise("OK"))
    return g.select("instrument", state.alias("state"), "n", "lakh").groupBy("instrument", "state").agg(F.sum("n").alias("n"), F.round(F.sum("lakh"), 4).alias("lakh"))


@register("s09_typed_records", "SELECT DISTINCT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS quantity FROM lineitem WHERE l_returnflag = 'R'")
def s09(spark, p):
    path = new_path(spark, "records")
    kind = F.when(F.col("l_returnflag") == "R", "20").otherwise("10")
    table(spark, p, "lineitem").select(F.concat_ws(",", kind, "l_orderkey", "l_linenumber", "l_quantity").alias("value")).write.text(path)
    return S.records(spark, path, "20", {"order_key": (1, "long"), "line": (2, "int"), "quantity": (3, "double")})


@register("s11_tagged_facts", "SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS context, o_orderstatus AS status, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total, CAST(count(*) OVER (PARTITION BY o_custkey) AS VARCHAR) AS orders FROM orders")
def s11(spark, p):
    """A document per customer: a header fact and two facts per order, pivoted back by context."""
    fact = lambda n, context, v: F.concat(F.lit(f'<{n} contextRef="'), context, F.lit('">'), v, F.lit(f"</{n}>"))
    o = table(spark, p, "orders").withColumn("c", F.col("o_orderkey").cast("string"))
    own = F.concat(fact("status", F.col("c"), F.col("o_orderstatus")), fact("total", F.col("c"), F.floor("o_totalprice").cast("long").cast("string")))
    docs = o.groupBy("o_custkey").agg(F.concat(fact("orders", F.lit("doc"), F.count(F.lit(1)).cast("string")), F.concat_ws("", F.collect_list(own))).alias("doc"))
    return S.tagged_facts(docs, "o_custkey", "doc", ["status", "total"], ["orders"])


@register("s16_replace_partitioned", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def s16(spark, p):
    """Writes the set, replaces it by a smaller one, and reads what stands there."""
    path, orders = new_path(spark, "set"), table(spark, p, "orders")
    S.replace_partitioned(orders, path, ["o_orderstatus"])
    S.replace_partitioned(S.read_replaced(spark, path, orders.schema).where("o_orderpriority <> '1-URGENT'"), path, ["o_orderstatus"])
    return S.read_replaced(spark, path, orders.schema).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("s17_newest_sorted_table", "SELECT user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def s17(spark, p):
    path = new_path(spark, "newest")
    e = table(spark, p, "events").select("user_id", "event_type", "ts", "value", "event_id")
    S.newest_first_once(e, ["user_id", "event_type"], F.struct("ts", "event_id").desc(), ["user_id", "event_type"]).drop("event_id").write.parquet(path)
    return spark.read.parquet(path)
