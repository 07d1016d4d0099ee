"""Row numbers, ranks, tiles and running extremes over a whole table, without a task that sees all rows.

Rows are dealt by ranges of the order and sorted where they lie; a row's number is its place in its range plus the rows of the ranges
before, which is one row a range to add up.  The ranges are written to the shared folder first, since sampled borders could fall
elsewhere if a lost range were dealt again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise

#: monotonically_increasing_id: the range above, the place within it below.
_PLACE = 33


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None, to: str = "rn", total: str | None = None) -> DataFrame:
    """Adds ``to``, the row's number from 1 in ``order`` (within its ``by`` keys), and ``total``, how many rows the keys have.

    The order should be total: rows that tie in it are numbered in any order, and stay in one range.  Null keys are a group.
    """
    by = by or []
    spark = df.sparkSession
    keys = [*(F.col(c) for c in by), *order]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", _PLACE).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    out = ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_at") % (1 << _PLACE) + 1).drop("_before", "_at")
    if by:
        first = out.groupBy(*(F.col(c).alias(f"_k_{c}") for c in by)).agg((F.min(to) - 1).alias("_first"), F.count(F.lit(1)).alias("_total"))
        on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
        out = out.join(first, on).withColumn(to, F.col(to) - F.col("_first")).drop("_first", *(f"_k_{c}" for c in by))
    elif total:
        out = out.join(F.broadcast(out.agg(F.count(F.lit(1)).alias("_total"))), F.lit(True))  # one row
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_total", "_part")


def tile(number: str, total: str, n: int) -> Column:
    """ntile(n) from a row's number: the first tiles have a row more than the last."""
    size, longer = F.floor(F.col(total) / n), F.col(total) % n
    inside = longer * (size + 1)
    late = longer + F.floor((F.col(number) - 1 - inside) / F.greatest(size, F.lit(1))) + 1
    return F.when(F.col(number) <= inside, F.floor((F.col(number) - 1) / (size + 1)) + 1).otherwise(late).cast("int")


def quantiles(df: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row with a column per quantile of ``at``, interpolated between the two values around it; nulls have no place, NaN is the greatest.

    Different values are counted and dealt by ranges; only the ranges that hold a wanted place are run through, so no task holds all values
    and a frequent value is one row.
    """
    spark = df.sparkSession
    counts = df.select(F.col(value).alias("_x")).where("_x IS NOT NULL").groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    ranged = materialise(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_x").withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.sum("_n").alias("_size"))
    upto, every = F.sum("_size").over(Window.orderBy("_part")), F.sum("_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row a range
    wanted = F.array(*(F.struct(F.lit(c).alias("to"), F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for c, q in at.items() for i in (0, 1)))
    parts = sizes.select("_part", "_size", (upto - F.col("_size")).alias("_before"), every.alias("_all")).select("*", F.explode(wanted).alias("w")).select("_part", "_size", "_before", ((F.col("_all") - 1) * F.col("w.q")).alias("_at"), "w.to", "w.i", "_all")
    places = parts.withColumn("_place", F.least(F.floor("_at") + F.col("i"), F.col("_all") - 1)).where("_place >= _before AND _place < _before + _size")
    own = Window.partitionBy("to", "i").orderBy("_x")
    found = ranged.join(F.broadcast(places), "_part").withColumn("_upto", F.col("_before") + F.sum("_n").over(own)).where("_place < _upto AND _place >= _upto - _n")
    value_of = lambda c, i: F.max(F.when((F.col("to") == c) & (F.col("i") == i), F.col("_x")))
    share = lambda c: F.max(F.when(F.col("to") == c, F.col("_at") - F.floor("_at")))
    # equal ends are the quantile themselves: infinities have no difference
    return found.agg(*(F.when((share(c) == 0) | (value_of(c, 0) == value_of(c, 1)), value_of(c, 0)).otherwise(value_of(c, 0) + (value_of(c, 1) - value_of(c, 0)) * share(c)).alias(c) for c in at))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, to: str = "rank") -> DataFrame:
    """Adds the rank of ``value`` with ties averaged, within ``by``; equal values may lie in several ranges."""
    by = by or []
    n = numbered(df, [F.col(value)], by, "_rn")
    tied = n.groupBy(*(F.col(c).alias(f"_t_{c}") for c in (*by, value))).agg(((F.min("_rn") + F.max("_rn")) / 2).alias(to))
    return n.drop("_rn").join(tied, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in (*by, value)]).drop(*(f"_t_{c}" for c in (*by, value)))


def running(df: DataFrame, number: str, value: str, how: str, to: str, span: int = 65_536) -> DataFrame:
    """Adds the running ``min``, ``max`` or ``sum`` of ``value`` along a row number, over blocks of ``span`` numbers and the blocks before.

    ``df`` is read twice; pass a written table.
    """
    fold = getattr(F, how)
    block = F.floor((F.col(number) - 1) / span)
    totals = df.groupBy(block.alias("_block")).agg(fold(value).alias("_all"))
    # a row a block; and blocks of blocks are few enough for one task up to span ** 2 rows
    before = totals.select("_block", fold("_all").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = fold(value).over(Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    inside = df.withColumn("_block", block).withColumn("_own", own).join(before, "_block")
    if how == "sum":
        total = F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))
        both = F.when(F.col("_own").isNotNull() | F.col("_before").isNotNull(), total)
    else:
        both = (F.least if how == "min" else F.greatest)("_own", "_before")
    return inside.withColumn(to, both).drop("_block", "_own", "_before")
