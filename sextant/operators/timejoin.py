"""As-of and validity-interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, how: str = "left", direction: str = "backward", strict: bool = False, spread: bool = False) -> DataFrame:
    """Each left row with the nearest right row of its key at or before its time (``forward``: at or after).

    Both sides are united and sorted once per key; the right row is carried along.  No range condition is joined, so
    rows are never multiplied, and a wide gap costs nothing.  ``strict`` excludes equal times.  Right rows should be
    unique per (keys, time).  Left columns keep their names; right columns other than keys come as they are.

    A key's rows are one task's, unless ``spread``: then rows are dealt by ranges of (keys, time), a range carries its own rows along, and the
    last right row of the ranges before comes from a table of two rows a range at most (a border splits one key).
    """
    carried = [c for c in right.columns if c not in keys]
    lead = direction == "forward"
    a = left.select(*keys, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*carried).alias("r")).schema["r"].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_l"), F.struct(*carried).alias("_r"), F.lit(0).alias("_side"))
    b = b.withColumn("_side", F.lit((0 if strict else 2) if lead else (2 if strict else 0)))
    both, part = a.unionByName(b), []
    if spread:
        from sextant.core.shared import materialise

        order = [*keys, "_t", "_side"]
        ranged = both.repartitionByRange(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
        both, part = materialise(ranged, "ranged"), ["_part"]
    if lead:
        over = Window.partitionBy(*part, *keys).orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
        pick = F.first("_r", ignorenulls=True).over(over)
    else:
        over = Window.partitionBy(*part, *keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        pick = F.last("_r", ignorenulls=True).over(over)
    out = both.withColumn("_got", pick).where("_side = 1")
    if spread:
        ends = both.groupBy(F.struct(*keys).alias("_end_key"), F.col("_part").alias("_end_part")).agg((F.min_by if lead else F.max_by)("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_side"))).alias("_end"), F.count(F.lit(1)).alias("_n"))
        several = ends.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy("_end_key"))).where("_parts > 1")  # keys that a border splits
        along = Window.partitionBy("_end_key").orderBy(F.desc("_end_part") if lead else "_end_part").rowsBetween(Window.unboundedPreceding, -1)
        carried_over = several.select("_end_key", "_end_part", F.last("_end", ignorenulls=True).over(along).alias("_carried"))
        out = out.join(F.broadcast(carried_over), (F.col("_part") == F.col("_end_part")) & F.struct(*keys).eqNullSafe(F.col("_end_key")), "left").withColumn("_got", F.coalesce("_got", "_carried"))
    if how == "inner":
        out = out.where("_got IS NOT NULL")
    return out.select("_l.*", *(F.col("_got")[c].alias(c) for c in carried))


def interval_join(left: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to", closed: bool = False, how: str = "left", disjoint: bool = False) -> DataFrame:
    """Rows with the spans of their key that hold at their time; a null end is open.  Half-open unless ``closed``.

    Where a key's spans are ``disjoint`` (validity histories), the last one started is the only one that can hold, so it is
    carried along one sort and rows are never paired with the other spans of their key.
    """
    if disjoint:
        got = asof_join(left.withColumn("_at", F.col(at)), spans.withColumn("_from", F.col(start)), keys, "_at", "_from")
        inside = F.col("_from").isNotNull() & (F.col(end).isNull() | ((F.col("_at") <= F.col(end)) if closed else (F.col("_at") < F.col(end))))
        carried = [c for c in spans.columns if c not in keys]
        out = got.select(*left.columns, *(F.when(inside, F.col(c)).alias(c) for c in carried), inside.alias("_inside"))
        return (out.where("_inside") if how == "inner" else out).drop("_inside")
    right = spans.select(*(F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in spans.columns))
    on = [F.col(c) == F.col(f"_k_{c}") for c in keys]
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    condition = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | upper)
    for c in on:
        condition = condition & c
    return left.join(right, condition, how).drop(*(f"_k_{c}" for c in keys))


def islands(rows: DataFrame, keys: list[str], order: str, label: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Consecutive rows with an equal label as validity intervals; each ends where the next begins, the last is open."""
    over = Window.partitionBy(*keys).orderBy(order)
    changed = rows.withColumn("_new", F.when(F.col(label).eqNullSafe(F.lag(label).over(over)) & (F.row_number().over(over) > 1), 0).otherwise(1))
    numbered = changed.withColumn("_island", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(*keys, "_island").agg(F.first(label).alias(label), F.min(order).alias(start), F.count(F.lit(1)).alias("n_rows"))
    return grouped.withColumn(end, F.lead(start).over(Window.partitionBy(*keys).orderBy(start))).drop("_island")


def merge_overlaps(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of overlapping or touching closed intervals per key."""
    over = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(over.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    numbered = new.withColumn("_island", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_spans")).drop("_island")


def nearest_span(rows: DataFrame, spans: DataFrame, keys: list[str], row_id: list[str], at: str, span_id: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Point-in-time resolution: the covering span, else the nearest by days, ties by id.  Ends belong to their span.

    ``confidence`` is HIGH for one covering span, LOW for several, MEDIUM for the nearest of a known key, UNRESOLVED for an
    unknown key (or a row without a time).

    Starts, rows and ends are sorted together once per key.  Running counts of starts and ends tell how many spans cover a row;
    the one of latest end among those started is the covering one if there is one, and the last end before and the first start
    after are the nearest if there is none.  Only rows that several spans cover are paired with spans.
    """
    known = spans.where(F.col(start).isNotNull()).select(*keys, F.col(span_id).alias("_i"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    starts = known.groupBy(*keys, F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_opened"), F.min("_i").alias("_start_id"), F.max(F.struct(F.col("_e").isNull().alias("open"), F.col("_e").alias("e"), F.col("_i").alias("i"))).alias("_top")).withColumn("_side", F.lit(0))
    ends = known.where("_e IS NOT NULL").groupBy(*keys, F.col("_e").alias("_t")).agg(F.count(F.lit(1)).alias("_closed"), F.min("_i").alias("_end_id")).withColumn("_side", F.lit(2))
    asked = rows.select(*keys, F.col(at).alias("_t"), F.struct(*rows.columns).alias("_row"), F.lit(1).alias("_side"))
    every = asked.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    upto, on, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*keys)
    last_end = F.last(F.when(F.col("_side") == 2, F.struct(F.col("_t").alias("t"), F.col("_end_id").alias("i"))), ignorenulls=True)
    next_start = F.first(F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_start_id").alias("i"))), ignorenulls=True)
    seen = every.withColumns({
        "n_valid": F.coalesce(F.sum("_opened").over(upto), F.lit(0)) - F.coalesce(F.sum("_closed").over(upto), F.lit(0)),
        "_covering": F.max("_top").over(upto)["i"], "_before": last_end.over(upto), "_after": next_start.over(on), "_known": F.count("_opened").over(whole) > 0,
    }).where("_side = 1")
    back, ahead = F.datediff("_t", F.col("_before.t")), F.datediff(F.col("_after.t"), "_t")
    nearest = F.least(F.struct(F.coalesce(back, F.lit(2**31 - 1)).alias("gap"), F.col("_before.i").alias("i")), F.struct(F.coalesce(ahead, F.lit(2**31 - 1)).alias("gap"), F.col("_after.i").alias("i")))
    timed = F.col("_t").isNotNull() & F.col("_known")
    one = seen.where(~timed | (F.col("n_valid") <= 1)).select(
        "_row", F.when(timed, F.when(F.col("n_valid") == 1, F.col("_covering")).otherwise(nearest["i"])).alias(span_id), F.when(timed, F.when(F.col("n_valid") == 1, 0).otherwise(nearest["gap"])).alias("gap_days"),
        F.when(~timed, "UNRESOLVED").when(F.col("n_valid") == 1, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )
    several = seen.where(timed & (F.col("n_valid") > 1)).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_t", "_row").withColumn("_n", F.monotonically_increasing_id())
    on_key = [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in keys]
    held = several.join(known, [*on_key, F.col("_t") >= F.col("_s"), F.col("_e").isNull() | (F.col("_t") <= F.col("_e"))])
    many = held.groupBy("_n").agg(F.first("_row").alias("_row"), F.min("_i").alias(span_id)).select("_row", span_id, F.lit(0).alias("gap_days"), F.lit("LOW").alias("confidence"))
    return one.unionByName(many).select("_row.*", span_id, "gap_days", "confidence")
