"""Row-level building blocks: first per key, ladders, average ranks, session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes groups before the shuffle's sort is complete."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def ladder(rules: list[tuple[str, Column]]) -> Column:
    """First reason whose condition holds, else null: nothing is dropped, every row says why."""
    out = None
    for reason, condition in rules:
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties averaged, within ``by``."""
    over = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(over) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def forward_return(df: DataFrame, h: int, max_span_days: int, key: str = "id", day: str = "d") -> DataFrame:
    """Adds ``fwd``: enter at the next row's open, leave at the close ``h`` rows on; null over a halt."""
    over = Window.partitionBy(key).orderBy(day)
    entry, leave, last = F.lead("open", 1).over(over), F.lead("close", h).over(over), F.lead(day, h).over(over)
    return df.withColumn("fwd", F.when(F.datediff(last, F.col(day)) <= max_span_days, leave / entry - 1))


def leave_one_out(df: DataFrame, cell: list[str], value: str, to: str = "peer_mean") -> DataFrame:
    """Mean of the cell's other rows; null in a cell of one."""
    over = Window.partitionBy(*cell)
    n, total = F.count(value).over(over), F.sum(value).over(over)
    return df.withColumn("peer_n", n - 1).withColumn(to, F.when(n > 1, (total - F.col(value)) / (n - 1)))


def match_ladder(events: DataFrame, cells: list[tuple[str, DataFrame, list[str]]], floor: int) -> DataFrame:
    """First of successively coarser cells with at least ``floor`` members; ``level`` names it.

    ``cells``: (level, DataFrame with the keys, n and mean, keys).
    """
    out = events
    for level, cell, keys in cells:
        out = out.join(cell.select(*keys, F.col("n").alias(f"_n_{level}"), F.col("mean").alias(f"_m_{level}")), keys, "left")
    level, mean = None, None
    for name, _, _ in cells:
        ok = F.col(f"_n_{name}") >= floor
        level = F.when(ok, name) if level is None else level.when(ok, name)
        mean = F.when(ok, F.col(f"_m_{name}")) if mean is None else mean.when(ok, F.col(f"_m_{name}"))
    return out.withColumn("level", level).withColumn("matched", mean).drop(*(f"_{x}_{n}" for n, _, _ in cells for x in "nm"))


def decluster(df: DataFrame, keys: list[str], index: str, gap: int, columns: list[str], spread: bool = False) -> DataFrame:
    """Greedy: keep a row only if it is at least ``gap`` after the last row kept; rows of one index stay together.

    Whether an index stays depends on the one kept before.  The decision runs over the different indices of a key alone, which stream
    through one task in order; where the index counts sessions they are a calendar at most, however many rows a key has.  ``spread``: for
    indices without such a bound the decision is made by pointers (``orbit``), so that a hot key's indices lie in many tasks.  Null
    keys form a key of their own, rows with a null index are dropped.
    """
    rows = df.select(*columns).where(F.col(index).isNotNull()).distinct()
    at = rows.select(*keys, index).distinct()
    if spread:
        kept = orbit(at, keys, index, gap)
    else:
        ordered = at.repartition(*keys).sortWithinPartitions(*keys, index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_key, last = None, None
            for batch in batches:
                stay = []
                for *key, i in zip(*(batch.column(c).to_pylist() for c in (*keys, index)), strict=True):
                    first = key != open_key
                    if first or i - last >= gap:
                        open_key, last = key, i
                    stay.append(first or i == last)
                yield batch.filter(pa.array(stay, pa.bool_()))

        kept = ordered.mapInArrow(run, ordered.schema)
    if {*columns} == {*keys, index}:
        return kept.select(*columns)
    named = kept.select(*(F.col(c).alias(f"_k_{c}") for c in (*keys, index)))
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, index)], "left_semi")


def orbit(at: DataFrame, keys: list[str], index: str, gap: int) -> DataFrame:
    """keys, index of what greedy de-clustering keeps, by pointer doubling.

    Every index points to the first one at least ``gap`` later (an as-of join that splits hot keys); pointers are joined to themselves level by
    level, and from the first index of each key the levels are walked back, doubling what is reached.  A step is a join of rows, so
    a key's indices lie in as many tasks as there are.
    """
    from sextant.core.shared import materialise
    from sextant.operators.timejoin import asof_join

    id_of = F.struct(*keys)
    points = at.select(id_of.alias("_k"), F.col(index).alias("_i"))
    ahead = asof_join(points.select("_k", "_i", (F.col("_i") + gap).alias("_want")), points.withColumnRenamed("_i", "_to"), ["_k"], "_want", "_to", direction="forward", spread=True)
    jumps = [materialise(ahead.where("_to IS NOT NULL").select("_k", "_i", "_to"), "jumps")]
    while not jumps[-1].isEmpty():
        a, b = jumps[-1], jumps[-1].select(F.col("_k").alias("_k2"), F.col("_i").alias("_at"), F.col("_to").alias("_end"))
        jumps.append(materialise(a.join(b, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_to") == F.col("_at"))).select("_k", "_i", F.col("_end").alias("_to")), "jumps"))
    reached = points.groupBy("_k").agg(F.min("_i").alias("_i"))
    for level in reversed(jumps[:-1]):
        step = reached.select(F.col("_k").alias("_k2"), F.col("_i").alias("_at"))
        further = level.join(step, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_i") == F.col("_at"))).select("_k", F.col("_to").alias("_i"))
        reached = materialise(reached.unionByName(further), "reached")
    return reached.select(*(F.col("_k")[c].alias(c) for c in keys), F.col("_i").alias(index))


def trailing_distinct(df: DataFrame, keys: list[str], index: str, who: str, span: int) -> DataFrame:
    """keys, index, n: how many different ``who`` the last ``span`` indices hold, for every index with a row.

    A row counts from its index up to ``span`` on or to the next row of the same ``who``, so the distinct count is a running
    sum of steps folded to one row an index, and no set is ever held.
    """
    b = df.select(*keys, who, index).distinct()
    following = F.lead(index).over(Window.partitionBy(*keys, who).orderBy(index))
    steps = F.array(F.struct(F.col(index).alias("at"), F.lit(1).alias("step"), F.lit(1).alias("rows")), F.struct(F.least(F.col(index) + span, following).alias("at"), F.lit(-1).alias("step"), F.lit(0).alias("rows")))
    day = b.select(*keys, steps.alias("steps")).select(*keys, F.inline("steps")).groupBy(*keys, "at").agg(F.sum("step").alias("step"), F.sum("rows").alias("rows"))
    return day.withColumn("n", F.sum("step").over(Window.partitionBy(*keys).orderBy("at"))).where("rows > 0").select(*keys, F.col("at").alias(index), "n")


def transitive_roots(edges: DataFrame, child: str, parent: str, rounds: int = 32) -> DataFrame:
    """child -> root by path doubling, up to chains of 2**rounds; members of cycles get a null root."""
    from sextant.core.shared import materialise

    now = edges.select(F.col(child).alias("c"), F.col(parent).alias("p"), F.lit(False).alias("cyclic"))
    for _ in range(rounds):
        a, b = now.alias("a"), now.alias("b")
        step = a.join(b, F.col("a.p") == F.col("b.c"), "left").select(
            F.col("a.c").alias("c"), F.coalesce("b.p", "a.p").alias("p"), (F.col("a.cyclic") | (F.coalesce("b.p", "a.p") == F.col("a.c"))).alias("cyclic"), (F.col("b.p").isNotNull() & ~F.col("a.cyclic")).alias("moved")
        )
        step = materialise(step, "roots")
        now = step.select("c", F.when(F.col("cyclic"), F.col("c")).otherwise(F.col("p")).alias("p"), "cyclic")
        if step.where("moved AND NOT cyclic").isEmpty():
            break
    else:
        raise RuntimeError(f"chains longer than 2 ** {rounds}")
    return now.select(F.col("c").alias(child), F.when(~F.col("cyclic"), F.col("p")).alias("root"))


def same_tokens(df: DataFrame, name: str) -> DataFrame:
    """a, b: pairs a < b of different names that hold the same tokens, each as often."""
    n = df.select(F.col(name).alias("name")).distinct().withColumn("tokens", F.array_sort(F.split("name", " ")))
    a, b = n.select("tokens", F.col("name").alias("a")), n.select("tokens", F.col("name").alias("b"))
    return a.join(b, "tokens").where("a < b").select("a", "b")


def ewm(value: str, number: str, half_life: float, keys: list[str], span: int = 4096) -> Column:
    """Exponentially weighted mean of ``value`` over the rows up to this one, by half-life in rows; ``number`` counts a key's rows.

    Weights are 2 ** (place / half_life) of the place in a stretch of ``span`` rows, so they never overflow: a row's sums are its own stretch's
    and those of the stretch before, decayed to it.  What is older has a share of 2 ** (-span / half_life) at most.  A null value has no weight.
    """
    place, stretch = F.col(number) % span, F.floor(F.col(number) / span)
    weight = F.when(F.col(value).isNotNull(), F.pow(F.lit(2.0), place / half_life))
    own = Window.partitionBy(*keys, stretch).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy(stretch).rangeBetween(-1, -1)  # every row of the stretch before
    fade = 2.0 ** (-span / half_life)

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x).over(own), F.lit(0.0)) + F.coalesce(F.sum(x).over(whole), F.lit(0.0)) * fade

    return F.try_divide(total(F.col(value) * weight), total(weight))


def within_two_edits(df: DataFrame, name: str) -> DataFrame:
    """a, b, distance: pairs a < b of different names at most two edits apart.

    Two such names give the same string when at most two letters are taken from each, so all strings that a name gives are its join keys (as
    hashes; 1 + n + n (n - 1) / 2 for n letters) and the distance decides.  No block of alike beginnings is paired.
    """
    n = df.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = F.when(F.length("name") > 0, less(F.col("name"))).otherwise(F.array())
    keyed = n.withColumn("one", F.array_distinct(one)).withColumn("two", F.flatten(F.transform("one", lambda x: F.when(F.length(x) > 0, less(x)).otherwise(F.array()))))
    keys = keyed.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), "one", "two"))).alias("key")).select("name", F.xxhash64("key").alias("key"))
    a, b = keys.select("key", F.col("name").alias("a")), keys.select("key", F.col("name").alias("b"))
    met = a.join(b, "key").where("a < b").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", 2)).where("distance >= 0")


def closure(edges: DataFrame, child: str, parent: str, rounds: int = 1_000) -> DataFrame:
    """child, ancestor, steps: every ancestor once, with the fewest steps to it; diamonds and cycles end.

    Semi-naive: only the pairs that a round found first are joined to the edges again, less what is known.  A member of a cycle is
    its own ancestor.  Swap the columns for descendants.
    """
    from sextant.core.shared import materialise

    e = materialise(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).dropna().distinct(), "edges")
    up = e.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"))
    new, found = e, e.withColumn("steps", F.lit(1))
    for n in range(2, rounds + 2):
        step = new.join(up, "ancestor").select("child", F.col("next").alias("ancestor")).distinct()
        new = materialise(step.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti"), "closure")
        if new.isEmpty():
            return found.select(F.col("child").alias(child), F.col("ancestor").alias("ancestor"), "steps")
        found = found.unionByName(new.withColumn("steps", F.lit(n)))
    raise RuntimeError(f"a lineage of more than {rounds} steps")
