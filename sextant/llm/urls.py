"""URL filter rules as a sort-merge range join, in DataFrame functions only.

A host is written backwards by labels with a dot after each (``example.com`` -> ``com.example.``) and a rule's key is that with
its path behind it, so what a rule fits is what begins with its key: one interval of the sorted keys, from the key up to the
key and a byte that no text has.  Intervals nest or are disjoint.  A url asks with one key for each of its host's label
prefixes (``com./en/7``, ``com.example./en/7``), since a rule of a host fits all subdomains.

Rules' interval bounds and urls' keys are sorted together, dealt over the cluster by ranges of the key.  A sweep in that order
holds the stack of active nested rules; only its top is ever asked for, so a bound carries the rule that is innermost from it
on: the rule itself where an interval opens, the enclosing rule where it closes.  Every range starts with the last bound of the
ranges before it, and each key takes the last bound before it.  Of a url's keys the longest rule wins.  Nothing is copied to
ranges, so any number of rules takes this one way; equal keys (a hot host or url) are split by a salt behind the key.

Defined results: null or schemeless urls have an empty host and path and fit no rule; rules with a null field, an empty host
or a path that doesn't begin with ``/`` fit nothing; repeated urls and rules are fine; an empty table of either gives no rows
or no rule; very long urls are compared whole; equally long rules: the greater rule string, then ``block`` before ``allow``;
input columns named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.core.shared import materialise

#: host, path, verdict
Rules = list[tuple[str, str, str]]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.col(url_col).substr(at + 3, F.length(url_col))).otherwise(F.lit(""))
    main = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    raw = F.substring_index(main, "/", 1)
    return df.withColumn("host", ascii_lower(raw)).withColumn("path", main.substr(F.length(raw) + 1, F.length(main)))


def key_of(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def prefixes(key: Column) -> Column:
    """Each label prefix of a key: ``com.``, ``com.example.`` ..."""
    labels = F.slice(F.split(key, r"\."), 1, F.size(F.split(key, r"\.")) - 1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.concat_ws(".", F.slice(labels, 1, i)), F.lit(".")))


def rule_frame(df: DataFrame) -> DataFrame:
    """Clean rules: key and the struct that orders them (longest first wins by max), one a key."""
    whole = "host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> '' AND (path = '' OR startswith(path, '/'))"
    rules = df.where(whole).withColumn("host", ascii_lower(F.col("host")))
    rule = F.concat("host", "path")
    ordered = F.struct(F.length(rule).alias("size"), rule.alias("rule"), F.col("verdict"))
    return rules.groupBy(F.concat(key_of(F.col("host")), "path").alias("key")).agg(F.max(ordered).alias("r"))


def bounds(rules: DataFrame) -> DataFrame:
    """Interval bounds (``at``, bytes) with the rule that is innermost from each on, null outside of all."""
    shorter = F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring("key", F.lit(1), i))
    enclosing = rules.select("key", F.explode(shorter).alias("outer")).join(rules.select(F.col("key").alias("outer"), F.col("r").alias("o")), "outer")
    parent = enclosing.groupBy("key").agg(F.max_by("o", F.length("outer")).alias("parent"))
    both = rules.join(parent, "key", "left")
    opened = F.struct(F.col("key").cast("binary").alias("at"), F.col("r").alias("top"))
    closed = F.struct(F.concat(F.col("key").cast("binary"), F.unhex(F.lit("FF"))).alias("at"), F.col("parent").alias("top"))
    return both.select(F.inline(F.array(opened, closed)))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``urls`` but for clashing names, and host, path, rule, verdict; longest fitting rule wins."""
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parts = with_parts(urls.select(*own), url_col)
    rows = parts.select(F.struct(*own).alias("_row"), "host", "path").withColumn("_id", F.monotonically_increasing_id())
    asks = F.when(F.col("host") != "", F.transform(prefixes(key_of(F.col("host"))), lambda k: F.concat(k, F.col("path")).cast("binary")))
    keys = rows.select("_row", "host", "path", "_id", F.posexplode_outer(asks).alias("_n", "_at"))
    first = F.coalesce(F.col("_n"), F.lit(0)) == 0  # one of a url's keys brings the row along
    keys = keys.select("_id", "_at", F.lit(1).alias("_kind"), F.when(first, F.struct("_row", "host", "path")).alias("_url"), F.xxhash64("_id").alias("_salt"))
    marks = bounds(rule_frame(rules)).select(F.col("at").alias("_at"), F.lit(0).alias("_kind"), F.struct("top").alias("_bound"), F.lit(0).cast("long").alias("_salt"))
    ranged = keys.unionByName(marks, allowMissingColumns=True).repartitionByRange("_at", "_kind", "_salt")
    dealt = materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    # of every range the last bound; what a range begins with is the last one of those before it (a row a range)
    ends = dealt.where("_kind = 0").groupBy("_range").agg(F.max_by("_bound", "_at").alias("_end"))
    every = dealt.select("_range").distinct().join(ends, "_range", "left")
    begins = every.select("_range", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_begin"))
    order = Window.partitionBy("_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("_last", F.last("_bound", ignorenulls=True).over(order)).where("_kind = 1").join(F.broadcast(begins), "_range")
    top = F.coalesce("_last", "_begin")["top"]
    judged = swept.groupBy("_id").agg(F.max(F.when(F.col("_at").isNotNull(), top)).alias("_r"), F.first("_url", ignorenulls=True).alias("_url"))
    return judged.select(*(F.col("_url._row")[c].alias(c) for c in own), "_url.host", "_url.path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.lit(default)).alias("verdict"))
