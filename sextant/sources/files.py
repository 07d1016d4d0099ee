"""Readers of text formats and replacing sinks.

A report file (JSON, delimited, tagged facts) is small and is one row while it is parsed; record and CSV files are read
by lines.  Nothing is inferred: every column arrives as text and is cast by name, a text that doesn't fit giving null.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

OK, EMPTY, PARSE_FAILED = "OK", "EMPTY", "PARSE_FAILED"


def csv_text(spark: SparkSession, path: str, casts: dict[str, str]) -> DataFrame:
    """Columns of ``casts`` from CSV files with a header that may differ in order."""
    names = spark.read.option("header", True).csv(path).columns
    rows = spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return rows.select(*(F.try_to_timestamp(n).alias(n) if kind == "timestamp" else F.col(n).try_cast(kind).alias(n) for n, kind in casts.items()))


def json_arrays(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """Records of files that hold ``[...]`` or ``{"data": [...]}`` (gzip by suffix); other files have none."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.from_json("value", ArrayType(record))
    wrapped = F.from_json("value", StructType().add("data", ArrayType(record)))["data"]
    return files.select("file", F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("r")).select("file", "r.*")


def report_files(spark: SparkSession, path: str, columns: dict[str, list[str]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, status) and the rows: canonical columns as text, ``raw`` with the full original row as JSON.

    ``columns`` maps a canonical name to the headers it goes by, compared in lower case without outer spaces.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", r"\r?\n"), lambda l: F.trim(l) != "").alias("lines"))
    header = F.transform(F.split(F.lower(F.get("lines", F.lit(0))), ","), lambda c: F.trim(c))
    named = files.withColumn("header", header)
    for name, spellings in columns.items():
        at = F.lit(None).cast("int")
        for s in reversed(spellings):
            at = F.when(F.array_position("header", s) > 0, F.array_position("header", s).cast("int") - 1).otherwise(at)
        named = named.withColumn(f"_at_{name}", at)
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"_at_{name}").isNull()
    status = F.when(F.size("lines") == 0, EMPTY).when(missing, PARSE_FAILED).when(F.size("lines") == 1, EMPTY).otherwise(OK)
    named = named.withColumn("status", status)
    fields = named.where(F.col("status") == OK).withColumn("cells", F.explode(F.slice("lines", F.lit(2), F.size("lines")))).withColumn("cells", F.split("cells", ","))
    full = fields.where(F.size("cells") == F.size("header"))
    rows = full.select("file", *(F.trim(F.get("cells", F.col(f"_at_{n}"))).alias(n) for n in columns), F.to_json(F.map_from_arrays("header", "cells")).alias("raw"))
    return named.select("file", "status"), rows


def records(spark: SparkSession, path: str, kind: str, fields: dict[str, tuple[int, str]]) -> DataFrame:
    """Distinct lines whose first field is ``kind``; ``fields`` maps a name to its place and type."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).where(F.get("p", F.lit(0)) == kind)
    return parts.select(*(F.trim(F.get("p", F.lit(i))).try_cast(t).alias(n) for n, (i, t) in fields.items())).distinct()


def tagged_facts(docs: DataFrame, key: str, text: str, facts: list[str], header: list[str]) -> DataFrame:
    """One row per document and context with a column per fact; header facts, whatever their context, go to every row."""
    tag = r'<([a-z_]+) contextRef="([^"]*)">([^<]*)</'
    part = lambda i: F.regexp_extract_all(text, F.lit(tag), i)
    found = docs.select(key, F.inline(F.arrays_zip(part(1).alias("name"), part(2).alias("context"), part(3).alias("value"))))
    found = found.toDF(key, "name", "context", "value")
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    rows = found.groupBy(key, "context").agg(*(pick(n).alias(n) for n in facts), *(pick(n).alias(f"_{n}") for n in header))
    own = Window.partitionBy(key)
    return rows.select(key, "context", *facts, *(F.max(f"_{n}").over(own).alias(n) for n in header)).where(" OR ".join(f"{n} IS NOT NULL" for n in facts))


POINTER = "_current"


def _fs(spark, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def version(spark, path: str) -> str | None:
    """The folder of the version that stands at ``path``; None before the first."""
    fs, pointer = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def point_to(spark, path: str, name: str) -> None:
    """Makes ``name`` the version that stands: a pointer file is written aside and renamed over the old one, in one step of the file system."""
    jvm = spark._jvm
    fs, aside = _fs(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)  # raises where it fails


def replace_partitioned(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replaces a whole partitioned set: a new version is written in a folder of its own, then the pointer to it is replaced.

    Readers see the old set or the new one, never part of either; a failure before the last step leaves the old one, and ``df`` may read
    the set that it replaces.  The version before stays for readers that have begun, older ones go.
    """
    spark = df.sparkSession
    before, name = version(spark, path), f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.repartition(*partition_by).write.partitionBy(*partition_by).parquet(f"{path}/{name}")
    point_to(spark, path, name)
    fs, top = _fs(spark, path)
    for status in fs.listStatus(top):
        own = status.getPath().getName()
        if own.startswith("version-") and own < name and own != (before or "").rsplit("/", 1)[-1]:
            fs.delete(status.getPath(), True)


def read_replaced(spark, path: str, schema) -> DataFrame:
    """The set that stands at ``path``; empty before the first version."""
    at = version(spark, path)
    return spark.createDataFrame([], schema) if at is None else spark.read.schema(schema).parquet(at)


def newest_first_once(df: DataFrame, keys: list[str], newest: Column, order: list[str]) -> DataFrame:
    """One row per key, the one of the newest source, globally sorted for writing."""
    kept = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(newest))).where("_rn = 1").drop("_rn")
    return kept.orderBy(*order)
