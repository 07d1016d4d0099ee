"""Incremental tables by Structured Streaming: append of new sessions, landing once, stateful de-clustering.

Every stream reads files, keeps its state in a checkpoint of the shared folder and writes through ``foreachBatch`` or a
Parquet sink, so a restarted stream goes on where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class LateSession(ValueError):
    """A session at or before the high-water mark is missing from the table."""


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def late_sessions(new: DataFrame, held: DataFrame, day: str = "d") -> DataFrame:
    """Rows of ``new`` whose day is not in ``held`` although a later (or the same) day is: they came too late to append."""
    last = held.agg(F.max(day).alias("_last"))  # one row
    return new.join(F.broadcast(last), F.col(day) <= F.col("_last")).drop("_last").join(held.select(day).distinct(), day, "left_anti")


def append_sessions(new: DataFrame, path: str, batch: int, day: str = "d") -> None:
    """Appends the rows of days later than the table's last one; days that are there already are left alone.

    A day at or before the last one that is not there stops the append.  Rows go to a partition of their batch that is
    overwritten when the batch is repeated, so a repeat writes the same rows again and not twice.  Beside the table lies a list of its days by batch
    (a row a session), which is all that an append reads of what is there; it is written after the rows, and a batch that failed between is repeated.
    """
    spark, marks = new.sparkSession, f"{path}-days"
    if exists(spark, marks):
        held = spark.read.schema(f"`{day}` {dict(new.dtypes)[day]}, _batch long").parquet(marks).where(F.col("_batch") < batch)
        last = held.agg(F.max(day)).first()[0]
        if last is not None:
            late = late_sessions(new.select(day), held.select(day), day).limit(1).collect()
            if late:
                raise LateSession(f"session {late[0][0]} is not after {last} and not in the table")
            new = new.where(F.col(day) > F.lit(last))
    new.write.mode("overwrite").parquet(f"{path}/_batch={batch}")
    own = spark.read.schema(new.schema).parquet(f"{path}/_batch={batch}")
    own.select(day).distinct().coalesce(1).write.mode("overwrite").parquet(f"{marks}/_batch={batch}")


def stream_sessions(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, day: str = "d") -> None:
    """All files of ``source`` not seen yet, one a batch in the order of arrival."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = rows.writeStream.foreachBatch(lambda df, n: append_sessions(df, path, n, day)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def land_batch(new: DataFrame, content: list[str], at: str, path: str, batch: int) -> None:
    """Lands the rows whose content no batch before has landed; of equal contents in the batch the earliest by ``at``.

    Rows go to a partition of their batch that is overwritten when the batch is repeated.
    """
    spark = new.sparkSession
    keyed = new.withColumn("sha", F.sha2(F.to_json(F.struct(*content)), 256))
    first = keyed.groupBy("sha").agg(F.min(F.struct(at, *(c for c in new.columns if c != at))).alias("row")).select(*(F.col(f"row.{c}") for c in new.columns), "sha")
    if exists(spark, path):
        held = spark.read.schema("sha string, _batch long").parquet(path).where(F.col("_batch") < batch)
        first = first.join(held, "sha", "left_anti")
    first.write.mode("overwrite").parquet(f"{path}/_batch={batch}")


def land_once(spark: SparkSession, source: str, schema: str, content: list[str], at: str, path: str, checkpoint: str) -> None:
    """Rows whose content was not landed before, whatever time lies between: the table's hashes are the state."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = rows.writeStream.foreachBatch(lambda df, n: land_batch(df, content, at, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def last_kept(stream: DataFrame, key: str, index: str, gap: int) -> DataFrame:
    """Greedy de-clustering: a row is kept if it comes ``gap`` or more after the key's last kept one.

    State is one number a key.  Rows of a key have to arrive in order across batches; inside a batch they are sorted.
    """

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for value in sorted({int(v) for f in frames for v in f[index]}):
            if last is None or value - last >= gap:
                kept.append(value)
                last = value
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [keys[0]] * len(kept), index: kept})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, F.col(index).cast("long").alias(index)).groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, `{index}` long", "last long", "append", GroupStateTimeout.NoTimeout)
