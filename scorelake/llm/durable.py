"""Lineage cuts, and caches of Python workers."""

from __future__ import annotations

import sys

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.durable import new_path, shared_dir, table

__all__ = ["fields", "forgotten", "kept_by_worker", "new_path", "row_key", "shared_dir", "stored_rows", "sums_joined", "table"]


def row_key(row: Column | None) -> Column:
    """uid: the stored row key where there is one. Numbers given to a scan differ from those of the next, whose splits depend on the cores alive."""
    return (F.monotonically_increasing_id() if row is None else row).alias("uid")


def stored_rows(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with a key of each row that every scan of it gives alike, however it is split: the row's file and its place in it.

    Parquet files tell both, so a table as it was read is not written again; anything else is, first.
    A file is known by 64 bits of its path's hash; files that share them (a chance of 3e-8 in a million files) fail.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = table(df)
    files = df.inputFiles()
    if len({xxhash.xxh64_intdigest(f, 42) for f in files}) < len(files):
        raise RuntimeError("two files have paths of one hash; rename one")
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return df.select("*", key.alias(name))


def fields(df: DataFrame, *names: str, **more: str) -> T.StructType:
    """Schema of some columns of df and of others by their types' names."""
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names] + [T.StructField(n, T.StructType.fromDDL(f"x {kind}")["x"].dataType) for n, kind in more.items()])


def kept_by_worker(name: str, key: object) -> dict:
    """A dictionary that a Python worker keeps from task to task, emptied when name or key changes, so that a worker has one at a time. For caches only."""
    held = sys.__dict__.setdefault("_scorelake_kept", {})
    if name not in held or held[name][0] != key:
        held.clear()
        held[name] = (key, {})
    return held[name][1]


def forgotten(spark: SparkSession, path: str) -> None:
    """Delete a table of ours below the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sums_joined(rows: DataFrame, sums: DataFrame, on: list[str], uid: str, few: int = 200_000, spread: int = 32) -> DataFrame:
    """rows with the columns of sums (one row a key; null keys are equal). Up to `few` keys are broadcast.

    Beyond, a key may still hold a third of the rows, so each key's sums are repeated `spread` times and rows are
    dealt over them by their uid: no task gets more than that part of a key.
    """
    sums = table(sums)
    keys = [f"_key_{c}" for c in on]
    named = sums.select(*[F.col(f"`{c}`").alias(f"_key_{c}") for c in on], *[F.col(f"`{c}`") for c in sums.columns if c not in on])
    match = F.lit(True)
    if sums.count() <= few:
        named = F.broadcast(named)
    else:
        rows = rows.withColumn("_deal", F.pmod(F.xxhash64(uid), F.lit(spread)))
        named = named.withColumn("_dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
        match = F.col("_deal") == F.col("_dealt")
    for c in on:
        match = match & F.col(f"`{c}`").eqNullSafe(F.col(f"_key_{c}"))
    return rows.join(named, match, "left").drop(*keys, "_deal", "_dealt")
