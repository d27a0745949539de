"""Tables that cut lineage: written to the folder all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own on a single machine, and none on a cluster, whose executors don't share it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or f"file://{tempfile.gettempdir()}/scorelake-{sc.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path of its own below the shared folder and the application's."""
    return f"{shared_dir(spark)}/scorelake-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """Write df once under the shared folder and return a scan of what was written.

    A lost executor costs its running tasks only: the rows are in the shared store, not on its
    disk. The folder is named by application, so one recursive delete clears a finished job.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
