"""Streams of a run's rows: resuming, last status and progress, exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import progress


def row_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """JSON rows of files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def completed_once(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of every key, however often a rerun repeats it. The state holds every key; bound it with a watermark where rows have an event time."""
    return rows.dropDuplicates(list(keys))


def run_to_end(rows: DataFrame, sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All rows that are there, in micro-batches, each through the sink once; a later run of the same checkpoint goes on from its state."""
    query = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_progress(tasks: DataFrame, last: DataFrame) -> DataFrame:
    """A25 from a stream's current state."""
    return progress(tasks, last.select("task_id", "status", F.col("seq")))
