"""Keyed state of streams: each task's last row, written as changes only, and timers for tasks that get no answer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import last_status
from ..sources.durable import exists, forget

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state and timers need: on local disk, its changes in the checkpoint."""
    spark.conf.set(_STORE, _ROCKS)
    return spark


def changed_last(rows: DataFrame, key: str = "task_id", order: str = "seq") -> DataFrame:
    """Of a stream of rows (key, status, order) the tasks whose last row a micro-batch changes, with that row.

    A task's last row, that of greatest order (of equal ones that of the first batch, in it the greatest status), is an aggregate in
    the store, with the time of the batch that brought it; a batch touches the tasks that it has, and hands on only those whose row is of its own time.
    Each slice of the input is cut to its tasks' last rows before the shuffle. Rows without an order
    are passed over; a null task is one of its own. State holds one row a task ever seen, on disk.
    """
    with_keyed_state(rows.sparkSession)
    now = F.unix_micros(F.current_timestamp())  # the micro-batch's, and the same if it runs again
    row = F.struct(F.col(order).cast("long").alias("place"), (-now).alias("earliness"), F.col("status").cast("string").alias("status"))
    last = rows.filter(F.col(order).cast("long").isNotNull()).select(key, row.alias("last")).groupBy(key).agg(F.max("last").alias("last"))
    return last.filter(F.col("last.earliness") == -now).select(key, "last.status", F.col("last.place").alias(order))


def changes_to(folder: str):
    """A sink for changed_last: each micro-batch's changes as a part of their own, replaced where the batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return write


def current_last(spark: SparkSession, folder: str, kind: str = "task_id long, status string, seq long", key: str = "task_id", order: str = "seq") -> DataFrame:
    """The tasks' last rows: of the compacted ones and the changes since, the last of each. Nothing written: no rows."""
    parts = [spark.read.schema(kind).parquet(f"{folder}/{p}").select(key, "status", order) for p in ("changes", "base") if exists(spark, f"{folder}/{p}")]
    if not parts:
        return spark.createDataFrame([], kind)
    return last_status(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), key, order)


def compacted(spark: SparkSession, folder: str, kind: str = "task_id long, status string, seq long", key: str = "task_id", order: str = "seq") -> None:
    """Put the changes so far into one table of last rows, and take them away. For times when no stream writes; ended half-way, it leaves rows twice, which reads the same."""
    parts = [p for p in _parts(spark, f"{folder}/changes") if p.startswith("batch=")]
    if not parts:
        return
    number = max(int(p[6:]) for p in parts)
    older = _parts(spark, f"{folder}/base")
    current_last(spark, folder, kind, key, order).write.mode("overwrite").parquet(f"{folder}/base/upto={number}")
    for p in older:
        if p != f"upto={number}":
            forget(spark, f"{folder}/base/{p}")
    for p in parts:
        forget(spark, f"{folder}/changes/{p}")


def _parts(spark: SparkSession, folder: str) -> list[str]:
    if not exists(spark, folder):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory()]


def _outcomes(held: tuple[int, int, bool], rows: list[tuple[int, bool]], limit: int, found: list[tuple]) -> tuple[int, int, bool]:
    """What a task's rows (time, whether a question), in order of time, answers before questions, make of the question that it holds (asked, attempt, waits); their outcomes go to `found`."""
    asked, attempt, open_ = held
    for ms, kinds in groupby(rows, key=itemgetter(0)):
        if open_ and ms > asked + limit:
            open_ = False
            found.append(("timed out", attempt, asked, asked + limit))
        if not open_:  # nothing waits for the answers of this time but its own question
            kinds = reversed(list(kinds))
        for _, ask in kinds:
            if ask:
                if not open_:
                    asked, attempt, open_ = ms, attempt + 1, True
            elif open_:
                open_ = False
                found.append(("answered", attempt, asked, ms))
            elif attempt:
                found.append(("late", attempt, asked, ms))
    return asked, attempt, open_


class _Stalls(StatefulProcessor):
    """Holds the questions of a bucket of tasks, and a timer at the first limit of those that wait.

    State is parts of rows (task, asked, attempt, waits): a call appends the tasks that it changes, and puts the parts together once those after the first outgrow it.
    """

    _names = ("id", "asked", "attempt", "waits")

    def __init__(self, limit_ms: int, kind: pa.DataType):
        self.limit, self.kind = limit_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "rows binary")
        self.due = handle.getValueState("due", "at long, first long, rest long, parts int")

    def _held(self) -> pd.DataFrame:
        """The last row of every task of the bucket, by task."""
        parts = [pa.ipc.open_stream(p[0]).read_all() for p in self.parts.get()] if self.parts.exists() else []
        held = pa.concat_tables(parts).to_pandas().set_index("id") if parts else pd.DataFrame({"id": [], "asked": np.zeros(0, np.int64), "attempt": np.zeros(0, np.int32), "waits": np.zeros(0, bool)}).set_index("id")
        return held[~held.index.duplicated(keep="last")] if len(parts) > 1 else held

    def _keep(self, held: pd.DataFrame, changed: pd.DataFrame) -> None:
        """Append what changed, and put the timer where the first question's limit now is."""
        before = self.due.get()
        timer, first, rest, parts = before if before is not None else (None, 0, 0, 0)
        now = pd.concat([held[~held.index.isin(changed.index)], changed]) if len(held) else changed
        if len(changed):
            rest += len(changed)
            whole = rest > first or parts >= 64
            rows = now if whole else changed
            table = pa.table([pa.array(rows.index, self.kind), *(pa.array(rows[n].to_numpy()) for n in self._names[1:])], names=self._names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            part = (sink.getvalue().to_pybytes(),)
            if whole:
                self.parts.put([part])
                first, rest, parts = len(now), 0, 1
            else:
                self.parts.appendValue(part)
                parts += 1
        waits = now["asked"].to_numpy()[now["waits"].to_numpy(bool)]
        due = int(waits.min()) + self.limit if len(waits) else None
        if timer != due and timer is not None:
            self.handle.deleteTimer(timer)
        if timer != due and due is not None:
            self.handle.registerTimer(due)
        if before != (due, first, rest, parts):
            self.due.update((due, first, rest, parts))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["id", "ms", "ask"]] for r in rows])
        if key[0] < 0:  # the null task
            new["id"] = 0 if pa.types.is_integer(self.kind) else ""
        codes, ids = pd.factorize(new["id"], use_na_sentinel=False)
        order = np.lexsort((new["ask"].to_numpy(bool), new["ms"].to_numpy(), codes))
        ends = np.cumsum(np.bincount(codes, minlength=len(ids)))
        steps = list(zip(new["ms"].to_numpy()[order].tolist(), new["ask"].to_numpy(bool)[order].tolist(), strict=True))
        held = self._held()
        at = held.index.get_indexer(ids) if len(held) else np.full(len(ids), -1)
        known = [held[n].to_numpy()[at].tolist() if len(held) else [0] * len(ids) for n in self._names[1:]]
        found, owners, states, begin = [], [], [], 0
        for i, (end, place, *was) in enumerate(zip(ends.tolist(), at.tolist(), *known, strict=True)):
            states.append(_outcomes(tuple(was) if place >= 0 else (0, 0, False), steps[begin:end], self.limit, found))
            owners.extend([i] * (len(found) - len(owners)))
            begin = end
        after = [np.array(c, t) for c, t in zip(zip(*states, strict=True), (np.int64, np.int32, bool), strict=True)]
        moved = (at < 0) & (after[1] > 0) | (at >= 0) & np.any([a != np.array(k, a.dtype) for a, k in zip(after, known, strict=True)], axis=0)
        changed = pd.DataFrame(dict(zip(self._names[1:], (a[moved] for a in after), strict=True)), index=pd.Index(ids)[moved])
        self._keep(held, changed)
        if found:
            yield self._rows(key, pd.Index(ids)[owners], *zip(*found, strict=True))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, upto = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = held[held["waits"].to_numpy(bool) & (held["asked"].to_numpy() + self.limit <= upto)]
        self._keep(held, over.assign(waits=False))
        if len(over):
            yield self._rows(key, over.index, "timed out", over["attempt"].to_numpy(), over["asked"].to_numpy(), over["asked"].to_numpy() + self.limit)

    def _rows(self, key: Any, ids: pd.Index, outcome: Any, attempt: Any, asked: Any, at: Any) -> pd.DataFrame:
        return pd.DataFrame({"id": [None] * len(ids) if key[0] < 0 else ids.to_numpy(), "outcome": outcome, "attempt": attempt, "asked_at": asked, "at": at})

    def close(self) -> None:
        pass


def with_stall_limit(rows: DataFrame, limit: float, delay: str = "0 seconds", buckets: int = 256) -> DataFrame:
    """Outcomes of a stream of questions and answers (task_id, kind: ask or answer, at): answered, timed out or late.

    A question without an answer within `limit` seconds of event time times out: its timer fires once the watermark
    (the latest time less `delay`) passes it, whether or not the task has rows again. An answer
    after that is late. A task asked again (a rerun) waits anew, attempt 2 and so on; while one waits, further questions are
    repeats of it. At one time an answer comes first if a question waits for it, else the question comes first; answers never asked for, and rows without a time, are passed over. Rows
    more than `delay` behind the latest of the batches before are dropped by the engine: choose it as late as rows may be.

    Tasks share a state and a timer with those of their bucket by hash, so a micro-batch calls the store some times a bucket, not a task.
    It reads the buckets that have rows or a timer due, writes the tasks that change, and holds one bucket in memory: more tasks want more buckets, which a checkpoint then fixes.
    """
    with_keyed_state(rows.sparkSession)
    task = rows.schema["task_id"].dataType
    plain = isinstance(task, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType))
    day = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}  # of ids that are times
    one = T.StructType([T.StructField("task_id", task)])
    ident = F.col("task_id") if plain else F.to_json(F.struct("task_id"), day)
    bucket = F.when(F.col("task_id").isNull(), -1).otherwise(F.pmod(F.xxhash64(ident), F.lit(buckets))).cast("int")
    rows = rows.filter("at is not null").select(bucket.alias("bucket"), ident.alias("id"), F.unix_millis("at").alias("ms"), F.expr("coalesce(kind = 'ask', false)").alias("ask"), "at").withWatermark("at", delay)
    kind = T.StructType([T.StructField("id", task if plain else T.StringType()), *T.StructType.fromDDL("outcome string, attempt int, asked_at long, at long").fields])
    stalls = _Stalls(round(limit * 1000), pa.int64() if plain and not isinstance(task, T.StringType) else pa.string())
    found = rows.groupBy("bucket").transformWithStateInPandas(stalls, kind, "Update", "EventTime")
    known = F.col("id") if plain else F.from_json("id", one, day)["task_id"]
    return found.select(known.alias("task_id"), "outcome", "attempt", *[F.timestamp_millis(c).alias(c) for c in ("asked_at", "at")])


def dead_letters(outcomes: DataFrame) -> DataFrame:
    """Tasks whose last attempt timed out and that no later answer, late ones included, has repaired: what a rerun asks again."""
    last = outcomes.groupBy("task_id").agg(F.max("attempt").alias("attempt"), F.max_by("outcome", F.struct("attempt", "at", (F.col("outcome") != "timed out").alias("o"))).alias("outcome"))
    return last.filter("outcome = 'timed out'").select("task_id", "attempt")
