"""Control of runs: pilots before full runs, locks, tables that one of several runs makes, and calls of a judge that may fail."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def todo_first(tasks: DataFrame, key: str, upto: int | None) -> DataFrame:
    """I8: all tasks, or the first `upto` of them for a pilot."""
    return tasks if upto is None else tasks.orderBy(key).limit(upto)


def pilot_then_full(done: Callable[[], int], run: Callable[[int | None], None], pilot: int, target: int, pilot_only: bool = False, skip_pilot: bool = False) -> tuple[str, int]:
    """I8: a run in two steps, each resuming what is there: a pilot, which has to end with as many rows as it should, before the rest. done counts rows; run takes how many tasks, or None for all. The outcome: done_already, pilot_only_done, done or partial, and the rows."""
    if pilot_only and skip_pilot:
        raise ValueError("a run can't both skip its pilot and be nothing else")
    if (rows := done()) >= target:
        return "done_already", rows
    if not skip_pilot and rows < pilot:
        run(pilot)
        if (rows := done()) < pilot:
            raise RuntimeError(f"the pilot gave {rows} rows of {pilot}")
    if pilot_only:
        return "pilot_only_done", rows
    run(None)
    rows = done()
    return ("done" if rows >= target else "partial"), rows


@contextmanager
def run_lock(spark: SparkSession, folder: str, wait: float = 0.0, stale: float | None = None, step: float = 0.5) -> Iterator[str]:
    """Only one run at a time in a folder: a lock file that only one can create, gone at the end. In any file system that Spark writes to.

    A second run waits up to `wait` seconds for the first to end, looking every `step`. A lock of over `stale` seconds, which a run
    that was killed has left, is taken away once; who then creates it first has it.
    """
    jvm = spark.sparkContext._jvm
    lock = jvm.org.apache.hadoop.fs.Path(f"{folder}/.lock")
    fs = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    until = time.monotonic() + wait
    while not fs.createNewFile(lock):
        if stale is not None and fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale:
            fs.delete(lock, False)
            stale = None
        elif time.monotonic() >= until:
            raise RuntimeError(f"{folder} is locked; remove {folder}/.lock if no run is in it")
        else:
            time.sleep(step)
    try:
        yield lock.toString()
    finally:
        fs.delete(lock, False)


def cached_once(spark: SparkSession, folder: str, make: Callable[[], DataFrame], wait: float = 3600.0, stale: float | None = None) -> DataFrame:
    """The table of a folder, made by whichever run comes first; others wait for it and read it. A run that was cut off leaves no _SUCCESS, so the next makes it anew."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/table/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        with run_lock(spark, folder, wait, stale):
            if not fs.exists(done):
                make().write.mode("overwrite").parquet(f"{folder}/table")
    return spark.read.parquet(f"{folder}/table")


def answered(prompts: DataFrame, judge: Callable[..., list[str]], options: dict, prompt: str = "prompt", batch: int = 100, attempts: int = 5, wait: float = 1.0) -> DataFrame:
    """Prompts with a judge's answers: judge(prompts, attempt=..., **options).

    An error is followed by another attempt after 1, 2, 4 ... times `wait` seconds, one that names top_p at
    once and without that option; blank answers are asked for again. What is blank after the last attempt
    stays so, for the dead letters; an error of the last attempt fails.
    """

    def ask(texts: list[str]) -> list[str]:
        out, open_, given = [""] * len(texts), list(range(len(texts))), dict(options)
        attempt = 0
        while open_ and attempt < attempts:
            try:
                for i, answer in zip(open_, judge([texts[i] for i in open_], attempt=attempt, **given), strict=True):
                    out[i] = answer
            except Exception as error:
                if "top_p" in str(error) and given.pop("top_p", None) is not None:
                    continue
                if attempt == attempts - 1:
                    raise
            open_ = [i for i in open_ if not (out[i] or "").strip()]
            attempt += 1
            if open_ and attempt < attempts:
                time.sleep(wait * 2 ** (attempt - 1))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[prompt].tolist()
            yield pdf.assign(answer=[x for a in range(0, len(texts), batch) for x in ask(texts[a : a + batch])])

    return prompts.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema.fields)}, answer string")
