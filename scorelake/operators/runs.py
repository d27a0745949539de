"""Match metrics, progress of runs, resuming, and comparison with expected metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_metrics(rows: DataFrame, by: Sequence[str] = ("case",)) -> DataFrame:
    """Counts of each status, covered ones, and their rates; a case without criteria divides by 1."""
    out = rows.groupBy(*by).agg(F.count("status").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "nearby", "none")])
    whole = F.greatest(F.lit(1), F.col("n"))
    rates = {f"{s}_rate": F.col(s) / whole for s in ("matched", "nearby", "none")} | {"covered_rate": (F.col("matched") + F.col("nearby")) / whole}
    return out.withColumns({"covered": F.col("matched") + F.col("nearby")} | rates)


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of every rate over cases, 0.0 without any."""
    return metrics.agg(F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in metrics.columns if c.endswith("_rate")])


def last_status(log: DataFrame, key: str = "task_id", order: str = "seq") -> DataFrame:
    """The last row's status of each task."""
    return log.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(order).alias(order))


def progress(tasks: DataFrame, log: DataFrame, resumed: DataFrame | None = None) -> DataFrame:
    """Total, completed, ok, error, skipped, resumed and pending tasks."""
    known = tasks.select("task_id").distinct().join(last_status(log).select("task_id", "status"), "task_id", "left")
    if resumed is not None:
        known = known.join(resumed.select("task_id").distinct().withColumn("resumed", F.lit(True)), "task_id", "left")
    else:
        known = known.withColumn("resumed", F.lit(False))
    has = lambda s: F.count_if(F.col("status") == s).alias(s)
    return known.agg(F.count(F.lit(1)).alias("total"), F.count("status").alias("completed"), has("ok"), has("error"), has("skipped"), F.count_if(F.coalesce("resumed", F.lit(False))).alias("resumed"), F.count_if(F.col("status").isNull()).alias("pending"))


def is_complete(summary: DataFrame, mode: str, wanted: str, expected: int) -> bool:
    """A summary exists, of the wanted mode, with as many ok tasks as expected."""
    row = summary.first()
    return row is not None and mode == wanted and row["ok"] >= expected


def complete_cases(rows: DataFrame, expected: DataFrame, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Rows of cases that have as many as expected (key, expected), and the keys to do again."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    state = expected.join(counts, key, "left").withColumn("done", F.coalesce("n", F.lit(0)) == F.col("expected"))
    return rows.join(state.filter("done"), key, "left_semi"), state.filter("not done").select(key)


def seeded(earlier: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of an earlier output, and those of rows that it lacks; columns that either lacks are null."""
    return earlier.unionByName(rows.join(earlier.select(*on).distinct(), list(on), "left_anti"), allowMissingColumns=True)


def weight_distribution(rows: DataFrame) -> DataFrame:
    """Rows of each side by weight; null weights are left out."""
    return rows.filter("weight is not null").groupBy("side", "weight").agg(F.count(F.lit(1)).alias("n"))


def dimension_distribution(rows: DataFrame, dimensions: str) -> DataFrame:
    """How often each side has each of its listed dimensions."""
    return rows.select("side", F.explode(dimensions).alias("dimension")).groupBy("side", "dimension").agg(F.count(F.lit(1)).alias("n"))


def side_shares(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of each side and their percentage to one place, 0 of none."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("side") == s).alias(s) for s in names])
    return counts.withColumns({f"{s}_pct": F.coalesce(F.bround(F.try_divide(100.0 * F.col(s), F.col("total")), 1), F.lit(0.0)) for s in names})


def one_sided_ids(residual: Column, found: Column) -> Column:
    """Residual ids that were found, and those that were missed."""
    return F.struct(F.array_intersect(residual, found).alias("confirmed"), F.array_except(residual, found).alias("missed"))


def outcome(findings: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    """For each of names how many findings there are, and ok or failed; names without any are ok."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(n,) for n in names], f"{by} string")
    counts = findings.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, by, "left").select(by, F.when(F.col("n") > 0, "failed").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def named_runs(specs: DataFrame) -> DataFrame:
    """Specs (label, response_tag, rubric_tag, ...) with run_slug, display_label and selectors.

    A response tag that only one spec has names its run by itself, and the label stays; where several specs share it,
    slug and label say the rubric too. selectors are the names that a run is asked for by: its tag and its slug, once if equal.
    Counts are joined, so a tag that a third of the specs share is split like any join. Specs without a tag have null names.
    """
    shared = specs.groupBy(F.col("response_tag").alias("_tag")).agg((F.count(F.lit(1)) > 1).alias("_shared"))
    both = specs.join(shared, specs["response_tag"] == shared["_tag"], "left")
    slug = F.when(F.col("_shared"), F.concat("response_tag", F.lit("__rubric__"), "rubric_tag")).otherwise(F.col("response_tag"))
    label = F.when(F.col("_shared"), F.concat("label", F.lit(" | response="), "response_tag", F.lit(" rubric="), "rubric_tag")).otherwise(F.when(F.col("_shared").isNotNull(), F.col("label")))
    return both.select(*specs.columns, slug.alias("run_slug"), label.alias("display_label"), F.array_distinct(F.array("response_tag", slug)).alias("selectors"))


def backfilled(log: DataFrame, earlier: DataFrame, metric: str, key: str = "task_id", order: str = "seq") -> DataFrame:
    """I4: each task's last status and metric; a metric that the last row lacks comes from an earlier table (key, metric)."""
    last = log.groupBy(key).agg(F.max_by(F.struct("status", metric), order).alias("l")).select(key, "l.status", F.col(f"l.{metric}").alias("_now"))
    return last.join(earlier.select(key, metric), key, "left").select(key, "status", F.coalesce("_now", metric).alias(metric))


def timed_out(elapsed: Column, limit: float) -> Column:
    """Whether a row took longer than it may; unknown times did not."""
    return F.coalesce(elapsed > limit, F.lit(False))
