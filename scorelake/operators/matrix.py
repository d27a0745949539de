"""The matrix of a run as tables: its entries, their files, and the workers of its jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.durable import table
from ..sources.readers import listed
from .runs import named_runs

_REQUIRED = ("label", "response_tag", "rubric_tag")
ENTRY = "label string, response_tag string, rubric_tag string, reuse_response boolean, reuse_rubric boolean, enabled boolean"
#: The release's own folders.
OWN = ("code", "data", "docs", "manifests")


def run_matrix(spark: SparkSession, path: str | Sequence[str], selected: str = "") -> DataFrame:
    """The enabled entries of matrix documents ({"models": [...]}), with the names of `named_runs`.

    selected: response tags or run slugs with commas between; only entries with one of them stay. An entry without a required key,
    a name that no enabled entry has, and nothing left each fail, with the entry's number or the names. An entry is enabled, and
    reuses nothing, unless it says otherwise. Names are those among all enabled entries, whichever are selected.
    """
    docs = spark.read.schema(f"models array<struct<{ENTRY}>>").option("multiLine", True).json(path)
    entries = docs.select(F.col("_metadata.file_path").alias("file"), F.posexplode("models").alias("number", "e")).select("file", "number", "e.*")
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in _REQUIRED]), lambda c: c.isNotNull())
    bad = entries.select("file", "number", lacks.alias("lacks")).filter(F.size("lacks") > 0).orderBy("file", "number").limit(1).collect()
    if bad:
        raise ValueError(f"entry {bad[0]['number']} of {bad[0]['file']} lacks {', '.join(bad[0]['lacks'])}")
    live = entries.filter(F.coalesce("enabled", F.lit(True))).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("reuse_response", "reuse_rubric")})
    runs = table(named_runs(live.drop("enabled", "file", "number")))
    wanted = sorted({t.strip() for t in selected.split(",")} - {""})
    if wanted:
        asked = spark.createDataFrame([(t,) for t in wanted], "name string")
        unknown = [r["name"] for r in asked.join(runs.select(F.explode("selectors").alias("name")), "name", "left_anti").orderBy("name").collect()]
        if unknown:
            raise ValueError(f"no enabled entry is called {', '.join(unknown)}")
        runs = runs.filter(F.arrays_overlap("selectors", F.array(*[F.lit(t) for t in wanted])))
    if runs.isEmpty():
        raise ValueError("no entry is left to run")
    return runs


def _there(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Paths of the files and folders below a root, relative to it."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    steps = F.split(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(whole), F.lit(r"\E")), 2), -1), "/")
    every = listed(spark, root, "").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("_at"))
    return every.distinct().withColumn(name, F.lit(True))


def resolved_paths(paths: DataFrame, release: str, repository: str, path: str = "path") -> DataFrame:
    """Paths with `resolved`: absolute ones as they are; others below the release, or the repository, whichever has the file or folder, the release first; those that neither has below the release if they begin with one of its own folders, else below the repository. Both roots are listed once, however many paths there are; null paths stay null."""
    spark = paths.sparkSession
    at = F.rtrim(F.col(path), F.lit("/"))
    both = paths.withColumn("_path", at).join(_there(spark, release, "_release"), F.col("_path") == F.col("_at"), "left").drop("_at").join(_there(spark, repository, "_repository"), F.col("_path") == F.col("_at"), "left").drop("_at")
    under = lambda root: F.concat(F.lit(root.rstrip("/") + "/"), F.col(path))
    own = F.element_at(F.split(F.col(path), "/"), 1).isin(*OWN)
    found = F.when(F.col(path).startswith("/"), F.col(path)).when(F.col("_release"), under(release)).when(F.col("_repository"), under(repository)).when(own, under(release)).when(~own, under(repository))
    return both.select(*paths.columns, found.alias("resolved"))


def worker_shares(jobs: DataFrame, workers: int, order: str) -> DataFrame:
    """Jobs with wave (from 0) and workers: as many at once as there are workers, one at least, which share them evenly, one each at least; the rest come in later waves, in order. Jobs are a run's models, so a dimension of at most thousands: one task numbers them."""
    n = max(1, jobs.count())
    at_once = min(n, max(1, workers))
    number = F.row_number().over(Window.orderBy(order)) - 1
    return jobs.select("*", F.floor(number / at_once).cast("int").alias("wave"), F.lit(max(1, workers // at_once)).alias("workers"))
