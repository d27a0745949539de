"""Writers: appended and replaced JSON, CSV, dead letters and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    """K1: more rows to an output; what is there stays."""
    df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    """K2: the whole output anew. Readers may find it half-way; where that matters, use `versions.Versioned` (K3)."""
    df.write.mode("overwrite").json(path)


def write_csv(parts: Sequence[DataFrame], path: str) -> None:
    """K4, K5: rows of several tables under the union of their columns, in the order these first appear."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def annotation_sheet(df: DataFrame, text: str, blank: Sequence[str], excerpt: int = 400) -> DataFrame:
    """K5: rows to fill in: the text cut to an excerpt, blank columns after the others."""
    return df.withColumn(text, F.substring(text, 1, excerpt)).withColumns({b: F.lit("") for b in blank})


def split_errors(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are good, and those for the dead-letter output, which a rerun repairs; a null condition is no failure."""
    bad = F.coalesce(failed, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def report_rows(df: DataFrame, columns: Sequence[str], style: str = "latex") -> DataFrame:
    """K7, K8: each row as a line of a LaTeX table or a Markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    if style == "latex":
        return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def replace_file(lines: DataFrame, path: str) -> None:
    """K3: one file of lines (column value), written beside its place and moved there when it is complete. For small outputs."""
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.tmp")
    lines.coalesce(1).write.mode("overwrite").text(aside.toString())
    written = next(f.getPath() for f in fs.listStatus(aside) if f.getPath().getName().startswith("part-"))
    fs.delete(at, False)
    if not fs.rename(written, at):
        raise OSError(f"{path} could not be replaced")
    fs.delete(aside, True)


def case_reports(rows: DataFrame, case: str, model: str, score: str, text: str) -> DataFrame:
    """K8: a Markdown text for each case, its models worst first. To have them as files, write them partitioned by case."""
    each = F.array_sort(F.collect_list(F.struct(score, model, text)))
    parts = F.transform(each, lambda x: F.concat(F.lit("## "), x[model], F.lit(" "), x[text], F.lit("\n")))
    return rows.groupBy(case).agg(F.concat(F.lit("# "), F.first(F.col(case)).cast("string"), F.lit("\n"), F.array_join(parts, "")).alias("text"))


def save_vectors(df: DataFrame, path: str, key: str, text: str, vec: str) -> None:
    """Texts and their vectors in one table, so that they can't get out of step."""
    df.select(key, text, vec).write.mode("overwrite").parquet(path)
