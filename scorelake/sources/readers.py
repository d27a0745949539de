"""Readers of the engine's inputs: JSON lines, whole JSON documents, CSV, id lists and trees of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rubric import CRITERION
from .durable import exists

#: Marks of files that are no data.
NOT_DATA = (".errors.", ".bak", "pilot", "backup")
JUDGEMENT = "task_id string, criterion_id string, criterion string, response string, dilemma_source string, criterion_dimension string, criterion_weight int, input_tokens int, output_tokens int, reasoning_tokens int, model string, dilemma_type string, role_domain string, theory string, idx int, judgement string, judge_input_tokens int, judge_output_tokens int"
RUBRIC = f"TASK_ID string, DILEMMA string, DILEMMA_SOURCE string, DILEMMA_TYPE string, THEORY string, ROLE_DOMAIN string, CONTEXT string, RUBRIC array<{CRITERION}>"
_CORRUPT = "_corrupt_record"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, unreadable ones are rows of nulls."""
    return spark.read.schema(schema).json(path)


def json_lines_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As S1, and no rows where there is no file."""
    try:
        return json_lines(spark, path, schema)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _schema(schema))


def json_lines_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: as S1 without lines that are torn or no JSON."""
    kept = _schema(schema).add(_CORRUPT, "string")
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    return rows.filter(F.col(_CORRUPT).isNull() | (F.length(_CORRUPT) == 0)).drop(_CORRUPT)


def bad_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """The first line of each file that is no JSON of the schema: file, line (from 1) and text; blank lines are fine.

    Large files are read in splits, several to a task. Lines are numbered within their split by the row's place in the task,
    and a split's first number is the lines of the file's splits before it, all from one pass with one row left for
    each split. Lines end with a line feed.
    """
    parsed = F.from_json("value", f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    bad = (F.trim("value") != "") & parsed[_CORRUPT].isNotNull()
    splits = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min(F.when(bad, F.struct("at", "value"))).alias("bad"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = splits.withColumn("line", before + F.col("bad.at") - F.col("first") + 1).filter("bad is not null")
    return found.groupBy("file").agg(F.min(F.struct("line", "bad.value")).alias("x")).select("file", "x.line", F.col("x.value").alias("text"))


class BadLine(ValueError):
    """A line that is no JSON of its schema."""


def json_lines_strict(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """As S1, failing with the file and number of the first bad line (of the first such file), before any row is read."""
    first = bad_lines(spark, path, schema).orderBy("file").limit(1).collect()
    if first:
        raise BadLine(f"{first[0]['file']}, line {first[0]['line']}: no JSON of the schema: {first[0]['text'][:200]}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """One row a whole-file JSON object, with the file it came from."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("_file", F.col("_metadata.file_path"))


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted fields of several lines, doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, stripped, blank lines skipped."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("id")).filter("id <> ''").distinct()


def listed(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Files below a folder with their sizes, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", "length")


def inventory(files: DataFrame, section: Column) -> DataFrame:
    """Number and bytes of the files of each section."""
    return files.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def _is_data(part: int = -1) -> Column:
    name = F.element_at(F.split("path", "/"), part)
    bad = F.lit(False)
    for mark in NOT_DATA:
        bad = bad | name.contains(mark)
    return ~bad


def single_file(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> str:
    """The one data file of a folder, error files and backups left out; fails for none or several."""
    found = [r["path"] for r in listed(spark, folder, suffix).filter(_is_data()).orderBy("path").limit(3).collect()]
    if len(found) != 1:
        raise RuntimeError(f"expected one data file in {folder}, found {len(found)}")
    return found[0]


def rubric_pair(spark: SparkSession, folder: str, exact_ai: str, exact_human: str) -> tuple[str, str]:
    """The model's and the human rubric file of a folder: those of the exact names if both are there, else the only one of either side that is neither a pilot nor a backup."""
    there = {p.rsplit("/", 1)[1]: p for p in (r["path"] for r in listed(spark, folder, ".jsonl").select("path").collect())}
    if exact_ai in there and exact_human in there:
        return there[exact_ai], there[exact_human]
    found = {side: [p for name, p in sorted(there.items()) if name.startswith(f"{side}_rubric_") and "backup" not in name] for side in ("ai", "human")}
    if [len(x) for x in found.values()] != [1, 1]:
        raise ValueError(f"expected one rubric file of either side in {folder}, found {({k: len(v) for k, v in found.items()})}")
    return found["ai"][0], found["human"][0]


def case_documents(spark: SparkSession, path: str, schema: str, model: str, case: str) -> DataFrame:
    """Documents of cases, with model (md) and case (c) read from their paths by patterns of one group."""
    docs = json_documents(spark, path, schema)
    return docs.select(F.regexp_extract("_file", model, 1).alias("md"), F.regexp_extract("_file", case, 1).alias("c"), *[f.name for f in _schema(schema)])


def packed_documents(spark: SparkSession, paths: str | Sequence[str], task_bytes: int = 64 << 20) -> DataFrame:
    """Many small files, one row each: path, length, modified and content, in as many tasks as their bytes need.

    Files are listed without being read; then the scan's tasks, which Spark sizes by the number of files where these are
    small, are joined to about one for each task_bytes, without a shuffle. Files of over that size are tasks of their own.
    """
    files = spark.read.format("binaryFile").load(paths)
    total = files.agg(F.sum("length")).head()[0] or 0
    tasks = max(1, -(-total // task_bytes))
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content").coalesce(tasks)


def compacted_documents(spark: SparkSession, paths: str | Sequence[str], to: str, keys: dict[str, str], task_bytes: int = 64 << 20) -> DataFrame:
    """Documents as a Parquet table: keys (columns read from the path by patterns of one group), text, path, length and modified.

    A later run adds only files that the table lacks, or that have changed since, whose earlier rows then no longer count. What
    comes back is the table as it is: each path once, the latest.
    """
    kind = ", ".join([*[f"{k} string" for k in keys], "text string, path string, length long, modified timestamp"])
    there = exists(spark, to)
    known = (spark.read.schema(kind).parquet(to) if there else spark.createDataFrame([], kind)).select("path", "length", "modified")
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("modified"))
    new = [r["path"] for r in files.join(known, ["path", "length", "modified"], "left_anti").select("path").collect()] if there else paths
    if new:
        docs = packed_documents(spark, new, task_bytes)
        docs.select(*[F.regexp_extract("path", p, 1).alias(k) for k, p in keys.items()], F.decode("content", "UTF-8").alias("text"), "path", "length", "modified").write.mode("append").parquet(to)
    rows = spark.read.schema(kind).parquet(to)
    last = rows.groupBy(F.col("path").alias("_path")).agg(F.max("modified").alias("_last"))
    return rows.join(last, (F.col("path") == F.col("_path")) & (F.col("modified") == F.col("_last")), "left_semi")


def provenance(stock: DataFrame, expected: DataFrame) -> DataFrame:
    """Sections of an inventory (section, files, bytes) beside the numbers that there should be (section, expected): same, differs, missing or unexpected."""
    both = stock.join(expected, "section", "full")
    found = F.when(F.col("expected").isNull(), "unexpected").when(F.col("files").isNull(), "missing").when(F.col("files") != F.col("expected"), "differs").otherwise("same")
    return both.select("section", "files", "bytes", "expected", found.alias("found"))


def judgement_tree(spark: SparkSession, folder: str, schema: str = JUDGEMENT, suffix: str = ".jsonl", model: str = r"([^/]+)/full/judgements/", rubric: str = r"([^/]+)/[^/]*$", bad_folders: bool = False) -> DataFrame:
    """All judgement files of a tree as one table, with model and rubric read from their paths (model/.../rubric/file, unless patterns say otherwise). Error files, backups and pilots don't count; bad_folders: neither do folders of such names."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    kept = rows.withColumn("path", F.col("_metadata.file_path")).filter(_is_data())
    if bad_folders:
        kept = kept.filter(_is_data(-2))
    return kept.withColumn("_rubric", F.regexp_extract("path", rubric, 1)).withColumn("_model", F.regexp_extract("path", model, 1)).drop("path")


def submissions(spark: SparkSession, path: str, answer: str) -> DataFrame:
    """annotators' answers, one row each: annotator, trial_id and the answer's fields; key and item files and unreadable ones are left out."""
    schema = f"annotator string, answers map<string,struct<{answer}>>, {_CORRUPT} string"
    docs = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    return docs.filter("answers is not null").select("annotator", F.explode("answers").alias("trial_id", "a")).select("annotator", "trial_id", "a.*")


def templates(spark: SparkSession, folder: str, suffix: str = ".txt") -> dict[str, str]:
    """Prompt templates by name: the texts of a folder's files, each named without its suffix. Configuration, so it comes to the driver; two of one name fail."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value").collect()
    found = {r["file"].removesuffix(suffix): r["value"] for r in rows}
    if len(found) < len(rows):
        raise ValueError(f"templates of one name in {folder}")
    return found


def missing_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The texts that a cache (text, vec) lacks; only these are to be embedded."""
    return texts.select("text").distinct().join(cache.select("text"), "text", "left_anti")


def cache_fingerprint(texts: DataFrame) -> DataFrame:
    """One hash of the ordered texts (text_idx, text): equal just for identical lists. Rows are hashed where they are; only hashes are gathered."""
    rows = texts.select(F.struct("text_idx", F.sha2(F.concat_ws("|", F.col("text_idx").cast("string"), "text"), 256).alias("h")).alias("x"))
    chunks = rows.groupBy(F.expr("x.text_idx div 65536").alias("c")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ","), 256).alias("h"))
    return chunks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ","), 256).alias("fingerprint"))
