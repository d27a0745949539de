"""The corpus pipeline: language, exact and near copies, source weights, tokens.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last
return the columns of documents. Stages that join decisions back key each row by its file and its place
in it: decision and drop read the same key, however the two scans are split, and docs are not copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.durable import stored_rows, table
from scorelake.llm.exact_dedup import exact_dedup
from scorelake.llm.language import documents_model, language_id
from scorelake.llm.mixing import mix
from scorelake.llm.sentencepiece import sentencepiece_encode
from scorelake.llm.simhash import simhash_dedup

#: Keys of rows to drop go to every task up to so many (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Keyed docs without the rows in dropped (column _row)."""
    dropped = table(dropped)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "_row", "left_anti").drop("_row")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word of letters, or of no likely language, go."""
    docs = stored_rows(docs)
    found = language_id(docs, documents_model(docs), id_col="doc_id", host=F.col("source"), row=F.col("_row"))
    return _without(docs, found.filter("not kept").select(F.col("uid").alias("_row")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    docs = stored_rows(docs)
    return _without(docs, exact_dedup(docs, row=F.col("_row")).filter("not kept").select(F.col("uid").alias("_row")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    docs = stored_rows(docs)
    found = table(simhash_dedup(docs, row=F.col("_row")))
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("a"), "id", "uid")).alias("least")).select(F.col("least.uid").alias("uid"))
    return _without(docs, found.join(stays, "uid", "left_anti").select(F.col("uid").alias("_row")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies: words taken by its size, halves rounded up."""
    columns, docs = docs.columns, stored_rows(docs)
    copies = mix(docs, row=F.col("_row")).taken().select(F.col("uid").alias("_row"), F.expr("CASE WHEN size = 0 THEN 0 ELSE cast(floor(taken / size + 0.5) as int) END").alias("_copies")).filter("_copies > 0")
    every = docs.join(copies, "_row")
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*[F.col(f"`{c}`") for c in columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces and byte_pieces of every document."""
    return sentencepiece_encode(docs).withColumnRenamed("id", "doc_id").drop("uid")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Fingerprints, schedules and segmentations are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = table(docs)
    return docs
