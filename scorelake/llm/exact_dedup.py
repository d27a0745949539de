"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import row_key, table

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """text without any white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for w in WHITE:
        out = F.replace(out, F.lit(w), F.lit(""))
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, filter_bits: int = 1 << 22, digest_all: bool = False, row: Column | None = None) -> DataFrame:
    """One row per row of df: uid, id, keep_id, group_size, kept, full_hash.

    Texts are equal when identical without white space. The row with the most code points in its
    original text stays, then the smallest id (null ids last), then the first of fully repeated rows.

    Levels one and two (length; length and hash of the first prefix_chars characters) are one
    aggregated table, since the groups of the first are unions of those of the second. Its groups of
    two rows or more set bits in a filter of filter_bits bits: the only thing that is broadcast,
    filter_bits / 64 rows of 16 bytes at most, whatever the corpus. Rows that miss the filter are
    unique and are not hashed in full (unless digest_all asks for everyone's hash); a false positive
    costs one hash. Only hashes of survivors are shuffled, never texts. Raise filter_bits with the
    number of groups; a full filter loses its savings, not its rightness.

    Null text: as empty; all empty texts are one group. Empty input: empty output. Other columns are
    not read, so their names can't clash. uid is `row`, a stored and unique key of any type that sorts, where
    given; else it numbers the rows of this scan, and is good for nothing outside the result.
    """
    norm = df.select(row_key(row), F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"), squeezed(F.col(text_col)).alias("norm"))
    coarse = [F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix")]
    slot = F.pmod(F.xxhash64("len", "prefix"), F.lit(filter_bits))
    alive = (
        norm.select(*coarse).groupBy("len", "prefix").count().filter("count > 1")
        .select(slot.alias("slot")).select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
        .groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    )
    probed = norm.select("uid", "id", "chars", "norm", *coarse).withColumn("slot", slot).withColumn("word", F.expr("slot div 64"))
    hit = F.expr("coalesce(shiftrightunsigned(bits, cast(slot % 64 as int)) & 1L, 0L) = 1L")
    digests = table(
        probed.join(F.broadcast(alive), "word", "left").withColumn("alive", hit)
        .select("uid", "id", "chars", "len", "alive", F.when(F.col("alive") | F.lit(digest_all), F.sha2("norm", 256)).alias("full_hash"))
    )
    survivors = digests.filter("alive")
    # grouped by hash alone and joined on (hash, len): the join deals its sides anew, so that AQE can split a hot group
    best = survivors.groupBy("full_hash").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("uid").alias("d"))).alias("best"))
    grouped = survivors.join(best, ["full_hash", "len"]).select("uid", "id", F.col("best.c").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.d")).alias("kept"), "full_hash")
    alone = digests.filter("not alive").select("uid", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash")
    return grouped.unionByName(alone)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS rn,
             first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM r
"""
