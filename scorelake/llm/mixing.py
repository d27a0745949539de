"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Native: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import row_key, table


def word_count(text: Column) -> Column:
    """Runs of other characters than U+0020 and U+0009 to U+000D; 0 for null."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))).cast("long")


def _offsets(rows: DataFrame, group: str, chunk: str, value: Column, wide: int = 4096) -> DataFrame:
    """Sum of value over a group's earlier chunks: one row for each (group, chunk).

    In two levels, runs of `wide` chunks and the runs themselves, so a task has that many rows of a group, or a row for each run.
    """
    totals = rows.groupBy(group, chunk).agg(F.sum(value).alias("total")).withColumn("run", F.expr(f"`{chunk}` div {wide}"))
    earlier = lambda by, order: F.coalesce(F.sum("total").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = table(totals.withColumn("inside", earlier((group, "run"), chunk)))
    runs = totals.groupBy(group, "run").agg(F.sum("total").alias("total"))
    before = runs.select(F.col(group).alias("_group"), F.col("run").alias("_run"), earlier((group,), "run").alias("before"))
    both = totals.join(before.hint("merge"), totals[group].eqNullSafe(before["_group"]) & (totals["run"] == before["_run"]))
    return table(both.select(group, chunk, (F.col("before") + F.col("inside")).alias("offset")))


@dataclass
class Mix:
    """sources: sid, source, size, target, words (the target in whole words), blocks, slots, cut (words of the last slot). docs: uid, id, sid, size.
    schedule: slot, sid, rank, epoch, block, words. pieces: uid, sid, block, at, words (a document's words in a block, and where they begin in it)."""

    sources: DataFrame
    docs: DataFrame
    schedule: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """uid, id, size, source_size, target and taken (words, repeats counted) of every document."""
        block = self.schedule.groupBy("sid", "block").agg(F.count_if(F.col("words").isNull()).alias("times"), F.max("words").alias("cut"))
        part = F.greatest(F.lit(0), F.least(F.col("words"), F.coalesce("cut", F.lit(0)) - F.col("at")))
        # these sides grow with the documents, so none is to be broadcast
        took = self.pieces.join(block.hint("merge"), ["sid", "block"]).groupBy("uid").agg(F.sum(F.col("words") * F.col("times") + part).alias("taken"))
        per_source = self.sources.select("sid", F.col("size").alias("source_size"), "target")
        return self.docs.join(took.hint("merge"), "uid", "left").join(per_source, "sid").select("uid", "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def targets(sizes: DataFrame, cycle: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """sid, source, size and target of each source (source, size).

    Sources by code point, null last, get the weights of `cycle` in turn and share `share` times all
    sizes; no target exceeds `ceiling` times its source's size, and what is above is shared anew by
    weight. That is a water level: sources in order of ceiling by weight are full until one is not.
    One row a source meets in one task, so sources are to be a dimension (thousands), not a fact.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("sid", F.row_number().over(every).cast("long"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    rows = rows.withColumn("w", F.element_at(weights, ((F.col("sid") - 1) % len(cycle) + 1).cast("int"))).withColumn("cap", F.col("size") * F.lit(float(ceiling)))
    level = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    below, whole = level.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    rows = rows.withColumn("lambda", rest / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    water = F.min(F.when(F.col("lambda") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "sid", "lambda"))).over(whole).getField("lambda")
    return rows.withColumn("water", water).select("sid", "source", "size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("w"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, block_words: int = 1024, chunk_rows: int = 500, seed: int = 42, row: Column | None = None) -> Mix:
    """Plan a mix of all rows of df that takes `target` words of each source, to the nearest word.

    A source's documents, shuffled by a hash of id and text, form one stream of words, cut into blocks
    of block_words words, the same for all sources (a source's last one may be short). A source gets as
    many slots as its target holds blocks: all of them once for each time that the target holds the whole
    source, then from the first one on; the last slot may take the first words of its block only.
    Slots are van der Corput points: slot numbers with their bits reversed fall into the sources'
    cumulative numbers of slots, so each source's slots are spread evenly. A source's slots are ranked, and
    the k-th takes block k modulo the source's blocks: every block once before any twice. So a document is
    taken `ceiling` times at most.

    Streams and ranks are prefix sums in two levels, by chunks of the order and inside each.
    Their number follows that of all rows (about chunk_rows rows a chunk), so a source with a third of them is
    many small windows. Sums of chunks grow with the rows, so they are merged, never broadcast. Reruns agree whatever the partitions.

    Null text: size 0, nothing taken. A null source is a source. Null ids and repeated rows are rows of
    their own. Empty input: empty plan. Other columns are not read. uid is `row` (stored, unique) where
    given, else the number of the row in this scan. Ids are of any type that sorts.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    rows = df.select(row_key(row), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("h"))
    rows = table(rows)
    chunk_bits = max(4, (rows.count() // chunk_rows).bit_length())
    sized = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), cycle, share, ceiling)
    sources = sized.withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.expr(f"(size + {block_words - 1}) div {block_words}"))
    rest = F.expr("CASE WHEN size > 0 THEN words % size ELSE 0L END")
    sources = sources.withColumn("rest", rest).withColumn("slots", F.expr(f"CASE WHEN size > 0 THEN (words div size) * blocks ELSE 0L END + (rest + {block_words - 1}) div {block_words}"))
    sources = table(sources.withColumn("cut", F.when(F.col("rest") > 0, (F.col("rest") - 1) % block_words + 1)).drop("rest"))

    docs = rows.join(sources.select("sid", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name"))).select("uid", "id", "sid", "size", "h")
    docs = table(docs.withColumn("chunk", F.shiftrightunsigned("h", 64 - chunk_bits)))
    within = Window.partitionBy("sid", "chunk").orderBy("h", "id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.filter("size > 0").withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(_offsets(docs, "sid", "chunk", F.col("size")).hint("merge"), ["sid", "chunk"]).withColumn("start", F.col("offset") + F.col("before"))
    pieces = placed.select("uid", "sid", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    at = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    pieces = pieces.select("uid", "sid", "block", at.alias("at"), (F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)) - at).alias("words"))

    runs = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    spans = table(sources.select("sid", "blocks", "slots", "cut", F.coalesce(F.sum("slots").over(runs), F.lit(0)).alias("first")))
    total = spans.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (max(1, total) - 1).bit_length())
    step = 4096
    starts = spans.filter("slots > 0").select("sid", "blocks", "slots", "cut", "first", F.explode(F.expr(f"sequence(0L, slots - 1, {step}L)")).alias("a"))
    points = starts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("sid", "blocks", "slots", "cut", F.explode(F.expr(f"sequence(first + a, first + least(a + {step - 1}, slots - 1))")).alias("v"))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("v"), bits, "0")), 2, 10).cast("long")
    slots = points.select("sid", "blocks", "slots", "cut", reversed_bits.alias("slot")).withColumn("chunk", F.expr(f"slot div {max(1, (1 << bits) >> chunk_bits)}"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = slots.withColumn("n", F.row_number().over(inside)).join(_offsets(slots, "sid", "chunk", F.lit(1)).hint("merge"), ["sid", "chunk"]).withColumn("rank", F.col("offset") + F.col("n") - 1)
    schedule = table(ranked.select("slot", "sid", "rank", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"), F.when(F.col("rank") == F.col("slots") - 1, F.col("cut")).alias("words")))
    return Mix(sources, docs.select("uid", "id", "sid", "size"), schedule, pieces)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken().drop("uid").withColumnRenamed("id", "doc_id")
