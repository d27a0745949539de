"""A cache of rewritten texts, in buckets by content hash; a null answer means: asked, unchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "text_key string, text string, rewrite string"


class RewriteCache:
    """A table of the session's warehouse: text_key (SHA-256 of the text), text and rewrite, bucketed and sorted by the key.

    A lookup joins texts to it bucket by bucket: the cache is not shuffled, and texts that are bucketed alike
    (`bucketed`) are not either. New answers stay in the bucket where they were asked.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            self._written(spark.createDataFrame([], _COLUMNS), name)

    def _written(self, df: DataFrame, name: str) -> None:
        df.write.bucketBy(self.buckets, "text_key").sortBy("text_key").option("compression", "zstd").mode("append").format("parquet").saveAsTable(name)

    def bucketed(self, texts: DataFrame, name: str, text: str = "text") -> DataFrame:
        """texts as a table with their key, bucketed as the cache is, for lookups without any shuffle."""
        self._written(self._keyed(texts.drop("text_key"), text), name)
        return self.spark.table(name)

    def _keyed(self, texts: DataFrame, text: str) -> DataFrame:
        return texts if "text_key" in texts.columns else texts.withColumn("text_key", F.sha2(F.col(text), 256)).repartition(self.buckets, "text_key")

    def unasked(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """The distinct texts that the cache lacks: text_key and text. Null texts are never asked."""
        fresh = self._keyed(texts, text).filter(F.col(text).isNotNull()).join(self.spark.table(self.name).select("text_key"), "text_key", "left_anti")
        return fresh.groupBy("text_key").agg(F.first(text).alias("text"))

    def fill(self, texts: DataFrame, ask: Callable[[list[str]], list[str | None]], text: str = "text", batch: int = 100) -> int:
        """Ask for the texts that the cache lacks, in batches, and keep the answers, null ones too: how many were asked.

        Answers become part of the cache all at once, when the job is done; a job that fails is asked again.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), batch):
                    part = pdf.iloc[a : a + batch]
                    answers = ask(part["text"].tolist())
                    if len(answers) != len(part):
                        raise ValueError(f"{len(part)} texts were asked and {len(answers)} answered")
                    yield part.assign(rewrite=pd.Series(answers, index=part.index, dtype=object))

        before = self.spark.table(self.name).count()
        self._written(self.unasked(texts, text).mapInPandas(run, _COLUMNS), self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).count() - before

    def rewritten(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """texts with final (the rewrite, or the text itself where it stays) and changed (null for a text that was never asked)."""
        known = self.spark.table(self.name).select("text_key", F.col("rewrite").alias("_rewrite"), F.lit(True).alias("_asked"))
        both = self._keyed(texts, text).join(known, "text_key", "left")
        changed = F.when(F.col("_asked"), F.col("_rewrite").isNotNull() & (F.col("_rewrite") != F.col(text)))
        return both.select(*texts.columns, F.coalesce("_rewrite", text).alias("final"), changed.alias("changed"))
