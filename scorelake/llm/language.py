"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import fields, kept_by_worker, row_key, stored_rows, table
from .ngrams import subwords
from .url_filter import url_host


@dataclass
class NgramModel:
    """Log probability of each bucket of character n-grams (1 to 3, and the word) under each language."""

    languages: list[str]
    weights: np.ndarray

    def values(self, words: list[str]) -> np.ndarray:
        flat, sizes = subwords(words, 1, 3, len(self.weights))
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)


def letters(text: str | None) -> list[str]:
    """The text's words that hold a letter, in lower case."""
    return [w for w in (text or "").lower().split() if not w.isascii() or any(c.isalpha() for c in w)]


def fitted(counts: dict[str, np.ndarray], buckets: int = 1 << 16) -> NgramModel:
    """Multinomial estimates from each language's counts of buckets, smoothed by half a count."""
    languages = sorted(counts)
    every = np.full((buckets, max(1, len(languages))), 0.5)
    for i, y in enumerate(languages):
        every[:, i] += counts[y]
    return NgramModel(languages, np.log(every / every.sum(0)).astype(np.float32))


def _counted(buckets: int):
    """Of each label of a task its n-grams' counts, one row a label and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                total = held.setdefault(y, np.zeros(buckets, np.int64))
                words = letters(text.as_py())
                for a in range(0, len(words), 50_000):
                    total += np.bincount(subwords(words[a : a + 50_000], 1, 3, buckets)[0], minlength=buckets)
        for y, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([y] * (len(at) + 1), pa.string()), pa.array(np.r_[at, 0].astype(np.int32)), pa.array(np.r_[total[at], 0])], names=["y", "bucket", "n"])

    return run


def _likelihoods(model: NgramModel, key: int, room: int = 200_000):
    def likelihood(texts: list[str | None], kept: dict) -> list[list[float] | None]:
        words = [letters(t) for t in texts]
        if len(kept) > room:
            kept.clear()
        new = list({w for t in words for w in t if w not in kept})
        start = kept.get("", (0,))[0] if kept else 0  # the empty string is no word: it holds the rows
        rows = kept[""][1] if kept else np.zeros((0, model.weights.shape[1]))
        if new:
            values = np.concatenate([model.values(new[a : a + 50_000]) for a in range(0, len(new), 50_000)])
            kept.update(zip(new, range(start, start + len(new)), strict=True))
            rows = np.concatenate([rows[:start], values])
            kept[""] = (start + len(new), rows)
        out = []
        for t in words:
            if not t:
                out.append(None)
                continue
            total = rows[np.fromiter(map(kept.__getitem__, t), np.int64, len(t))].sum(0, dtype=np.float64)
            out.append((total - total.max()).tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_by_worker("language", key)
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), []
            for a in range(0, len(texts), 1000):
                found += likelihood(texts[a : a + 1000], kept)
            columns = [batch.column(c) for c in ("uid", "id", "host", "suffix", "declared")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.float64()))], names=["uid", "id", "host", "suffix", "declared", "text_ll"])

    return run


def thinned(h: Column, count: Column, per_language: int) -> Column:
    """Whether a row with a hash of 40 bits is among about twice per_language of its label's `count` rows; in doubles, so no count is too large."""
    return h.cast("double") / F.lit(float(1 << 40)) < F.lit(2.0 * per_language) / count.cast("double")


def sample_texts(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int, seed: int, row: Column | None = None) -> DataFrame:
    """Whole texts (y, text) of at most per_language rows of every label, drawn by a hash of the id and the row's place in its file.

    A label's rows are thinned to about twice per_language before they are ranked, so no task ranks a common label, and a
    label of few rows keeps them all. Rows that share an id, or are alike, are drawn each by itself.
    """
    if row is None:
        df, row = stored_rows(df, "_sample_row"), F.col("_sample_row")
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.pmod(F.xxhash64(F.col(id_col), row["place"], F.lit(seed)), F.lit(1 << 40)).alias("h"), row.alias("row"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("y"))
    counts = table(rows.groupBy("y").count())
    few = rows.join(counts, "y").filter(thinned(F.col("h"), F.col("count"), per_language))
    return few.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("h", "row"))).filter(F.col("n") <= per_language).select("y", "text")


def _grouped(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of each language by text alone, as an array, for each value of `by`."""
    sums = F.array(*[F.sum((F.col("best") == i).cast("double")) for i in range(n)])
    return rows.filter(F.col(by).isNotNull() & F.col("best").isNotNull()).groupBy(by).agg(sums.alias("counts"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    return F.transform(F.arrays_zip(counts.alias("c"), prior.alias("p")), lambda x: (x["c"] + x["p"] * weight) / (_total(counts) + F.lit(weight)))


def language_id(df: DataFrame, model: NgramModel, id_col: str = "id", text_col: str = "text", host: Column | None = None, suffix: Column | None = None, declared: Column | None = None, temper: float = 0.2, weight: float = 20.0, least: float = 0.5, row: Column | None = None) -> DataFrame:
    """uid, id, lang, posterior, text_lang and kept of every row of df.

    Posterior of a language: its text likelihood (to the power `temper`, as n-grams overlap), times the
    probability of the declared language given it, times that of the address suffix given it, times the
    host's prior. These come from one grouped aggregation each over all rows, by text alone; a host's
    prior is smoothed by `weight` rows of its domain's (its last two labels), and that by as many of all
    rows'. Joins are on written tables, so that AQE can split a hot host; none is broadcast by us.

    A row is rejected (kept false) if its text has no word with a letter, or if no language reaches
    `least`. Null and empty texts are rejected; their lang is what the other evidence says. Null hosts,
    suffixes and declared languages are no evidence. Without languages, lang is null and texts with letters are kept.
    Ties go to the first language. Ids are of any type, repeated rows are rows of their own. Empty input: empty output. Other columns are not read.
    uid is `row` (stored, unique) where given, else the number of the row in this scan.
    """
    none = F.lit(None).cast("string")
    host, suffix, declared = (none if c is None else F.nullif(c, F.lit("")) for c in (host, suffix, declared))
    rows = df.select(row_key(row), F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.alias("host"), suffix.alias("suffix"), declared.alias("declared"))
    key = crc32(model.weights.tobytes())
    scored = rows.mapInArrow(_likelihoods(model, key), fields(rows, "uid", "id", "host", "suffix", "declared", text_ll="array<double>"))
    n = len(model.languages)
    if not n:
        return scored.select("uid", "id", none.alias("lang"), F.lit(None).cast("double").alias("posterior"), none.alias("text_lang"), F.col("text_ll").isNotNull().alias("kept"))
    # place of the greatest, the first of equal ones
    first = lambda a: -F.array_max(F.transform(a, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]
    scored = scored.withColumn("best", F.when(F.col("text_ll").isNotNull(), first(F.col("text_ll"))))
    scored = table(scored.withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)))
    sums = scored.filter("best is not null").agg(*[F.count_if(F.col("best") == i).cast("double").alias(f"n{i}") for i in range(n)]).first()
    sizes = [float(x) for x in sums]
    prior = [(c + weight / n) / (sum(sizes) + weight) for c in sizes]
    all_prior = F.array(*[F.lit(p) for p in prior])
    domains = table(_grouped(scored, "domain", n).select("domain", _smoothed(F.col("counts"), all_prior, weight).alias("domain_prior")))
    hosts = _grouped(scored, "host", n).withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)).join(domains, "domain")
    hosts = table(hosts.select("host", _smoothed(F.col("counts"), F.col("domain_prior"), weight).alias("host_prior")))

    def given(by: str) -> DataFrame:
        """Log probability of each value of `by` given each language, one row of doubt added for every value."""
        some = table(_grouped(scored, by, n))
        values = some.count() + 1
        share = F.transform(F.arrays_zip(F.col("counts").alias("c"), F.array(*[F.lit(s) for s in sizes]).alias("s")), lambda x: F.log((x["c"] + 1.0) / (x["s"] + F.lit(float(values)))))
        return table(some.select(by, share.alias(f"{by}_ll")))

    zero = F.array(*[F.lit(0.0)] * n)
    full = scored.join(hosts, "host", "left").join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")
    parts = F.arrays_zip(F.coalesce("text_ll", zero).alias("a"), F.coalesce("declared_ll", zero).alias("b"), F.coalesce("suffix_ll", zero).alias("c"), F.coalesce("host_prior", all_prior).alias("d"))
    full = full.withColumn("sum", F.transform(parts, lambda x: x["a"] * F.lit(temper) + x["b"] + x["c"] + F.log(x["d"])))
    names = F.array(*[F.lit(x) for x in model.languages])
    top = F.array_max("sum")
    posterior = 1.0 / _total(F.transform("sum", lambda x: F.exp(x - top)))
    out = full.select("uid", "id", F.get(names, first(F.col("sum"))).alias("lang"), posterior.alias("posterior"), F.get(names, F.col("best")).alias("text_lang"), F.col("best").isNotNull().alias("some"))
    return out.select("uid", "id", "lang", "posterior", "text_lang", (F.col("some") & (F.col("posterior") >= least)).alias("kept"))


def html_text(html: Column) -> Column:
    """What a page shows: without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")


def html_language(html: Column) -> Column:
    """The language that the markup declares: first part of the lang of its html element, in lower case."""
    return F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1))


def documents_model(docs: DataFrame, per_language: int = 512, seed: int = 9, buckets: int = 1 << 16, row: Column | None = None) -> NgramModel:
    """The text model, learnt from a bounded sample of the documents' own language labels: whole texts of up to per_language rows of each.

    N-grams are counted in tasks and summed by Spark, so only counts come to the driver: one for each language and
    n-gram bucket. Rows without id, label or text don't teach; repeated rows teach each by itself.
    """
    found = sample_texts(docs, "doc_id", "text", "lang", per_language, seed, row).mapInArrow(_counted(buckets), "y string, bucket int, n long")
    counts: dict[str, np.ndarray] = {}
    for batch in found.groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        labels = batch.column("y").dictionary_encode()
        which, bucket, n = labels.indices.to_numpy(), batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
        for i, y in enumerate(labels.dictionary.to_pylist()):
            counts.setdefault(y, np.zeros(buckets))[bucket[which == i]] += n[which == i]
    return fitted(counts, buckets)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (its source is its host) and every page (host, address suffix and declared language)."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    none = F.lit(None).cast("string")
    long = F.lit(None).cast("long")
    rows = docs.select(F.struct(F.col("doc_id"), long.alias("page_id")).alias("id"), "text", F.col("source").alias("host"), none.alias("suffix"), none.alias("declared"))
    host = url_host(F.col("url"))
    rows = rows.unionByName(pages.select(F.struct(long.alias("doc_id"), F.col("page_id")).alias("id"), html_text(F.col("html")).alias("text"), host.alias("host"), F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"), html_language(F.col("html")).alias("declared")))
    found = language_id(rows, documents_model(docs), host=F.col("host"), suffix=F.col("suffix"), declared=F.col("declared"))
    return found.select("id.doc_id", "id.page_id", "lang", "posterior", "text_lang", "kept")
