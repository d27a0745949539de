"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import fields, kept_by_worker
from .ngrams import subwords


def places_in(n: int, size: int) -> int:
    """Windows of n words: runs of `size`; a rest of under half that joins the last."""
    return max(1, n // size + (n % size >= size // 2))


def window_of(n: int, size: int) -> np.ndarray:
    """The window of each of n words."""
    return np.minimum(np.arange(n) // size, places_in(n, size) - 1)


@dataclass
class BagModel:
    """Mean over a window's places of the mean of each distinct word's subword weights (repeats and missing places: 0), plus a bias: the log odds of label 1."""

    weights: np.ndarray
    bias: float
    low: int
    high: int
    window: int

    def values(self, words: list[str]) -> np.ndarray:
        """The mean weight of each word's subwords."""
        if not words:
            return np.zeros(0)
        flat, sizes = subwords(words, self.low, self.high, len(self.weights))
        return np.add.reduceat(self.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes

    def logits(self, texts: list[str | None], kept: dict, room: int = 1_000_000) -> np.ndarray:
        """Greatest log odds of any window of each text; the bias alone for an empty one. kept: a cache of words' values."""
        texts = [(t or "").lower().split() for t in texts]
        if len(kept) > room:
            kept.clear()
        new = list({w for t in texts for w in t if w not in kept})
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            kept.update(zip(some, self.values(some).tolist(), strict=True))
        out = np.full(len(texts), self.bias)
        for i, words in enumerate(texts):
            values = np.fromiter(map(kept.__getitem__, words), np.float64, len(words))
            full = np.flatnonzero(values)
            if len(full):
                places = window_of(len(words), self.window)[full].tolist()
                sums: dict[int, float] = {}
                for (place, _), v in {(p, words[j]): values[j] for p, j in zip(places, full.tolist(), strict=True)}.items():
                    sums[place] = sums.get(place, 0.0) + v
                out[i] += max(0.0 if len(sums) < places_in(len(words), self.window) else -np.inf, *sums.values()) / self.window
        return out


def train(texts: list[str], labels: np.ndarray, prior: float, buckets: int = 1 << 18, dims: int = 8, low: int = 3, high: int = 6, window: int = 64, epochs: int = 6, rate: float = 0.2, batch: int = 64, least_texts: int = 4, least_z: float = 4.0, seed: int = 7) -> BagModel:
    """Fit embeddings and softmax together by Adagrad; prior: the share of label 1 to which the bias is set.

    The first epoch takes every window by its document's label. From then on a document stands for
    its highest window, as in scoring, so windows of a toxic document without anything toxic no
    longer teach. Subwords of fewer than least_texts distinct texts, and those whose share of texts doesn't differ
    between the labels by least_z standard errors, teach nothing and weigh 0: else a few thousand texts
    are told apart by their rare words.
    """
    rng = np.random.default_rng(seed)
    out = rng.normal(0, 1.0, (dims, 2))
    bias = np.zeros(2)
    g_emb, g_out, g_bias = np.full(buckets, 1e-12), np.full(out.shape, 1e-12), np.full(2, 1e-12)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()], dtype=np.int32) for t in texts]
    if not vocabulary or len(set(labels.tolist())) < 2:
        return BagModel(np.zeros(buckets, dtype=np.float32), float(np.log(prior / (1 - prior))), low, high, window)
    flat, sizes = subwords(list(vocabulary), low, high, buckets)
    first = np.cumsum(sizes) - sizes
    seen = np.zeros((2, buckets))
    distinct = {ids.tobytes(): d for d, ids in enumerate(docs)}.values()
    for d in distinct:
        seen[labels[d], np.unique(np.concatenate([flat[:0], *[flat[first[w] : first[w] + sizes[w]] for w in np.unique(docs[d])]]))] += 1
    n = np.bincount([labels[d] for d in distinct], minlength=2)
    share = seen.sum(0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(1, n[0]) + 1 / max(1, n[1])))
    taught = (seen.sum(0) >= least_texts) & (np.abs(seen[1] / max(1, n[1]) - seen[0] / max(1, n[0])) >= least_z * error)
    emb = rng.uniform(-0.01, 0.01, (buckets, dims)) * taught[:, None]
    spans = []
    for d, ids in enumerate(docs):
        if len(ids):
            ends = np.cumsum(np.bincount(window_of(len(ids), window))).tolist()
            spans += [(d, a, b) for a, b in zip([0, *ends], ends, strict=False)]
    label_weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)

    def word_logits() -> np.ndarray:
        scalar = emb @ (out[:, 1] - out[:, 0])
        return np.add.reduceat(scalar[flat], first) / sizes

    for epoch in range(epochs):
        if epoch == 0:
            use = spans
        else:
            score, best = word_logits(), {}
            for d, a, b in spans:
                s = score[np.unique(docs[d][a:b])].sum()
                if d not in best or s > best[d][0]:
                    best[d] = (s, (d, a, b))
            use = [x for _, x in best.values()]
        use = [use[i] for i in rng.permutation(len(use))]
        for at in range(0, len(use), batch):
            some = use[at : at + batch]
            y = np.array([labels[d] for d, _, _ in some], dtype=np.int64)
            weight = np.array([label_weight[d] for d, _, _ in some])
            bags = [np.unique(docs[d][a:b]) for d, a, b in some]
            words, lengths = np.concatenate(bags), np.array([len(x) for x in bags])
            row = np.repeat(np.arange(len(some)), lengths)
            counts = sizes[words]
            where = np.repeat(first[words] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            feats, share, frow = flat[where], np.repeat(1.0 / counts, counts), np.repeat(row, counts)
            used = taught[feats]
            feats, share, frow = feats[used], share[used], frow[used]
            hidden = np.stack([np.bincount(frow, share * emb[feats, k], len(some)) for k in range(dims)], 1)
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = p
            err[np.arange(len(y)), y] -= 1
            err *= weight[:, None] / len(some)
            d_out, d_bias, d_hidden = hidden.T @ err, err.sum(0), err @ out.T
            g_out += d_out**2
            g_bias += d_bias**2
            out -= rate * d_out / np.sqrt(g_out)
            bias -= 0.1 * rate * d_bias / np.sqrt(g_bias)
            used, inverse = np.unique(feats, return_inverse=True)
            d_emb = np.stack([np.bincount(inverse, share * d_hidden[frow, k], len(used)) for k in range(dims)], 1)
            g_emb[used] += (d_emb**2).mean(1)
            emb[used] -= rate * d_emb / np.sqrt(g_emb[used])[:, None]
    # classes weigh the same above; scores are to be at home where label 1 has its real share
    return BagModel((window * (emb @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0] + np.log(prior / (1 - prior))), low, high, window)


def _scores(model: BagModel, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("toxicity", key)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            logits = np.concatenate([np.zeros(0), *[model.logits(texts[a : a + 1000], known) for a in range(0, len(texts), 1000)]])
            score = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(score)], names=["uid", "id", "score"])

    return run


def sample_labelled(df: DataFrame, labels: DataFrame, learn: str, id_col: str, text_col: str, label_col: str, per_class: int, seed: int) -> tuple[list[str], np.ndarray, float]:
    """Whole texts and labels of at most per_class rows of each label, least hash first, and the share of label 1.

    So 2 * per_class texts come to the driver. A row labelled twice has the higher label.
    """
    marked = labels.filter(learn).filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    prior = marked.agg(F.avg("y")).first()[0]
    rank = F.xxhash64("id", F.lit(seed))
    picked = marked.filter("y = 1").orderBy(rank, "id").limit(per_class).unionByName(marked.filter("y = 0").orderBy(rank, "id").limit(per_class))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(picked), "id").orderBy(rank, "id", "text").limit(2 * per_class).collect()
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.int64), min(0.99, max(0.01, prior or 0.5))


def toxicity(df: DataFrame, labels: DataFrame, learn: str = "true", id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2048, seed: int = 7) -> DataFrame:
    """uid, id and score (0 to 1, higher: label 1 likelier) of every row of df.

    A word is the mean of its subwords' embeddings (character n-grams of 3 to 6 and the word, hashed to
    2**18 buckets), so an unseen misspelling shares most of its vectors with the word it hides. A window
    of about 64 words has 64 places: its vector is the mean over them of its distinct words, repeats and places
    without a word being blanks, under a linear softmax. A text scores as its highest window, so that a toxic
    passage isn't thinned out by the rest. Subwords that differ too little between the labels weigh 0 (see train). After training both layers are one
    weight a bucket: a megabyte, whatever the corpus, is all that is sent to the tasks.

    It learns from at most per_class rows of each label (see sample_labelled) for which the SQL condition
    `learn` holds; every row is scored, over its whole text. Only the text is an input of a score.
    Null and empty texts get the bias's score. Without labels of both kinds every score is their share
    (0.5 without any). Empty input: empty output. Ids are of any type. Repeated rows score alike; other columns are not read.
    """
    texts, y, prior = sample_labelled(df, labels, learn, id_col, text_col, label_col, per_class, seed)
    model = train(texts, y, prior, seed=seed)
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = crc32(model.weights.tobytes())
    return rows.mapInArrow(_scores(model, key), fields(rows, "uid", "id", score="double"))


HELD_OUT = "crc32(coalesce(cast(doc_id as string), '')) % 5 = 0"


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity(docs, labels, learn=f"not ({HELD_OUT})").withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
