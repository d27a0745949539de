"""Language-model scores by deleted interpolation over corpus-wide counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .durable import table

#: No word holds white space, so these two are none: the end that counts as a token, and the start that is a context only.
_END, _START = b"\n", b"\t"
#: Context-frequency buckets: 0, 1, 2-3, 4-7, and so on; the last is open.
FREQUENCIES = 16
#: Histogram cells of probability ratios are a tenth of a decade wide and 20 decades long at most.
_CELL, _SPAN = 0.1, 200

_CHUNK = "chunk long, em boolean, uids array<long>, ids array<{id}>, learnt array<boolean>, sizes array<int>, texts binary, train_tokens long, bytes long"


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


class Tokens:
    """A chunk's tokens: a local vocabulary, and unique keys of its words (odd) and pairs (even)."""

    def __init__(self, texts: list[bytes]):
        local: dict[bytes, int] = {_END: 0, _START: 1}
        number = local.setdefault
        rows = []
        for t in texts:
            rows.append([number(w, len(local)) for w in t.split()])
            rows[-1].append(0)
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.words = np.concatenate([np.zeros(0, dtype=np.int64), *[np.array(r, dtype=np.int64) for r in rows]])
        self.doc = np.repeat(np.arange(len(rows)), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.first] = 1
        self.context = before
        pair, self.pair = np.unique(before * len(local) + self.words, return_inverse=True)
        one = _mix(hashed) | np.uint64(1)
        two = _mix(hashed[pair // len(local)] * np.uint64(0x9E3779B97F4A7C15) + _mix(hashed[pair % len(local)])) & ~np.uint64(1)
        self.vocabulary = len(local)
        self.keys, self.place = np.unique(np.concatenate([one, two]), return_inverse=True)  # place: of words, then of pairs

    def own(self, use: np.ndarray) -> np.ndarray:
        """How often each key occurs at the tokens of `use`."""
        counts = np.concatenate([np.bincount(self.words[use], minlength=self.vocabulary), np.bincount(self.pair[use], minlength=len(self.place) - self.vocabulary)])
        return np.bincount(self.place, counts, len(self.keys)).astype(np.int64)

    def counts(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From totals by key: counts of each token's context, of the token and of both together."""
        word = total[self.place[: self.vocabulary]]
        word[1] = word[0]  # a text starts as often as one ends
        return word[self.context], word[self.words], total[self.place[self.vocabulary :]][self.pair]

    def deleted(self, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same without what the token's own text counts."""
        less = []
        for what in (self.context, self.words, self.pair):
            _, inverse, times = np.unique(self.doc * (int(what.max(initial=0)) + 1) + what, return_inverse=True, return_counts=True)
            less.append(times[inverse])
        return tuple(c - n for c, n in zip(counts, less, strict=True))


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed: small ones and zeros cost next to nothing."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _keys_packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of as many bytes as the widest needs."""
    steps = np.diff(keys, prepend=keys[:1])
    steps[:1] = 0
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + planes.tobytes()


def _keys_unpacked(data: bytes) -> np.ndarray:
    width, first = data[0], np.frombuffer(data[1:9], "<u8")
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    planes = np.frombuffer(data[9:], np.uint8).reshape(-1, width)
    steps = np.zeros((len(planes), 8), dtype=np.uint8)
    steps[:, :width] = planes
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype=np.uint64) + first[0]


def _texts(sizes: list[int], data: bytes) -> list[bytes]:
    data, out, at = zlib.decompress(data), [], 0
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


def _chunked(chunk_bytes: int, id_type: pa.DataType):
    """Documents gathered to chunks, those of the weight estimation apart; A-Z lower-cased."""

    def row(number: int, em: bool, held: list[tuple]) -> dict:
        texts = [t for *_, t in held]
        return {
            "chunk": (TaskContext.get().partitionId() << 32) + number, "em": em, "uids": [h[0] for h in held], "ids": [h[1] for h in held], "learnt": [h[2] for h in held],
            "sizes": [len(t) for t in texts], "texts": zlib.compress(b"".join(texts), 1), "train_tokens": sum(len(t.split()) + 1 for _, _, learnt, t in held if learnt), "bytes": sum(map(len, texts)),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size, number, shape = {False: 0, True: 0}, 0, None
        shape = pa.schema([("chunk", pa.int64()), ("em", pa.bool_()), ("uids", pa.list_(pa.int64())), ("ids", pa.list_(id_type)), ("learnt", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary()), ("train_tokens", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            for uid, i, learnt, em, text in zip(*[batch.column(c).to_pylist() for c in ("uid", "id", "learnt", "em", "text")], strict=True):
                t = (text or "").encode("utf-8", "surrogatepass").lower()
                held[em].append((uid, i, learnt, t))
                size[em] += len(t) + 16
                if size[em] >= chunk_bytes:
                    yield pa.RecordBatch.from_pylist([row(number, em, held[em])], shape)
                    held[em], size[em], number = [], 0, number + 1
        for em in (False, True):
            if held[em]:
                yield pa.RecordBatch.from_pylist([row(number, em, held[em])], shape)
                number += 1

    return run


def _token_use(tokens: Tokens, learnt: list[bool]) -> np.ndarray:
    return np.array(learnt, dtype=bool)[tokens.doc]


def _keyed(bits: int):
    """Each chunk's keys and its own training counts, cut by the keys' first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens = Tokens(_texts(r["sizes"], r["texts"]))
                own = tokens.own(_token_use(tokens, r["learnt"]))
                part = (tokens.keys >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()  # only the parts that the chunk has, however many there are
                parts = [(int(part[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in parts], pa.int32()), pa.array([r["chunk"]] * len(parts), pa.int64()), pa.array([_keys_packed(tokens.keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([_packed(own[a:b]) for _, a, b in parts], pa.binary())],
                    names=["part", "chunk", "keys", "own"],
                )

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """All chunks' keys of one part: each chunk's answer is how much more than its own count a key has in all; chunk -1 tells the part's distinct words."""
    chunks = rows.column("chunk").to_pylist()
    keys = [_keys_unpacked(k) for k in rows.column("keys").to_pylist()]
    own = [_unpacked(c) for c in rows.column("own").to_pylist()]
    every = np.concatenate(keys)
    unique, inverse = np.unique(every, return_inverse=True)
    total = np.bincount(inverse, np.concatenate(own).astype(np.float64), len(unique)).astype(np.uint64)
    out, at = [], 0
    part = rows.column("part")[0].as_py()
    for c, k, n in zip(chunks, keys, own, strict=True):
        out.append((c, part, _packed(total[inverse[at : at + len(k)]] - n), 0))
        at += len(k)
    out.append((-1, part, b"", int(((unique & np.uint64(1)) == 1)[total > 0].sum())))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["chunk", "part", "more", "words"])


def _answered(row: dict, answers: pa.Table) -> tuple[Tokens, np.ndarray]:
    """A chunk's tokens and the corpus-wide count of each of its keys."""
    tokens = Tokens(_texts(row["sizes"], row["texts"]))
    by = sorted(zip(answers.column("part").to_pylist(), answers.column("more").to_pylist(), strict=True))
    more = np.concatenate([np.zeros(0, dtype=np.uint64), *[_unpacked(m) for _, m in by]]).astype(np.int64)
    return tokens, tokens.own(_token_use(tokens, row["learnt"])) + more


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of its count's binary logarithm."""
    return np.minimum(np.frexp(np.maximum(context, 0).astype(np.float64))[1], FREQUENCIES - 1)


def _ratios(counts: tuple[np.ndarray, np.ndarray, np.ndarray], total: np.ndarray | int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood probability of each token in its context, and alone, as multiples of the uniform one."""
    context, word, pair = counts
    uniform = 1.0 / (words + 1)
    return pair / np.maximum(context, 1) / uniform, word / np.maximum(total, 1) / uniform


def _histogram(total: int, words: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells: list[np.ndarray] = []
        for row in left.to_pylist():
            tokens, sums = _answered(row, right)
            counts = tokens.deleted(tokens.counts(sums))
            two, one = _ratios(counts, total - np.repeat(tokens.lengths, tokens.lengths), words)
            with np.errstate(divide="ignore"):
                a, b = (np.where(x > 0, np.clip(np.round(np.log10(np.maximum(x, 1e-300)) / _CELL), -_SPAN, _SPAN), -_SPAN - 1).astype(np.int64) + _SPAN + 1 for x in (two, one))
            cells.append((_bucket(counts[0]) * 1000 + a) * 1000 + b)
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        return pa.table([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return run


def estimate(cells: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each context-frequency bucket by expectation-maximisation."""
    bucket, a, b = cells // 1_000_000, cells // 1000 % 1000, cells % 1000
    value = lambda x: np.where(x > 0, 10.0 ** ((x - _SPAN - 1) * _CELL), 0.0)
    p = np.stack([value(a), value(b), np.ones(len(cells))], 1)
    weights = np.tile(np.array([0.5, 0.4, 0.1]), (FREQUENCIES, 1))
    weights[0] = (0.0, 0.8, 0.2)
    for _ in range(rounds):
        mixed = p * weights[bucket]
        share = mixed / mixed.sum(1, keepdims=True) * n[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], FREQUENCIES) for k in range(3)], 1)
        full = sums.sum(1) > 0
        weights[full] = sums[full] / sums[full].sum(1, keepdims=True)
        weights = np.maximum(weights, [0.0, 0.0, 1e-6])
        weights /= weights.sum(1, keepdims=True)
    return weights


def _scored(total: int, words: int, weights: np.ndarray, id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            tokens, sums = _answered(row, right)
            counts = tokens.counts(sums)
            two, one = _ratios(counts, total, words)
            w = weights[_bucket(counts[0])]
            score = np.log10((w[:, 0] * two + w[:, 1] * one + w[:, 2]) / (words + 1)) if total else np.zeros(len(two))
            base = np.log10((counts[1] + 1) / (total + words + 1))
            sums_of = lambda x: np.add.reduceat(x, tokens.first)
            out.append(pa.table([pa.array(row["uids"], pa.int64()), pa.array(row["ids"], id_type), pa.array(tokens.lengths), pa.array(sums_of((counts[1] > 0).astype(np.int64))), pa.array(sums_of(base)), pa.array(sums_of(score))], names=["uid", "id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


def lm_score(df: DataFrame, learn: str, estimation: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, part_bytes: int = 8 << 20) -> DataFrame:
    """uid, id, n_tokens, n_known, train_tokens, base_score and score of every row of df.

    Tokens are words between white space (U+0020, U+0009 to U+000D), A-Z lower-cased, and one end a text.
    base_score adds one to every count. score mixes the maximum-likelihood estimates of the token after
    the one before it, of the token alone, and 1 / (V + 1), by weights for each bucket of the context's
    frequency. Counts are those of all rows for which the SQL condition `learn` holds. Weights come from
    expectation-maximisation over those of them for which `estimation` holds: each such text is held
    out, its own counts deleted. Its tokens reduce to a histogram of probability ratios (16 by 402 by 402 cells,
    at most, whatever the corpus), which is all that the driver gets.

    Texts are gathered to chunks of about chunk_bytes, written once. A chunk names its distinct words and
    pairs by 64-bit keys; parts of the key space (one for each part_bytes of text) sum all chunks' counts,
    and answer each chunk in the order of its own keys, so that an answer is bytes, not keys. So a key
    travels once for each chunk that has it, a frequent one too, and no table of counts is ever sent to
    all tasks. A chunk and a part are what a task holds.

    Null text: as empty, one end token. Ids are of any type, null ones stay null. Repeated rows are rows of their own. Nothing
    to learn from: N and V are 0 and both scores 0. No text for estimation: the weights' starting values.
    Empty input: empty output. Other columns are not read.
    """
    spark = df.sparkSession
    flag = lambda c: F.coalesce(F.expr(c), F.lit(False))
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), flag(learn).alias("learnt"), (flag(learn) & flag(estimation)).alias("em"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    id_type = to_arrow_schema(rows.select("id").schema).field("id").type
    chunks = table(rows.mapInArrow(_chunked(chunk_bytes, id_type), _CHUNK.format(id=kind.simpleString())))
    sizes = chunks.agg(F.sum("train_tokens").alias("n"), F.sum("bytes").alias("bytes")).first()
    total = sizes["n"] or 0
    bits = max(4, (-(-(sizes["bytes"] or 0) // part_bytes)).bit_length())
    keyed = chunks.select("chunk", "learnt", "sizes", "texts").mapInArrow(_keyed(bits), "part int, chunk long, keys binary, own binary")
    answers = table(keyed.groupBy("part").applyInArrow(_summed, "chunk long, part int, more binary, words long"))
    words = answers.filter("chunk = -1").agg(F.sum("words")).first()[0] or 0
    answers = answers.filter("chunk <> -1").select("chunk", "part", "more")
    asked = answers.groupBy("chunk")
    own = chunks.select("chunk", "em", "uids", "ids", "learnt", "sizes", "texts")
    cells = own.filter("em").groupBy("chunk").cogroup(asked).applyInArrow(_only(_histogram(total, words), {"cell": pa.int64(), "n": pa.int64()}), "cell long, n long")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = estimate(np.array([r["cell"] for r in got], dtype=np.int64), np.array([r["n"] for r in got], dtype=np.float64))
    shape = {"uid": pa.int64(), "id": id_type, "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    scored = own.groupBy("chunk").cogroup(asked).applyInArrow(_only(_scored(total, words, weights, id_type), shape), f"uid long, id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def _only(run, shape: dict):
    """Nothing for answers without their chunk."""
    empty = pa.schema(list(shape.items())).empty_table()
    return lambda left, right: run(left, right) if left.num_rows else empty


def _remainder(n: int) -> str:
    return f"crc32(coalesce(cast(doc_id as string), '')) % {n}"


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are estimated on the training documents of remainder 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = lm_score(docs, learn=f"{_remainder(7)} <> 2", estimation=f"{_remainder(7)} = 3").withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.expr(f"{_remainder(7)} = 2").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
