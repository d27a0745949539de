"""Vector code compression: product codebooks by Yinyang Lloyd rounds over integer vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import forgotten, new_path, sums_joined, table

_NONE = np.iinfo(np.int64).max


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to integer entries: in doubles while these are exact, else in 64-bit integers."""
    span = float(np.abs(x).max(initial=0)) + float(np.abs(entries).max(initial=0))
    if x.shape[1] * span * span < 2**52:
        f, e = x.astype(np.float64), entries.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Groups of a codebook's entries: a few rounds of Lloyd over the entries themselves, from evenly spread ones."""
    centres = entries[np.linspace(0, len(entries) - 1, groups).astype(int)].astype(np.float64)
    for _ in range(rounds):
        of = ((entries[:, None, :] - centres) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (of == g).any():
                centres[g] = entries[of == g].mean(0)
    return of


@dataclass
class Book:
    """The codebook of one part position, its entries' groups, and how far each entry moved since the last assignment."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(int(self.group.max()) + 1)]

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Book:
        """The entries after a round: floor(sum / count) of their parts; unused ones stay."""
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], self.entries)
        return Book(new, self.group, np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(1)))


@dataclass
class State:
    """Of each part: its entry, an upper bound of the distance to it, and for each group a lower bound of the distance to every other entry of the group."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def _down(x: np.ndarray) -> np.ndarray:
    return (x - np.abs(np.where(np.isinf(x), 0, x)) * 1e-6).astype(np.float32)


def _up(x: np.ndarray) -> np.ndarray:
    return (x * (1 + 1e-6)).astype(np.float32)


def assigned(book: Book, x: np.ndarray, state: State | None) -> tuple[State, int]:
    """The nearest entry of each part, ties to the lower index, and how many distances were worked out.

    Without a state every entry is scanned. With one, bounds first move by the drifts. A part whose lower
    bounds are all above its upper one keeps its entry; else the upper bound is made exact, and
    only groups whose bound is not above it are scanned. Bounds are rounded outwards and must differ
    for an entry to be passed over; whatever may tie is compared in integers.
    """
    n, every, members = len(x), np.arange(len(x)), book.members()
    if state is None:
        state = State(np.zeros(n, np.uint8), np.full(n, np.inf, np.float32), np.full((n, len(members)), -np.inf, np.float32))
        todo, done = every, 0
    else:
        far = np.array([book.drift[m].max(initial=0) for m in members])
        upper = _up(state.upper.astype(np.float64) + book.drift[state.code])
        lower = _down(state.lower.astype(np.float64) - far)
        todo = np.flatnonzero(lower.min(1) <= upper)
        own = np.zeros(len(todo), np.int64)
        for k in np.unique(state.code[todo]):
            mine = state.code[todo] == k
            own[mine] = distances(x[todo[mine]], book.entries[k : k + 1])[:, 0]
        upper[todo] = _up(np.sqrt(own.astype(np.float64)))
        done = len(todo)
        state = State(state.code.copy(), upper, lower)
        more = state.lower[todo].min(1) <= upper[todo]
        todo, own = todo[more], own[more]
    if not len(todo):
        return state, done
    need, old = state.lower[todo] <= state.upper[todo][:, None], state.code[todo]
    found = np.full((len(todo), len(book.entries)), _NONE)
    if done or not np.isinf(state.upper[todo]).any():
        found[np.arange(len(todo)), old] = own
    for g, m in enumerate(members):
        rows = np.flatnonzero(need[:, g])
        if len(rows) and len(m):
            found[np.ix_(rows, m)] = distances(x[todo[rows]], book.entries[m])
            done += len(rows) * len(m)
    best = found.argmin(1)
    at = np.arange(len(todo))
    state.code[todo] = best
    state.upper[todo] = _up(np.sqrt(found[at, best].astype(np.float64)))
    found[at, best] = _NONE
    for g, m in enumerate(members):
        other = found[:, m].min(1, initial=_NONE)
        bound = _down(np.where(other == _NONE, np.inf, np.sqrt(other.astype(np.float64))))
        state.lower[todo, g] = np.where(need[:, g], bound, np.minimum(state.lower[todo, g], bound))
    return state, done


def _cuts(dims: int, parts: int) -> list[int]:
    """Where parts begin and end; where dims is no multiple the first parts are longer by one."""
    return np.r_[0, np.cumsum([dims // parts + (p < dims % parts) for p in range(parts)])].tolist()


_STATE = "n int, kind string, x binary, code binary, upper binary, lower binary, sums array<bigint>, scanned bigint"
_NAMES = [column.split()[0] for column in _STATE.split(", ")]


class _Round:
    """One assignment of blocks of vectors: their new state, and for each part position and entry the sums and counts of its parts."""

    def __init__(self, books: list[Book], dims: int):
        self.books, self.cuts, self.dims = books, _cuts(dims, len(books)), dims

    def of(self, x: np.ndarray, states: list[State | None]) -> tuple[list[State], int]:
        both = [assigned(b, x[:, p:q], s) for b, p, q, s in zip(self.books, self.cuts[:-1], self.cuts[1:], states, strict=True)]
        return [s for s, _ in both], sum(n for _, n in both)

    def held(self, x: np.ndarray, states: list[State], scanned: int) -> dict:
        sums = []
        for b, p, q, s in zip(self.books, self.cuts[:-1], self.cuts[1:], states, strict=True):
            one = np.zeros((len(b.entries), len(x)))
            one[s.code, np.arange(len(x))] = 1
            exact = np.abs(x).max(initial=0) * len(x) < 2**53
            part = np.c_[x[:, p:q], np.ones(len(x), np.int64)]
            sums.append((one @ part).astype(np.int64).ravel() if exact else (one.astype(np.int64) @ part).ravel())
        kind = "<i2" if np.abs(x).max(initial=0) < 2**15 else "<i4"
        return {"n": len(x), "kind": kind, "x": x.astype(kind).tobytes(), "sums": np.concatenate(sums), "scanned": scanned} | {k: b"".join(getattr(s, k).tobytes() for s in states) for k in ("code", "upper", "lower")}

    def read(self, r: dict) -> tuple[np.ndarray, list[State]]:
        n, parts = r["n"], len(self.books)
        x = np.frombuffer(r["x"], r["kind"]).reshape(n, self.dims).astype(np.int64)
        code, upper, lower = np.frombuffer(r["code"], np.uint8).reshape(parts, n), np.frombuffer(r["upper"], np.float32).reshape(parts, n), np.frombuffer(r["lower"], np.float32)
        at, states = 0, []
        for p, b in enumerate(self.books):
            g = int(b.group.max()) + 1
            states.append(State(code[p], upper[p], lower[at : at + n * g].reshape(n, g)))
            at += n * g
        return x, states


def _begun(step: _Round, scale: float, block: int, names: list[str]):
    """Blocks of the vectors of a task, assigned by full scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                some = batch.slice(a, block)
                vectors = some.column("v")
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(flat * scale).astype(np.int64).reshape(some.num_rows, step.dims)
                states, scanned = step.of(x, [None] * len(step.books))
                row = step.held(x, states, scanned)
                whole = pa.array([0, some.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, some.column(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*lists, *_columns(row)], names=[*names, *_NAMES])

    return run


def _columns(row: dict) -> list[pa.Array]:
    kinds = {"n": pa.int32(), "kind": pa.string(), "sums": pa.list_(pa.int64()), "scanned": pa.int64()}
    return [pa.array([row[k]], kinds.get(k, pa.binary())) for k in _NAMES]


def _again(step: _Round, names: list[str]):
    """The next assignment of blocks, by their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                some = batch.slice(a, 1)
                x, states = step.read({k: some.column(k)[0].as_py() for k in ("n", "kind", "x", "code", "upper", "lower")})
                states, scanned = step.of(x, states)
                row = step.held(x, states, scanned)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], *_columns(row)], names=[*names, *_NAMES])

    return run


def _ended(step: _Round, names: list[str]):
    """The last assignment: code and exact error of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                some = batch.slice(a, 1)
                x, states = step.read({k: some.column(k)[0].as_py() for k in ("n", "kind", "x", "code", "upper", "lower")})
                states, _ = step.of(x, states)
                error = sum(((x[:, p:q] - b.entries[s.code]) ** 2).sum(1) for b, s, p, q in zip(step.books, states, step.cuts[:-1], step.cuts[1:], strict=True))
                data = np.stack([s.code for s in states], axis=1).tobytes().hex()
                wide = 2 * len(step.books)
                codes = pa.array([data[i : i + wide] for i in range(0, len(data), wide)], pa.string())
                yield pa.RecordBatch.from_arrays([*[some.column(c).flatten() for c in names], codes, pa.array(error, pa.int64())], names=[*names, "code", "error"])

    return run


@dataclass
class Coded:
    """rows: uid, id, label, code and error of every vector; books: the final entries of each part position; scanned: distances worked out in each round."""

    rows: DataFrame
    books: list[np.ndarray]
    scanned: list[int]

    def digest(self) -> str:
        """SHA-256 of all final entries' components in decimal: by part, entry and position."""
        return sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, block: int = 1024) -> Coded:
    """Codes of vectors: each of `parts` equal parts by the nearest of its position's `entries` codebook entries, and the codebooks.

    Components become floor(scale * x). A codebook starts as that part of the rows of smallest id (of equal ids
    the smaller vector, null ids last). Each round assigns every part to its nearest entry, ties to the
    lower index, and moves every entry to its parts' floored mean. This is Yinyang Lloyd: entries are put into
    groups once (`groups`, else a quarter as many as entries), and each part keeps between rounds an upper bound and
    one lower bound a group, so later rounds scan only groups whose bound, less the group's drift, fails. All sums are
    of integers, so neither partitions nor bounds change a result.

    Blocks of vectors and their bounds are written once a round, with the sums of the block's parts beside them;
    the table before the last is deleted once the next is whole. The driver gets entries x (components + parts) sums
    a round, aggregated by Spark, however many vectors there are.

    Vectors that are null or hold null or non-finite components take no part, nor those of
    another length than the row of smallest id, nor those whose scaled components are too large for
    exact 64-bit sums of squares (2^30 / sqrt(length)). Fewer vectors than entries: as many entries as vectors. None: no rows and
    empty books. A length that is no multiple of parts makes the first parts longer by one. Ids
    and labels are of any types that sort, repeated rows are rows of their own; other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    spark = vectors.sparkSession
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    most = F.lit(float(2**30)) / F.sqrt(F.greatest(F.size("v"), F.lit(1)))
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(scale)) < most)))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    names = ["uid", "id", "label"]
    kinds = {n: rows.schema[n].dataType for n in names}
    out = T.StructType([T.StructField(n, kinds[n]) for n in names] + T.StructType.fromDDL("code string, error bigint").fields)
    if not first:
        return Coded(spark.createDataFrame([], out), [np.zeros((0, 0), np.int64)] * parts, [])
    dims = len(first[0]["v"])
    rows = rows.filter(F.size("v") == dims)
    if any(len(r["v"]) != dims for r in first):
        first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.floor(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), dims) * scale).astype(np.int64)
    cuts, books = _cuts(dims, parts), []
    for p, q in zip(cuts[:-1], cuts[1:], strict=True):
        some = start[:, p:q]
        books.append(Book(some, grouped(some, min(len(some), groups or max(1, entries // 4))), np.zeros(len(some))))
    state = T.StructType([T.StructField(n, T.ArrayType(kinds[n])) for n in names] + T.StructType.fromDDL(_STATE).fields)
    path, before, scanned = "", "", []
    for turn in range(rounds):
        step = _Round([*books], dims)
        blocks = rows.mapInArrow(_begun(step, scale, block, names), state) if not turn else spark.read.schema(state).parquet(path).mapInArrow(_again(step, names), state)
        before, path = path, new_path(spark)
        blocks.write.parquet(path)
        if before:
            forgotten(spark, before)
        found = spark.read.schema(state).parquet(path)
        totals = found.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        scanned.append(found.agg(F.sum("scanned")).head()[0])
        flat = np.zeros(sum(b.entries.size + len(b.entries) for b in books), np.int64)
        flat[[r["at"] for r in totals]] = [r["x"] for r in totals]
        at = 0
        for i, b in enumerate(books):
            size = b.entries.size + len(b.entries)
            sums = flat[at : at + size].reshape(len(b.entries), -1)
            books[i] = b.moved(sums[:, :-1], sums[:, -1])
            at += size
    if not rounds:
        path = new_path(spark)
        rows.mapInArrow(_begun(_Round([*books], dims), scale, block, names), state).write.parquet(path)
    coded = table(spark.read.schema(state).parquet(path).mapInArrow(_ended(_Round([*books], dims), names), out))
    forgotten(spark, path)
    return Coded(coded, [b.entries for b in books], scanned)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector, the errors' sum of its label, and the digest of the codebooks."""
    coded = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label_col="label")
    sums = coded.rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    found = sums_joined(coded.rows, sums, ["label"], "uid")
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same rounds in SQL, every part against every entry."""
    out = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT uid, p, CAST(v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS DOUBLE[]) AS x FROM v, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, uid - 1 AS k, x AS c FROM s WHERE uid <= {entries})"""
    ]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT uid, p, (min((d, k)))[1] AS d, (min((d, k)))[2] AS k
  FROM (SELECT s.uid, s.p, k, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) AS d FROM s JOIN c{r} c ON c.p = s.p) GROUP BY uid, p)""")
        if r < rounds:
            out.append(f"""m{r} AS (
  SELECT p, k, list(floor(t / n) ORDER BY i) AS c
  FROM (SELECT s.p, a.k, i, sum(x[i]) AS t, count(*) AS n FROM s JOIN a{r} a USING (uid, p), (SELECT unnest(range(1, 9)) AS i) GROUP BY s.p, a.k, i) GROUP BY p, k),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.k = c.k)""")
    out.append(f"""e AS (SELECT uid, string_agg(printf('%02x', CAST(k AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY uid),
h AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM c{rounds}, (SELECT unnest(range(1, 9)) AS i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (uid), h""")
    return ",\n".join(out)


OP11_SQL = _oracle()
