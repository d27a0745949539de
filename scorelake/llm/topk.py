"""Exact top-k inner-product search over vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import new_path, table

def quantised(values: list | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) of every component, or None where the vector takes no part."""
    if values is None:
        return None
    x = np.array([np.nan if v is None else v for v in values], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    return x if np.isfinite(x).all() else None


def exact_products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with rows: in doubles while these are exact, else in Python's integers, held to 64 bits."""
    if q.size * float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) < 2**53:
        return (rows @ q).astype(np.int64)
    big = [int(v) for v in q]
    lo, hi = -(2**63), 2**63 - 1
    return np.array([min(hi, max(lo, sum(a * int(b) for a, b in zip(big, r, strict=True)))) for r in rows], dtype=np.int64)


def cells_of(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of every component, and the lowest and highest member of each cell and dimension.

    Cells' edges are the block's own quantiles, so cells are about equally full.
    """
    n, dims = rows.shape
    cells = 1 << bits
    order = np.sort(rows, axis=0)
    at = (np.arange(1, cells) * n) // cells
    cell, low, high = np.empty((n, dims), dtype=np.uint8), np.zeros((cells, dims)), np.zeros((cells, dims))
    for d in range(dims):
        edges = order[at, d]
        cell[:, d] = np.searchsorted(edges, rows[:, d], side="right")
        left = np.searchsorted(order[:, d], np.r_[-np.inf, edges], side="left")
        right = np.r_[left[1:], n]
        full = right > left
        low[full, d] = order[left[full], d]
        high[full, d] = order[right[full] - 1, d]
    return cell, low, high


class ApproximationFile:
    """One block's cells: bounds of every inner product, without the vectors."""

    def __init__(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray):
        dim = np.arange(cell.shape[1])
        self._low, self._high = low[cell, dim], high[cell, dim]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of each query (rows) with each vector (columns)."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        slack = 1e-6 * (1 + np.abs(queries).sum(1, keepdims=True))
        low = plus @ self._low.T + minus @ self._high.T
        high = plus @ self._high.T + minus @ self._low.T
        room = slack + 1e-9 * np.maximum(np.abs(low), np.abs(high))
        return low - room, high + room


def search(rows: np.ndarray, q: np.ndarray, high: np.ndarray, floor: float, ids: np.ndarray, skip: int, k: int, step: int = 32) -> list[tuple[int, int]]:
    """The k best (score, place) that may reach the floor, ties to the smaller id, exact vectors read in order of their bound until no other can enter."""
    places = np.flatnonzero(high >= floor)
    places = places[places != skip]
    places = places[np.argsort(-high[places], kind="stable")]
    best: list[tuple[int, int, int]] = []
    for start in range(0, len(places), step):
        if len(best) == k and high[places[start]] < best[-1][0] * -1:
            break
        some = places[start : start + step]
        scores = exact_products(q, rows[some].astype(np.float64))
        best = sorted(best + [(-int(s), int(ids[p]), int(p)) for s, p in zip(scores, some, strict=True)])[:k]
    return [(-s, p) for s, _, p in best]


_BLOCK = "dims int, uids binary, ids binary, cells binary, low binary, high binary, kind string, exact binary"


def _filed(scale: float, bits: int, block: int):
    """Blocks of equally long vectors: their cells, and the vectors themselves in a column that a scan of the cells doesn't read."""

    def filed(ids: list, uids: list, rows: list) -> pd.DataFrame:
        m = np.stack(rows)
        cell, low, high = cells_of(m, bits) if m.shape[1] else (np.zeros(m.shape, np.uint8), np.zeros((1, 0)), np.zeros((1, 0)))
        columns = (np.array(uids, np.int64), np.array(ids, np.int64), cell, low, high)
        kind = next(t for t, most in (("<i2", 2**15), ("<i4", 2**31), ("<f8", np.inf)) if np.abs(m).max(initial=0) < most)
        return pd.DataFrame([(m.shape[1], *[c.tobytes() for c in columns], kind, m.astype(kind).tobytes())], columns=["dims", "uids", "ids", "cells", "low", "high", "kind", "exact"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list, list]] = {}
        for pdf in batches:
            for uid, i, v in zip(pdf["uid"], pdf["place"], pdf["v"], strict=True):
                q = quantised(v, scale)
                if q is None:
                    continue
                ids, uids, rows = held.setdefault(len(q), ([], [], []))
                ids.append(i)
                uids.append(uid)
                rows.append(q)
                if len(rows) >= max(64, min(block, (1 << 20) // max(1, len(q)))):
                    yield filed(*held.pop(len(q)))
        for some in held.values():
            yield filed(*some)

    return run


def _blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, ApproximationFile, pd.Series]]:
    for pdf in batches:
        for _, r in pdf.iterrows():
            uids, dims = np.frombuffer(r["uids"], "<i8"), r["dims"]
            cell = np.frombuffer(r["cells"], np.uint8).reshape(len(uids), dims)
            low, high = (np.frombuffer(r[c], "<f8").reshape(-1, dims) if dims else np.zeros((1, 0)) for c in ("low", "high"))
            yield dims, uids, ApproximationFile(cell, low, high), r


def _floors(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """For each query the k greatest lower bounds of all the blocks of a task; reads cells only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {dims: np.full((len(quids), k), -np.inf) for dims, (quids, _) in queries.items()}
        for dims, uids, file, _ in _blocks_of(batches):
            quids, qs = queries.get(dims, ((), ()))
            for a in range(0, len(quids), 256):
                low, _ = file.bounds(qs[a : a + 256])
                low[np.asarray(quids[a : a + 256])[:, None] == uids[None, :]] = -np.inf
                both = np.concatenate([best[dims][a : a + 256], low], axis=1)
                best[dims][a : a + 256] = -np.partition(-both, k - 1, axis=1)[:, :k]
        for dims, low in best.items():
            pdf = pd.DataFrame({"query": np.repeat(queries[dims][0], k), "low": low.ravel()})
            yield pdf[pdf["low"] > -np.inf]

    return run


def _searched(queries: dict[int, tuple[np.ndarray, np.ndarray]], floors: dict[int, float], k: int):
    """The k best of one block of queries in all the blocks of a task: exact vectors only where the bound reaches the query's floor, or the k-th best that the task has found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[int, int, int]]] = {}  # (-score, id, uid), least first
        for dims, uids, file, r in _blocks_of(batches):
            quids, qs = queries.get(dims, ((), ()))
            ids, rows = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["exact"], r["kind"]).reshape(len(uids), dims)
            where = {int(u): i for i, u in enumerate(uids)}
            for a in range(0, len(quids), 256):
                _, high = file.bounds(qs[a : a + 256])
                for j in range(len(high)):
                    u = int(quids[a + j])
                    held = best.get(u, [])
                    floor = max(floors.get(u, -np.inf), -held[-1][0] if len(held) == k else -np.inf)
                    found = search(rows, qs[a + j], high[j], floor, ids, where.get(u, -1), k)
                    if found:
                        best[u] = sorted(held + [(-s, int(ids[p]), int(uids[p])) for s, p in found])[:k]
        out = [(u, uid, i, -s) for u, held in best.items() for s, i, uid in held]
        yield pd.DataFrame(out, columns=["query", "uid", "place", "score"])

    return run


def exact_topk(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, bits: int = 4, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """The k greatest integer inner products of each query row with every other row: query_id, rank, id, score.

    Components become floor(scale * x). Vectors are filed once, in blocks of `block` rows (fewer of very
    long ones): the cells of their components, and the vectors in a column of their own. Queries (rows where
    the SQL condition is_query on the id holds) are taken in blocks of about query_block, the only thing
    that the driver and the tasks hold of them, each in two scans. The first reads cells only, and the k-th
    greatest lower bound over all blocks is a query's floor. The second reads, of the vectors whose upper
    bound reaches the floor, the exact ones in order of their bound until the k-th result is certain. Both keep k
    rows a query and task, however many blocks of vectors it has. What a block of queries finds is written before the
    next, so memory does not grow with their number; a scan of the files is shared by query_block queries, so that
    its work is their products and not its reading.

    Vectors that are null or hold null or non-finite components, or whose scaled components are
    infinite, take no part, neither do rows with a null id. Vectors of another length are not compared.
    Ids are of any type that sorts. Equal scores go to the smaller id, then to the earlier row; repeated ids
    are rows of their own, and a query leaves out only its own row. With fewer than k candidates all are
    returned. Scores beyond 64 bits are held to the ends of that range. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    rows = table(rows.withColumn("is_query", F.coalesce(F.expr(is_query), F.lit(False))))
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    # within a task ties go by the id where it is a whole number; other ids are ranked first, in their order
    names = rows.select("uid", "id", F.col("id").cast("long").alias("place")) if whole else table(_ranked(rows.select("uid", "id")))
    placed = rows.select("uid", F.col("id").cast("long").alias("place"), "v") if whole else rows.select("uid", "v").join(names.select("uid", "place"), "uid")
    files = table(placed.mapInPandas(_filed(scale, bits, block), _BLOCK))
    asked = rows.filter("is_query").select("uid", "v")
    waves = max(1, -(-asked.count() // query_block))
    found = new_path(spark)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "place", "uid")
    last = Window.partitionBy("query").orderBy(F.desc("low"))
    for wave in range(waves):
        by: dict[int, tuple[list, list]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("uid"), F.lit(waves)) == wave).toLocalIterator():
            q = quantised(r["v"], scale)
            if q is not None:
                uids, qs = by.setdefault(len(q), ([], []))
                uids.append(r["uid"])
                qs.append(q)
        queries = {d: (np.array(u, dtype=np.int64), np.array(q, dtype=np.float64).reshape(len(u), d)) for d, (u, q) in by.items()}
        lows = files.select("dims", "uids", "cells", "low", "high").mapInPandas(_floors(queries, k), "query long, low double")
        floors = {r["query"]: r["low"] for r in lows.withColumn("n", F.row_number().over(last)).filter(F.col("n") == k).collect()}
        part = files.mapInPandas(_searched(queries, floors, k), "query long, uid long, place long, score long")
        part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).write.mode("append").parquet(found)
    top = spark.read.schema("query long, uid long, place long, score long, rank int").parquet(found)
    asked_names, found_names = (rows.select(F.col("uid").alias(u), F.col("id").alias(i)) for u, i in (("query", "query_id"), ("uid", "id")))
    return top.join(asked_names, "query").join(found_names, "uid").select("query_id", "rank", "id", "score")


def _ranked(rows: DataFrame, chunks: int = 4096) -> DataFrame:
    """uid, id and place: the number of the id in order, by ranges of about equal size, so that no task sorts all."""
    parted = table(rows.repartitionByRange(chunks, "id").withColumn("part", F.spark_partition_id()))
    sizes = parted.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.dense_rank().over(Window.partitionBy("part").orderBy("id"))
    return parted.withColumn("n", inside).join(before, "part").select("uid", "id", (F.col("before") + F.col("n")).alias("place"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP10_SQL = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS uid,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.uid AS qu, b.vec_id, b.uid,
             CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.uid <> b.uid),
r AS (SELECT *, row_number() OVER (PARTITION BY qu ORDER BY score DESC, vec_id, uid) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
