"""Connected components of a large edge table, without ever collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import table


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) with the least node connected to it, itself left out: as many edges as a spanning forest has."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]]
    for batch in batches:
        for i in (0, 1):
            held[i].append(batch.column(i).to_numpy())
    root, node = forest(*map(np.concatenate, held))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["old", "new"])


def components(edges: DataFrame, max_rounds: int = 200, few: int = 10_000) -> DataFrame:
    """(node, root) for every node of edges (a, b): nodes have one root just when they are connected.

    Each round every node adopts its neighbour (or itself) of least hash, under a hash drawn anew
    each round, and edges are rewritten between adopters. An edge's ends map to the ends of an edge,
    so components stay whole, and a random order shrinks any shape, long chains too, by a constant
    factor a round. Adoption is an aggregate with partial sums; the joins are between written tables,
    so AQE can split those of a node with very many edges. The last `few` edges (16 bytes each, by
    their count) are settled in one task. Empty edges give an empty result.
    """
    edges = table(edges.select("a", "b").filter("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    roots = table(nodes.select("node", F.col("node").alias("root")))
    for number in range(max_rounds):
        left = edges.count()
        if left <= few:
            if not left:
                return roots
            last = table(edges.coalesce(1).mapInArrow(_rest, "old long, new long"))
            return table(roots.join(last.withColumnRenamed("old", "root"), "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("v"))
        adopted = table(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("old"), F.least(rank("a"), F.col("m")).getField("v").alias("new")))
        to = lambda c: adopted.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))
        half = table(edges.join(to("a"), "a").select(F.col("a_new").alias("a"), "b"))
        edges = table(half.join(to("b"), "b").select("a", F.col("b_new").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        roots = table(roots.join(to("root"), "root", "left").select("node", F.coalesce("root_new", "root").alias("root")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
