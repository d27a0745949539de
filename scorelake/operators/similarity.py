"""Similarity joins of unit vectors over parts around pivots: a row meets only the parts that can hold a partner.

Each row of the right side belongs to its nearest pivot, and to a part of those around it by its angle. A row
x at angle a to the pivot of a part whose rows lie at angles low to high from it is, by the triangle inequality of
angles, at least max(a - high, low - a) away from all of them, so it goes to the part only where that is within its reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import table

#: Angles are cut into so many rings before these are merged into parts.
RINGS = 64
#: Rounding of cosines may move an angle by less than this.
SLACK = 1e-6
#: A row is copied to about so many blocks at most, until blocks have MOST_ROWS rows.
COPIES = 16
MOST_ROWS = 16384
#: Entries of one product of a slice of x with y.
TILE = 1 << 22


@dataclass
class Bounds:
    """Pivots (rows), and each part's pivot and its rows' least and greatest angle to it."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Parts:
    """The filed right side: bounds, how many blocks each part has, the blocks (part, block, rows), and each row's part."""

    bounds: Bounds
    blocks_of: np.ndarray
    blocks: DataFrame
    homes: DataFrame


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to pivots; pi / 2 for zero rows."""
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows of a sample, each the farthest from those before it; equal ones once."""
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(most, len(sample)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        picked.append(far)
        near = np.maximum(near, sample @ sample[far])
    return sample[picked]


def filed(rows: DataFrame, block: int, most_pivots: int = 1024) -> Parts | None:
    """Rows (pos, vec) as parts of about `block` rows; those larger have several blocks. None without rows.

    Pivots come from a sample of at most four times as many rows, which the driver holds, as it does the counts of each
    pivot's rings; both are bounded by most_pivots. Zero vectors make up a part that every row meets.
    """
    n = rows.count()
    if not n:
        return None
    spark, most = rows.sparkSession, min(most_pivots, max(1, -(-n // (2 * block))))
    some = rows.filter(F.exists("vec", lambda v: v != 0)).orderBy(F.xxhash64("pos"), "pos").limit(4 * most).select("vec").collect()
    pivots = spread_out(np.array([r["vec"] for r in some], dtype=np.float64), most) if some else np.zeros((1, len(rows.head()["vec"])))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            angles = _angles(x, pivots)
            nearest = angles.argmin(1) if len(x) else np.zeros(0, np.int64)
            angle = angles[np.arange(len(x)), nearest]
            ring = np.where((x == 0).all(1), -1, np.minimum(RINGS - 1, (angle * (RINGS / np.pi)).astype(int)))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("vec"), pa.array(nearest.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(angle)], names=["pos", "vec", "pivot", "ring", "angle"])

    at = table(rows.select("pos", "vec").mapInArrow(placed, "pos long, vec array<double>, pivot int, ring int, angle double"))
    found = at.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    parts: list[list] = []
    last, of = None, []
    for r in sorted(found, key=lambda r: (r["ring"] >= 0, r["pivot"], r["ring"])):
        zero = r["ring"] < 0
        if last == (r["pivot"], zero) and (zero or parts[-1][3] < block):
            parts[-1][2], parts[-1][3] = max(parts[-1][2], r["high"]), parts[-1][3] + r["n"]
        else:
            parts.append([r["pivot"], 0.0 if zero else r["low"], np.pi if zero else r["high"], r["n"]])
        last = (r["pivot"], zero)
        of.append((r["pivot"], r["ring"], len(parts) - 1))
    pivot, low, high, size = (np.array(c) for c in zip(*parts, strict=True))
    blocks_of = np.maximum(1, -(-size.astype(np.int64) // block))
    of = spark.createDataFrame([(p, r, s, int(blocks_of[s])) for p, r, s in of], "pivot int, ring int, part int, blocks int")
    homes = at.join(F.broadcast(of), ["pivot", "ring"]).select("pos", "vec", "part", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int").alias("block"))
    blocks = homes.groupBy("part", "block").agg(F.collect_list(F.struct("pos", "vec")).alias("rows"))
    return Parts(Bounds(pivots, pivot.astype(np.int64), low.astype(np.float64), high.astype(np.float64)), blocks_of, table(blocks), homes)


def _routed(parts: Bounds, nearest: bool, ordered: bool):
    """The parts that each row (pos, vec, reach, at_least) goes to: all within its reach, or only the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, reach, least = _matrix(batch.column("vec")), batch.column("reach").to_numpy(), batch.column("at_least").to_numpy()
            sizes, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            step = max(1, 2_000_000 // len(parts.pivot))
            for a in range(0, len(x), step):
                angle = _angles(x[a : a + step], parts.pivots)[:, parts.pivot]
                gap = np.maximum(np.maximum(angle - parts.high, parts.low - angle), 0)
                if nearest:  # of parts that may hold a partner at no distance the one whose pivot is nearest
                    sizes.append(np.ones(len(gap), np.int64))
                    targets.append((gap * 4 + angle).argmin(1).astype(np.int32))
                    continue
                goes = gap <= reach[a : a + step, None] + SLACK
                other = least[a : a + step, None]
                goes &= (np.arange(gap.shape[1]) >= other) if ordered else (np.arange(gap.shape[1]) != other)
                sizes.append(goes.sum(1))
                targets.append(np.nonzero(goes)[1].astype(np.int32))
            ends = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("pos", "vec", "reach", "at_least")], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(targets)))], names=["pos", "vec", "reach", "at_least", "parts"])

    return run


def meetings(left: DataFrame, parts: Parts, block: int, nearest: bool = False, ordered: bool = False) -> DataFrame:
    """Pairs of blocks that meet: part, x (rows of left: pos, vec, reach, at_least) and y (rows of the part).

    Left rows have a reach (an angle) and a part: with `ordered` the first that they go to, else one that they
    leave out (-1 for none). Rows of a part are dealt over blocks of about `block`, on both sides.
    """
    spark = left.sparkSession
    routed = table(left.select("pos", "vec", "reach", "at_least").mapInArrow(_routed(parts.bounds, nearest, ordered), "pos long, vec array<double>, reach double, at_least int, parts array<int>"))
    each = routed.select("pos", "vec", "reach", "at_least", F.explode("parts").alias("part"))
    counts = each.groupBy("part").count().collect()
    deal = spark.createDataFrame([(r["part"], int(-(-r["count"] // block)), int(parts.blocks_of[r["part"]])) for r in counts], "part int, dealt int, blocks int")
    dealt = each.join(F.broadcast(deal), "part").withColumn("mine", F.pmod(F.xxhash64("pos"), F.col("dealt")))
    x = dealt.groupBy("part", "mine").agg(F.collect_list(F.struct("pos", "vec", "reach", "at_least")).alias("x"), F.first("blocks").alias("blocks"))
    x = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return x.join(parts.blocks.withColumnRenamed("rows", "y"), ["part", "block"]).select("part", "x", "y")


def _copies(left: DataFrame, parts: Parts, some: int = 512) -> float:
    """Blocks that a row of left (pos, vec, reach) goes to, on average over `some` rows of a draw."""
    drawn = left.orderBy(F.xxhash64("pos"), "pos").limit(some).select("vec", "reach").collect()
    if not drawn:
        return 0.0
    angle = _angles(np.array([r["vec"] for r in drawn], dtype=np.float64), parts.bounds.pivots)[:, parts.bounds.pivot]
    gap = np.maximum(angle - parts.bounds.high, parts.bounds.low - angle)
    return float(((gap <= np.array([[r["reach"]] for r in drawn])) * parts.blocks_of).sum(1).mean())


def _fitting(rows: DataFrame, left: DataFrame, block: int) -> tuple[Parts | None, int]:
    """Rows (pos, vec) filed for left (pos, vec, reach), and the size of blocks: fine ones where most never meet; where each row would be copied to more than COPIES of them, as much larger, up to MOST_ROWS, so that the rows moved grow with the rows and not with their pairs."""
    block = max(block, min(MOST_ROWS, -(-rows.count() // 2048)))
    parts = filed(rows, block)
    copies = _copies(left, parts) if parts is not None else 0
    if copies <= COPIES or block >= MOST_ROWS:
        return parts, block
    block = min(MOST_ROWS, round(block * copies / COPIES))
    return filed(rows, block), block


def _cosines(x: pa.Scalar, y: pa.Scalar) -> Iterator[tuple[pa.StructArray, pa.StructArray, np.ndarray]]:
    """Slices of x with y and their products, of about TILE entries each."""
    x, y = x.values, y.values
    of_y = _matrix(y.field("vec")).T
    step = max(1, TILE // max(1, len(y)))
    for a in range(0, len(x), step):
        part = x.slice(a, step)
        yield part, y, _matrix(part.field("vec")) @ of_y


def _rows(df: DataFrame, pos: str, vec: str) -> DataFrame:
    return df.select(F.col(pos).cast("long").alias("pos"), F.col(vec).cast("array<double>").alias("vec")).filter("pos is not null and vec is not null")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, pos: str = "pos", vec: str = "vec", block: int = 1024, ordered: bool = False) -> DataFrame:
    """Pairs (a, b, cos) of rows of left and right at cosine >= threshold; ordered: of right with itself (left is not read), only a < b.

    Vectors are unit ones or zero (`unit`), of one length; rows without a position or vector pair with none. Where the
    data have clusters narrower than the threshold most parts never meet; where they have none (or the threshold
    is low) every block meets every other, as the definition then asks. Only pairs at the threshold leave a task.
    """
    reach = float(np.arccos(np.clip(threshold, -1, 1))) if threshold > 0 else np.pi
    rows = table(_rows(right, pos, vec))
    x = rows if ordered else table(_rows(left, pos, vec))
    parts, block = _fitting(rows, x.withColumn("reach", F.lit(reach)), block)
    if parts is None:
        return right.sparkSession.createDataFrame([], "a long, b long, cos double")
    if ordered:
        x = parts.homes.select("pos", "vec", F.lit(reach).alias("reach"), F.col("part").alias("at_least"))
    else:
        x = x.select("pos", "vec", F.lit(reach).alias("reach"), F.lit(-1).alias("at_least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s, t in zip(batch.column("part").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                for x, y, cos in _cosines(s, t):
                    i, j = np.nonzero(cos >= threshold)
                    a, b = x.field("pos").to_numpy()[i], y.field("pos").to_numpy()[j]
                    if ordered:  # within a part both ways are met, between two only one
                        keep = (a < b) | (x.field("at_least").to_numpy()[i] != part)
                        a, b, i, j = np.minimum(a, b)[keep], np.maximum(a, b)[keep], i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cos[i, j])], names=["a", "b", "cos"])

    return meetings(x, parts, block, ordered=ordered).mapInArrow(run, "a long, b long, cos double")


def greatest_cosine(left: DataFrame, right: DataFrame, block: int = 1024, pos: str = "pos", vec: str = "vec") -> DataFrame:
    """Each row of left with its greatest cosine to right and the first row that has it; 0 and null if right is empty.

    Equal vectors of right count once, by their first row. A row first meets the nearest part; the best
    found there is its reach, and it meets only the parts within it that may hold a nearer one (or an equal, earlier one).
    What a task finds below a row's best so far stays there. Rows of left without a vector have 0 and null.
    """
    every = left.select(F.col(pos).cast("long").alias("pos"))
    distinct = table(_rows(right, pos, vec).groupBy("vec").agg(F.min("pos").alias("pos")))
    x = table(_rows(left, pos, vec))
    zero = ~F.exists("vec", lambda v: v != 0)
    parts, block = _fitting(distinct, x.filter(~zero).withColumn("reach", F.lit(float(np.pi / 3))), block)
    none = every.select("pos", F.lit(0.0).alias("cos"), F.lit(None).cast("long").alias("other"))
    if parts is None:
        return none
    first = int(distinct.agg(F.min("pos")).head()[0])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s, t in zip(batch.column("part").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                for x, y, cos in _cosines(s, t):
                    there = y.field("pos").to_numpy()
                    most = cos.max(1)
                    top = np.where(cos == most[:, None], there, np.iinfo(np.int64).max).min(1)  # of equal cosines the first row's
                    keep = np.arccos(np.clip(most, -1, 1)) <= x.field("reach").to_numpy() + SLACK
                    yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (x.field("pos").to_numpy(), most, top, np.full(len(top), part, np.int32))], names=["pos", "cos", "other", "part"])

    kind = "pos long, cos double, other long, part int"
    some = x.filter(~zero).select("pos", "vec", F.lit(float(np.pi)).alias("reach"), F.lit(-1).alias("at_least"))
    order = F.max(F.struct("cos", (-F.col("other")).alias("o"), "part")).alias("m")
    near = table(meetings(some, parts, block, nearest=True).mapInArrow(best, kind).groupBy("pos").agg(order).select("pos", "m.cos", (-F.col("m.o")).alias("other"), "m.part"))
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos"))))
    again = x.filter(~zero).join(near.select("pos", reach.alias("reach"), F.col("part").alias("at_least")), "pos")
    more = meetings(again, parts, block).mapInArrow(best, kind)
    found = near.unionByName(more).groupBy("pos").agg(order).select("pos", "m.cos", (-F.col("m.o")).alias("other"))
    found = found.unionByName(x.filter(zero).select("pos", F.lit(0.0).alias("cos"), F.lit(first).cast("long").alias("other")))
    return every.join(found, "pos", "left").select("pos", F.coalesce("cos", F.lit(0.0)).alias("cos"), "other")


def case_pairs(rows: DataFrame, threshold: float, case: str = "case", block: int = 1024) -> DataFrame:
    """Pairs (case, a < b, cos) of one case's rows (case, pos, vec) at cosine >= threshold.

    A case is a rubric, so mostly one block; a larger one is dealt over several, and every block of a case
    meets itself and those after it, as one matrix product each.
    """
    rows = rows.select(F.col(case).alias("case"), F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and pos is not null")
    sizes = table(rows.groupBy("case").count().select("case", F.ceil(F.col("count") / block).alias("blocks")).filter("blocks > 1"))
    dealt = rows.join(sizes, "case", "left").withColumn("i", F.coalesce(F.pmod(F.xxhash64("pos"), F.col("blocks")), F.lit(0)))
    blocks = table(dealt.groupBy("case", "i").agg(F.collect_list(F.struct("pos", "vec")).alias("rows")))
    a, b = blocks.withColumnRenamed("rows", "x"), blocks.select(F.col("case").alias("of"), F.col("i").alias("j"), F.col("rows").alias("y"))
    kind = rows.schema["case"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, first, second, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for k, (same, s, t) in enumerate(zip(batch.column("same").to_pylist(), batch.column("x"), batch.column("y"), strict=True)):
                for x, y, cos in _cosines(s, t):
                    i, j = np.nonzero(cos >= threshold)
                    a, b = x.field("pos").to_numpy()[i], y.field("pos").to_numpy()[j]
                    keep = (a < b) | (not same)
                    at.append(np.full(int(keep.sum()), k))
                    first.append(np.minimum(a, b)[keep])
                    second.append(np.maximum(a, b)[keep])
                    found.append(cos[i, j][keep])
            yield pa.RecordBatch.from_arrays([batch.column("case").take(pa.array(np.concatenate(at))), *[pa.array(np.concatenate(c)) for c in (first, second, found)]], names=["case", "a", "b", "cos"])

    met = a.join(b, F.col("case").eqNullSafe(F.col("of")) & (F.col("i") <= F.col("j"))).select("case", (F.col("i") == F.col("j")).alias("same"), "x", "y")
    return met.mapInArrow(run, f"case {kind}, a long, b long, cos double")
