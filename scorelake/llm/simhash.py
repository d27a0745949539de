"""SimHash near-deduplication with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import fields, row_key, table
from .graph import components, forest

#: Set bits of each byte value, lowest bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the text's word shingles as an unsigned 64-bit number; 0 for no words."""
    some = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only ASCII white space
    if not some:
        return 0
    joined = b" ".join(some)
    width = min(words, len(some))
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(some) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(fps)], names=["uid", "id", "fp"])

    return run


#: A ring of five segments of a fingerprint, their bits, and how many bits may differ: l segments of a chain may hold l * BITS / 5, rounded down.
RING, BITS = (13, 13, 13, 13, 12), 4
_FROM = np.cumsum((0, *RING[:-1]))


def turned(fps: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints with the ring turned so that segment `start` has the lowest bits."""
    by = np.uint64(_FROM[start])
    return fps if not by else (fps >> by) | (fps << (np.uint64(64) - by))


def chain(diff: np.ndarray, start: int) -> np.ndarray:
    """Whether the chain of turned differences from its first segment keeps each of its sums within its budget."""
    ok, upto = np.ones(len(diff), dtype=bool), 0
    for n in range(1, len(RING)):
        upto += RING[(start + n - 1) % len(RING)]
        ok &= np.bitwise_count(diff & np.uint64((1 << upto) - 1)) <= n * BITS // len(RING)
    return ok


def pigeonring(diff: np.ndarray) -> np.ndarray:
    """Whether a difference has a chain from some segment. Every one of BITS bits or fewer does; most others don't."""
    return np.logical_or.reduce([chain(turned(diff, s), s) for s in range(len(RING))])


def _keys(fps: np.ndarray, start: int) -> np.ndarray:
    """The first three segments of turned fingerprints (rows), as they are and with each bit of the second and third flipped (columns)."""
    widths = [RING[(start + n) % len(RING)] for n in range(3)]
    flips = [0] + [1 << b for b in range(widths[0], sum(widths))]
    return (fps & np.uint64((1 << sum(widths)) - 1))[:, None] ^ np.array(flips, dtype=np.uint64)[None, :]


def _meet(keys: np.ndarray, fps: np.ndarray, start: int, dense: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, int]:
    """Links among turned fingerprints that share a key: ends, the members of runs of over `dense`, and how many pairs a chain let through."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    size = np.repeat(sizes, sizes)
    crowded = np.unique(fps[size > dense])
    some = np.flatnonzero((size > 1) & (size <= dense))
    keys, fps, room = keys[some], fps[some], (np.repeat(first + sizes, sizes) - np.arange(len(size)))[some]
    low = np.uint64((1 << sum(RING[(start + n) % len(RING)] for n in range(3))) - 1)
    a_ends, b_ends, through = [], [], 0
    for step in range(1, int(room.max(initial=1))):
        at = np.flatnonzero(room > step)
        a, b, key = np.minimum(fps[at], fps[at + step]), np.maximum(fps[at], fps[at + step]), keys[at]
        diff = a ^ b
        d = diff & low
        flip = np.where(np.bitwise_count(d) == 2, d & (~d + np.uint64(1)), np.uint64(0))
        once = key == (a & low) ^ flip  # of the numbers that both reach, the pair is taken at one: the lesser's own, or its lower differing bit flipped
        found = once & chain(diff, start)
        through += int(found.sum())
        found &= np.bitwise_count(diff) <= BITS
        a_ends.append(a[found])
        b_ends.append(b[found])
    return a_ends, b_ends, crowded, through


def _back(fps: np.ndarray, start: int) -> np.ndarray:
    by = np.uint64(_FROM[start])
    return (fps if not by else (fps << by) | (fps >> (np.uint64(64) - by))).view(np.int64)


def _linked(dense: int, keyed: bool, rows: int = 1 << 16):
    """Links (a, b) of a partition's fingerprints by ring start and key; a member of a crowded run is linked to itself; start -1 counts pairs that passed a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not got:
            return
        start, key, fps = (np.concatenate(x) for x in zip(*got, strict=True))
        fps = fps.view(np.uint64)
        order = np.lexsort((key, start))
        start, key, fps = start[order], key[order], fps[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (key[1:] != key[:-1])]), len(key)]
        at = 0
        while at < len(cuts) - 1:  # whole groups of one first segment, of one start, about so many rows at once
            upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + rows, side="right")) - 1)
            upto = min(upto, int(np.searchsorted(cuts, np.searchsorted(start, start[cuts[at]], side="right"))))
            s, some = int(start[cuts[at]]), fps[cuts[at] : cuts[upto]]
            if keyed:
                keys, members = key[cuts[at] : cuts[upto]].view(np.uint64), some
            else:
                every = _keys(some, s)
                keys, members = every.ravel(), np.repeat(some, every.shape[1])
            a, b, crowded, through = _meet(keys, members, s, dense)
            root, node = forest(np.concatenate([np.zeros(0, np.uint64), *a]), np.concatenate([np.zeros(0, np.uint64), *b]))
            ends = [pa.array(np.concatenate([_back(x, s), _back(crowded, s)])) for x in (root, node)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(np.full(len(ends[0]), s, dtype=np.int32))], names=["a", "b", "start"])
            yield pa.RecordBatch.from_arrays([pa.array([through], pa.int64()), pa.array([len(members)], pa.int64()), pa.array([-1], pa.int32())], names=["a", "b", "start"])
            at = upto

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of crowded first segments, by all keys of their first three."""
    for batch in batches:
        start, fps = batch.column("start").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        for s in np.unique(start).tolist():
            some = fps[start == s]
            for a in range(0, len(some), 4096):
                every = _keys(some[a : a + 4096], s)
                n = every.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, dtype=np.int32)), pa.array(every.ravel().view(np.int64)), pa.array(np.repeat(some[a : a + 4096], every.shape[1]).view(np.int64))], names=["start", "key", "fp"])


def _ball(bits: int):
    """Every number within `bits` flips of each fingerprint, as (key, fp)."""
    flips = [0] + [sum(1 << b for b in some) for n in range(1, bits + 1) for some in combinations(range(64), n)]
    masks = np.array(flips, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 256):
                some = fps[a : a + 256]
                keys = (some[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(some, len(masks)).view(np.int64))], names=["key", "fp"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, fp), members of a key linked to its least one; no key has more members than a ball."""
    got = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if got:
        key, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        root, node = forest(np.repeat(fp[first], np.diff(np.r_[first, len(key)])), fp)
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], names=["a", "b"])


def links(fps: DataFrame, dense: int = 256, hot: int = 1 << 18) -> DataFrame:
    """Pairs (a, b) that connect just those distinct fingerprints (column fp) that chains of links at 4 or fewer differing bits connect.

    Pigeonring: of two such fingerprints, cut into a ring of five segments, some run of segments holds
    at most 0, 1, 2 and 3 differing bits in its first one, two, three and four. So each fingerprint is
    sent to five places, by ring start and first segment, which must be equal: the only shuffle. There the
    chain goes on: at most one flip on either side in the second and third segment takes a pair to a common
    39-bit key, and only pairs that keep every budget of the chain come to the full count.

    First segments of over `hot` fingerprints (40960 segments at most, the one thing collected) are dealt
    by those 39-bit keys instead. Runs of over `dense` members of one key are not paired off: their members
    link to the least fingerprint of every number within two flips. Two fingerprints share such a number
    just when they differ in 4 bits or fewer, so no link is lost, and the work is linear in the members.
    Each task passes on a spanning forest of the links it finds.
    """
    spark = fps.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = [F.when(F.col("start") == s, F.shiftrightunsigned("fp", int(n)).bitwiseOR(F.shiftleft("fp", 64 - int(n)))) for s, n in enumerate(_FROM) if n]
    rows = fps.select("fp", F.explode(F.array(*[F.lit(s) for s in range(len(RING))])).alias("start"))
    rows = rows.select("start", F.coalesce(*turns, "fp").alias("fp"))
    head = F.when(F.col("start") == 4, F.col("fp").bitwiseAND(F.lit((1 << RING[4]) - 1))).otherwise(F.col("fp").bitwiseAND(F.lit((1 << RING[0]) - 1)))
    rows = rows.select("start", head.alias("key"), "fp")
    number = fps.count()
    heavy = [] if number <= hot else [(r["start"], r["key"]) for r in rows.groupBy("start", "key").count().filter(F.col("count") > hot).collect()]
    shape = "a long, b long, start int"
    parts = max(least, number * len(RING) // 1_000_000)
    if heavy:
        names = spark.createDataFrame(heavy, "start int, key long")
        full = rows.join(F.broadcast(names), ["start", "key"], "left_semi").select("start", "fp").mapInArrow(_spread, "start int, key long, fp long")
        rows = rows.join(F.broadcast(names), ["start", "key"], "left_anti")
    found = rows.repartition(parts, "start", "key").mapInArrow(_linked(dense, False), shape)
    if heavy:
        found = found.unionByName(full.repartition(parts * 27, "start", "key").mapInArrow(_linked(dense, True), shape))
    found = table(found)
    crowded = table(found.filter("start >= 0 and a = b").select(F.col("a").alias("fp")).distinct())
    found = found.filter("start >= 0 and a <> b").select("a", "b")
    members = crowded.count()
    if members:
        ball = crowded.repartition(max(least, members // 1000), "fp").mapInArrow(_ball(2), "key long, fp long")
        found = found.unionByName(ball.repartition(max(least, members * 2081 // 2_000_000), "key").mapInArrow(_stars, "a long, b long"))
    return found


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, dense: int = 256, row: Column | None = None) -> DataFrame:
    """uid, id, fp (signed 64 bits), root and component_id of every row of df.

    The fingerprint: A-Z lower-cased, words split at U+0020 and U+0009 to U+000D, shingles of `words`
    words (all of them, if fewer), XXH64 of each, repeats counted; a bit is 1 if set in over half.
    Fingerprints link at 4 or fewer differing bits; component_id is the smallest id reachable, root a
    fingerprint that names the component.

    Copies share a fingerprint, so linking runs on distinct fingerprints and a group of copies costs
    one. Null text and text without words have fingerprint 0 and link like any other. Ids are of any
    type that sorts. A null id takes no part in the smallest id; a component of null ids has a null
    component_id. Repeated rows are rows of their own. Empty input: empty output. Whole texts are read,
    one batch at a time. uid is `row` (a stored, unique key of any type) where given, else the number
    of the row in this scan.
    """
    rows = df.select(row_key(row), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = table(rows.mapInArrow(_fingerprints(words, seed), fields(rows, "uid", "id", fp="long")))
    classes = table(marked.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(links(classes.select("fp"), dense))
    placed = table(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = table(placed.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = table(placed.join(least, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp").select("uid", "id", "fp", "root", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
