"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import fields, kept_by_worker
from .sentencepiece import _BYTE, _NORMAL, MODEL, _fields, _slices

_MARK, _START = "▁".encode(), 0xFFFFFFFF


class Merges:
    """Ranks of the pieces of a merge model, and the counting of what merging leaves."""

    def __init__(self, data: bytes):
        kinds, scores = set(), {}
        trained, normal = {}, {}
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                kind = got.get(3, _NORMAL)
                kinds.add(kind)
                if kind == _NORMAL:
                    scores[got[1].decode()] = float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0])
            elif number == 2:
                trained = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trained.get(3, 1) != 2 or _BYTE not in kinds or kinds & {4, 5}:
            raise ValueError("not a merge model with byte pieces and without user-defined or unused ones")
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or trained.get(24, 0):
            raise ValueError("a model that maps characters, drops spaces, puts none first or puts it last")
        order = {s: i << 32 for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        # neighbours by the last byte of one character and the first of the next; bytes within a character stay together
        self.apart = np.ones((256, 256), dtype=bool)
        self.apart[:, 0x80:0xC0] = False
        for p in self.rank:
            said = p.replace("▁", " ").encode()
            self.apart[list(said[:-1]), list(said[1:])] = False

    def left(self, unit: str) -> int:
        """How many tokens merging leaves of a unit: its symbols minus the merges, lowest rank first, of equal ones the leftmost.

        A symbol is known by where it starts; ends[i] is where it ends, so where the next one starts, and before[i]
        where the previous one starts. A heap entry is a rank and a start; one whose pair has merged otherwise
        no longer has that rank and is passed over.
        """
        rank, n = self.rank.get, len(unit)
        heap = [r | i for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        heapify(heap)
        symbols, ends, before = n, list(range(1, n + 1)), list(range(-1, n))
        while heap:
            key = heappop(heap)
            i = key & _START
            j = ends[i]
            if not j or j == n:
                continue
            k = ends[j]
            if rank(unit[i:k]) != key - i:
                continue
            ends[i], ends[j], before[k] = k, 0, i
            symbols -= 1
            if k < n and (r := rank(unit[i : ends[k]])) is not None:
                heappush(heap, r | i)
            if i and (r := rank(unit[before[i] : k])) is not None:
                heappush(heap, r | before[i])
        if not unit.isascii():  # a character that is no piece counts as its bytes
            symbols += sum(len(c.encode("utf-8", "replace")) - 1 for i, c in enumerate(unit) if ends[i] == i + 1 and rank(c) is None)
        return symbols

    def units(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of texts, each after a space, and how many each text has: cut wherever no piece has both neighbours, so where nothing merges."""
        texts = [b" " + t.replace(_MARK, b" ") if t else t for t in texts]  # to the model a U+2581 is a space
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = self.apart[data[:-1], data[1:]]
        cut[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.r_[starts, len(data)].astype(np.int32))
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        return found, np.diff(np.r_[0, np.searchsorted(starts, np.cumsum(sizes))])

    def counts(self, texts: list[bytes], kept: dict[bytes, int], room: int = 300_000) -> np.ndarray:
        """Tokens of each text (UTF-8); kept: a cache of units' counts, begun anew beyond `room`."""
        found, each = self.units(texts)
        ends = np.frombuffer(found.dictionary.buffers()[1], dtype=np.int32)[: len(found.dictionary) + 1].tolist()
        data = found.dictionary.buffers()[2].to_pybytes() if len(ends) > 1 else b""
        if len(kept) > room:
            kept.clear()
        of = np.zeros(len(ends) - 1, dtype=np.int64)
        for at, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            word = data[a:b]
            n = kept.get(word)
            if n is None:
                n = self.left(word.decode("utf-8", "replace").replace(" ", "▁"))
                if b - a <= 256:  # long units seldom come again
                    kept[word] = n
            of[at] = n
        total = np.r_[0, np.cumsum(of[found.indices.to_numpy()])]
        upto = np.cumsum(each)
        return total[upto] - total[upto - each]


def _counted(merges: Merges, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_by_worker("token_counts", key)
        for batch in batches:
            for some in _slices(batch, "text"):
                texts = [t or b"" for t in some.column("text").cast(pa.binary()).to_pylist()]
                n_bytes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("uid"), some.column("id"), n_bytes, pa.array(merges.counts(texts, kept), pa.int64())], names=["uid", "id", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, id, n_bytes (UTF-8) and n_tokens of every row of df: as many as the model's own merging gives, without begin and end.

    Where no piece has two neighbouring characters nothing merges, so texts are cut there into units (words
    with the spaces before them, signs, digits), and a worker keeps the counts of those it has met. Within one a heap holds the ranks of
    adjacent pairs and a linked list the symbols: the pair of lowest rank merges, of equal ones the
    leftmost, until none is left, in n log n steps for a unit of n characters however long. The count is
    symbols minus merges, and characters that are no piece count as their bytes; no numbers are made.

    Begin, end and other special strings in a text are plain text, as the library has it. Null and empty texts:
    0 tokens. Ids are of any type, repeated rows are rows of their own, other columns are not read. Models
    that are not merge models with byte pieces, or that map characters, fail. The driver reads the
    model file; its ranks go to the tasks.
    """
    with open(model, "rb") as f:
        data = f.read()
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(Merges(data), crc32(data)), fields(rows, "uid", "id", n_bytes="bigint", n_tokens="bigint"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under the piece model, and whether they are over 4,096."""
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
