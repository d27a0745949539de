"""SentencePiece encoding and decoding by batched numpy Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import fields, kept_by_worker

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE, _LITERAL = 0x2581, 0x110001
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NORMAL, _UNKNOWN, _BYTE, _USER = 1, 2, 6, 4
#: Probes that meet no piece are told by so many bits of their hash before the sorted keys are searched.
_SIEVE = 17


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """A model file's pieces, as sorted keys of each length."""

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        kind = 1
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]), got.get(3, _NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
        known = [(i, p, s) for i, (p, s, t) in enumerate(pieces) if t in (_NORMAL, _USER)]
        self.scores = np.zeros(len(pieces))
        if kind == 2:
            # scores of a merge model are ranks; a unigram model needs log probabilities, so Zipf's law of the rank
            for rank, (i, _, _) in enumerate(sorted(known, key=lambda x: (-x[2], x[0]))):
                self.scores[i] = -np.log(rank + 2.7)
        else:
            self.scores[:] = [s for _, s, _ in pieces]
        self.unknown = min((self.scores[i] for i, _, _ in known), default=0.0) - 10
        self.byte = np.full(256, next((i for i, (_, _, t) in enumerate(pieces) if t == _UNKNOWN), 0), dtype=np.int32)
        self.is_byte = np.array([t == _BYTE for _, _, t in pieces], dtype=bool)
        said = []
        for i, (p, _, t) in enumerate(pieces):
            if t == _BYTE:
                self.byte[int(p[3:5], 16)] = i
            said.append(bytes([int(p[3:5], 16)]) if t == _BYTE else p.replace("▁", " ").encode() if t in (_NORMAL, _USER) else " ⁇ ".encode() if t == _UNKNOWN else b"")
        self.bytes = said
        self.said, self.said_size = np.frombuffer(b"".join(said), dtype=np.uint8), np.array([len(x) for x in said], dtype=np.int64)
        self.said_at = np.cumsum(self.said_size) - self.said_size
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sieve: dict[int, np.ndarray] = {}
        lengths = sorted({len(p) for _, p, _ in known})
        for n in lengths:
            some = [(i, [ord(c) for c in p]) for i, p, _ in known if len(p) == n]
            points = np.array([c for _, c in some], dtype=np.uint32)
            keys = np.zeros(len(some), dtype=np.uint64)
            for k in range(n):
                keys = keys * _BASE + points[:, k] + np.uint64(1)
            order = np.argsort(keys)
            self.tables[n] = (keys[order], np.array([i for i, _ in some], dtype=np.int32)[order], points[order])
            self.sieve[n] = np.zeros(1 << _SIEVE, dtype=bool)
            self.sieve[n][keys >> np.uint64(64 - _SIEVE)] = True
        self.longest = max(lengths, default=1)

    def _hits(self, points: np.ndarray, a: int, b: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length (columns of code points) and ends a + 1 .. b: (end, length, words, pieces), longest first at each end."""
        low = max(0, a - self.longest + 1)
        part = points[low:b].astype(np.uint64)
        rolled, out = np.zeros_like(part), []
        for n in range(1, min(self.longest, b - low) + 1):
            rolled = rolled[: len(part) - n + 1] * _BASE + part[n - 1 :] + np.uint64(1)
            if n not in self.tables:
                continue
            start = max(low, a + 1 - n)  # a piece from i ends at i + n in a + 1 .. b
            keys, ids, exact = self.tables[n]
            probe = rolled[start - low :]
            i, r = np.nonzero(self.sieve[n][probe >> np.uint64(64 - _SIEVE)])
            probe = probe[i, r]
            which = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            same = keys[which] == probe
            for k in range(n):
                same &= points[start + i + k, r] == exact[which, k]
            i, r, which = i[same], r[same], which[same]
            cuts = np.searchsorted(i, np.arange(b - n - start + 2))
            for at in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                some = slice(cuts[at], cuts[at + 1])
                out.append((start + at + n, n, r[some], ids[which[some]]))
        out.sort(key=lambda x: (x[0], -x[1]))
        return out

    def _best(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (columns of code points): length and number of the piece that ends the best path at each place (rows)."""
        size, words = points.shape
        best = np.empty((size + 1, words))
        best[0] = 0.0
        back, piece = np.ones((size + 1, words), dtype=np.int16), np.full((size + 1, words), -1, dtype=np.int32)
        step = max(64, 200_000 // words)
        for a in range(0, size, step):
            b, done = min(size, a + step), a
            for end, n, some, ids in [*self._hits(points, a, b), (b + 1, 0, None, None)]:
                while done < min(end, b):  # a character that is no piece
                    done += 1
                    best[done] = best[done - 1] + self.unknown
                if n:
                    total = best[end - n, some] + self.scores[ids]
                    more = total > best[end, some]
                    some = some[more]
                    best[end, some], back[end, some], piece[end, some] = total[more], n, ids[more]
        return back, piece

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all units' pieces one after the other, and how many each unit has; equally long units advance together."""
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by.setdefault(len(u), []).append(i)
        owners, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for size, members in by.items():
            step = max(1, 40_000 // max(1, size))
            for a in range(0, len(members), step):
                some = members[a : a + step]
                points = np.frombuffer("".join(units[i] for i in some).encode("utf-32-le"), dtype=np.uint32).reshape(len(some), size).T.copy()
                points[points == _SPACE] = _LITERAL
                points[points == 0x20] = _SPACE
                back, piece = self._best(points)
                every, at, owner = np.arange(len(some)), np.full(len(some), size), np.array(some)
                while len(every):
                    every = every[at > 0]
                    at = at[at > 0]
                    number = piece[at, every]
                    lone = number < 0
                    owners.append(owner[every[~lone]])
                    places.append(at[~lone] * 4)
                    found.append(number[~lone])
                    for e, j in zip(every[lone].tolist(), at[lone].tolist(), strict=True):
                        coded = self.byte[np.frombuffer(units[some[e]][j - 1].encode(), dtype=np.uint8)]
                        owners.append(np.full(len(coded), some[e]))
                        places.append(4 * j - len(coded) + 1 + np.arange(len(coded)))
                        found.append(coded)
                    at = at - back[at, every]
        owner, place = np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((place, owner))
        return np.concatenate(found)[order], np.bincount(owner, minlength=len(units))

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of runs of pieces (numbers one after the other, and how many each text has): without the space that encoding puts first."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.said_size)):
            raise ValueError("piece numbers beyond the model's")
        data = self.said[_spans(self.said_at[ids], self.said_size[ids])].tobytes()
        ends = np.r_[0, np.cumsum(self.said_size[ids])][np.cumsum(lengths)]
        out, at = [], 0
        for end in ends.tolist():
            out.append(data[at + (data[at : at + 1] == b" " and end > at) : end].decode("utf-8", "replace"))
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of some pieces."""
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans [start, start + size), one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Coded:
    """Pieces of the units met so far, in one growing array."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)


def units(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of texts, each after a space, and how many each text has.

    No piece crosses a unit's end: a space begins a piece or follows a space, and a line feed is in none.
    So units are line feeds, and words with the spaces before them.
    """
    sizes = np.array([len(t) + (len(t) > 0) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join([b" " + t for t in texts if t]), dtype=np.uint8)
    feed, space = data == 0x0A, data == 0x20
    cut = feed | space
    cut[1:] &= feed[1:] | ~space[:-1]
    cut[1:] |= feed[:-1]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    cut[first] = True
    starts = np.flatnonzero(cut)
    offsets = pa.py_buffer(np.r_[starts, len(data)].astype(np.int32))
    found = pa.StringArray.from_buffers(len(starts), offsets, pa.py_buffer(data)).dictionary_encode()
    upto = np.searchsorted(starts, np.cumsum(sizes))
    return found, np.diff(np.r_[0, upto])


def encode(pieces: Pieces, texts: list[bytes], kept: dict[str, Coded], room: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of all texts one after the other, and how many each has; kept: a cache of units' pieces."""
    found, counts = units(texts)
    coded = kept.setdefault("", Coded())
    if len(coded.number) > room:
        coded = kept[""] = Coded()
    ends = np.frombuffer(found.dictionary.buffers()[1], dtype=np.int32)[: len(found.dictionary) + 1].tolist()
    data = found.dictionary.buffers()[2].to_pybytes() if len(ends) > 1 else b""
    words = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    new = [w for w in words if w not in coded.number]
    if new:
        ids, sizes = pieces.encode_units([w.decode() for w in new])
        coded.number.update(zip(new, range(len(coded.sizes), len(coded.sizes) + len(new)), strict=True))
        coded.starts = np.concatenate([coded.starts, len(coded.ids) + np.cumsum(sizes) - sizes])
        coded.ids, coded.sizes = np.concatenate([coded.ids, ids]), np.concatenate([coded.sizes, sizes])
    which = np.fromiter(map(coded.number.__getitem__, words), np.int64, len(words))[found.indices.to_numpy()]
    ends = np.r_[0, np.cumsum(coded.sizes[which])]
    upto = np.cumsum(counts)
    return coded.ids[_spans(coded.starts[which], coded.sizes[which])], ends[upto] - ends[upto - counts]


def _slices(batch: pa.RecordBatch, of: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of 1000 rows and about `most` bytes of a column."""
    for a in range(0, batch.num_rows, 1000):
        some = batch.slice(a, 1000)
        each = max(1, int(some.num_rows * most / max(most, some.column(of).nbytes)))
        for b in range(0, some.num_rows, each):
            yield some.slice(b, each)


def _encoded(pieces: Pieces, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_by_worker("sentencepiece", key)
        for batch in batches:
            for some in _slices(batch, "text"):
                ids, sizes = encode(pieces, [t or b"" for t in some.column("text").cast(pa.binary()).to_pylist()], kept)
                ends = np.r_[0, np.cumsum(sizes)]
                bytes_ = np.diff(np.r_[0, np.cumsum(pieces.is_byte[ids])][ends])
                arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column("uid"), some.column("id"), arrays, pa.array(bytes_.astype(np.int32))], names=["uid", "id", "pieces", "byte_pieces"])

    return run


def sentencepiece_encode(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, id, pieces (numbers) and byte_pieces (how many of them are bytes) of every row of df.

    The best segmentation under a unigram model of the file's pieces: words of one length form a matrix,
    hashes of all its substrings up to the longest piece probe the sorted piece keys (and hits are
    compared in full), and at each place a vectorised maximum over the piece lengths stores the way
    back. A merge model's scores are ranks, not log probabilities, so there a piece's is that of Zipf's
    law for its rank: the numbers are the model's, the segmentation is the best one under those scores and
    not the one that merging gives. Tokenizers are not trained here, so the scores are not learnt either.
    Ties go to the longest last piece. A character in no piece costs 10 more than the worst piece and
    becomes its UTF-8 bytes, or the unknown piece in a model without bytes, which decodes as U+2047.

    As the model says, a space is put first and spaces become U+2581. A U+2581 of the text itself
    becomes bytes, so decoding gives every text back exactly
    where the model has byte pieces. Ids are of any type. Null and empty texts: no pieces (a null
    text decodes as empty). Very long words go in blocks. Repeated rows are rows of their own; other
    columns are not read. The model file is read by the driver; its pieces go to the tasks.
    """
    with open(model, "rb") as f:
        data = f.read()
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(Pieces(data), crc32(data)), fields(rows, "uid", "id", pieces="array<int>", byte_pieces="int"))


def sentencepiece_decode(df: DataFrame, model: str = MODEL, pieces_col: str = "pieces", keep: tuple[str, ...] = ("uid", "id", "pieces", "byte_pieces"), to: str = "text") -> DataFrame:
    """The columns `keep` of df and the text of its pieces; null pieces give a null text, unknown numbers fail."""
    with open(model, "rb") as f:
        pieces = Pieces(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, pieces_col):
                lists = some.column(pieces_col)
                sizes = np.diff(lists.offsets.to_numpy())
                texts = pieces.decode_all(lists.flatten().to_numpy(), np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in keep], pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=[*keep, to])

    return df.mapInArrow(run, fields(df, *keep, **{to: "string"}))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces (Viterbi over the merge model's pieces: not its merges, see sentencepiece_encode), and the hash of the text that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sentencepiece_decode(sentencepiece_encode(docs), to="decoded")
    return found.select(F.col("id").alias("doc_id"), F.size("pieces").alias("n_pieces"), "byte_pieces", F.sha2("decoded", 256).alias("decoded_sha256"), "pieces")
