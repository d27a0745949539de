"""Cross-tokenizer alignment by elementary intervals."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import fields, kept_by_worker, new_path, table
from .sentencepiece import _BYTE, MODEL, _fields, _slices, _spans
from .token_counts import Merges

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: White space of more than one byte by its bytes before the last: after such a character (and some others) texts are not cut.
_WIDE = {b"\xc2", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"}
#: Of each byte: 1 a plain letter, 2 a digit, 3 a plain sign, 0 anything else.
_KINDS = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 0x21 <= b <= 0x7E else 0 for b in range(128)] + [0] * 128, dtype=np.uint8)


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others counted up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Said:
    """The bytes of every token number, in one array."""

    def __init__(self, by_id: dict[int, bytes]):
        top = max(by_id, default=-1) + 1
        each = [by_id.get(i, b"") for i in range(top)]
        self.data = np.frombuffer(b"".join(each), dtype=np.uint8)
        self.size = np.array([len(b) for b in each], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_spans(self.at[ids], self.size[ids])]


class _Cached:
    """Token numbers of the units met so far, in one growing array; a text's are those of its units."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes], ids: list[list[int]]) -> None:
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        self.number.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.sizes = np.concatenate([self.sizes, sizes])


def _by_unit(kept: dict, name: str, units: tuple[pa.DictionaryArray, np.ndarray], encode, room: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all texts one after the other, and how many each has."""
    found, counts = units
    cached = kept.setdefault(name, _Cached())
    if len(cached.number) > room:
        cached = kept[name] = _Cached()
    words = found.dictionary.to_pylist()
    new = [w for w in words if w not in cached.number]
    if new:
        cached.add(new, encode(new))
    which = np.fromiter(map(cached.number.__getitem__, words), np.int64, len(words))[found.indices.to_numpy()]
    ends = np.r_[0, np.cumsum(cached.sizes[which])]
    upto = np.cumsum(counts)
    return cached.ids[_spans(cached.starts[which], cached.sizes[which])], ends[upto] - ends[upto - counts]


class ByteLevel:
    """A byte-level merge vocabulary (a tokenizers file), special strings read as plain text."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        steps = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or steps.get("type") != "ByteLevel" or not steps.get("use_regex", True) or steps.get("add_prefix_space"):
            raise ValueError("not a byte-level vocabulary that takes texts as they are")
        letters = byte_letters()
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.said = Said(added | {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added})
        self.data, self.key = data, crc32(data)

    def units(self, data: np.ndarray, sizes: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Texts cut where a match of the splitting pattern always ends: before a run of white space, and between plain letters, digits and signs.

        Only before a plain space or line feed whose neighbour is surely no white space, and not after an apostrophe, which may
        belong to what follows; fewer cuts are as right.
        """
        white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & ~white[:-1]
        for wide in _WIDE:
            n = len(wide)
            after = np.ones(max(0, len(data) - n - 1), dtype=bool)
            for k, b in enumerate(wide):
                after &= data[k : len(data) - n - 1 + k] == b
            cut[n + 1 :] &= ~after
        kind = _KINDS[data]
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 0x27)
        return _split(data, sizes, cut)

    def encoder(self):
        """Token numbers of units; the library's own object, made in the task."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(self.data.decode())
        own.encode_special_tokens = True
        own.no_truncation()
        own.no_padding()
        return lambda words: [e.ids for e in own.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]


class PieceLevel:
    """A sentencepiece merge model with byte pieces, which puts a space before each text."""

    def __init__(self, data: bytes):
        self.merges = Merges(data)
        pieces = [dict(_fields(v)) for n, v in _fields(data) if n == 1]
        self.said = Said({i: bytes([int(p[1][3:5], 16)]) if p.get(3, 1) == _BYTE else p[1].decode().replace("▁", " ").encode() for i, p in enumerate(pieces)})
        self.data, self.key = data, crc32(data)

    def encoder(self):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=self.data)
        lead = len(own.encode("\n"))  # a space is put before each text; a line feed, in no piece, keeps it apart

        def encode(words: list[bytes]) -> list[list[int]]:
            texts = [w.decode("utf-8", "replace") for w in words]
            spaced = [t[:1] == " " and t[1:2] not in ("", " ") for t in texts]
            found = own.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
            return [f if s else f[lead:] for f, s in zip(found, spaced, strict=True)]

        return encode


def _split(data: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Units of texts (laid one after the other) that begin where cut says and at each text."""
    if len(data):
        cut[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(cut)
    offsets = pa.py_buffer(np.r_[starts, len(data)].astype(np.int32))
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    return found, np.diff(np.r_[0, np.searchsorted(starts, np.cumsum(sizes))])


class Digits:
    """Token numbers in decimal, each with a sign after it, for all of one vocabulary."""

    def __init__(self, top: int):
        self.plain = Said({i: b"%d" % i for i in range(top)})

    def put(self, out: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        out[_spans(at, self.plain.size[ids])] = self.plain.of(ids)


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.union1d of ascending arrays: by merging their runs, where numpy's own hashes every value."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.diff(both, prepend=-1) != 0]


def intervals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The elementary intervals of two cuttings of one range: their ends, owners in a and b, and whether both end there.

    Ends ascend; both cuttings begin at 0 and end together. Each interval between neighbouring ends is the overlap
    of one token of a with one of b.
    """
    ends = union(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


def products(a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in a and b of one group; groups are numbered from 0, ascending, and each is in both."""
    na, nb = np.bincount(a_group), np.bincount(b_group)
    a = np.repeat(np.arange(len(a_group)), nb[a_group])
    first = (np.cumsum(nb) - nb)[a_group]
    return a, _spans(first, nb[a_group])


class Aligned:
    """Texts in both vocabularies: numbers, ends, groups, and links."""

    def __init__(self, texts: list[bytes], a: ByteLevel, b: PieceLevel, kept: dict, encoders: tuple, links: str):
        laid = [b" " + t if t else b"" for t in texts]
        sizes = np.array([len(t) for t in laid], dtype=np.int64)
        data = np.frombuffer(b"".join(laid), dtype=np.uint8)
        self.a_ids, a_n = _by_unit(kept, "a", a.units(data, sizes), encoders[0])
        self.b_ids, b_n = _by_unit(kept, "b", b.merges.units(texts), encoders[1])
        good = sizes > 0
        for said, ids, n in ((a.said, self.a_ids, a_n), (b.said, self.b_ids, b_n)):
            got = said.of(ids)
            of = np.r_[0, np.cumsum(said.size[ids])][np.r_[0, np.cumsum(n)]]
            same = np.diff(of) == sizes
            good &= same
            if same.all() and (got == data).all():
                continue
            at = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(good).tolist():
                good[i] = np.array_equal(got[of[i] : of[i + 1]], data[at[i] : at[i] + sizes[i]])
        self.a_ids, self.b_ids = self.a_ids[np.repeat(good, a_n)], self.b_ids[np.repeat(good, b_n)]
        self.n_a, self.n_b = np.where(good, a_n, 0), np.where(good, b_n, 0)
        # all texts one after the other are one range: a text's end is an end in both
        a_ends, b_ends = np.cumsum(a.said.size[self.a_ids]), np.cumsum(b.said.size[self.b_ids])
        ends, of_a, of_b, closed = intervals(a_ends, b_ends)
        shared = ends[closed]
        self.a_group, self.b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        self.n_groups = np.diff(np.r_[0, np.searchsorted(shared, np.cumsum(np.where(good, sizes, 0)), side="right")])
        if links == "end":
            of_a, of_b = of_a[closed], of_b[closed]
        elif links == "group":
            of_a, of_b = products(self.a_group, self.b_group)
        self.link_a, self.link_b = self.a_ids[of_a], self.b_ids[of_b]
        self.n_links = np.diff(np.r_[0, np.searchsorted(of_a, np.cumsum(self.n_a))])

    def lines(self, a_digits: Digits, b_digits: Digits) -> list[bytes]:
        """Each text's groups: `a1,a2|b1;a3|b2,b3`."""
        order = np.argsort(np.r_[2 * self.a_group, 2 * self.b_group + 1], kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        n, size = len(self.a_ids), np.r_[a_digits.plain.size[self.a_ids], b_digits.plain.size[self.b_ids]] + 1
        ends = np.cumsum(size[order])
        at = (ends - size[order])[place]
        out = np.full(int(ends[-1]) if len(ends) else 0, ord(","), dtype=np.uint8)
        a_digits.put(out, self.a_ids, at[:n])
        b_digits.put(out, self.b_ids, at[n:])
        last = at + size - 1
        if n:
            out[last[:n][np.diff(self.a_group, append=-1) != 0]] = ord("|")
            out[last[n:][np.diff(self.b_group, append=-1) != 0]] = ord(";")
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        data = out.tobytes()
        return [data[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:], strict=False)]


def _packed(ids: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """Each text's numbers as bytes of one kind."""
    data = ids.astype(kind)
    ends = np.r_[0, np.cumsum(counts)] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _kind(top: int) -> str:
    return "<u2" if top <= 1 << 16 else "<u4"


def _aligned(a: ByteLevel, b: PieceLevel, links: str, groups: bool, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_by_worker("alignment", (a.key, b.key))
        if "encoders" not in kept:
            kept["encoders"] = (a.encoder(), b.encoder())
            kept["digits"] = (Digits(len(a.said.size)), Digits(len(b.said.size)))
        for batch in batches:
            for some in _slices(batch, "text", 1 << 20):
                texts = [(t or b"").decode("utf-8", "replace").encode() for t in some.column("text").cast(pa.binary()).to_pylist()]
                got = Aligned(texts, a, b, kept, kept["encoders"], links)
                lines = got.lines(*kept["digits"])
                out = {"uid": some.column("uid"), "id": some.column("id")} | {k: pa.array(getattr(got, k), pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")}
                out["groups_sha256"] = pa.array([sha256(x).hexdigest() if x else "" for x in lines], pa.string())
                if packed:
                    out |= {k: _packed(getattr(got, k), got.n_links, _kind(len(x.said.size))) for k, x in (("link_a", a), ("link_b", b))}
                else:
                    ends = pa.array(np.r_[0, np.cumsum(got.n_links)].astype(np.int32))
                    out |= {k: pa.ListArray.from_arrays(ends, pa.array(getattr(got, k), pa.int32())) for k in ("link_a", "link_b")}
                if groups:
                    out["groups"] = pa.array([x.decode() for x in lines], pa.string())
                yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    return run


def tokens_aligned(df: DataFrame, byte_level: str = BYTE_LEVEL, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", links: str = "end", groups: bool = False, packed: bool = False) -> DataFrame:
    """Each text in a byte-level vocabulary (A: a space and the text) and a piece model (B: the text), aligned by bytes.

    uid, id, n_a, n_b, n_groups, n_links, groups_sha256, link_a and link_b (the numbers of every link's tokens, in
    order) and, if asked for, groups: `a1,a2|b1;a3|b2,b3`. The union of both arrays of ends cuts a text's bytes into
    elementary intervals; each has one owner in A and one in B, found by binary search. Where both end a group
    closes. links: `end`, pairs of tokens that end together; `overlap`, one for each interval; `group`, all
    pairs of a group, which may be many where texts have long stretches without a shared end. packed: link_a and
    link_b as bytes (little-endian, two for each number if the vocabulary has up to 65,536, else four), which costs
    Spark less.

    Encoding is the libraries', of units (words) that neither vocabulary's tokens cross, kept by the
    worker. Special strings are plain text. Texts that are null or empty, or whose tokens' bytes are not
    a space and the text (a U+2581 in it), have no tokens: zeros, and '' for the digest. Ids are of any type, repeated
    rows are rows of their own, other columns are not read. The driver reads both files, which go to the tasks.
    """
    if links not in ("end", "overlap", "group"):
        raise ValueError(f"links: end, overlap or group, not {links}")
    with open(byte_level, "rb") as f, open(model, "rb") as g:
        a, b = ByteLevel(f.read()), PieceLevel(g.read())
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbers = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), "bigint")
    more = {"groups": "string"} if groups else {}
    link = dict.fromkeys(("link_a", "link_b"), "binary" if packed else "array<int>")
    return rows.mapInArrow(_aligned(a, b, links, groups, packed), fields(rows, "uid", "id", **numbers, groups_sha256="string", **link, **more))


def _tallied(most: int):
    """Counts of a task's pairs (a << 32 | b), summed whenever `most` are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32, pa.int64()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            for some in _by_links(batch):
                new, n = np.unique(_pairs(some), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > most:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    return run


def _by_links(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` links; one row's links stay together."""
    ends, a = np.r_[0, np.cumsum(batch.column("n_links").to_numpy())], 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _numbers(column: pa.Array, n: int) -> np.ndarray:
    """All token numbers of lists, or of packed bytes, one after the other."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy().astype(np.int64)
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    n = int(batch.column("n_links").to_numpy().sum())
    return _numbers(batch.column("link_a"), n) << 32 | _numbers(batch.column("link_b"), n)


def _looked_up(keys: np.ndarray, counts: np.ndarray, best: np.ndarray, names: list[str]):
    """n_best and count_sum of each row over the pairs that are among keys (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_links(batch):
                pairs = _pairs(some)
                n, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                if len(keys):
                    where = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    here = keys[where] == pairs
                    n[here], top[here] = counts[where[here]], best[where[here]]
                ends = np.r_[0, np.cumsum(some.column("n_links").to_numpy())]
                sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (top, n)]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], *[pa.array(x) for x in sums]], names=[*names, "n_best", "count_sum"])

    return run


def link_counts(found: DataFrame, most: int = 1_000_000) -> DataFrame:
    """a, b, n (how many links of all texts have the pair) and best (whether no pair of its b has more), of every pair."""
    pairs = found.select("n_links", "link_a", "link_b").mapInArrow(_tallied(most), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = table(pairs)
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def linked_best(found: DataFrame, few: int = 2_000_000) -> DataFrame:
    """The rows of tokens_aligned (without links) with n_best, how many of their links have the most frequent pair of their b, and count_sum, the sum of their links' counts.

    Counts of pairs are summed in tasks, then by Spark. The rows are not shuffled: the pairs' table comes to them, in
    blocks of about `few` pairs (17 bytes each), the only thing that driver and tasks hold of it. More pairs
    mean more passes over the links, whose sums are then added by row.
    """
    spark = found.sparkSession
    counts = table(link_counts(found))
    names = [c for c in found.columns if c not in ("link_a", "link_b", "groups")]
    blocks = max(1, -(-counts.count() // few))
    block = F.pmod(F.xxhash64("a", "b"), F.lit(blocks))
    path = new_path(spark)

    def held(i: int):
        got = counts.filter(block == i).toArrow()
        keys = got.column("a").to_numpy().astype(np.int64) << 32 | got.column("b").to_numpy()
        order = np.argsort(keys)
        return keys[order], got.column("n").to_numpy()[order], got.column("best").to_numpy()[order]

    if blocks == 1:
        return found.select(*names, "link_a", "link_b").mapInArrow(_looked_up(*held(0), names), fields(found, *names, n_best="bigint", count_sum="bigint"))
    for i in range(blocks):
        part = found.select("uid", "n_links", "link_a", "link_b").mapInArrow(_looked_up(*held(i), ["uid"]), fields(found, "uid", n_best="bigint", count_sum="bigint"))
        part.write.mode("append").parquet(path)
    sums = spark.read.schema(part.schema).parquet(path).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select(*names).join(sums, "uid")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under both vocabularies, their groups, and how common its links are over all documents."""
    found = table(tokens_aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), packed=True))
    return linked_best(found).select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
