"""Operators 11 to 13 against brute force and the libraries."""

import random
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from scorelake.llm.alignment import BYTE_LEVEL, byte_letters, intervals, linked_best, products, tokens_aligned
from scorelake.llm.durable import sums_joined, table
from scorelake.llm.sentencepiece import MODEL
from scorelake.llm.token_counts import Merges, token_counts
from scorelake.llm.vector_codes import OP11_SQL, op11_vector_codes, vector_codes

ODD = ["", "x", "▁", " ", "  \n\n", "<s>a</s>", "<|endoftext|>", "<0x0A>\n", "a▁b ▁ c", "漢字かな 😀 naïve", "it's they'll 12,345.67", "tab\tand\rfeed\x0b \x85 end", "a" * 5000, " " * 999, "ab" * 3000 + "!", "　wide space s", "nul\0byte", "x y z"]


def random_texts(n=300, seed=5):
    rng, letters = random.Random(seed), list("ab \n\t\réßЖ漢字😀\xa0　.,'") + ["the", "ing", "'s", " I'll", "<s>", "▁", "123", "  "]
    return ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(n)]


def docs(spark, texts):
    """With columns whose names the operators use themselves, a null id and text, and repeated rows."""
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, None, "clash", 7), (3, "again", "", 0), (3, "again", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, uid string, n_tokens int")


# ---- op12 -------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark):
    library = SentencePieceProcessor(model_file=MODEL)
    got = token_counts(docs(spark, ODD + random_texts())).collect()
    texts = [*ODD, *random_texts(), "", "again", "again"]
    assert sorted((-1 if r["id"] is None else r["id"], r["n_tokens"], r["n_bytes"]) for r in got) == sorted((i, len(library.encode(t)), len(t.encode())) for i, t in zip([*range(len(texts) - 3), -1, 3, 3], texts, strict=True))


def test_token_counts_of_an_empty_table_and_of_ids_of_any_type(spark):
    assert token_counts(docs(spark, ["a"]).limit(0)).count() == 0
    got = token_counts(spark.createDataFrame([("k", "one two")], "key string, body string"), id_col="key", text_col="body").head()
    assert (got["id"], got["n_tokens"]) == ("k", 2)


def test_a_long_unit_merges_in_n_log_n(spark):
    """Heap entries looked at, not seconds: ten times the length takes about ten times as many."""
    with open(MODEL, "rb") as f:
        merges = Merges(f.read())

    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    asked = []
    for n in (1_000, 10_000, 100_000):
        merges.rank = Counting(merges.rank)
        merges.left("ab" * n)
        asked.append(merges.rank.asked)
    assert asked[1] < 11 * asked[0] and asked[2] < 11 * asked[1]


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merge model"):
        Merges(b"")


# ---- op13 -------------------------------------------------------------------------------------


def said_a(library):
    letters = byte_letters()
    return lambda i: bytes(letters[c] for c in library.id_to_token(i)) if i != 50256 else b"<|endoftext|>"


def said_b(library):
    return lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()


def brute_alignment(texts):
    """Of each text: A and B numbers, group line, links (all pairs of tokens whose ranges end together), overlaps, pairs within groups."""
    own_a, own_b, out = Tokenizer.from_file(BYTE_LEVEL), SentencePieceProcessor(model_file=MODEL), []
    own_a.encode_special_tokens = True
    say_a, say_b = said_a(own_a), said_b(own_b)
    for t in texts:
        a, b = (own_a.encode(" " + t, add_special_tokens=False).ids, own_b.encode(t)) if t else ([], [])
        whole = (" " + t).encode()
        if b"".join(map(say_a, a)) != whole or b"".join(map(say_b, b)) != whole:
            a, b = [], []
        spans = []
        for ids, say in ((a, say_a), (b, say_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(say(i))))
                at = found[-1][1]
            spans.append(found)
        ends_a, ends_b = {e: i for i, (_, e) in enumerate(spans[0])}, {e: i for i, (_, e) in enumerate(spans[1])}
        shared = sorted(set(ends_a) & set(ends_b))
        group = lambda e, s=shared: sum(x < e for x in s)
        lines = [",".join(str(i) for i, (_, e) in zip(a, spans[0], strict=True) if group(e) == g) + "|" + ",".join(str(i) for i, (_, e) in zip(b, spans[1], strict=True) if group(e) == g) for g in range(len(shared))]
        ends = [(a[ends_a[e]], b[ends_b[e]]) for e in shared]
        overlaps = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
        inside = [(i, j) for i, (_, e) in zip(a, spans[0], strict=True) for j, (_, v) in zip(b, spans[1], strict=True) if group(e) == group(v)]
        out.append((a, b, ";".join(lines), ends, overlaps, inside))
    return out


SMALL = [t for t in ODD if len(t) < 500] + random_texts(120, 9) + ["the thing and the things", "unbelievably tokenised wordings"]


@pytest.mark.parametrize(("links", "at"), [("end", 3), ("overlap", 4), ("group", 5)])
def test_groups_and_links_are_those_of_brute_force(spark, links, at):
    want = brute_alignment(SMALL)
    got = {r["id"]: r for r in tokens_aligned(spark.createDataFrame(list(enumerate(SMALL)), "doc_id int, text string"), links=links, groups=True).collect()}
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["groups"], r["n_links"]) == (len(w[0]), len(w[1]), w[2], len(w[at])), SMALL[i]
        assert r["n_groups"] == (w[2].count(";") + 1 if w[2] else 0)
        assert r["groups_sha256"] == (sha256(w[2].encode()).hexdigest() if w[2] else "")
        assert sorted(zip(r["link_a"], r["link_b"], strict=True)) == sorted(w[at])


@pytest.mark.parametrize(("few", "packed"), [(1_000_000, True), (1_000_000, False), (40, True)])
def test_counts_of_links_over_all_texts(spark, few, packed):
    """One block of pairs and several give the same sums."""
    df = docs(spark, SMALL)
    texts = [*SMALL, "", "again", "again"]
    want = brute_alignment(texts)
    total = Counter(p for w in want for p in w[3])
    top = Counter()
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    ids = [*range(len(SMALL)), None, 3, 3]
    rows = Counter((i, len(w[3]), sum(total[p] == top[p[1]] for p in w[3]), sum(total[p] for p in w[3])) for i, w in zip(ids, want, strict=True))
    got = linked_best(table(tokens_aligned(df, packed=packed)), few=few).collect()
    assert Counter((r["id"], r["n_links"], r["n_best"], r["count_sum"]) for r in got) == rows


def test_alignment_of_nothing(spark):
    empty = docs(spark, ["a"]).limit(0)
    assert linked_best(table(tokens_aligned(empty))).count() == 0
    only = linked_best(table(tokens_aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")))).collect()
    assert {tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in only} == {(0, 0, 0, 0, 0, 0, "")}
    with pytest.raises(ValueError, match="links"):
        tokens_aligned(empty, links="start")


def test_intervals_and_products():
    ends, a, b, closed = intervals(np.array([2, 5, 9]), np.array([5, 6, 9]))
    assert (ends.tolist(), a.tolist(), b.tolist(), closed.tolist()) == ([2, 5, 6, 9], [0, 1, 2, 2], [0, 0, 1, 2], [False, True, False, True])
    a, b = products(np.array([0, 0, 1]), np.array([0, 1, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2)]


# ---- op11 -------------------------------------------------------------------------------------


def brute_codes(vectors, parts, entries, rounds, scale=4096):
    """Plain Lloyd in Python's integers; vectors in order of id."""
    kept = [[int(np.floor(float(x) * scale)) for x in v] for v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], [], []
    w = len(kept[0]) // parts
    codes, books = [["" for _ in range(parts)] for _ in kept], []
    errors = [0] * len(kept)
    for p in range(parts):
        x = [v[p * w : (p + 1) * w] for v in kept]
        book = [list(v) for v in x[:entries]]
        dist = lambda u, v: sum((i - j) ** 2 for i, j in zip(u, v, strict=True))
        for turn in range(rounds + 1):
            near = [min((dist(v, c), k) for k, c in enumerate(book)) for v in x]
            if turn < rounds:
                for k in range(len(book)):
                    mine = [v for v, (_, n) in zip(x, near, strict=True) if n == k]
                    if mine:
                        book[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for i, (d, k) in enumerate(near):
            codes[i][p], errors[i] = f"{k:02x}", errors[i] + d
        books.append(book)
    return ["".join(c) for c in codes], errors, books


def vectors_like(kind, n=400, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    if kind == "clustered":
        return (rng.normal(size=(9, dims))[rng.integers(9, size=n)] + rng.normal(size=(n, dims)) * 0.02).tolist()
    if kind == "ties":  # few values, so many equal distances, and whole runs of one vector
        return (rng.integers(-2, 3, size=(n, dims)) / 4096).tolist() + [[1 / 4096] * dims] * 200
    if kind == "large":
        return (rng.normal(size=(n, dims)) * 10_000).tolist()
    return rng.normal(size=(n, dims)).tolist()


@pytest.mark.parametrize("kind", ["plain", "clustered", "ties", "large"])
@pytest.mark.parametrize("groups", [1, 4])
def test_codes_are_those_of_plain_lloyd(spark, kind, groups):
    vectors = vectors_like(kind)
    vectors[5], vectors[7], vectors[9] = None, [*vectors[7][:-1], None], [float("nan"), *vectors[9][1:]]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)]
    got = vector_codes(spark.createDataFrame(rows, "vec_id int, embedding array<double>, code string").repartition(5), parts=4, groups=groups, block=64)
    codes, errors, books = brute_codes(vectors, 4, 16, 6)
    assert [(r["code"], r["error"]) for r in got.rows.orderBy("id").collect()] == list(zip(codes, errors, strict=True))
    assert got.digest() == sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_bounds_spare_distances(spark):
    vectors = vectors_like("clustered", n=2000)
    got = vector_codes(spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>"), parts=4)
    assert got.scanned[0] == 2000 * 4 * 16
    assert got.scanned[-1] < got.scanned[0] / 4


def test_few_vectors_other_lengths_and_none(spark):
    schema = "vec_id int, embedding array<double>, label string"
    rows = [(2, [0.5, -0.25, 1.0], "x"), (1, [0.25, 0.5, 0.0], None), (1, [0.25, 0.5, 0.0], None), (None, [0.0, 0.0, 0.1], "x"), (9, [1.0], "x"), (3, [1e300, 0.0, 0.0], "x"), (4, [], "x")]
    got = vector_codes(spark.createDataFrame(rows, schema), parts=2, label_col="label")
    found = got.rows.collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["error"]) for r in found) == [(-1, 0), (1, 0), (1, 0), (2, 0)]
    assert [b.shape for b in got.books] == [(4, 2), (4, 1)]
    none = vector_codes(spark.createDataFrame(rows, schema).limit(0), label_col="label")
    assert none.rows.count() == 0 and none.digest() == sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="256"):
        vector_codes(spark.createDataFrame(rows, schema), entries=257)


def test_the_query_gives_what_its_sql_does(spark, tmp_path):
    vectors = vectors_like("clustered", n=300, dims=32)
    rows = [(i, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [None] * 32, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(OP11_SQL.replace("range(1, 9)", "range(1, 5)")).fetchall()
    got = op11_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("few", [100, 0])
def test_sums_joined_beyond_the_broadcast(spark, few):
    rows = table(spark.range(1000).select(F.col("id").alias("uid"), F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END").alias("k")))
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = sums_joined(rows, sums, ["k"], "uid", few=few, spread=4).collect()
    want = Counter(None if i % 3 == 0 else i % 5 for i in range(1000))
    assert len(got) == 1000 and all(r["n"] == want[r["k"]] for r in got)
