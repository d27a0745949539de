import hashlib
import random

import numpy as np
import pytest
import xxhash

from scorelake.llm.exact_dedup import exact_dedup
from scorelake.llm.graph import components
from scorelake.llm.simhash import fingerprint, links, pigeonring, simhash_dedup

DOCS = "doc_id long, text string, keep_id string, kept string, TEXT2 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


ROWS = [(5, "a b"), (2, "ab"), (9, "a\tb \n"), (4, None), (3, ""), (7, " "), (1, "unique " * 5000), (8, "é"), (6, "e"), (None, "ab"), (2, "ab"), (11, "\u00a0ab")]


def brute_exact(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, n, i))
    return sorted((str(i), str(min(g)[4]), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g), len(groups)


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_exact_dedup_matches_brute_force(spark, bits):
    got = exact_dedup(docs(spark, ROWS), filter_bits=bits, digest_all=True).collect()
    want, kept = brute_exact(ROWS)
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["full_hash"]) for r in got) == want
    assert sum(r["kept"] for r in got) == kept
    for r in got:
        assert r["kept"] <= (r["id"] == r["keep_id"])


def test_exact_dedup_hashes_survivors_only_and_takes_empty_tables(spark):
    got = exact_dedup(docs(spark, [(1, "one"), (2, "two two"), (3, "one")])).collect()
    assert {r["id"]: r["full_hash"] is not None for r in got} == {1: True, 2: False, 3: True}
    assert exact_dedup(docs(spark, [])).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_brute_force_and_sparks_own_hash(spark):
    for t in ("", None, "One", "a b c", "A b c D", "x y z w v " * 40, "É È\u00a0k L m N", "a\x0bb\x0cc\rd e"):
        assert fingerprint(t) == brute_fingerprint(t)
    own = spark.sql("select xxhash64('a b c d') as h").first()["h"]
    assert fingerprint("A b c d") == own % 2**64


def brute_components(fps):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin((a ^ b) % 2**64).count("1") <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("dense, hot", [(256, 1 << 18), (3, 1 << 18), (256, 2), (3, 2)])
def test_links_lose_nothing_in_dense_and_sparse_groups(spark, dense, hot):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for centre in list(fps)[:6]:
        for _ in range(30):
            fps.add(centre ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 6)))))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense, hot)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    want = brute_components(signed)
    groups = lambda label: {frozenset(f for f in signed if label.get(f, f) == r) for r in {label.get(f, f) for f in signed}}
    assert groups(roots) == groups(want)


def test_a_chain_lets_all_near_pairs_through_and_few_others():
    rng = random.Random(4)
    flipped = lambda n: np.array([sum(1 << b for b in rng.sample(range(64), n)) for _ in range(2000)], dtype=np.uint64)
    for n in range(5):
        assert pigeonring(flipped(n)).all()
    assert pigeonring(flipped(8)).mean() < 0.3 and pigeonring(flipped(32)).mean() < 0.001


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "x")], "doc_id string, text string")
    assert sorted((str(r["id"]), str(r["component_id"])) for r in simhash_dedup(rows).collect()) == [("None", "None"), ("a", "a"), ("b", "a")]


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_long_chains_and_stars(spark, few):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert len({got[i] for i in range(101)}) == 1 and len({got[500 + i] for i in range(80)}) == 1 and len(set(got.values())) == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_dedup_edges(spark):
    base = " ".join(f"word{i}" for i in range(400))
    changed = (base.replace(f"word{k} ", "other ") for k in range(10, 400))
    near = next(t for t in changed if 0 < bin(fingerprint(t) ^ fingerprint(base)).count("1") <= 4)
    rows = [(10, base), (4, near), (7, base), (3, None), (2, ""), (9, " \t"), (None, "solo text here"), (10, base), (12, "x" * 200_000)]
    got = simhash_dedup(docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add(r["component_id"])
    assert by[10] == by[4] == by[7] == {4} and by[3] == by[2] == by[9] == {2} and by[None] == {None} and by[12] == {12}
    assert len(got) == len(rows)
    assert simhash_dedup(docs(spark, [])).count() == 0


def test_query_columns(spark):
    from scorelake.llm.simhash import op2_simhash

    got = op2_simhash(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = got.collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(int(r["fingerprint"], 16) == brute_fingerprint(texts[r["doc_id"]]) and len(r["fingerprint"]) == 16 for r in rows)
    want = brute_components([int(r["fingerprint"], 16) for r in rows])
    least = {}
    for r in rows:
        root = want[int(r["fingerprint"], 16)]
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[want[int(r["fingerprint"], 16)]] for r in rows)
