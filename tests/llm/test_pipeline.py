import re
import struct
from collections import Counter

import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from scorelake.llm.durable import table

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    """Bit by bit, in Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_taken(rows, block=1024, share=1.5, ceiling=2):
    """Words that a mix takes of each document (doc_id, text, source): targets by filling, streams word by word, slots by reversed bits, in Python."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for *_, s in rows)
    weight, total = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}, {n: sum(size[i] for i, _, s in rows if s == n) for n in names}
    full = set()
    while True:
        left = share * sum(total.values()) - sum(ceiling * total[n] for n in full)
        level = {n: left * weight[n] / sum(weight[m] for m in names if m not in full) for n in names if n not in full}
        over = {n for n, v in level.items() if v > ceiling * total[n]}
        if not over:
            break
        full |= over
    target = {n: ceiling * total[n] if n in full else level[n] for n in names}

    def order(i, text):
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        return xxhash.xxh64_intdigest(struct.pack("<i", 42), xxhash.xxh64_intdigest(text.encode(), h)) if text is not None else xxhash.xxh64_intdigest(struct.pack("<i", 42), h)

    slots = {n: -(-(round(target[n]) % total[n]) // block) + round(target[n]) // total[n] * -(-total[n] // block) if total[n] else 0 for n in names}
    bits, first, taken = max(1, (max(1, sum(slots.values())) - 1).bit_length()), 0, Counter()
    for n in names:
        stream = [i for _, i in sorted((order(i, t), i) for i, t, s in rows if s == n) for _ in range(size[i])]
        points = sorted(int(f"{v:0{bits}b}"[::-1], 2) for v in range(first, first + slots[n]))
        first, left = first + slots[n], round(target[n])
        for rank in range(len(points)):
            at = rank % max(1, -(-total[n] // block)) * block
            words = stream[at : at + block][:left]
            left -= len(words)
            taken.update(words)
        assert left == 0
    return taken, size


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "12 34 !!", "en", "src1", 8), (9003, docs.first()["text"] + "  ", "fr", None, 0)], docs.schema)
    docs = table(docs.unionByName(extra))
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    spoken = table(stages["language_id"](spark, docs, SF))
    assert {r["doc_id"] for r in spoken.collect()} == set(rows) - {9001, 9002}

    exact = table(stages["exact_dedup"](spark, spoken, SF))
    groups = {}
    for r in spoken.collect():
        groups.setdefault("".join(r["text"].split(" ")).translate(str.maketrans("", "", "\t\n\x0b\x0c\r")), []).append((-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in exact.collect()} == {min(g)[1] for g in groups.values()}

    near = table(stages["simhash_dedup"](spark, exact, SF))
    ids = sorted(r["doc_id"] for r in exact.collect())
    prints = {i: brute_fingerprint(rows[i]) for i in ids}
    label = {i: i for i in ids}
    for _ in ids:
        before = dict(label)
        for a in ids:
            label[a] = min(label[b] for b in ids if bin(prints[a] ^ prints[b]).count("1") <= 4)
        if label == before:
            break
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({label[i] for i in ids})

    mixed = table(stages["mixing"](spark, near, SF))
    taken, size = brute_taken([(r["doc_id"], r["text"], r["source"]) for r in near.collect()])
    want = Counter({i: int(t / size[i] + 0.5) for i, t in taken.items() if int(t / size[i] + 0.5)})
    assert Counter(r["doc_id"] for r in mixed.collect()) == want

    tokens = stages["sentencepiece"](spark, mixed, SF)
    assert tokens.columns == ["doc_id", "pieces", "byte_pieces"] and tokens.count() == sum(want.values())
    for stage in (spoken, exact, near, mixed):
        assert stage.columns == columns


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = table(spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    for _, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, SF))
        assert docs.count() == 0


@pytest.mark.parametrize("stage, operator", [("language_id", "language_id"), ("exact_dedup", "exact_dedup"), ("simhash_dedup", "simhash_dedup"), ("mixing", "mix")])
def test_decisions_hold_when_the_next_scan_is_split_anew(spark, monkeypatch, tmp_path, stage, operator):
    """The operator's scan has other splits than the one that its decisions are joined to, as when executors come or go."""
    rows = pq.read_table(f"{SF}/documents.parquet")
    pq.write_table(rows, tmp_path / "docs.parquet", row_group_size=8)
    docs = spark.read.parquet(str(tmp_path / "docs.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    want = Counter(r["doc_id"] for r in run(spark, docs, SF).collect())
    plain = getattr(corpus_pipeline, operator)

    def split_anew(df, *args, **named):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        try:
            found = plain(df, *args, **named)
            return found if operator == "mix" else table(found)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    monkeypatch.setattr(corpus_pipeline, operator, split_anew)
    assert Counter(r["doc_id"] for r in run(spark, docs, SF).collect()) == want
