import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm.mixing import _offsets, mix, word_count
from scorelake.llm.preference import preference_format
from scorelake.llm.topk import ApproximationFile, cells_of, exact_topk
from scorelake.llm.url_filter import url_filter

# ---- mixing -----------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, ceiling=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        level = rest / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] > ceiling * sizes[n] + 1e-9}
        if not over:
            return target | {n: level * weight[n] for n in free}
        target |= {n: ceiling * sizes[n] for n in over}
        free -= over
    return target


def mixed_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 400])), rng.choices(["a", "b", "é", "Z", None, "tiny"], [30, 8, 8, 8, 4, 1])[0]) for i in range(400)]
    return rows + [(1000, None, "a"), (1001, "x " * 20_000, "b"), (5, "again", "a"), (5, "again", "a"), (None, "no id here", "Z"), (1002, "lone", "only")]


def test_mix_reaches_targets_within_the_ceiling(spark):
    rows = mixed_rows()
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, taken string")
    got = mix(df, block_words=64).taken().collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    source = {}
    for r in got:
        source.setdefault((round(r["target"], 6), r["source_size"]), []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert {(round(v, 6), sizes[k]) for k, v in want.items()} == set(source)
    for (target, _), members in source.items():
        assert abs(sum(r["taken"] for r in members) - target) <= 0.5


@pytest.mark.parametrize("block_words", [1, 7, 64, 1024])
def test_taken_words_are_those_of_the_scheduled_blocks(spark, block_words):
    """Streams laid out word by word, and every slot's words handed out, in Python."""
    df = spark.createDataFrame(mixed_rows(3)[:60] + [(2000, "one two", "lone")], "doc_id long, text string, source string")
    hashed = df.select("doc_id", "source", word_count(F.col("text")).alias("n"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(42)).alias("h")).collect()
    plan = mix(df, block_words=block_words)
    sources = {r["sid"]: r for r in plan.sources.collect()}
    slots = {}
    for r in plan.schedule.collect():
        slots.setdefault(r["sid"], []).append(r)
    want = {}
    for sid, s in sources.items():
        stream = [r["doc_id"] for r in sorted((r for r in hashed if r["source"] == s["source"]), key=lambda r: (r["h"] >> 52 & 4095, r["h"], r["doc_id"])) for _ in range(r["n"])]
        left = round(s["target"])
        for slot in sorted(slots.get(sid, []), key=lambda r: r["slot"]):
            words = stream[slot["block"] * block_words : (slot["block"] + 1) * block_words][:left]
            left -= len(words)
            for i in words:
                want[i] = want.get(i, 0) + 1
        assert left == 0
    got = {r["id"]: r["taken"] for r in plan.taken().collect()}
    assert {i: n for i, n in got.items() if n} == want


@pytest.mark.parametrize("wide", [2, 4096])
def test_offsets_in_two_levels(spark, wide):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(40), rng.randrange(9)) for _ in range(500)]
    got = {(r["g"], r["c"]): r["offset"] for r in _offsets(spark.createDataFrame(rows, "g long, c long, v long"), "g", "c", F.col("v"), wide).collect()}
    assert got == {(g, c): sum(v for h, d, v in rows if h == g and d < c) for g, c, _ in rows}


def test_mix_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(mixed_rows(2), "doc_id long, text string, source string")
    runs = [sorted((str(r["id"]), r["size"], r["taken"]) for r in mix(d, block_words=64).taken().collect()) for d in (df.repartition(1), df.repartition(7))]
    assert runs[0] == runs[1]


def test_schedule_spreads_each_source(spark):
    df = spark.createDataFrame([(i, "w " * 100, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    plan = mix(df, block_words=32)
    slots = plan.schedule.orderBy("slot").collect()
    assert len({r["slot"] for r in slots}) == len(slots)
    half = slots[: len(slots) // 2]
    for sid in {r["sid"] for r in slots}:
        assert abs(sum(r["sid"] == sid for r in half) - sum(r["sid"] == sid for r in slots) / 2) <= 12
        ranks = sorted(r["rank"] for r in slots if r["sid"] == sid)
        assert ranks == list(range(len(ranks)))
    assert all(r["epoch"] in (0, 1) for r in slots)


def test_mix_of_nothing_and_of_nothing_but_blanks(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).taken().count() == 0
    blanks = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mix(blanks).taken().collect()] == [(0, 0.0), (0, 0.0)]


def test_word_count(spark):
    texts = ["", None, " a  b\n", "a\x0bb\x0cc\rd\te", "a\u00a0b", "x" * 100_000, "a " * 50_000]
    got = [r["n"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).orderBy("i").select(word_count(F.col("t")).alias("n")).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]


# ---- preference pairs -------------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "good <|user|>"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", None), (1, 3, "assistant", None),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (None, 0, "user", "lost"), (6, 0, None, None), (7, 0, "", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in preference_format(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).collect()}
    a = got[0]
    assert a["n_common"] == 3 and a["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    assert a["chosen"] == "<|assistant|>\ngood < |user|><|end|>\n" and a["rejected"] == "<|assistant|>\n<|end|>\n"
    (span,) = a["chosen_mask"]
    assert a["chosen"][span["start"] : span["end"]] == "good < |user|><|end|>\n"
    assert got[1]["n_common"] == 1 and got[1]["chosen"] == got[1]["rejected"] == "" and got[1]["chosen_mask"] == []
    assert got[2]["rejected_id"] is None and got[2]["n_common"] == 0 and got[2]["chosen"].startswith("<|user|>")
    assert got[3]["n_common"] == 0  # a null turn is not an empty one
    assert set(got) == {0, 1, 2, 3}
    assert preference_format(df.limit(0), F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).count() == 0


# ---- URL filters ------------------------------------------------------------------------------


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "badexample.com", "net", "x.net", "example.com.net", "", "localhost"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y", "/es/", "/é/", "/en/\u0001", "//"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:8] for p in ("/", "/en/", "/en/x", "/es/", "/é/", "") if rng.random() < 0.5]
    urls = [f"{s}://{h.upper() if rng.random() < 0.2 else h}{p}{e}" for s in ("http", "s") for h in hosts for p in paths for e in ("", "?q=/en/", "#f://z")]
    urls += [None, "", "no scheme", "http://example.com/en/" + "y" * 50_000] + ["http://example.com/en/x"] * 300
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = {r["id"]: r for r in url_filter(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = host.lower()
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == brute_rule(host, path, rules), u


def test_url_filter_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in url_filter(pages, none).collect()] == [(None, "allow")]
    assert url_filter(pages.limit(0), none).count() == 0


# ---- top-k ------------------------------------------------------------------------------------


def brute_topk(rows, k):
    whole = [(n, i, [int(np.floor(256 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for m, j, v in whole if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block,queries", [(64, 3), (8192, 4096)])
def test_topk_matches_brute_force(spark, block, queries):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 340)] + [(100, rows[3][1]), (350, None), (351, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (401, [float("inf")] * 6), (450, [1.0, 2.0]), (451, [0.5, 0.5]), (None, rows[0][1]), (500, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = exact_topk(df, "id % 50 = 0", block=block, query_block=queries)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, 5)
    assert exact_topk(df.limit(0), "id % 50 = 0").count() == 0


def test_ids_that_are_no_numbers(spark):
    rows = [(f"v{i % 7}", [float(i % 3), float(i % 5)]) for i in range(40)] + [("v0", None)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["score"], r["id"]) for r in exact_topk(df, "id = 'v3'", k=3, block=16).collect())
    want = []
    whole = [(n, i, [256 * int(x) for x in v]) for n, (i, v) in enumerate(rows) if v]
    for n, i, q in whole:
        if i == "v3":
            best = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for m, j, v in whole if m != n)[:3]
            want += [(i, r + 1, -s, j) for r, (s, j, _) in enumerate(best)]
    assert got == sorted(want)


def test_bounds_hold_every_product():
    rng = np.random.default_rng(4)
    rows, qs = np.floor(rng.normal(0, 300, (500, 16))), np.floor(rng.normal(0, 300, (20, 16)))
    low, high = ApproximationFile(*cells_of(rows, 4)).bounds(qs)
    exact = qs @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < (exact.max() - exact.min())


def test_huge_components_score_exactly(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, -1e9 + 1]), (2, [3e300, 1.0]), (3, [1e9, 1e9])], "vec_id long, embedding array<double>")
    got = {r["id"]: r["score"] for r in exact_topk(df, "id = 0").collect()}
    big = 256 * 10**9
    assert got[3] == 2**63 - 1 or got[3] == 2 * big * big
    assert got[1] == big * big + big * (-big + 256)
