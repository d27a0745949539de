"""Pruned similarity joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import similarity as S
from scorelake.operators import vectors as C
from scorelake.sources.durable import new_path, table


def unit_rows(kind, n, seed, dims=12):
    rng = np.random.default_rng(seed)
    if kind == "clustered":
        centres = np.random.default_rng(99).normal(size=(20, dims))
        x = centres[rng.integers(20, size=n)] + rng.normal(size=(n, dims)) * 0.05
    else:
        x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5] = 0  # a zero vector stays zero
    x[20:60] = x[20]  # a group of equal vectors
    return x


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), "clash", 0) for i, v in enumerate(x)], "pos long, vec array<double>, part string, reach int").repartition(3)


@pytest.mark.parametrize("kind", ["clustered", "random"])
@pytest.mark.parametrize("threshold", [0.9, 0.3, 0.0])
def test_no_pair_is_lost(spark, kind, threshold):
    a, b = unit_rows(kind, 300, 1), unit_rows(kind, 250, 2)
    cos = a @ b.T
    got = {(r["a"], r["b"]): r["cos"] for r in S.similar_pairs(frame(spark, a), frame(spark, b, 1000), threshold, block=32).collect()}
    assert set(got) == {(i, 1000 + j) for i, j in zip(*np.nonzero(cos >= threshold), strict=True)}
    assert all(abs(cos[i, j - 1000] - c) < 1e-9 for (i, j), c in got.items())
    rows = frame(spark, a)
    got = [(r["a"], r["b"]) for r in S.similar_pairs(rows, rows, threshold, block=32, ordered=True).collect()]
    own = a @ a.T
    near = np.abs(own - threshold) < 1e-12  # products that round to either side
    want = {(i, j) for i, j in zip(*np.nonzero((own >= threshold) & ~near), strict=True) if i < j}
    assert len(got) == len(set(got)) and want <= set(got) and all(i < j and own[i, j] >= threshold - 1e-12 for i, j in got)


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_greatest_cosine_and_its_first_row(spark, kind):
    a, b = unit_rows(kind, 300, 1), unit_rows(kind, 250, 2)
    b[100] = b[30]  # an equal one after the first
    cos = a @ b.T
    got = {r["pos"]: r for r in S.greatest_cosine(frame(spark, a), frame(spark, b, 1000), block=32).collect()}
    assert len(got) == 300
    for i in range(300):
        best = np.flatnonzero(cos[i] >= cos[i].max() - 1e-12)
        assert abs(got[i]["cos"] - cos[i].max()) < 1e-9 and got[i]["other"] - 1000 in best
    assert got[5]["cos"] == 0 and got[5]["other"] == 1000
    assert {r["other"] for i, r in got.items() if r["other"] in (1100, 1020 + 1)} == set()  # copies: the first one


def test_parts_that_cannot_reach_do_not_meet(spark):
    """Blocks met on clustered data: far fewer than all; on the whole none is lost (above)."""
    a, b = unit_rows("clustered", 2000, 1), unit_rows("clustered", 2000, 2)
    parts = S.filed(table(frame(spark, b).select("pos", "vec")), 32)
    blocks = parts.blocks.count()
    left = frame(spark, a).select("pos", "vec", F.lit(float(np.arccos(0.9))).alias("reach"), F.lit(-1).alias("at_least"))
    met = S.meetings(left, parts, 32).select(F.size("x").alias("x"), F.size("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("n")).head()["n"]
    assert blocks >= 2000 / 64
    assert met < 2000 * 2000 / 5
    wide = left.withColumn("reach", F.lit(float(np.pi)))
    assert S.meetings(wide, parts, 32).select(F.size("x").alias("x"), F.size("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("n")).head()["n"] == 2000 * 2000


def test_a_third_of_the_rows_alike_goes_to_many_blocks(spark):
    x = unit_rows("random", 600, 3)
    x[:200] = x[0]
    parts = S.filed(table(frame(spark, x).select("pos", "vec")), 16)
    assert parts.blocks.agg(F.max(F.size("rows"))).head()[0] < 60
    cos = {r["pos"]: r["other"] for r in S.greatest_cosine(frame(spark, x), frame(spark, x), block=16).collect()}
    assert all(cos[i] == 0 for i in range(200))


def test_empty_sides_and_missing_vectors(spark):
    none, some = frame(spark, unit_rows("random", 80, 1)).limit(0), frame(spark, unit_rows("random", 80, 1))
    assert S.similar_pairs(some, none, 0.1).count() == 0 and S.similar_pairs(none, some, 0.1).count() == 0
    assert {(r["cos"], r["other"]) for r in S.greatest_cosine(some, none).collect()} == {(0.0, None)}
    assert S.greatest_cosine(none, some).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (None, [1.0, 0.0])], "pos long, vec array<double>")
    assert [(r["a"], r["b"]) for r in S.similar_pairs(odd, odd, 0.5).collect()] == [(2, 2)]
    assert {(r["pos"], r["other"]) for r in S.greatest_cosine(odd.filter("pos > 0"), odd).collect()} == {(1, None), (2, 2)}
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "pos long, vec array<double>")
    assert S.similar_pairs(zero, zero, 0.5, ordered=True).count() == 0
    assert {(r["pos"], r["cos"], r["other"]) for r in S.greatest_cosine(zero, zero).collect()} == {(1, 0.0, 1), (2, 0.0, 1)}


@pytest.mark.parametrize("block", [1000, 7])
def test_pairs_within_cases(spark, block):
    x = unit_rows("random", 120, 4)
    case = [0] * 70 + [1] * 20 + [None] * 30
    df = spark.createDataFrame([(c, i, v.tolist()) for i, (c, v) in enumerate(zip(case, x, strict=True))], "case int, pos long, vec array<double>")
    got = sorted((r["a"], r["b"]) for r in S.case_pairs(df, 0.2, block=block).collect())
    cos = x @ x.T
    assert got == sorted((i, j) for i in range(120) for j in range(i + 1, 120) if case[i] == case[j] and cos[i, j] >= 0.2)


def test_appended_batches_equal_one_run(spark):
    """Batches one after the other keep the leaders and give the joins of the whole; a batch done again changes nothing."""
    x = unit_rows("clustered", 400, 6)
    rows = table(frame(spark, x).select("pos", "vec"))
    folder, found = new_path(spark), []
    for i in (0, 1, 1, 2, 3, 4):
        got = C.dedupe_appended(folder, i, rows.filter(F.expr("pos div 100") == i), 0.8, block=32).collect()
        if i == 1 and len(found) > 100:
            assert sorted(got) == sorted(found[100:])
            continue
        found += got
    whole = C.global_dedupe(rows, 0.8, batch=100, block=32).collect()
    assert sorted((r["pos"], r["leader"], round(r["cos"], 9)) for r in found) == sorted((r["pos"], r["leader"], round(r["cos"], 9)) for r in whole)


@pytest.mark.parametrize("most", [10_000, 20])
def test_large_cases_are_settled_without_gathering_them(spark, most):
    x = unit_rows("clustered", 300, 7)
    case = [1] * 200 + [2] * 60 + [3] * 15 + [4] * 25
    order = np.random.default_rng(1).permutation(300)
    df = spark.createDataFrame([(c, int(order[i]), i, v.tolist(), f"m{i % 3}") for i, (c, v) in enumerate(zip(case, x, strict=True))], "case long, rank long, pos long, vec array<double>, model string").repartition(3)
    got = {r["pos"]: (r["leader"], round(r["cos"], 9), r["tag"], r["case"]) for r in C.dedupe_by_case(df, 0.8, "model", most=most, block=16).collect()}
    want, leaders = {}, {}
    for i in np.argsort(order):
        mine = leaders.setdefault(case[i], [])
        cos = [float(x[j] @ x[i]) for j in mine]
        if cos and max(cos) >= 0.8:
            best = max(cos)
            want[int(i)] = (next(j for j, c in zip(mine, cos, strict=True) if c > best - 1e-12), round(best, 9), f"m{i % 3}", case[i])
        else:
            mine.append(int(i))
            want[int(i)] = (int(i), 0.0, f"m{i % 3}", case[i])
    assert got == want


@pytest.mark.parametrize("most", [100_000, 8])
def test_components_of_large_cases(spark, most):
    rng = np.random.default_rng(5)
    chain = rng.permutation(60).tolist()
    edges = [(1, a, b) for a, b in zip(chain, chain[1:])] + [(2, 0, j) for j in range(1, 40)] + [(3, 4, 5)] + [(4, int(a), int(b)) for a, b in rng.integers(0, 50, size=(30, 2))]
    nodes = [(1, i) for i in range(60)] + [(2, i) for i in range(45)] + [(3, i) for i in range(6)] + [(4, i) for i in range(50)]
    label = {n: n[1] for n in nodes}
    for _ in nodes:
        for c, a, b in edges:
            label[(c, a)] = label[(c, b)] = min(label[(c, a)], label[(c, b)])
    got = C.case_components(spark.createDataFrame(nodes, "case long, pos long"), spark.createDataFrame(edges, "case long, a long, b long"), most).collect()
    assert {(r["case"], r["pos"]): r["component"] for r in got} == label and len(got) == len(nodes)


@pytest.mark.parametrize("how", ["pairs", "own", "greatest"])
def test_rows_moved_grow_with_rows_where_every_block_meets_every_other(spark, monkeypatch, how):
    """Random vectors have no clusters: fine blocks would copy each row to 125 of them."""
    moved, meet = [], S.meetings

    def counted(left, *args, **named):
        out = table(meet(left, *args, **named))
        moved.append(out.agg(F.sum(F.size("x"))).head()[0] or 0)
        return out

    monkeypatch.setattr(S, "meetings", counted)
    monkeypatch.setattr(S, "TILE", 5000)  # several slices a product
    a, b = unit_rows("random", 2000, 1), unit_rows("random", 2000, 2)
    cos = (a if how == "own" else b) @ a.T
    if how == "greatest":
        got = S.greatest_cosine(frame(spark, b), frame(spark, a), block=16).collect()
        assert len(got) == 2000 and all(abs(r["cos"] - cos[r["pos"]].max()) < 1e-9 for r in got if r["pos"] != 5)
    else:
        found = S.similar_pairs(frame(spark, b), frame(spark, a), 0.6, block=16, ordered=how == "own")
        want = np.argwhere(np.triu(cos >= 0.6, 1) if how == "own" else cos >= 0.6)
        assert sorted((r["a"], r["b"]) for r in found.collect() if abs(r["cos"] - 0.6) > 1e-9) == [(i, j) for i, j in want.tolist() if abs(cos[i, j] - 0.6) > 1e-9]
    assert sum(moved) < 2000 * 40


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_leaders_of_slices_are_those_of_all_pairs(spark, kind):
    x = unit_rows(kind, 400, 8)
    rows = table(frame(spark, x).select("pos", "vec"))
    older = F.expr("a div 50 < b div 50")
    want = C._settled(rows, table(S.similar_pairs(rows, rows, 0.55, block=32, ordered=True)), older)
    got = C._joined(rows, 0.55, older, 32, first=20)
    key = lambda df: sorted((r["pos"], r["leader"], round(r["cos"], 9)) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 400
