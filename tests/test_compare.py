"""Deep comparison against a plain recursive one."""

import json
import math
import random

import pytest

from scorelake.operators.compare import differences, documents, json_documents


def plain(a, b, path=()):
    """What differs, by the contract of `differences`, in Python."""
    name = lambda v: {dict: "object", list: "list", str: "str", bool: "bool", int: "int", float: "float", type(None): "null"}[type(v)]
    if name(a) != name(b):
        return [(path, "type mismatch", name(a), name(b))]
    if isinstance(a, dict):
        out = [((*path, k), "missing from expected", None, None) for k in a.keys() - b.keys()] + [((*path, k), "missing from actual", None, None) for k in b.keys() - a.keys()]
        return out + [d for k in a.keys() & b.keys() for d in plain(a[k], b[k], (*path, k))]
    if isinstance(a, list):
        if len(a) != len(b):
            return [(path, "length mismatch", str(len(a)), str(len(b)))]
        return [d for i, (x, y) in enumerate(zip(a, b, strict=True)) for d in plain(x, y, (*path, i))]
    if isinstance(a, float):
        return [(path, "differs", None, None)] if abs(a - b) > 1e-6 else []
    return [(path, "differs", None, None)] if a != b else []


def shown(path):
    return "".join(f"[{p}]" if isinstance(p, int) else f".{p}" if i else p for i, p in enumerate(path))


def grown(rng, depth=0):
    roll = rng.random()
    if depth < 4 and roll < 0.3:
        return {k: grown(rng, depth + 1) for k in rng.sample(["a", "b", "c.d", "e f", "[0]"], rng.randrange(4))}
    if depth < 4 and roll < 0.55:
        return [grown(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, 2, 0.5, 0.25, 1e-9, "x", "1", "", True, False, None, 10**20])


def changed(rng, v):
    if rng.random() < 0.08:
        return grown(rng, 2)
    if isinstance(v, dict):
        return {k: changed(rng, x) for k, x in v.items() if rng.random() > 0.05}
    if isinstance(v, list):
        return [changed(rng, x) for x in v if rng.random() > 0.05]
    return v + rng.choice([0, 1e-8, 1e-3]) if isinstance(v, float) else v


def test_random_documents(spark):
    rng = random.Random(4)
    actual = {i: {"root": grown(rng), "list": [grown(rng) for _ in range(3)]} for i in range(150)}
    expected = {i: changed(rng, v) for i, v in actual.items()}
    del actual[7], expected[9]
    frame = lambda docs: json_documents(spark.createDataFrame([(i, json.dumps(v), "clash") for i, v in docs.items()], "id int, j string, path string"), "id", "j")
    got = sorted((r["id"], r["path"], r["problem"]) for r in differences(frame(actual), frame(expected)).collect())
    want = [(i, shown(p), problem) for i in actual.keys() & expected.keys() for p, problem, _, _ in plain(actual[i], expected[i])]
    assert got == sorted([*want, (7, "", "missing from actual"), (9, "", "missing from expected")])


def test_lists_and_tolerance_in_columns(spark):
    kind = "id int, rates array<double>, m map<string,int>, s struct<x:array<struct<y:float>>>, n int"
    a = spark.createDataFrame([(1, [0.1, 0.2], {"k": 1}, ([(1.5,)],), None), (2, [0.1], {}, None, 3), (None, [math.nan, 1.0, math.inf], {}, None, 1)], kind)
    e = spark.createDataFrame([(1, [0.1, 0.200000001], {"k": 2}, ([(2.5,)],), None), (2, [0.1, 0.2], {}, ([],), None), (None, [math.nan, math.nan, math.inf], {}, None, 1)], kind)
    got = {(r["id"], r["path"]): (r["problem"], r["a"], r["e"]) for r in differences(documents(a, "id"), documents(e, "id")).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "m.k"): "differs", (1, "s.x[0].y"): "differs", (2, "rates"): "length mismatch", (2, "s"): "type mismatch", (2, "n"): "type mismatch", (None, "rates[1]"): "differs"}
    assert got[(2, "rates")] == ("length mismatch", "1", "2") and got[(2, "n")] == ("type mismatch", "int", "null") and got[(1, "m.k")][1:] == ("1", "2")


@pytest.mark.parametrize("empty", [True, False])
def test_nothing_to_compare(spark, empty):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":null}]}'), (2, None)], "id int, j string")
    df = df.limit(0) if empty else df
    assert differences(json_documents(df, "id", "j"), json_documents(df, "id", "j")).count() == 0
