"""Versions, the rewrite cache, numbered bad lines, and packed and compacted documents."""

import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from scorelake.operators.rewrites import RewriteCache
from scorelake.sources import readers
from scorelake.sources.versions import VersionConflict, Versioned


def test_a_reader_sees_whole_versions_while_they_change(spark, tmp_path):
    """Every version has as many rows of one number; a reader that runs all the while sees no other state."""
    out, kind = Versioned(spark, str(tmp_path / "t"), "json", keep=1), "v long, i long"
    rows = lambda v: spark.range(500, numPartitions=4).select(F.lit(v).cast("long").alias("v"), F.col("id").alias("i"))
    out.replace(rows(1))
    seen, stop = set(), threading.Event()

    def reader():
        while not stop.is_set():
            r = Versioned(spark, str(tmp_path / "t"), "json").read(kind).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
            seen.add((r["n"], r["a"] == r["b"]))

    thread = threading.Thread(target=reader)
    thread.start()
    for v in range(2, 7):
        out.replace(rows(v))
    stop.set()
    thread.join()
    assert seen == {(500, True)}
    assert out.version() == 6 and out.read(kind).agg(F.max("v")).first()[0] == 6
    assert len(os.listdir(tmp_path / "t" / "data")) == 6
    # without grace the last three versions stay, and nothing of the others
    out = Versioned(spark, str(tmp_path / "t"), "json", keep=3, grace=0)
    out._swept()
    assert sorted(n for n in os.listdir(tmp_path / "t" / "_manifests") if n.endswith(".json") and not n.startswith(".")) == [f"{n:012d}.json" for n in (4, 5, 6)]
    assert len(os.listdir(tmp_path / "t" / "data")) == 3
    assert out.read(kind, 4).agg(F.max("v")).first()[0] == 4


def test_appended_rows_and_two_writers(spark, tmp_path):
    out, kind = Versioned(spark, f"file://{tmp_path}/t", "parquet"), "i long"
    assert out.version() is None and out.read(kind).count() == 0
    out.append(spark.range(3).withColumnRenamed("id", "i"))
    out.append(spark.range(3, 5).withColumnRenamed("id", "i"))
    assert out.read(kind).count() == 5
    other = Versioned(spark, f"file://{tmp_path}/t", "parquet")
    part = other._written(spark.range(9).withColumnRenamed("id", "i"))
    out.replace(out.read(kind).filter("i > 1"))  # reads what it replaces
    with pytest.raises(VersionConflict):
        other._published(3, [part])
    assert sorted(r["i"] for r in out.read(kind).collect()) == [2, 3, 4]
    out.replace(out.read(kind).limit(0))
    assert out.read(kind).count() == 0
    with pytest.raises(ValueError, match="current"):
        Versioned(spark, "x", keep=0)


def test_a_second_run_asks_for_nothing(spark, tmp_path):
    path = str(tmp_path / "asked")
    os.makedirs(path)

    def judge(texts):
        for t in texts:
            open(f"{path}/{uuid.uuid4().hex}", "w").write(t)
        return [None if t.startswith("keep") else t.upper() for t in texts]

    cache = RewriteCache(spark, f"cache_{uuid.uuid4().hex}", buckets=4)
    rows = [(1, "a"), (2, "keep b"), (3, "a"), (4, None), (5, ""), (6, "C")]
    texts = spark.createDataFrame([(*r, "clash") for r in rows], "i int, text string, rewrite string")
    assert cache.rewritten(texts).agg(F.count("changed")).first()[0] == 0  # nothing asked yet: the originals
    assert cache.fill(texts.select("i", "text"), judge) == 4 and len(os.listdir(path)) == 4
    assert cache.fill(texts.select("i", "text"), judge) == 0 and len(os.listdir(path)) == 4
    got = {r["i"]: (r["final"], r["changed"]) for r in cache.rewritten(texts.select("i", "text")).collect()}
    assert got == {1: ("A", True), 2: ("keep b", False), 3: ("A", True), 4: (None, None), 5: ("", False), 6: ("C", False)}
    again = RewriteCache(spark, cache.name, buckets=4)  # another run finds the table
    assert again.fill(spark.createDataFrame([("d",), ("a",)], "text string"), judge) == 1
    with pytest.raises(Exception, match="answered"):
        again.fill(spark.createDataFrame([("e",)], "text string"), lambda texts: [])
    assert again.fill(texts.select("text").limit(0), judge) == 0


def test_lookups_do_not_shuffle_the_cache(spark):
    cache = RewriteCache(spark, f"cache_{uuid.uuid4().hex}", buckets=4)
    texts = spark.range(200).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    cache.fill(texts, lambda ts: [t + "!" for t in ts])
    alike = cache.bucketed(texts, f"texts_{uuid.uuid4().hex}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = [cache.rewritten(t)._jdf.queryExecution().executedPlan().toString() for t in (texts, alike)]
        assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 0]
        assert cache.rewritten(alike).filter("changed").count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_bucketed_alike_are_asked_without_a_shuffle(spark):
    used = lambda: sum(e.totalShuffleWrite() for e in map(found().apply, range(found().size())))
    found = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    cache = RewriteCache(spark, f"cache_{uuid.uuid4().hex}", buckets=4)
    texts = spark.range(2000).select("id", F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(8)]).alias("text"))
    alike, before = cache.bucketed(texts, f"texts_{uuid.uuid4().hex}"), used()
    assert cache.fill(alike, lambda ts: [t.upper() for t in ts]) == 2000 and cache.fill(alike, lambda ts: [None for _ in ts]) == 0
    assert cache.rewritten(alike).filter("changed and final = upper(text)").count() == 2000
    assert used() - before < 20_000  # counts only; the texts alone are 526,000 bytes


def test_bad_lines_have_their_numbers_in_split_files(spark, tmp_path):
    schema, lines = "a int, b string", ['{"a": %d, "b": "é%s"}' % (i, "x" * (i % 50)) for i in range(4000)]
    for name, bad in (("one", {2500: '{"a": 1', 3000: "no"}), ("two", {}), ("three", {0: '{"a": "x"}', 7: "}"}), ("four", {3999: "[1"})):
        some = [bad.get(i, line) for i, line in enumerate(lines)]
        some[10:10] = ["", "   "]  # blank lines count, and are fine
        (tmp_path / f"{name}.jsonl").write_text("\n".join(some))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        got = {os.path.basename(r["file"]): (r["line"], r["text"]) for r in readers.bad_lines(spark, str(tmp_path), schema).collect()}
        assert got == {"one.jsonl": (2503, '{"a": 1'), "three.jsonl": (1, '{"a": "x"}'), "four.jsonl": (4002, "[1")}
        with pytest.raises(readers.BadLine, match=r"four\.jsonl, line 4002"):
            readers.json_lines_strict(spark, str(tmp_path), schema)
        assert readers.json_lines_strict(spark, str(tmp_path / "two.jsonl"), schema).count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_small_documents_in_as_few_tasks_as_their_bytes_need(spark, tmp_path):
    folder, to = tmp_path / "docs", str(tmp_path / "table")
    for m in ("a", "b"):
        (folder / m).mkdir(parents=True)
        for i in range(500):
            (folder / m / f"case{i}.json").write_text('{\n "n": %d,\n "t": "é"}' % i)
    some = readers.packed_documents(spark, f"{folder}/*/*.json", task_bytes=10_000)
    size = sum(f.stat().st_size for f in folder.glob("*/*.json"))
    assert some.rdd.getNumPartitions() <= -(-size // 10_000) and some.count() == 1000
    keys = {"md": r"/([^/]+)/case", "c": r"case([0-9]+)\.json$"}
    docs = readers.compacted_documents(spark, f"{folder}/*/*.json", to, keys)
    assert docs.count() == 1000 and docs.filter("md = 'b' and c = '7'").first()["text"] == '{\n "n": 7,\n "t": "é"}'
    files = len([f for f in os.listdir(to) if f.endswith(".parquet")])
    readers.compacted_documents(spark, f"{folder}/*/*.json", to, keys)
    assert len([f for f in os.listdir(to) if f.endswith(".parquet")]) == files  # nothing new
    (folder / "a" / "case500.json").write_text("{}")
    (folder / "b" / "case7.json").write_text('{"n": 70000}')
    os.utime(folder / "b" / "case7.json", (4_000_000_000,) * 2)
    docs = readers.compacted_documents(spark, f"{folder}/*/*.json", to, keys)
    assert docs.count() == 1001 and docs.filter("md = 'b' and c = '7'").first()["text"] == '{"n": 70000}'
