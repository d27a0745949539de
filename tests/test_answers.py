"""Readers of raw answers, trials and the control of runs, on cases made by hand."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from scorelake.functions import verdicts as V
from scorelake.operators import control as J
from scorelake.operators import matrix as N
from scorelake.operators import trials as T
from scorelake.plans import catalog
from scorelake.sources import readers, writers

SF = "/root/testdata/sf0.001"


def read(spark, column, *raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").coalesce(1)
    return [r["y"] for r in rows.orderBy("i").select(column(F.col("raw")).alias("y")).collect()]


def test_repeated_keys_of_answers_take_the_last(spark):
    got = read(spark, V.batched, '[{"idx":0,"verdict":"yes"},{"idx":0,"verdict":"no","reason":"late"}]', "none here", None)
    assert got[0][0].asDict() == {"verdict": False, "reason": "late"} and got[1] is None and got[2] is None
    got = read(spark, lambda r: V.numbered_map(r, F.lit(2)), '{"1":"yes"," 1":"no"}', '{"x": "yes"}', '{"2": "YES!"}')
    assert got == [{1: "no"}, None, {2: "yes"}]
    found = read(spark, lambda r: V.batched_answer(V.batched(r), F.lit(3)), '[{"idx":1,"verdict":"yes"}]')[0]
    assert found["verdict"] is None and found["reason"] == "missing idx=3 in batched response"


def test_blind_maps(spark):
    of = lambda n: (lambda r: V.blind_map(r, F.lit(n)))
    raws = ['```json\n{"1": [3, "2", true, "x"], "2": "None"}\n``` {"1": 9}', 'a {b} c {"1": 4, "2": "2 and 1 and 0"} d', '{"1": {"1": 2}} then {"1": false, "2": null}', 'open { {"1": 2, "2": 3}', "none", None, "{}"]
    assert read(spark, of(4), *raws) == [{1: [2, 3], 2: []}, {1: [4], 2: [0, 1]}, {1: [], 2: []}, None, None, None, None]
    assert read(spark, of(6), '{"1": 1, "2": 2}') == [None] and read(spark, of(1), '{"1": 7.0}') == [{1: [7]}]


def test_find_only_sides(spark):
    aliases = F.create_map(F.lit("H001"), F.lit("c1"))
    side = lambda r: F.transform(V.only_side(F.from_json(r, V.ONLY_SIDE), aliases), lambda c: F.concat_ws("|", c["criterion_id"], c["reason"]))
    raw = '[{"criterion_id": "h001 ", "status": "matched"}, {"criterion_id": "X9", "status": ""}, {"criterion_id": ""}, {"criterion_id": "H001", "status": "UNIQUE", "reason": " r "}, {"criterion_id": "z", "status": "shared"}]'
    assert read(spark, side, raw, "[]") == [["c1|r", "X9|"], []]


def test_ladder_keeps_reasons(spark):
    far = "x" * 900 + " it fails"
    got = read(spark, V.ladder, '{"meets_requirements": true, "reason": "r", "rewrite": "w"}', far, "no idea")
    assert [tuple(r) for r in got] == [(True, "r", "w"), (False, far[-200:], ""), (None, "no idea", "")]


def test_foils_are_kept_apart():
    kinds = ["FOIL_A", "FOIL_B", "R", "R", "R", "FOIL_A", "FOIL_B"]
    places = T.foils_apart(kinds)
    assert sorted(places) == list(range(7)) and [kinds[p] for p in places] == ["FOIL_A", "R", "R", "FOIL_B", "R", "FOIL_A", "FOIL_B"]
    assert T.foils_apart([]) == [] and T.foils_apart(["FOIL_A", "FOIL_B"]) == [0, 1]


def test_running_order_spreads_kinds(spark):
    got = sorted(catalog.queries()["w5_w6_running_order"](spark, SF).collect(), key=lambda r: r["place"])
    kinds = [r["kind"] for r in got]
    assert [r["place"] for r in got] == list(range(len(got))) and kinds.count("REAL") == 20
    assert kinds[: len(kinds) // 2].count("REAL") in range(8, 13)
    assert sum(a.startswith("FOIL") and b.startswith("FOIL") for a, b in zip(kinds, kinds[1:])) <= 1


def test_matrix_of_a_run(spark, tmp_path):
    raw = [{"label": "A", "response_tag": "a", "rubric_tag": "ra"}, {"label": "B", "response_tag": "b", "rubric_tag": "rb", "enabled": False}, {"label": "C", "response_tag": "c", "rubric_tag": "rc", "reuse_rubric": True}, {"label": "D", "response_tag": "c", "rubric_tag": "rd"}]

    def matrix(entries, selected=""):
        (tmp_path / "m.json").write_text(json.dumps({"models": entries}, indent=1))
        return {r["label"]: r for r in N.run_matrix(spark, str(tmp_path / "m.json"), selected).collect()}

    every = matrix(raw)
    assert set(every) == {"A", "C", "D"} and every["C"]["reuse_rubric"] and not every["A"]["reuse_response"] and every["C"]["run_slug"] == "c__rubric__rc"
    assert set(matrix(raw, " a, c__rubric__rd,")) == {"A", "D"} and set(matrix(raw, "c")) == {"C", "D"}
    for bad, tags, why in ((raw, "b", "called b"), ([raw[0], {"label": "x", "rubric_tag": "r"}], "", "entry 1 .* lacks response_tag"), (raw[1:2], "", "no entry is left"), ([], "", "no entry is left")):
        with pytest.raises(ValueError, match=why):
            matrix(bad, tags)


def test_paths_below_two_roots(spark, tmp_path):
    release, repository = tmp_path / "re.l (1)", tmp_path / "repo"
    for f in (release / "a" / "x.txt", repository / "a" / "x.txt", repository / "b" / "c" / "y.txt"):
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    names = ["/x", "a/x.txt", "a", "b/c", "b/c/", "b/c/y.txt", "b/c/y", "data/z", "z", None]
    got = {r["path"]: r["resolved"] for r in N.resolved_paths(spark.createDataFrame([(n, 1) for n in names], "path string, _n int"), str(release), str(repository)).collect()}
    below = {"a/x.txt": release, "a": release, "b/c": repository, "b/c/": repository, "b/c/y.txt": repository, "b/c/y": repository, "data/z": release, "z": repository}
    assert got == {"/x": "/x", None: None} | {n: f"{root}/{n}" for n, root in below.items()}


@pytest.mark.parametrize(("jobs", "workers", "want"), [(3, 8, [(0, 2)] * 3), (4, 2, [(0, 1), (0, 1), (1, 1), (1, 1)]), (2, 0, [(0, 1), (1, 1)]), (0, 4, [])])
def test_workers_of_jobs(spark, jobs, workers, want):
    got = N.worker_shares(spark.range(jobs), workers, "id").orderBy("id").collect()
    assert [(r["wave"], r["workers"]) for r in got] == want


def test_pilots_come_before_full_runs():
    def run_of(gives, target=10, **how):
        rows, asked = [0], []
        return J.pilot_then_full(lambda: rows[0], lambda upto: (asked.append(upto), rows.__setitem__(0, gives(upto))), 3, target, **how), asked

    whole = lambda upto: upto or 10
    assert run_of(whole) == (("done", 10), [3, None]) and run_of(whole, pilot_only=True) == (("pilot_only_done", 3), [3])
    assert run_of(whole, skip_pilot=True) == (("done", 10), [None]) and run_of(lambda u: u or 7) == (("partial", 7), [3, None])
    assert run_of(whole, target=0) == (("done_already", 0), [])
    with pytest.raises(RuntimeError, match="pilot gave 1"):
        run_of(lambda u: 1)


def test_only_one_run_holds_a_lock(spark, tmp_path):
    with J.run_lock(spark, str(tmp_path)):
        with pytest.raises(RuntimeError, match="locked"), J.run_lock(spark, str(tmp_path)):
            pass
    with J.run_lock(spark, str(tmp_path)):
        pass
    (tmp_path / ".lock").touch()  # of a run that was killed
    os.utime(tmp_path / ".lock", (1, 1))
    with J.run_lock(spark, str(tmp_path), stale=60):
        pass
    assert not (tmp_path / ".lock").exists()


def test_a_table_is_made_by_one_run_and_waited_for_by_others(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        time.sleep(1)
        return spark.range(5)

    found = []
    runs = [threading.Thread(target=lambda: found.append(J.cached_once(spark, str(tmp_path), make, wait=60).count())) for _ in range(3)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert found == [5, 5, 5] and made == [1]
    os.remove(tmp_path / "table" / "_SUCCESS")  # cut off: made anew
    assert J.cached_once(spark, str(tmp_path), make).count() == 5 and made == [1, 1]


def test_failing_judges_are_asked_again(spark):
    def judge(prompts, attempt, **options):
        if attempt == 0 and "a" in prompts:
            raise RuntimeError("busy")
        return ["" if p == "never" else p.upper() for p in prompts]

    rows = spark.createDataFrame([("a",), ("never",)], "prompt string").coalesce(1)
    assert {r["prompt"]: r["answer"] for r in J.answered(rows, judge, {}, wait=0.0).collect()} == {"a": "A", "never": ""}


def test_pairs_of_exact_names_come_first(spark, tmp_path):
    for name in ("ai_x.jsonl", "human_x.jsonl", "ai_rubric_1.jsonl", "human_rubric_1.jsonl", "human_rubric_2.jsonl"):
        (tmp_path / name).write_text("{}")
    ai, human = readers.rubric_pair(spark, str(tmp_path), "ai_x.jsonl", "human_x.jsonl")
    assert ai.endswith("/ai_x.jsonl") and human.endswith("/human_x.jsonl")
    with pytest.raises(ValueError, match="'human': 2"):
        readers.rubric_pair(spark, str(tmp_path), "no.jsonl", "human_x.jsonl")


def test_files_are_replaced_whole(spark, tmp_path):
    for text in ("one", "two"):
        writers.replace_file(spark.createDataFrame([(text,)], "value string"), str(tmp_path / "f.txt"))
    assert (tmp_path / "f.txt").read_text() == "two\n" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["f.txt"]


def test_every_concept_and_line_counts(spark):
    lines = sum(r["text"].count("\n") + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] is not None)
    assert catalog.queries()["j14_j15_resolved_ids"](spark, SF).count() == lines == catalog.queries()["x9_inner_capitals"](spark, SF).count()
