"""Streams with keyed state: changes only, restarts, timers and the dead letters they make."""

import json
import os
import random

from scorelake.operators import runs as O
from scorelake.streaming import incremental as I
from scorelake.streaming import keyed as K

LOG = "task_id long, status string, seq long"


def put(folder, number, columns, rows):
    """A file of the stream, with a time of its own."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{number}.json")
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(dict(zip(columns, r, strict=True))) for r in rows))
    os.utime(path, (1_700_000_000 + number * 10,) * 2)


def follow(spark, path):
    I.run_to_end(K.changed_last(I.row_stream(spark, f"{path}/in", LOG)), K.changes_to(f"{path}/out"), f"{path}/ck", "update")


def batches(spark, path):
    return {r["batch"]: r["count"] for r in spark.read.parquet(f"{path}/out/changes").groupBy("batch").count().collect()}


def test_batches_write_only_what_they_change(spark, tmp_path):
    log = [(i % 7, "ok" if i % 3 else "error", i) for i in range(60)]
    for n in range(3):
        put(f"{tmp_path}/in", n, ("task_id", "status", "seq"), log[n * 20 : n * 20 + 20])
    for _ in range(2):  # the second run finds nothing new
        follow(spark, tmp_path)
    want = sorted(map(tuple, O.last_status(spark.createDataFrame(log, LOG)).collect()))
    assert sorted(map(tuple, K.current_last(spark, f"{tmp_path}/out").collect())) == want
    assert batches(spark, tmp_path) == {0: 7, 1: 7, 2: 7}
    # restarts from the checkpoint: one task, one row; an older row and a repeated one, none
    put(f"{tmp_path}/in", 3, ("task_id", "status", "seq"), [(3, "again", 100), (4, "old", 1), (5, "error", 54), (None, "no task", 7), (2, "no order", None)])
    follow(spark, tmp_path)
    assert batches(spark, tmp_path) == {0: 7, 1: 7, 2: 7, 3: 2}
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["changes"]
    K.compacted(spark, f"{tmp_path}/out")
    assert not any(n.startswith("batch") for n in os.listdir(f"{tmp_path}/out/changes")) and [n for n in os.listdir(f"{tmp_path}/out/base") if not n.startswith(".")] == ["upto=3"]
    put(f"{tmp_path}/in", 4, ("task_id", "status", "seq"), [(6, "after", 200)])
    follow(spark, tmp_path)
    got = {r["task_id"]: (r["status"], r["seq"]) for r in K.current_last(spark, f"{tmp_path}/out").collect()}
    assert got == {t: (s, q) for t, s, q in want} | {3: ("again", 100), 6: ("after", 200), None: ("no task", 7)}
    last = K.current_last(spark, f"{tmp_path}/out")
    assert I.current_progress(spark.range(9).withColumnRenamed("id", "task_id"), last).first()["pending"] == 2
    seen = []
    I.run_to_end(I.completed_once(I.row_stream(spark, f"{tmp_path}/in", LOG), ["task_id"]), lambda b, n: seen.extend(r["task_id"] for r in b.collect()), f"{tmp_path}/ck2")
    assert sorted(seen, key=str) == sorted([*range(7), None], key=str)


def test_a_batch_done_again_replaces_its_changes(spark, tmp_path):
    write = K.changes_to(f"{tmp_path}/out")
    for rows in ([(1, "a", 1), (2, "b", 2)], [(1, "a", 1)]):
        write(spark.createDataFrame(rows, LOG), 0)
    assert K.current_last(spark, f"{tmp_path}/out").count() == 1
    assert K.current_last(spark, f"{tmp_path}/none").count() == 0
    K.compacted(spark, f"{tmp_path}/none")


def ask(path, number, rows):
    put(path, number, ("task_id", "kind", "at"), [(t, k, f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z") for t, k, s in rows])


def outcomes(spark, path, out):
    stream = K.with_stall_limit(I.row_stream(spark, f"{path}/in", "task_id long, kind string, at timestamp"), 10)
    I.run_to_end(stream, lambda b, n: out.extend((r["task_id"], r["outcome"], r["attempt"], r["asked_at"].second + 60 * r["asked_at"].minute, r["at"].second + 60 * r["at"].minute) for r in b.collect()), f"{path}/ck", "update")
    return out


def test_late_and_missing_answers_and_the_rerun(spark, tmp_path):
    folder, out = f"{tmp_path}/in", []
    ask(folder, 0, [(1, "ask", 0), (2, "ask", 1), (3, "ask", 2), (9, "answer", 2), (7, "ask", 3), (7, "ask", 4)])
    ask(folder, 1, [(1, "answer", 5), (7, "answer", 12), (6, "ask", 13)])
    ask(folder, 2, [(2, "answer", 20), (4, "ask", 21), (6, "answer", 23)])
    outcomes(spark, tmp_path, out)
    # 1 and 6 in time (6 at the limit), 7 by its first question, 2 late, 3 by its timer alone, 4 still waits; 9 was never asked
    assert sorted(out) == [(1, "answered", 1, 0, 5), (2, "late", 1, 1, 20), (2, "timed out", 1, 1, 11), (3, "timed out", 1, 2, 12), (6, "answered", 1, 13, 23), (7, "answered", 1, 3, 12)]
    rows = spark.createDataFrame(out, "task_id long, outcome string, attempt int, asked_at int, at int")
    dead = K.dead_letters(rows).collect()
    assert [(r["task_id"], r["attempt"]) for r in dead] == [(3, 1)]  # a late answer repairs 2
    # the rerun asks it again, after a restart from the checkpoint; a later row moves time on for 4 too
    ask(folder, 3, [(3, "ask", 40), (3, "answer", 45), (5, "ask", 90)])
    again = outcomes(spark, tmp_path, [])
    assert sorted(again) == [(3, "answered", 2, 40, 45), (4, "timed out", 1, 21, 31)]
    every = spark.createDataFrame(out + again, rows.schema)
    assert [(r["task_id"], r["attempt"]) for r in K.dead_letters(every).collect()] == [(4, 1)]


def test_an_answer_at_the_time_of_its_question(spark, tmp_path):
    """1 is answered at once, 2 asked anew at the time of its answer, 3 answered at once after it timed out."""
    ask(f"{tmp_path}/in", 0, [(1, "answer", 0), (1, "ask", 0), (2, "ask", 1), (2, "ask", 5), (2, "answer", 5), (3, "ask", 2), (3, "ask", 30), (3, "answer", 30)])
    out = outcomes(spark, tmp_path, [])
    assert sorted(out) == [(1, "answered", 1, 0, 0), (2, "answered", 1, 1, 5), (2, "timed out", 2, 5, 15), (3, "answered", 2, 30, 30), (3, "timed out", 1, 2, 12)]


def test_last_rows_are_kept_without_python(spark, tmp_path, capsys):
    """State is an aggregate of the engine's: no call for each task. Of equal rows of a batch the greatest status stays, of equal ones of two batches the first batch's."""
    put(f"{tmp_path}/in", 0, ("task_id", "status", "seq"), [(1, "a", 5), (1, "b", 5), (2, None, 5), (2, "c", 4)])
    put(f"{tmp_path}/in", 1, ("task_id", "status", "seq"), [(1, "z", 5), (2, "c", 5), (2, "d", 3)])
    query = I.run_to_end(K.changed_last(I.row_stream(spark, f"{tmp_path}/in", LOG)), K.changes_to(f"{tmp_path}/out"), f"{tmp_path}/ck", "update")
    query.explain()
    plan = capsys.readouterr().out
    assert "StateStoreSave" in plan and "Python" not in plan and "Pandas" not in plan
    assert sorted(map(tuple, K.current_last(spark, f"{tmp_path}/out").collect())) == [(1, "b", 5), (2, None, 5)]
    assert batches(spark, tmp_path) == {0: 2}


def stalls(rows, limit):
    """Outcomes of (task, kind, second) row by row, but for those that only a timer finds."""
    out = []
    for task in sorted({r[0] for r in rows}, key=str):
        asked, attempt, waits = 0, 0, False
        for second, kind in sorted((s, k) for t, k, s in rows if t == task):  # no two rows of a task at one time
            if waits and second > asked + limit:
                waits = False
                out.append((task, "timed out", attempt, asked, asked + limit))
            if kind == "ask" and not waits:
                asked, attempt, waits = second, attempt + 1, True
            elif kind == "answer" and attempt:
                out.append((task, "answered" if waits else "late", attempt, asked, second))
                waits = False
        if waits and asked + limit <= max(r[2] for r in rows):
            out.append((task, "timed out", attempt, asked, asked + limit))
    return sorted(out, key=str)


def test_tasks_share_the_state_and_timer_of_their_bucket(spark, tmp_path):
    """What the store holds grows with the buckets, not with the tasks, which are asked and answered over several batches and restarts; a null task is one of its own."""
    rng, rows, n = random.Random(8), [], 700
    for task in [None, *range(n)]:
        name = None if task is None else f"t{task}"
        rows += [(name, rng.choice(["ask", "ask", "answer"]), s) for s in rng.sample(range(0, 120), rng.randrange(1, 6))]
    rows = sorted(rows, key=lambda r: r[2]) + [("end", "ask", 120)]
    out = []
    for batch in range(6):
        ask(f"{tmp_path}/in", batch, [r for r in rows if r[2] // 21 == batch])
        stream = K.with_stall_limit(I.row_stream(spark, f"{tmp_path}/in", "task_id string, kind string, at timestamp"), 10, "0 seconds", 3)
        query = I.run_to_end(stream, lambda b, n: out.extend((r["task_id"], r["outcome"], r["attempt"], *(r[c].second + 60 * r[c].minute for c in ("asked_at", "at"))) for r in b.collect()), f"{tmp_path}/ck", "update")
    assert sorted(out, key=str) == stalls(rows, 10)
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal < n / 10


def test_a_limit_that_the_watermark_just_reaches(spark, tmp_path):
    ask(f"{tmp_path}/in", 0, [(1, "ask", 0), (2, "ask", 1), (3, "ask", 10)])
    assert outcomes(spark, tmp_path, []) == [(1, "timed out", 1, 0, 10)]


def test_ids_of_other_types(spark, tmp_path):
    """Numbers beside a null task, and times to the microsecond."""
    for kind, name in (("int", 7), ("timestamp", "2024-01-01T00:00:00.123456Z")):
        ask(f"{tmp_path}/{kind}", 0, [(None, "ask", 0), (name, "ask", 0), (name, "answer", 3), (None, "answer", 4), (None, "ask", 5)])
        out = []
        stream = K.with_stall_limit(I.row_stream(spark, f"{tmp_path}/{kind}", f"task_id {kind}, kind string, at timestamp"), 10)
        I.run_to_end(stream, lambda b, n: out.extend(tuple(r) for r in b.selectExpr("date_format(task_id, 'ss.SSSSSS')" if kind == "timestamp" else "task_id", "outcome").collect()), f"{tmp_path}/ck_{kind}", "update")  # noqa: B023
        assert sorted(out, key=str) == sorted([(7 if kind == "int" else "00.123456", "answered"), (None, "answered")], key=str)
