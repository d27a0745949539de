"""Queries of runs, statistics, validation and annotation (A23-A34, D, I, M), with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stats as M
from ..operators import agree as G
from ..operators import compare as D
from ..operators import control as J
from ..operators import runs as O
from ..sources import readers, writers
from .catalog import query
from .scoring import rounded

_MATCH = "m AS (SELECT c AS \"case\", CASE WHEN hj = 'YES' AND mj = 'YES' THEN 'matched' WHEN hj = 'YES' THEN 'nearby' ELSE 'none' END AS status FROM pairs)"
_RATES = "x AS (SELECT \"case\", count(*) AS n, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'nearby') AS nearby, count(*) FILTER (status = 'none') AS none FROM m GROUP BY 1)"


def _matches(pairs):
    status = F.when((F.col("hj") == "YES") & (F.col("mj") == "YES"), "matched").when(F.col("hj") == "YES", "nearby").otherwise("none")
    return pairs.select(F.col("c").alias("case"), status.alias("status"))


@query("a23_a37_match_metrics", f"WITH {_MATCH}, {_RATES} SELECT *, matched + nearby AS covered, round(matched / n, 6) AS matched_rate, round(nearby / n, 6) AS nearby_rate, round(none / n, 6) AS none_rate, round((matched + nearby) / n, 6) AS covered_rate FROM x")
def a23(pairs):
    return rounded(O.match_metrics(_matches(pairs)), "matched_rate", "nearby_rate", "none_rate", "covered_rate")


@query("a24_mean_metrics", f"WITH {_MATCH}, {_RATES} SELECT count(*) AS cases, round(avg(matched / n), 6) AS matched_rate, round(avg(nearby / n), 6) AS nearby_rate, round(avg(none / n), 6) AS none_rate, round(avg((matched + nearby) / n), 6) AS covered_rate FROM x")
def a24(pairs):
    return rounded(O.mean_metrics(O.match_metrics(_matches(pairs))), "matched_rate", "nearby_rate", "none_rate", "covered_rate")


@query("a25_i5_progress", "WITH l AS (SELECT task_id, arg_max(status, seq) AS status FROM status_log GROUP BY 1), k AS (SELECT t.task_id, l.status FROM tasks t LEFT JOIN l USING (task_id)) SELECT count(*) AS total, count(status) AS completed, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (task_id % 100 = 0) AS resumed, count(*) FILTER (status IS NULL) AS pending FROM k")
def a25(tasks, status_log):
    return O.progress(tasks, status_log, tasks.filter("task_id % 100 = 0"))


@query("a26_i4_last_status", "SELECT task_id, arg_max(status, seq) AS status, max(seq) AS seq FROM status_log GROUP BY 1")
def a26(status_log):
    return O.last_status(status_log)


@query("a32_j17_foil_scores", """WITH t AS (SELECT criterion_id, CASE criterion_id % 3 WHEN 0 THEN 'POS' WHEN 1 THEN 'FOIL_HARD' ELSE 'FOIL_EASY' END AS kind, meets AS match FROM verdicts WHERE judge = 'judge_c'),
r AS (SELECT CASE WHEN kind = 'POS' THEN 'sensitivity' ELSE 'specificity' END AS measure, kind, CASE WHEN kind = 'POS' THEN match ELSE NOT match END AS ok FROM t)
SELECT measure, kind, count(*) AS n, round(100 * avg(CAST(ok AS INT)), 6) AS rate FROM r GROUP BY 1, 2 UNION ALL SELECT measure, 'all', count(*), round(100 * avg(CAST(ok AS INT)), 6) FROM r GROUP BY 1""")
def a32(verdicts):
    """Keys of trials, joined with the answers that there are."""
    keys = verdicts.select("criterion_id").distinct().select("criterion_id", F.when(F.col("criterion_id") % 3 == 0, "POS").when(F.col("criterion_id") % 3 == 1, "FOIL_HARD").otherwise("FOIL_EASY").alias("kind"))
    answers = verdicts.filter("judge = 'judge_c'").select("criterion_id", F.col("meets").alias("match"))
    return rounded(G.foil_scores(keys.join(answers, "criterion_id", "left")), "rate")


@query("a33_spot_tallies", "WITH r AS (SELECT priority AS stratum, task_id % 2 = 0 AS same, task_id % 5 < 2 AS general, cust % 3 = 0 AS opened FROM tasks) SELECT stratum, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (same) / count(*), 6) AS same_rate, round(100.0::DOUBLE * count(*) FILTER (same AND general) / count(*) FILTER (same), 6) AS general_rate, count(*) FILTER (opened) AS opened FROM r GROUP BY 1")
def a33(tasks):
    rows = tasks.select(F.col("priority").alias("stratum"), F.expr("task_id % 2 = 0").alias("same"), F.expr("task_id % 5 < 2").alias("more_general"), F.expr("cust % 3 = 0").alias("opened"))
    return rounded(G.spot_tallies(rows), "same_rate", "general_rate")


@query("a34_majorities", "WITH p AS (SELECT criterion_id, count(meets) AS n, count(*) FILTER (meets) AS y FROM verdicts GROUP BY 1 HAVING count(meets) >= 2) SELECT count(*) AS items, round(100.0::DOUBLE * count(*) FILTER (y * 2 > n) / count(*), 6) AS majority_rate, round(100.0::DOUBLE * count(*) FILTER (y = 0 OR y = n) / count(*), 6) AS unanimous_rate FROM p")
def a34(verdicts):
    return rounded(G.majorities(verdicts, "criterion_id", "meets"), "majority_rate", "unanimous_rate")


_CHOOSE = "exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
_TAIL = "list_sum(list_transform(range(k, n + 1), lambda i: " + _CHOOSE.format(n="n") + "))"


@query("m1_binomial_tail", f"WITH t AS (SELECT task_id, task_id % 90 + 1 AS n, task_id % 7 * (task_id % 90 + 1) // 7 AS k FROM tasks) SELECT task_id, round({_TAIL}, 9) AS p FROM t")
def m1(tasks):
    """Chance of k or more of n, exactly; the published case is in the tests."""
    n = F.col("task_id") % 90 + 1
    rows = tasks.select("task_id", n.alias("n"), F.expr("(task_id % 7 * (task_id % 90 + 1)) div 7").alias("k"))
    return rounded(rows.select("task_id", M.binomial_tail("k", "n").alias("p")), "p", digits=9)


@query("m1_m11_log_tail", f"WITH t AS (SELECT task_id, task_id % 90 + 1 AS n, (task_id % 7 * (task_id % 90 + 1)) // 7 + 1 AS k FROM tasks) SELECT task_id, abs(round(ln({_TAIL}), 6)) AS log_p FROM t")
def m1b(tasks):
    rows = tasks.select("task_id", (F.col("task_id") % 90 + 1).cast("int").alias("n"), F.expr("cast((task_id % 7 * (task_id % 90 + 1)) div 7 + 1 as int)").alias("k"))
    return rounded(rows.select("task_id", F.abs(M.log_tail(F.col("k"), F.col("n"))).alias("log_p")), "log_p")


# the normal tail by Simpson's rule over 2000 steps up to |z|
_NORMAL = "1 - 2 * list_sum(list_transform(range(0, 2001), lambda j: (CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(z * j / 2000, 2) / 2))) * z / 6000 / sqrt(2 * pi())"


@query("m2_sign_test", f"""WITH c AS (SELECT h_part % 40 AS grp, count(*) FILTER (hj = 'YES' AND mj = 'NO') AS a, count(*) FILTER (hj = 'NO' AND mj = 'YES') AS b FROM pairs GROUP BY 1
UNION ALL SELECT -1, count(*) FILTER (hj = 'YES' AND mj = 'NO'), count(*) FILTER (hj = 'NO' AND mj = 'YES') FROM pairs),
n AS (SELECT grp, a, b, a + b AS n, least(a, b) AS k, abs(a - b) / sqrt(greatest(a + b, 1)) AS z FROM c)
SELECT grp, a, b, CASE WHEN n = 0 THEN NULL WHEN n < 1100 THEN round(2 * list_sum(list_transform(range(0, k + 1), lambda i: {_CHOOSE.format(n="n")})), 9) WHEN z > 12 THEN 0 ELSE abs(round({_NORMAL}, 9)) END AS p FROM n""")
def m2(pairs):
    """Groups of pairs, exact where they are small, and all pairs."""
    counted = lambda rows, grp: rows.groupBy(grp.alias("grp")).agg(F.count_if(F.expr("hj = 'YES' and mj = 'NO'")).alias("a"), F.count_if(F.expr("hj = 'NO' and mj = 'YES'")).alias("b"))
    counts = counted(pairs, F.col("h_part") % 40).unionByName(counted(pairs, F.lit(-1).cast("long")))
    return rounded(counts.withColumn("p", M.sign_test("a", "b")), "p", digits=9)


@query("m4_m5_weak_floor", "WITH g AS (SELECT model, avg(output_tokens) FILTER (changed) AS strong, avg(output_tokens) FILTER (NOT changed) AS weak FROM judgements GROUP BY 1) SELECT round(avg(100 * weak / strong), 6) AS retention, max(weak) < 600 AS below_floor, max(weak) < 600 AND min(strong) - max(weak) >= 10 AS below_with_margin FROM g")
def m5(judgements):
    gaps = judgements.groupBy("model").agg(F.avg(F.when(F.col("changed"), F.col("output_tokens"))).alias("strong"), F.avg(F.when(~F.col("changed"), F.col("output_tokens"))).alias("weak"))
    return rounded(G.weak_floor(gaps, 600, 10), "retention")


@query("m9_threshold_verdict", "SELECT task_id, CASE WHEN a >= 0.6 AND b >= 0.6 THEN 'confirmed' WHEN a >= 0.6 AND b <= 0.4 THEN 'meaning kept only' WHEN a > 0.4 AND a < 0.6 THEN 'middle' ELSE 'mixed' END AS verdict FROM (SELECT task_id, avg(CAST(changed AS INT)) AS a, avg(CASE WHEN criterion_weight > 1 THEN 1 ELSE 0 END) AS b FROM judgements GROUP BY 1)")
def m9(judgements):
    """Of each task: the shares of its judgements that changed, and of its heavy criteria."""
    rates = judgements.groupBy("task_id").agg(F.avg(F.col("changed").cast("int")).alias("a"), F.avg((F.col("criterion_weight") > 1).cast("int")).alias("b"))
    return rates.select("task_id", G.threshold_verdict(F.col("a"), F.col("b")).alias("verdict"))


@query("m10_rounding", "SELECT task_id, round_even(task_id / 4.0::DOUBLE, 1) AS r FROM tasks")
def m10(tasks):
    """Half to even, as the published means are rounded."""
    return tasks.select("task_id", F.bround(F.col("task_id") / 4, 1).alias("r"))


@query("d1_d2_differences", "SELECT task_id AS id, 'stats.weight' AS path, 'differs' AS problem, CAST(2 * task_id AS VARCHAR) AS a, CAST(2 * task_id + 1 AS VARCHAR) AS e FROM tasks WHERE task_id % 50 = 0 UNION ALL SELECT task_id, 'name', 'type mismatch', 'str', 'null' FROM tasks WHERE task_id % 70 = 0")
def d1(tasks):
    """Metrics as columns; a missing name is null."""
    t = F.col("task_id")
    actual = tasks.select("task_id", F.struct((t * 2).alias("weight"), (t / 3).alias("mean")).alias("stats"), F.col("priority").alias("name"))
    expected = tasks.select("task_id", F.struct((t * 2 + (t % 50 == 0).cast("int")).alias("weight"), (t / 3 + 1e-9).alias("mean")).alias("stats"), F.when(t % 70 != 0, F.col("priority")).alias("name"))
    return D.differences(D.documents(actual, "task_id"), D.documents(expected, "task_id"))


_DEEP = """SELECT task_id AS id, 'runs[1].rate' AS path, 'differs' AS problem, '0.5' AS a, '0.25' AS e FROM tasks WHERE task_id % 11 = 0
UNION ALL SELECT task_id, 'runs', 'length mismatch', '2', '3' FROM tasks WHERE task_id % 11 = 1
UNION ALL SELECT task_id, 'runs[0].tags[1]', 'type mismatch', 'str', 'int' FROM tasks WHERE task_id % 11 = 2
UNION ALL SELECT task_id, 'runs[0].extra', 'missing from expected', '[1,2]', NULL FROM tasks WHERE task_id % 11 = 3
UNION ALL SELECT task_id, 'by.' || status, 'missing from actual', NULL, '{"n":' || task_id || '}' FROM tasks WHERE task_id % 11 = 4
UNION ALL SELECT task_id, 'runs[1]', 'type mismatch', 'object', 'list' FROM tasks WHERE task_id % 11 = 5
UNION ALL SELECT task_id, '', 'missing from actual', NULL, '{"by":{},"runs":[]}' FROM tasks WHERE task_id % 11 = 6
UNION ALL SELECT task_id, 'note', 'type mismatch', 'null', 'str' FROM tasks WHERE task_id % 11 = 8"""


@query("d1_deep_differences", _DEEP)
def d1_deep(tasks):
    """Documents of lists in objects in lists, different in one way each by the task's number; 7 differs within the tolerance, 9 and 10 not at all."""
    t, m = F.col("task_id").cast("string"), F.col("task_id") % 11
    at = lambda n, special, usual: F.when(m == n, special).otherwise(usual)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    a = text('{"runs":[{"rate":0.125,"tags":["x","y"]', at(3, F.lit(',"extra":[1,2]'), F.lit("")), '},{"rate":0.5}],"by":{}', at(8, F.lit(',"note":null'), F.lit("")), "}")
    second = at(0, F.lit('{"rate":0.25}'), at(5, F.lit("[0.5]"), at(7, F.lit('{"rate":0.50000001}'), F.lit('{"rate":0.5}'))))
    e = text('{"runs":[{"rate":0.125,"tags":["x",', at(2, F.lit("1"), F.lit('"y"')), "]},", second, at(1, F.lit(',{"rate":1.5}'), F.lit("")), '],"by":{', at(4, text('"', F.col("status"), '":{"n":', t, "}"), F.lit("")), "}", at(8, F.lit(',"note":"q"'), F.lit("")), "}")
    actual = tasks.filter(m != 6).select("task_id", a.alias("j"))
    expected = tasks.select("task_id", at(6, F.lit('{"runs":[],"by":{}}'), e).alias("j"))
    return D.differences(D.json_documents(actual, "task_id", "j"), D.json_documents(expected, "task_id", "j"))


@query("i3_k11_complete_cases", "WITH n AS (SELECT task_id, count(*) AS n FROM judgements GROUP BY 1), e AS (SELECT task_id, CASE WHEN task_id % 3 = 0 THEN coalesce(n, 0) + 1 ELSE coalesce(n, 0) END AS expected, coalesce(n, 0) AS n FROM tasks LEFT JOIN n USING (task_id)) SELECT count(*) FILTER (n <> expected) AS again, CAST(sum(n) FILTER (n = expected) AS BIGINT) AS kept FROM e")
def i3(judgements, tasks):
    n = judgements.groupBy("task_id").agg(F.count(F.lit(1)).alias("k"))
    expected = tasks.select("task_id").join(n, "task_id", "left").select("task_id", (F.coalesce("k", F.lit(0)) + (F.col("task_id") % 3 == 0).cast("int")).alias("expected"))
    kept, again = O.complete_cases(judgements.select("task_id", "criterion_id"), expected)
    return again.agg(F.count(F.lit(1)).alias("again")).join(kept.agg(F.count(F.lit(1)).alias("kept")))


@query("i6_i11_seeded", "SELECT count(*) AS n, count(*) FILTER (status IS NULL) AS without_status FROM (SELECT task_id, status FROM status_log WHERE status = 'ok' UNION ALL SELECT task_id, NULL FROM tasks WHERE task_id NOT IN (SELECT task_id FROM status_log WHERE status = 'ok'))")
def i11(tasks, status_log):
    """Seeded from every event that ended well."""
    earlier = status_log.filter("status = 'ok'").select("task_id", "status")
    return O.seeded(earlier, tasks.select("task_id", "priority"), ["task_id"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isNull()).alias("without_status"))


@query("j19_one_sided_ids", "WITH a AS (SELECT task_id, list(DISTINCT criterion_id) FILTER (changed) AS x, list(DISTINCT criterion_id) FILTER (criterion_weight > 1) AS y FROM judgements GROUP BY 1) SELECT task_id, len(list_filter(coalesce(x, []), lambda e: list_contains(coalesce(y, []), e))) AS confirmed, len(list_filter(coalesce(x, []), lambda e: NOT list_contains(coalesce(y, []), e))) AS missed FROM a")
def j19(judgements):
    ids = lambda c: F.collect_set(F.when(c, F.col("criterion_id")))
    rows = judgements.groupBy("task_id").agg(ids(F.col("changed")).alias("x"), ids(F.col("criterion_weight") > 1).alias("y"))
    found = rows.select("task_id", O.one_sided_ids(F.col("x"), F.col("y")).alias("s"))
    return found.select("task_id", F.size("s.confirmed").cast("long").alias("confirmed"), F.size("s.missed").cast("long").alias("missed"))


@query("d2_d3_reports", r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM turns), h AS (SELECT 'th_word' AS pattern, count(*) FILTER (regexp_matches(t, '\bthe\b')) AS n FROM l UNION ALL SELECT 'digits', count(*) FILTER (regexp_matches(t, '[0-9]{3}')) FROM l UNION ALL SELECT 'never', 0)
SELECT 'closure' AS report, pattern, CASE WHEN n > 0 THEN 'failed' ELSE 'ok' END AS status, n FROM h UNION ALL SELECT 'metrics', 'differs', CASE WHEN count(*) > 0 THEN 'failed' ELSE 'ok' END, count(*) FROM tasks WHERE task_id % 50 = 0""")
def d2(turns, tasks):
    """A closure scan by pattern and a comparison of metrics, each with its outcome."""
    from ..functions.text import forbidden

    patterns = {"th_word": r"\bthe\b", "digits": r"[0-9]{3}", "never": "\x01"}
    hits = forbidden(turns.select(F.col("conv_id").alias("path"), "text"), patterns)
    t = F.col("task_id")
    whole = lambda weight: D.documents(tasks.select("task_id", weight.alias("weight")), "task_id")
    found = D.differences(whole(t * 2), whole(t * 2 + (t % 50 == 0).cast("int")))
    return O.outcome(hits, "pattern", list(patterns)).select(F.lit("closure").alias("report"), "pattern", "status", "n").unionByName(O.outcome(found, "problem", ["differs"]).select(F.lit("metrics").alias("report"), F.col("problem").alias("pattern"), "status", "n"))


@query("a28_dimensions", "SELECT CASE WHEN changed THEN 'human' ELSE 'model' END AS side, d AS dimension, count(*) AS n FROM (SELECT changed, unnest(string_split(criterion_dimension, ' ')) AS d FROM judgements) GROUP BY 1, 2")
def a28(judgements):
    rows = judgements.select(F.when(F.col("changed"), "human").otherwise("model").alias("side"), F.split("criterion_dimension", " ").alias("dimensions"))
    return O.dimension_distribution(rows, "dimensions")


@query("p14_blank_responses", "SELECT model, count(*) AS n FROM judgements WHERE trim(coalesce(response, '')) = '' GROUP BY 1")
def p14(judgements):
    """The rows over which a run fails."""
    from ..operators.rubric import blank_rows

    return blank_rows(judgements, "response").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("p15_expected_rows", "SELECT 'whole' AS part, count(*) AS n, '' AS refusal FROM tasks UNION ALL SELECT status, count(*), 'expected ' || (SELECT count(*) FROM tasks) || ' rows, found ' || count(*) FROM tasks GROUP BY 1")
def p15(spark, tasks):
    """The guard over the whole table, which passes, and over each status of it, which it refuses."""
    from ..operators.rubric import require_count

    n, rows = tasks.count(), []
    for part in ("whole", *[r["status"] for r in tasks.select("status").distinct().collect()]):
        some = tasks if part == "whole" else tasks.filter(F.col("status") == part)
        try:
            require_count(some, n)
            refusal = ""
        except ValueError as found:
            refusal = str(found)
        rows.append((part, some.count(), refusal))
    return spark.createDataFrame(rows, "part string, n long, refusal string")


@query("i4_status_with_metrics", "WITH l AS (SELECT task_id, arg_max(status, seq) AS status, arg_max(elapsed_sec, seq) AS e FROM status_log GROUP BY 1) SELECT task_id, l.status, CASE WHEN l.status = 'ok' THEN e ELSE cust END AS metric FROM l JOIN tasks USING (task_id) WHERE task_id % 3 = 0 UNION ALL SELECT task_id, l.status, CASE WHEN l.status = 'ok' THEN e END FROM l WHERE task_id % 3 <> 0 OR task_id NOT IN (SELECT task_id FROM tasks)")
def i4b(status_log, tasks):
    """Tasks whose last row has no metric get it from an earlier run's table, which has a third of them."""
    log = status_log.select("task_id", "seq", "status", F.when(F.col("status") == "ok", F.col("elapsed_sec")).alias("metric"))
    return O.backfilled(log, tasks.filter("task_id % 3 = 0").select("task_id", F.col("cust").cast("double").alias("metric")), "metric")


@query("i7_timed_out", "SELECT coalesce(elapsed_sec > 50 OR status = 'error', false) AS dead, count(*) AS n FROM status_log GROUP BY 1")
def i7(status_log):
    from ..sources.writers import split_errors

    good, dead = split_errors(status_log, O.timed_out(F.col("elapsed_sec"), 50) | (F.col("status") == "error"))
    n = lambda rows, which: rows.groupBy(F.lit(which).alias("dead")).agg(F.count(F.lit(1)).alias("n"))
    return n(good, False).unionByName(n(dead, True))


@query("i10_answers", "SELECT task_id, 'About ' || priority || ': yes' AS answer FROM tasks")
def i10(tasks):
    """A judge that knows no top_p and leaves every third prompt blank at first; any other is plugged in alike."""

    def judge(prompts: list[str], attempt: int, **options: object) -> list[str]:
        if "top_p" in options:
            raise ValueError("unsupported parameter: top_p")
        return ["" if attempt == 0 and n % 3 == 0 else f"{p}: yes" for n, p in enumerate(prompts)]

    prompts = tasks.select("task_id", F.concat(F.lit("About "), "priority").alias("prompt"))
    return J.answered(prompts, judge, options={"top_p": 0.9, "temperature": 0.0}, wait=0.0).select("task_id", "answer")


@query("i8_i13_gated_run", "SELECT 'done' AS outcome, true AS complete, status, count(*) AS n, CAST(sum(task_id) AS BIGINT) AS ids FROM tasks GROUP BY status")
def i8(spark, tasks):
    """A run that writes a pilot, then the rest of all tasks, to a folder."""
    from ..sources.durable import shared_dir

    path = f"{shared_dir(spark)}/scorelake-files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    done = lambda: readers.json_lines_or_empty(spark, path, "task_id long")

    def work(upto: int | None) -> None:
        todo = J.todo_first(tasks.select("task_id"), "task_id", upto)
        writers.append_json(todo.join(done().select("task_id"), "task_id", "left_anti"), path)

    outcome, count = J.pilot_then_full(lambda: done().count(), work, 10, tasks.count())
    summary = spark.createDataFrame([(outcome, count)], "outcome string, ok long")
    complete = O.is_complete(summary, "full", "full", tasks.count())
    rows = done().join(tasks.select("task_id", "status"), "task_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("task_id").alias("ids"))
    return rows.select(F.lit(outcome).alias("outcome"), F.lit(complete).alias("complete"), "status", "n", "ids")
