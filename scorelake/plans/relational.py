"""Queries of projections, joins, orders, sets and samples (P, J, W, U, R), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.verdicts import strip
from ..operators import relate as R
from ..operators import rubric as P
from .catalog import query
from .scoring import rounded


def _rubric(judgements):
    rows = judgements.select("task_id", "pos", F.col("criterion_id").alias("id"), F.concat(F.lit(" "), "criterion_dimension", F.lit(" "), "criterion_id").alias("title"), F.col("criterion_weight").alias("weight"), F.struct(F.col("criterion_dimension").alias("rubric_dimension")).alias("annotations"))
    return P.nest(rows, "task_id", "pos", ["id", "title", "weight", "annotations"])


_PLACE = "p AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY pos, criterion_id) - 1 AS INTEGER) AS place FROM judgements)"


@query("p1_p27_explode_rubric", f"WITH {_PLACE} SELECT task_id, place, criterion_id AS id, concat(' ', criterion_dimension, ' ', criterion_id) AS title, criterion_weight AS weight, criterion_dimension AS dimension FROM p")
def p1(judgements):
    return P.explode_rubric(_rubric(judgements), ["task_id", "not_there"]).select("task_id", "place", "id", "title", "weight", F.col("annotations.rubric_dimension").alias("dimension"))


@query("p2_p7_explode_strict", f"WITH {_PLACE} SELECT task_id, place, criterion_id AS id, criterion_weight AS weight FROM p WHERE criterion_weight <> 1")
def p2(judgements):
    blank = judgements.withColumn("criterion_id", F.when(F.col("criterion_weight") != 1, F.col("criterion_id")))
    rows = blank.select("task_id", "pos", F.col("criterion_id").alias("id"), F.lit("t").alias("title"), F.col("criterion_weight").alias("weight"))
    order = P.explode_strict(P.nest(rows, "task_id", "pos", ["id", "title", "weight"]), "task_id")
    return order.select("task_id", "place", "id", "weight")


@query("p3_p4_completed", "SELECT count(*) FILTER (length(trim(coalesce(response, ''))) > 0) AS by_response, count(*) FILTER (length(trim(judgement)) > 0) AS by_judgement, count(*) AS neither FROM judgements")
def p3(judgements):
    r, j = F.col("response"), F.col("judgement")
    return judgements.agg(F.count_if(P.completed(r, j)).alias("by_response"), F.count_if(P.completed(None, j)).alias("by_judgement"), F.count_if(P.completed(None, None)).alias("neither"))


@query("p5_weight_sign", "SELECT count(*) AS every, count(*) FILTER (w < 0) AS negative, count(*) FILTER (w > 0) AS positive, count(*) FILTER (w >= 0) AS nonnegative FROM (SELECT coalesce(TRY_CAST(CASE WHEN criterion_weight = 2 THEN 'x' ELSE CAST(criterion_weight AS VARCHAR) END AS INTEGER), 0) AS w FROM judgements)")
def p5(judgements):
    w = F.when(F.col("criterion_weight") == 2, "x").otherwise(F.col("criterion_weight").cast("string"))
    return judgements.agg(*[F.count_if(P.weight_sign(w, k)).alias(n) for k, n in (("all", "every"), ("negative", "negative"), ("positive", "positive"), ("nonnegative", "nonnegative"))])


@query("p6_neutral", "SELECT count(*) FILTER (t = 'neutral') AS strict, count(*) FILTER (t = 'neutral' OR t IS NULL) AS loose FROM (SELECT CASE priority WHEN '5-LOW' THEN 'neutral' WHEN '1-URGENT' THEN NULL ELSE priority END AS t FROM tasks)")
def p6(tasks):
    t = F.when(F.col("priority") == "5-LOW", "neutral").when(F.col("priority") != "1-URGENT", F.col("priority"))
    return tasks.agg(F.count_if(P.neutral(t, True)).alias("strict"), F.count_if(P.neutral(t, False)).alias("loose"))


@query("p8_aliases", f"WITH {_PLACE} SELECT task_id, CASE WHEN place < 999 THEN 'H' || lpad(CAST(place + 1 AS VARCHAR), 3, '0') ELSE 'H' || (place + 1) END AS alias, criterion_id FROM p")
def p8(judgements):
    return _rubric(judgements).select("task_id", F.explode(P.alias_map(F.col("RUBRIC"), "H")).alias("alias", "criterion_id"))


@query("p9_renamed", f"WITH {_PLACE} SELECT task_id, place, criterion_id AS id, upper(criterion_dimension) AS title, coalesce(nullif(criterion_weight, 3), 1) AS weight, criterion_dimension AS dimension FROM p")
def p9(judgements):
    raw = judgements.select("task_id", "pos", F.col("criterion_id").alias("id"), F.upper("criterion_dimension").alias("description"), F.nullif(F.col("criterion_weight"), F.lit(3)).alias("weight"), F.upper("criterion_dimension").alias("dimension"))
    named = P.nest(raw, "task_id", "pos", ["id", "description", "weight", "dimension"]).withColumn("RUBRIC", P.renamed_criteria(F.col("RUBRIC")))
    return P.explode_rubric(named, ["task_id"]).select("task_id", "place", "id", "title", "weight", F.col("annotations.rubric_dimension").alias("dimension"))


@query("p10_p11_w2_pair_selection", "SELECT md, pos, 'HN_MY' AS label FROM (SELECT *, row_number() OVER (PARTITION BY md ORDER BY pos, c) AS r FROM pairs WHERE hj = 'NO' AND mj = 'YES' AND cos >= 0.6 AND cos < 0.8 AND md IN ('model1', 'model2', 'model3')) WHERE r <= 20")
def p11(pairs):
    label = F.when((F.col("hj") == "NO") & (F.col("mj") == "YES"), "HN_MY").otherwise("OTHER")
    some = pairs.withColumn("label", label).filter("label = 'HN_MY' and cos >= 0.6 and cos < 0.8 and md in ('model1', 'model2', 'model3')")
    return P.first_n_per_group(some.withColumn("o", F.struct("pos", "c")), "md", "o", 20).select("md", "pos", "label")


@query("p12_p13_slice", "SELECT DISTINCT task_id FROM judgements ORDER BY task_id LIMIT 25 OFFSET 100")
def p13(judgements):
    return P.id_slice(judgements, "task_id", 100, 25)


@query("p16_no_ids", "SELECT task_id, string_agg(criterion_id, ',' ORDER BY pos, criterion_id) AS ids FROM judgements WHERE upper(trim(judgement)) = 'NO' GROUP BY 1")
def p16(judgements):
    from ..functions.verdicts import is_no

    rows = judgements.filter(is_no(F.col("judgement"))).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "criterion_id"))).alias("x"))
    return rows.select("task_id", F.array_join(F.transform("x", lambda x: x["criterion_id"]), ",").alias("ids"))


@query("p17_numbered_list", f"WITH {_PLACE} SELECT task_id, string_agg((place + 1) || '. ' || criterion_dimension || ' ' || criterion_id, chr(10) ORDER BY place) AS text FROM p GROUP BY 1")
def p17(judgements):
    return _rubric(judgements).select("task_id", P.numbered_list(F.transform("RUBRIC", lambda c: c["title"])).alias("text"))


@query("p18_parsed_list", f"WITH {_PLACE} SELECT task_id, place + 1 AS number, criterion_dimension || ' ' || criterion_id AS title FROM p")
def p18(judgements):
    text = P.numbered_list(F.transform("RUBRIC", lambda c: c["title"]))
    return _rubric(judgements).select("task_id", F.explode(P.parsed_list(text)).alias("number", "title"))


@query("p19_prefix_guard", "SELECT count(*) AS differing FROM texts a JOIN texts b ON a.pos + 1 = b.pos WHERE substr(a.title, 1, 200) IS DISTINCT FROM substr(b.title, 1, 200)")
def p19(texts):
    """The guard is on the first 200 characters of the whole text."""
    other = texts.select((F.col("pos") - 1).alias("pos"), F.col("title").alias("other"))
    return texts.join(other, "pos").filter(~F.substring("title", 1, 200).eqNullSafe(F.substring("other", 1, 200))).agg(F.count(F.lit(1)).alias("differing"))


@query("p20_truthy", "SELECT count(*) FILTER (lower(CASE WHEN changed THEN 'True' ELSE 'no' END) = 'true') AS n FROM judgements")
def p20(judgements):
    return judgements.agg(F.count_if(P.truthy(F.when(F.col("changed"), "True").otherwise("no"))).alias("n"))


@query("p21_valid_weight", "SELECT x, CASE WHEN x IN ('-3', '-3.0') THEN -3 WHEN x IN ('2', '2.0') THEN 2 ELSE 0 END AS weight, count(*) AS n FROM (SELECT CASE criterion_weight WHEN -3 THEN '-3' WHEN -2 THEN '-3.0' WHEN -1 THEN '1.5' WHEN 1 THEN '7' WHEN 2 THEN '2' ELSE 'two' END AS x FROM judgements) GROUP BY 1, 2")
def p21(judgements):
    w = F.col("criterion_weight")
    x = F.when(w == -3, "-3").when(w == -2, "-3.0").when(w == -1, "1.5").when(w == 1, "7").when(w == 2, "2").otherwise("two")
    return judgements.select(x.alias("x")).groupBy("x", F.coalesce(P.valid_weight(F.col("x")), F.lit(0)).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("p22_j4_task_number", "SELECT task_id, CASE WHEN task_id % 4 = 3 THEN -1 ELSE task_id END AS number, 'case_' || CASE WHEN task_id < 1000 THEN lpad(CAST(task_id AS VARCHAR), 3, '0') ELSE CAST(task_id AS VARCHAR) END AS name FROM tasks")
def p22(tasks):
    t = F.col("task_id")
    raw = F.when(t % 4 == 0, t.cast("string")).when(t % 4 == 1, P.case_name(t)).when(t % 4 == 2, F.concat(F.lit(" "), t.cast("string"), F.lit("\n"))).otherwise(F.lit("None"))
    return tasks.select("task_id", F.coalesce(P.task_number(raw), F.lit(-1)).cast("long").alias("number"), P.case_name(t).alias("name"))


@query("p23_p24_grouped_ids", "SELECT task_id, string_agg(criterion_id, ',' ORDER BY criterion_id) AS ids FROM (SELECT DISTINCT task_id, criterion_id FROM judgements WHERE changed) GROUP BY 1")
def p24(judgements):
    return judgements.filter("changed").groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("criterion_id")), ",").alias("ids"))


@query("p25_id_lines", f"WITH {_PLACE} SELECT task_id, string_agg(criterion_id || ' | ' || CASE WHEN place = 0 THEN 'first' ELSE ' ' || criterion_dimension || ' ' || criterion_id END, chr(10) ORDER BY place) AS text FROM p GROUP BY 1")
def p25(judgements):
    rubric = F.col("RUBRIC")
    return _rubric(judgements).select("task_id", P.id_lines(rubric, F.create_map(rubric[0]["id"], F.lit("first"))).alias("text"))


@query("p26_match_none", f"WITH {_PLACE} SELECT task_id, criterion_id AS atom_id, 'none' AS status, 0 AS n_ids, criterion_weight AS weight FROM p")
def p26(judgements):
    rows = _rubric(judgements).select("task_id", F.explode(P.match_none(F.col("RUBRIC"))).alias("m"))
    return rows.select("task_id", "m.atom_id", "m.status", F.size("m.matched_atom_ids").alias("n_ids"), "m.weight")


@query("s16_flexible_rubric", f"WITH {_PLACE} SELECT task_id, place, criterion_id AS id, criterion_weight AS weight FROM p")
def s16(judgements):
    text = F.to_json(F.transform("RUBRIC", lambda c: F.struct(c["id"].alias("id"), c["weight"].alias("weight"))))
    literal = F.when(F.col("task_id") % 2 == 0, text).otherwise(F.replace(F.replace(text, F.lit('"'), F.lit("'")), F.lit("}"), F.lit(", 'title': None}")))
    rows = _rubric(judgements).select("task_id", P.flexible_rubric(literal).alias("RUBRIC"))
    return P.explode_rubric(rows, ["task_id"]).select("task_id", "place", "id", "weight")


@query("s18_last_row_wins", "SELECT task_id, arg_max(status, seq) AS status, max(seq) AS seq FROM status_log GROUP BY 1")
def s18(status_log):
    return P.last_row_wins(status_log.select("task_id", "seq", "status"), "task_id", "seq")


@query("s20_first_of_task", "SELECT task_id, arg_min(criterion_id, pos) AS criterion_id FROM judgements GROUP BY 1")
def s20(judgements):
    return judgements.groupBy("task_id").agg(F.min_by("criterion_id", "pos").alias("criterion_id"))


# ---- joins ------------------------------------------------------------------------------------


@query("j1_j2_matched", "SELECT (SELECT count(*) FROM judgements JOIN tasks USING (task_id)) AS both, (SELECT count(*) FROM judgements ANTI JOIN tasks USING (task_id)) AS left_only, (SELECT count(*) FROM tasks ANTI JOIN judgements USING (task_id)) AS right_only")
def j1(judgements, tasks):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both, left, right = R.matched(judgements.select("task_id", "criterion_id"), tasks.select("task_id", "status"), ["task_id"])
    return n(both, "both").join(n(left, "left_only")).join(n(right, "right_only"))


@query("j3_interleaved_criteria", "WITH p AS (SELECT c, pos, ha, ma FROM pairs JOIN tasks ON c = task_id WHERE status = 'F') SELECT c, string_agg(ha || ',' || ma, ',' ORDER BY pos, ha) AS ids FROM p GROUP BY 1")
def j3(pairs, tasks):
    some = pairs.join(tasks.filter("status = 'F'").select(F.col("task_id").alias("c")), "c")
    rows = some.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "ha", "ma"))).alias("x"))
    return rows.select("c", F.array_join(F.flatten(F.transform("x", lambda x: F.array(x["ha"], x["ma"]))), ",").alias("ids"))


@query("j5_weight_join", "SELECT a.criterion_weight, count(*) AS n FROM judgements a JOIN judgements b ON a.task_id = b.task_id AND a.criterion_id = b.criterion_id WHERE b.changed GROUP BY 1")
def j5(judgements):
    audit = judgements.filter("changed").select("task_id", "criterion_id")
    return audit.join(judgements.select("task_id", "criterion_id", "criterion_weight"), ["task_id", "criterion_id"]).groupBy("criterion_weight").agg(F.count(F.lit(1)).alias("n"))


@query("j6_semi", "SELECT criterion_dimension, count(*) AS n FROM judgements WHERE (task_id) IN (SELECT task_id FROM tasks WHERE status = 'P') GROUP BY 1")
def j6(judgements, tasks):
    return judgements.join(tasks.filter("status = 'P'"), "task_id", "left_semi").groupBy("criterion_dimension").agg(F.count(F.lit(1)).alias("n"))


@query("j7_prior_verdict", "SELECT count(*) AS n FROM (SELECT DISTINCT criterion_id FROM verdicts) WHERE criterion_id IN (SELECT criterion_id FROM verdicts WHERE judge = 'judge_b' AND meets IS FALSE)")
def j7(verdicts):
    """A null verdict is neither a pass nor a fail."""
    keys = verdicts.filter((F.col("judge") == "judge_b") & F.col("meets").eqNullSafe(False))
    return verdicts.select("criterion_id").distinct().join(keys, "criterion_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("j8_i1_i2_resume", "SELECT task_id, priority FROM tasks WHERE task_id NOT IN (SELECT task_id FROM status_log WHERE status = 'ok')")
def j8(tasks, status_log):
    return R.resume(tasks, status_log.filter("status = 'ok'"), ["task_id"]).select("task_id", "priority")


@query("j9_untouched", "SELECT a.title IS NOT DISTINCT FROM b.title AS same, count(*) AS n FROM texts a JOIN texts b ON a.pos = b.pos + 1 GROUP BY 1")
def j9(texts):
    other = texts.select((F.col("pos") + 1).alias("pos"), F.col("title").alias("other"))
    return texts.join(other, "pos").groupBy(F.col("title").eqNullSafe(F.col("other")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("j10_m6_judge_pairs", "SELECT a.judge AS judge_1, b.judge AS judge_2, count(*) AS n, round(100 * avg(CASE WHEN a.meets = b.meets THEN 1 ELSE 0 END), 6) AS agreement FROM verdicts a JOIN verdicts b ON a.criterion_id = b.criterion_id AND a.judge < b.judge GROUP BY 1, 2")
def j10(verdicts):
    return rounded(R.judge_pairs(verdicts), "agreement")


@query("j11_j20_judged_by_all", "SELECT criterion_id, bool_or(meets) FILTER (judge = 'judge_a') AS judge_a, bool_or(meets) FILTER (judge = 'judge_b') AS judge_b, bool_or(meets) FILTER (judge = 'judge_c') AS judge_c FROM verdicts GROUP BY 1 HAVING count(DISTINCT judge) = 3")
def j11(verdicts):
    return R.judged_by_all(verdicts, ["judge_a", "judge_b", "judge_c"])


@query("m7_unanimity", """WITH w AS (SELECT criterion_id, bool_and(meets) AS p, bool_and(NOT meets) AS f FROM verdicts GROUP BY 1 HAVING count(DISTINCT judge) = 3)
SELECT count(*) AS n, round(100 * avg(CAST(f AS INT)), 6) AS all_fail, round(100 * avg(CAST(p AS INT)), 6) AS all_pass, round(100 * avg(CAST(p OR f AS INT)), 6) AS all_same FROM w""")
def m7(verdicts):
    return rounded(R.unanimity(verdicts, ["judge_a", "judge_b", "judge_c"]), "all_fail", "all_pass", "all_same")


@query("m8_coverage_agreement", """WITH v AS (SELECT criterion_id, judge, meets, CASE WHEN judge = 'judge_a' THEN criterion_id % 5 ELSE criterion_id % 3 END AS item FROM verdicts),
w AS (SELECT a.meets AS am, b.meets AS bm, a.item AS ai, b.item AS bi FROM v a JOIN v b USING (criterion_id) WHERE a.judge = 'judge_a' AND b.judge = 'judge_b')
SELECT count(*) AS n, count(*) FILTER (am AND bm) AS both_yes, round(count(*) FILTER (am AND bm) / count(*) FILTER (am OR bm), 6) AS jaccard, count(*) FILTER (am AND bm) AS numbered,
round(count(*) FILTER (am AND bm AND ai = bi) / count(*) FILTER (am AND bm), 6) AS same_item, count(*) FILTER (am AND NOT bm) AS a_only, count(*) FILTER (bm AND NOT am) AS b_only FROM w""")
def m8(verdicts):
    items = verdicts.withColumn("item", F.when(F.col("judge") == "judge_a", F.col("criterion_id") % 5).otherwise(F.col("criterion_id") % 3))
    return rounded(R.coverage_agreement(items, "judge_a", "judge_b"), "jaccard", "same_item")


_RATES = "SELECT {name} AS source, avg(rate) AS mean, max(rate) FILTER (judge = 'judge_a') AS judge_a, max(rate) FILTER (judge = 'judge_b') AS judge_b, max(rate) FILTER (judge = 'judge_c') AS judge_c FROM (SELECT {key} AS k, judge, 100 * avg(CAST(meets AS INT)) AS rate FROM v GROUP BY 1, 2) GROUP BY k"


@query("a20_verdict_rates", f"""WITH v AS (SELECT *, 's' || (criterion_id % 4) AS src FROM verdicts),
e AS ({_RATES.format(name="k", key="src")}), p AS ({_RATES.format(name="k", key="CASE WHEN src = 's0' THEN 'Human' ELSE 'Pooled AI' END")}),
g AS (SELECT 'Gap' AS source, max(round_even(mean, 1)) FILTER (source = 'Pooled AI') - max(round_even(mean, 1)) FILTER (source = 'Human') AS mean, max(round_even(judge_a, 1)) FILTER (source = 'Pooled AI') - max(round_even(judge_a, 1)) FILTER (source = 'Human') AS judge_a,
max(round_even(judge_b, 1)) FILTER (source = 'Pooled AI') - max(round_even(judge_b, 1)) FILTER (source = 'Human') AS judge_b, max(round_even(judge_c, 1)) FILTER (source = 'Pooled AI') - max(round_even(judge_c, 1)) FILTER (source = 'Human') AS judge_c FROM p)
SELECT source, round(mean, 6) AS mean, round(judge_a, 6) AS judge_a, round(judge_b, 6) AS judge_b, round(judge_c, 6) AS judge_c FROM (SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM g)""")
def a20(verdicts):
    v = verdicts.withColumn("src", F.concat(F.lit("s"), (F.col("criterion_id") % 4).cast("string")))
    return rounded(R.verdict_rates(v, "src", "s0", ["judge_a", "judge_b", "judge_c"]), "mean", "judge_a", "judge_b", "judge_c")


@query("j12_a31_candidate_labels", """SELECT count(*) FILTER (a.meets AND b.meets) AS tp, count(*) FILTER (NOT a.meets AND NOT b.meets) AS tn, count(*) FILTER (a.meets AND NOT b.meets) AS fp, count(*) FILTER (NOT a.meets AND b.meets) AS fn,
round(100 * avg(CASE WHEN a.meets = b.meets THEN 1 ELSE 0 END), 6) AS accuracy, round(100 * avg(CAST(a.meets AS INT)), 6) AS capture FROM verdicts a JOIN verdicts b USING (criterion_id) WHERE a.judge = 'judge_c' AND b.judge = 'judge_a'""")
def j12(verdicts):
    from ..operators.agree import confusion

    candidate = verdicts.filter("judge = 'judge_c'").select("criterion_id", F.col("meets").alias("said"))
    return rounded(confusion(candidate.join(verdicts.filter("judge = 'judge_a'").select("criterion_id", F.col("meets").alias("truth")), "criterion_id")).drop("unparsed"), "accuracy", "capture")


@query("j13_first_label", """WITH l AS (SELECT c, ha, status FROM (SELECT c, ha, CASE WHEN hj = 'YES' THEN 'matched' ELSE 'partial' END AS status, row_number() OVER (PARTITION BY c, ha ORDER BY pos) AS r FROM pairs WHERE m_part % 2 = 0) WHERE r = 1)
SELECT coalesce(l.status, 'unlabelled') AS status, count(*) AS n FROM pairs p LEFT JOIN l ON p.c = l.c AND p.ha = l.ha GROUP BY 1""")
def j13(pairs):
    labels = pairs.filter("m_part % 2 = 0").select("c", "ha", "pos", F.when(F.col("hj") == "YES", "matched").otherwise("partial").alias("status"))
    return R.first_label_wins(pairs.select("c", "ha"), labels, ["c", "ha"], "pos").groupBy(F.coalesce("status", F.lit("unlabelled")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("j14_j15_resolved_ids", """WITH k AS (SELECT pos, task_id, CASE pos % 3 WHEN 0 THEN title WHEN 1 THEN '  ' || title ELSE substr(title, 2) END AS title FROM titles),
n AS (SELECT *, trim(lower(regexp_replace(title, '\\s+', ' ', 'g'))) AS nt FROM titles), kn AS (SELECT *, trim(lower(regexp_replace(title, '\\s+', ' ', 'g'))) AS nt FROM k),
a AS (SELECT task_id, title, max(pos) AS a FROM n GROUP BY 1, 2), b AS (SELECT task_id, nt, max(pos) AS b FROM n GROUP BY 1, 2),
r AS (SELECT kn.*, a, b FROM kn LEFT JOIN a USING (task_id, title) LEFT JOIN b USING (task_id, nt)), d AS (SELECT task_id, lower(title) AS t, min(pos) AS c FROM n GROUP BY 1, 2),
x AS (SELECT DISTINCT task_id, lower(title) AS t FROM r WHERE a IS NULL AND b IS NULL), y AS (SELECT x.task_id, x.t, min(d.c) AS c FROM x JOIN d ON x.task_id = d.task_id AND (contains(d.t, x.t) OR contains(x.t, d.t)) GROUP BY 1, 2)
SELECT r.pos AS concept_id, coalesce(a, b, c) AS criterion_id FROM r LEFT JOIN y ON r.task_id = y.task_id AND lower(r.title) = y.t AND a IS NULL AND b IS NULL""")
def j14(titles):
    """Every line of every document, whole, indented or without its first character, among all lines of its source."""
    kind = F.col("pos") % 3
    concepts = titles.select(F.col("pos").alias("concept_id"), "task_id", F.when(kind == 0, F.col("title")).when(kind == 1, F.concat(F.lit("  "), "title")).otherwise(F.expr("substring(title, 2)")).alias("title"))
    norm = lambda c: F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    return R.resolved_ids(concepts, titles.select("task_id", F.col("pos").alias("place"), F.col("pos").alias("criterion_id"), "title"), norm)


@query("j18_m3_paired_conditions", """WITH a AS (SELECT model, avg(output_tokens) AS v FROM judgements WHERE changed AND model <> 'model3' GROUP BY 1), b AS (SELECT model, avg(output_tokens) AS v FROM judgements WHERE NOT changed AND model <> 'model5' GROUP BY 1),
d AS (SELECT a.v AS av, b.v AS bv, b.v - a.v AS d FROM a FULL JOIN b USING (model)), s AS (SELECT count(*) FILTER (bv IS NULL) AS left_only, count(*) FILTER (av IS NULL) AS right_only, count(d) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(d)) AS se, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) FILTER (d = 0) AS tied FROM d)
SELECT left_only, right_only, n, up, down, tied, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 1.96::DOUBLE * se, 6) AS low, round(mean + 1.96::DOUBLE * se, 6) AS high FROM s""")
def j18(judgements):
    side = lambda changed, but: judgements.filter((F.col("changed") == changed) & (F.col("model") != but)).groupBy("model").agg(F.avg("output_tokens").alias("v"))
    return rounded(R.paired_conditions(side(True, "model3"), side(False, "model5"), "model", "v"), "mean", "se", "low", "high")


@query("j21_missing_ids", "SELECT (SELECT count(*) FROM status_log LEFT JOIN tasks USING (task_id) WHERE priority IS NULL) AS missing, (SELECT count(*) FROM status_log) AS n")
def j21(status_log, tasks):
    found = status_log.join(tasks.select("task_id", "priority"), "task_id", "left")
    return found.agg(F.count_if(F.col("priority").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))


# ---- orders and top-n -------------------------------------------------------------------------


@query("w1_top_groups", "SELECT task_id, count(*) AS n, min(pos) AS first FROM titles GROUP BY 1 ORDER BY n DESC, first LIMIT 7")
def w1(titles):
    return R.top_groups(titles, "task_id", "pos", 7)


@query("w4_first_argmax", "SELECT model, (SELECT min(pos) FROM judgements b WHERE b.model = a.model AND b.output_tokens = max(a.output_tokens)) AS place FROM judgements a GROUP BY model")
def w4(judgements):
    return judgements.groupBy("model").agg(R.first_argmax(F.col("output_tokens"), F.col("pos")).alias("place"))


@query("w5_interleaved", "SELECT pos, round((row_number() OVER (PARTITION BY task_id ORDER BY pos) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY task_id), 9) AS share FROM titles")
def w5(titles):
    return rounded(R.interleaved(titles, "task_id", "pos").select("pos", "share"), "share", digits=9)


@query("w7_ranked_models", "SELECT model, dilemma_source, count(*) AS n, row_number() OVER (PARTITION BY dilemma_source ORDER BY count(*), model) AS rank FROM judgements GROUP BY 1, 2")
def w7(judgements):
    from pyspark.sql import Window

    counts = judgements.groupBy("model", "dilemma_source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("dilemma_source").orderBy("n", "model")).cast("long"))


@query("w9_w10_longest", "SELECT pos, length(title) AS n FROM texts ORDER BY length(title) DESC, pos LIMIT 10")
def w9(texts):
    return texts.select("pos", F.length("title").cast("long").alias("n")).orderBy(F.desc("n"), "pos").limit(10)


@query("w11_fixed_order", "SELECT DISTINCT priority, CAST(CASE priority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS BIGINT) AS place FROM tasks")
def w11(tasks):
    return tasks.select("priority", R.ordered_by_list("priority", ["3-MEDIUM", "1-URGENT"]).cast("long").alias("place")).distinct()


# ---- sets -------------------------------------------------------------------------------------


@query("u1_u2_u3_sets", "SELECT 'both' AS side, count(*) AS n FROM (SELECT task_id FROM tasks INTERSECT SELECT task_id FROM status_log) UNION ALL SELECT 'left', count(*) FROM (SELECT task_id FROM tasks EXCEPT SELECT task_id FROM status_log) UNION ALL SELECT 'rows', (SELECT count(*) FROM tasks) + (SELECT count(*) FROM status_log)")
def u1(tasks, status_log):
    a, b = tasks.select("task_id"), status_log.select("task_id")
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "left")).unionByName(n(a.unionByName(b), "rows"))


@query("u5_j19_convergence", """WITH a AS (SELECT task_id, list(DISTINCT criterion_id) FILTER (changed) AS x, list(DISTINCT criterion_id) FILTER (criterion_weight > 0) AS y FROM judgements GROUP BY 1), b AS (SELECT task_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a)
SELECT task_id, array_to_string(list_sort(list_filter(x, lambda e: list_contains(y, e))), ',') AS agree, array_to_string(list_sort(list_filter(x, lambda e: NOT list_contains(y, e))), ',') AS extra, array_to_string(list_sort(list_filter(y, lambda e: NOT list_contains(x, e))), ',') AS missed FROM b""")
def u5(judgements):
    ids = lambda cond: F.collect_set(F.when(cond, F.col("criterion_id")))
    rows = judgements.groupBy("task_id").agg(ids(F.col("changed")).alias("x"), ids(F.col("criterion_weight") > 0).alias("y"))
    found = rows.select("task_id", R.convergence(F.col("x"), F.col("y")).alias("s"))
    return found.select("task_id", *[F.array_join(f"s.{c}", ",").alias(c) for c in ("agree", "extra", "missed")])


@query("u6_registry", "WITH f AS (SELECT title AS text, min(pos) AS first FROM texts GROUP BY 1) SELECT text, first, row_number() OVER (ORDER BY first) - 1 AS text_idx FROM f")
def u6(texts):
    return R.registry(texts, F.col("title"), "pos")


@query("u7_repeated_keys", "SELECT lower(trim(title)) AS k, count(*) AS n FROM texts GROUP BY 1 HAVING count(*) > 1")
def u7(texts):
    return R.repeated_keys(texts, F.lower(F.trim("title")).alias("k"))


# ---- samples ----------------------------------------------------------------------------------


@query("r1_r7_r8_sample", "SELECT pos FROM titles ORDER BY md5(concat(CAST(pos AS VARCHAR), ':42')), pos LIMIT 100")
def r1(titles):
    return R.sample(titles.select("pos"), "pos", 100, 42)


@query("r2_u4_tranches", "WITH d AS (SELECT pos, row_number() OVER (ORDER BY md5(concat(CAST(pos AS VARCHAR), ':7')), pos) AS n FROM titles) SELECT pos, CASE WHEN n <= 50 THEN 1 ELSE 2 END AS tranche FROM d WHERE n <= 100")
def r2(titles):
    return R.tranches(titles.select("pos"), "pos", [50, 50], 7)


@query("r3_one_per_stratum", "SELECT task_id, status, priority FROM (SELECT *, row_number() OVER (PARTITION BY status, priority ORDER BY md5(concat(CAST(task_id AS VARCHAR), ':3')), task_id) AS r FROM tasks) WHERE r = 1")
def r3(tasks):
    return R.stratified(tasks, ["status", "priority"], "task_id", 1, 3).select("task_id", "status", "priority")


@query("r4_judge_strata", """WITH w AS (SELECT criterion_id, count(*) FILTER (meets) AS y, count(*) FILTER (NOT meets) AS n FROM verdicts GROUP BY 1),
s AS (SELECT criterion_id, CASE WHEN y > 0 AND n > 0 THEN 'SPLIT' WHEN y = 0 THEN 'FRONTIER_NO' WHEN criterion_id % 2 = 1 THEN 'SAMEITEM_SPLIT' ELSE 'UNANIMOUS_YES' END AS stratum FROM w)
SELECT criterion_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(CAST(criterion_id AS VARCHAR), ':5')), criterion_id) AS r FROM s) WHERE r <= CASE WHEN stratum = 'SPLIT' THEN 20 ELSE 10 END""")
def r4(verdicts):
    w = verdicts.groupBy("criterion_id").agg(F.count_if("meets").alias("y"), F.count_if(~F.col("meets")).alias("n"))
    s = w.select("criterion_id", R.judge_stratum(F.col("y"), F.col("n"), F.col("criterion_id") % 2 == 0).alias("stratum"))
    return R.stratified(s, ["stratum"], "criterion_id", F.when(F.col("stratum") == "SPLIT", 20).otherwise(10), 5)


_D = "md5(concat(CAST(pos AS VARCHAR), ':{s}'))"


@query("r5_foils", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {_D.format(s=1)}, pos) AS n FROM titles), a AS (SELECT task_id, pos AS anchor FROM i WHERE n = 1),
p AS (SELECT 'POS' AS kind, task_id, anchor, anchor AS pos FROM a), h AS (SELECT 'FOIL_HARD' AS kind, task_id, anchor, i.pos FROM a JOIN i USING (task_id) WHERE n = 2),
t AS (SELECT *, row_number() OVER (ORDER BY {_D.format(s=2)}, pos) AS k FROM i WHERE n = 3), e AS (SELECT 'FOIL_EASY' AS kind, x.task_id, x.pos AS anchor, y.pos FROM t x JOIN t y ON x.k % 2 = 1 AND y.k = x.k + 1 WHERE y.k <= 16),
u AS (SELECT * FROM p UNION ALL SELECT * FROM h UNION ALL SELECT * FROM e) SELECT kind, task_id, anchor, pos AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_D.format(s=1)}, pos) AS r FROM u) WHERE r <= 8""")
def r5(titles):
    return R.foils(titles.select("task_id", F.col("pos").alias("item_id")), 1, 8)
