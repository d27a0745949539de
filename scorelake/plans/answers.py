"""Queries of readers of raw answers (L, V5, S19): answers are written out from judgements, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..operators import rubric as P
from .catalog import query

_ITEMS = """i AS (SELECT task_id, pos, criterion_id, criterion_weight AS w, changed, CAST(row_number() OVER (PARTITION BY task_id ORDER BY pos, criterion_id, criterion_weight, changed) AS INTEGER) AS item,
CAST(count(*) OVER (PARTITION BY task_id) AS INTEGER) AS n FROM judgements)"""


def _tasks(judgements):
    """Each task's items in order, and how many."""
    rows = judgements.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "criterion_id", F.col("criterion_weight").alias("w"), "changed"))).alias("x"))
    return rows.withColumn("n", F.size("x"))


def _each(sql: str):
    """SQL text for every item: r is its row, i its number from 0."""
    return F.expr(f"transform(x, (r, i) -> {sql})")


#: (raw answer, verdict, reason of the ladder)
LADDER = [
    ('{"meets_requirements": true, "reason": "r"}', "true", "r"),
    ('```json\n{"passes_generality": false}\n```', "false", ""),
    ('Sure. {"meets_requirements": false, "reason": "x"} done', "false", "x"),
    ("broken {'meets_requirements': true", "true", "broken {'meets_requirements': true"),
    ('broken {"passes_generality": false', "false", 'broken {"passes_generality": false'),
    ("I think it passes", "true", "I think it passes"),
    ("It is too specific", "false", "It is too specific"),
    ("Reason: this is a broad idea", "true", "Reason: this is a broad idea"),
    ("Reason: mandates one thing", "false", "Reason: mandates one thing"),
    ("no idea", "null", "no idea"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("l4_ladder", "WITH v(k, verdict, reason) AS (VALUES " + ", ".join(f"({i}, '{v}', {_quoted(r)})" for i, (_, v, r) in enumerate(LADDER)) + ") SELECT task_id, verdict, reason FROM tasks JOIN v ON task_id % 10 = k")
def l4(tasks):
    """Ten kinds of answer, in turn by task."""
    raw = F.element_at(F.array(*[F.lit(r) for r, _, _ in LADDER]), (F.col("task_id") % 10 + 1).cast("int"))
    return tasks.select("task_id", V.ladder(raw).alias("l")).select("task_id", F.coalesce(F.col("l.verdict").cast("string"), F.lit("null")).alias("verdict"), "l.reason")


@query("l4_ladder_lines", r"""WITH k AS (SELECT pos, title, CASE WHEN pos % 3 = 0 THEN 'true' ELSE 'false' END AS v, CASE WHEN pos % 4 = 2 AND (contains(title, '{') OR contains(title, '}')) THEN 0 ELSE pos % 4 END AS kind FROM titles)
SELECT pos, v AS verdict, CASE WHEN kind = 3 THEN substr('"meets_requirements": ' || v || ', ' || title, 1, 200) ELSE title END AS reason FROM k""")
def l4_lines(titles):
    """Every line as the reason of an answer: bare JSON, in a fence, inside a sentence, or after a key and value as text."""
    said = F.col("pos") % 3 == 0
    body = F.to_json(F.struct(said.alias("meets_requirements"), F.col("title").alias("reason")))
    kind = F.when((F.col("pos") % 4 == 2) & F.col("title").rlike("[{}]"), 0).otherwise(F.col("pos") % 4)
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Well: "), body, F.lit(" ok"))).otherwise(F.concat(F.lit('"meets_requirements": '), said.cast("string"), F.lit(", "), "title"))
    return titles.select("pos", V.ladder(raw).alias("l")).select("pos", F.col("l.verdict").cast("string").alias("verdict"), "l.reason")


@query("l1_l2_l3_rubric_array", f"WITH {_ITEMS} SELECT task_id, criterion_id AS id, 't' AS title, w AS weight FROM i")
def l3(judgements):
    """Arrays with a comma too many, in a fence, or inside a sentence."""
    body = F.concat(F.lit("["), F.array_join(_each("""concat('{"id": "', r.criterion_id, '", "title": "t", "weight": ', r.w, '}')"""), ", "))
    kind = F.col("task_id") % 3
    raw = F.when(kind == 0, F.concat(body, F.lit(",]"))).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("]\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit("] ok")))
    return _tasks(judgements).select("task_id", F.explode(F.filter(V.rubric_array(raw), lambda c: c["id"].isNotNull())).alias("c")).select("task_id", "c.id", "c.title", "c.weight")


@query("l5_batched", f"""WITH {_ITEMS} SELECT task_id, item, CASE WHEN w <> 1 THEN CAST(changed AS VARCHAR) WHEN item = 1 THEN 'false' ELSE 'none' END AS verdict,
CASE WHEN w <> 1 THEN 'r' || item WHEN item = 1 THEN 'old' ELSE 'missing idx=' || item || ' in batched response' END AS reason FROM i""")
def l5(judgements):
    """Items of weight 1 are left out of the answer, and the first item is answered twice: its last answer counts."""
    some = F.filter(_each("""if(r.w = 1, null, concat('{"idx": ', i + 1, ', "meets_requirements": ', if(r.changed, '"Pass"', 'false'), ', "reason": "r', i + 1, '"}'))"""), lambda t: t.isNotNull())
    raw = F.concat(F.lit("Here: ["), F.array_join(F.concat(F.array(F.lit('{"idx": 1, "verdict": "no", "reason": "old"}')), some), ", "), F.lit("]"))
    rows = _tasks(judgements).select("task_id", V.batched(raw).alias("m"), F.explode(F.sequence(F.lit(1), "n")).alias("item"))
    found = rows.select("task_id", "item", V.batched_answer(F.col("m"), F.col("item")).alias("a"))
    return found.select("task_id", "item", F.coalesce(F.col("a.verdict").cast("string"), F.lit("none")).alias("verdict"), "a.reason")


@query("l6_l11_numbered_map", f"WITH {_ITEMS} SELECT task_id, item, CASE WHEN task_id % 4 = 0 AND (n // 2 > 1 OR item > 1) THEN 'no' WHEN changed THEN 'yes' ELSE 'no' END AS verdict FROM i")
def l6(judgements):
    """The first item is answered twice; every fourth answer stops after it, which is too few where half of the items are more than one."""
    each = _each("""concat('"', if(i = 0, ' ', ''), i + 1, '": "', if(r.changed, 'Yes!', 'no'), '"')""")
    entries = F.when(F.col("task_id") % 4 == 0, F.slice(each, 1, 1)).otherwise(each)
    raw = F.concat(F.lit('x {"1": "maybe", "q": "yes", '), F.array_join(entries, ", "), F.lit("} y"))
    rows = _tasks(judgements).select("task_id", V.numbered_map(raw, F.col("n")).alias("m"), F.explode(F.sequence(F.lit(1), "n")).alias("item"))
    return rows.select("task_id", "item", V.positional_verdict(F.col("m"), F.col("item"), "no").alias("verdict"))


@query("l7_blind_map", f"""WITH {_ITEMS} SELECT task_id, item, CASE WHEN item = 1 THEN '9' WHEN changed THEN item || ',' || (item + 1) WHEN w > 0 THEN '' ELSE '5,7' END AS ids FROM i
WHERE NOT (task_id % 3 = 2 AND n // 2 > 1) AND (task_id % 3 <> 2 OR item = 1)""")
def l7(judgements):
    """Answers in a fence, after prose with braces of its own, or of one item, which is too few where half of the items are more than one."""
    each = _each("""concat('"', if(i = 0, ' 1 ": 9', concat(i + 1, '": ', if(r.changed, concat('[', i + 3, ', "', i + 2, ' ", ', i + 1, ', "x"]'), if(r.w > 0, '"None"', '"items 7 and 5"')))))""")
    body = lambda e: F.concat(F.lit("{"), F.array_join(e, ", "), F.lit("}"))
    kind = F.col("task_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("I think {maybe} so.\n```json\n"), body(each), F.lit("\n```\n}"))).when(kind == 1, F.concat(F.lit('First {"a": {"1": "x"}} and {note}. Final: '), body(each))).otherwise(body(F.slice(each, 1, 1)))
    rows = _tasks(judgements).select("task_id", F.explode(V.blind_map(raw, F.col("n"))).alias("item", "ids"))
    return rows.select("task_id", "item", F.array_join("ids", ",").alias("ids"))


@query("l8_settled_match", """SELECT task_id, criterion_id, CASE criterion_weight WHEN -3 THEN 'matched' WHEN -2 THEN 'nearby' WHEN -1 THEN 'matched' ELSE 'none' END AS status,
CASE WHEN criterion_weight < 0 THEN 'M' || criterion_id ELSE '' END AS ids FROM judgements""")
def l8(judgements):
    w, own = F.col("criterion_weight"), F.concat(F.lit("M"), "criterion_id")
    status = F.when(w == -3, "Covered").when(w == -2, "partially").when(w == 1, "matched").when(w == 2, "missing").when(w == 3, "near")
    ids = F.when(w == -3, F.array(F.concat(F.lit(" "), F.lower(own)), own)).when(w == -2, F.array(F.lower(own), F.lit("m-9"))).when(w == 1, F.array(F.lit("m-9"))).when(w == 3, F.array().cast("array<string>")).otherwise(F.array(own))
    found = judgements.select("task_id", "criterion_id", V.settled_match(status, V.matched_ids(ids), F.array(own)).alias("m"))
    return found.select("task_id", "criterion_id", "m.status", F.array_join("m.ids", ",").alias("ids"))


@query("l9_only_side", f"""WITH {_ITEMS}, r AS (SELECT task_id, criterion_id, item, changed OR w = 1 AS kept, 'r' || item AS reason FROM i UNION ALL SELECT task_id, criterion_id, 1000000, true, 'last' FROM i WHERE item = 1)
SELECT task_id, criterion_id, arg_max(reason, item) AS reason FROM r GROUP BY 1, 2 HAVING arg_max(kept, item)""")
def l9(judgements):
    """Ids as aliases; statuses of others than unique rows; the first criterion comes again at the end, and a criterion may be in a task twice."""
    each = _each("""concat('{"criterion_id": " h', lpad(i + 1, 3, '0'), '", "status": "', if(r.changed, 'Uniquely human', if(r.w = 1, '', 'matched')), '", "reason": " r', i + 1, '"}')""")
    raw = F.concat(F.lit('{"human_only": ['), F.array_join(F.concat(each, F.array(F.lit('{"criterion_id": "H001", "status": "unique", "reason": "last"}'))), ", "), F.lit("]}"))
    rows = _tasks(judgements).withColumn("r", F.transform("x", lambda r: F.struct(r["criterion_id"].alias("id"))))
    side = F.from_json(V.first_object(raw), f"struct<human_only:{V.ONLY_SIDE}>")["human_only"]
    found = rows.select("task_id", F.explode(V.only_side(side, P.alias_map(F.col("r"), "H"))).alias("c"))
    return found.select("task_id", "c.criterion_id", "c.reason")


@query("v5_marked_item", "SELECT task_id, criterion_id, CASE WHEN criterion_weight IN (-3, 3) THEN 'true' WHEN criterion_weight = -2 THEN 'false' ELSE 'null' END AS verdict, CASE WHEN criterion_weight = -3 THEN task_id ELSE -1 END AS item FROM judgements")
def v5(judgements):
    w, t = F.col("criterion_weight"), F.col("task_id").cast("string")
    j = F.when(w == -3, F.concat(F.lit("**Yes, item "), t)).when(w == -2, F.concat(F.lit("# no "), t)).when(w == 3, "yes").otherwise(F.concat(F.lit("maybe "), t))
    return judgements.select("task_id", "criterion_id", F.coalesce(V.marked_verdict(j).cast("string"), F.lit("null")).alias("verdict"), F.coalesce(V.marked_item(j), F.lit(-1)).cast("long").alias("item"))


@query("s19_keyed_verdicts", "SELECT criterion_id, arg_max(lower(trim(judgement)) LIKE 'yes%', task_id) AS verdict, max(task_id) AS task_id FROM judgements WHERE lower(trim(judgement)) LIKE 'yes%' OR lower(trim(judgement)) LIKE 'no%' GROUP BY 1")
def s19(judgements):
    return P.keyed_verdicts(judgements, "criterion_id", "judgement", "task_id").select("criterion_id", "verdict", "task_id")
