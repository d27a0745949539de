"""Queries of annotators' trials (R4, R5, R6, W6, W12), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relate as R
from ..operators import trials as T
from .catalog import query

_D = "md5(concat(CAST({c} AS VARCHAR), ':{s}'))"


def _drawn(c: str, s: int) -> str:
    return f"{_D.format(c=c, s=s)}, {c}"


@query("r4_blind_ids", f"""WITH s AS (SELECT task_id, status, priority FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY {_drawn("task_id", 5)}) AS r FROM tasks) WHERE r <= 20)
SELECT 'T' || lpad(CAST(row_number() OVER (ORDER BY {_drawn("task_id", 6)}) AS VARCHAR), 3, '0') AS trial_id, status, task_id, priority FROM s""")
def r4(tasks):
    """Sheet and key, joined again by the blind id."""
    rows = R.stratified(tasks, ["priority"], "task_id", 20, 5).select("task_id", "status", "priority")
    sheet, key = T.blinded(rows, "task_id", ["status"], 6)
    return sheet.join(key, "trial_id")


@query("r5_foil_trials", f"""WITH v AS (SELECT criterion_id AS cid, criterion_id % 40 AS task_id, CAST(criterion_id AS VARCHAR) AS item, bool_and(meets) AS y, bool_or(meets) AS one FROM verdicts GROUP BY 1),
p AS (SELECT * FROM v WHERE y ORDER BY {_drawn("cid", 3)} LIMIT 12), h AS (SELECT * FROM v WHERE one AND NOT y AND cid NOT IN (SELECT cid FROM p) ORDER BY {_drawn("cid", 4)} LIMIT 7),
f AS (SELECT * FROM v WHERE cid NOT IN (SELECT cid FROM p) AND cid NOT IN (SELECT cid FROM h)), d AS (SELECT * FROM f ORDER BY {_drawn("cid", 5)} LIMIT 1),
d2 AS (SELECT * FROM f WHERE task_id <> (SELECT task_id FROM d) ORDER BY {_drawn("cid", 5)} LIMIT 1), e AS (SELECT * FROM f ORDER BY {_drawn("cid", 5)} LIMIT (SELECT 20 - count(*) FROM h))
SELECT 'POS' AS kind, cid, task_id, item FROM p UNION ALL SELECT 'FOIL_HARD', cid, task_id, item FROM h
UNION ALL SELECT 'FOIL_EASY', cid, task_id, CASE WHEN task_id <> (SELECT task_id FROM d) THEN (SELECT item FROM d) ELSE (SELECT item FROM d2) END FROM e""")
def r5(verdicts):
    rows = verdicts.groupBy(F.col("criterion_id").alias("cid")).agg(F.bool_and("meets").alias("y"), F.bool_or("meets").alias("one")).select("cid", (F.col("cid") % 40).alias("task_id"), F.col("cid").cast("string").alias("item"), "y", "one")
    return T.foil_trials(rows.filter("y"), rows.filter("one and not y"), rows, 12, 20, 7, 3)


def _spots(judgements):
    final = F.concat(F.repeat(F.lit("x"), (F.col("output_tokens") % 12).cast("int")), F.substring("criterion_dimension", 1, 4))
    rows = judgements.filter("changed").select((F.col("task_id") * 10 + F.expr("pos div 100000000000")).alias("key"), "task_id", F.col("criterion_id").alias("original"), final.alias("final"))
    rows = rows.groupBy("key", "task_id").agg(F.min(F.struct("original", "final")).alias("r")).select("key", "task_id", "r.*")
    return T.spot_trials(rows, 20, 10, 8, 6, 11)


_SPOTS = f"""c AS (SELECT task_id * 10 + pos // 100000000000 AS key, task_id, criterion_id AS original, repeat('x', CAST(output_tokens % 12 AS INTEGER)) || substr(criterion_dimension, 1, 4) AS final FROM judgements WHERE changed QUALIFY row_number() OVER (PARTITION BY key ORDER BY original, final) = 1),
re AS (SELECT * FROM c ORDER BY {_drawn("key", 11)} LIMIT 20), co AS (SELECT * FROM c WHERE length(final) < length(original) AND task_id NOT IN (SELECT task_id FROM re) ORDER BY {_drawn("key", 12)} LIMIT 10),
fr AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {_drawn("key", 13)}) AS k, count(*) OVER (PARTITION BY task_id) AS m FROM c WHERE task_id NOT IN (SELECT task_id FROM re) AND task_id NOT IN (SELECT task_id FROM co)),
ht AS (SELECT task_id FROM (SELECT DISTINCT task_id FROM fr WHERE m >= 2) ORDER BY {_drawn("task_id", 14)} LIMIT 8),
po AS (SELECT * FROM fr WHERE k = 1 AND task_id NOT IN (SELECT task_id FROM ht)),
ea AS (SELECT *, row_number() OVER (ORDER BY {_drawn("task_id", 15)}) AS p FROM po), eb AS (SELECT *, row_number() OVER (ORDER BY {_drawn("task_id", 16)}) AS p FROM po),
tr AS (SELECT 'REAL' AS kind, key, task_id, original, final FROM re UNION ALL SELECT 'REAL_CONTROL', key, task_id, original, final FROM co
UNION ALL SELECT 'FOIL_HARD', b.key, a.task_id, a.original, b.final FROM fr a JOIN fr b ON a.task_id = b.task_id AND a.k = 1 AND b.k = 2 WHERE a.task_id IN (SELECT task_id FROM ht)
UNION ALL SELECT 'FOIL_EASY', eb.key, ea.task_id, ea.original, eb.final FROM ea JOIN eb ON ea.p = eb.p WHERE ea.p <= 6 AND ea.task_id <> eb.task_id)"""


@query("r6_spot_trials", f"WITH {_SPOTS} SELECT *, substr(md5(concat(CAST(key AS VARCHAR), ':17')), 1, 1) >= '8' AS flipped FROM tr")
def r6(judgements):
    return _spots(judgements)


@query("w5_w6_running_order")
def w6(judgements):
    """Places are held against Python in the tests."""
    rows = _spots(judgements).withColumn("order", F.col("key") * 4 + F.when(F.col("kind") == "REAL", 0).when(F.col("kind") == "REAL_CONTROL", 1).when(F.col("kind") == "FOIL_HARD", 2).otherwise(3)).withColumn("trial", F.col("order"))
    return T.running_order(rows, "trial", "order", 19)


@query("w12_cluster_order", "SELECT c, string_agg(DISTINCT h, ',' ORDER BY h) FILTER (h IS NOT NULL) AS human, string_agg(DISTINCT m, ',' ORDER BY m) AS model, coalesce(min(h), 'Z') AS ordered_by FROM (SELECT c, CASE WHEN hj = 'YES' THEN 'H' || ha END AS h, 'M' || ha AS m FROM pairs) GROUP BY 1")
def w12(pairs):
    rows = pairs.select("c", F.explode(F.array(F.when(F.col("hj") == "YES", F.concat(F.lit("H"), "ha")), F.concat(F.lit("M"), "ha"))).alias("member"))
    found = T.ordered_clusters(rows, "c", "member")
    return found.select("c", F.nullif(F.array_join("human", ","), F.lit("")).alias("human"), F.array_join("model", ",").alias("model"), "ordered_by")
