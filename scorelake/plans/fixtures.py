"""Shapes of the engine's inputs, derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WEIGHT = "CASE CAST(floor(l_quantity) AS INT) % 6 WHEN 0 THEN -3 WHEN 1 THEN -2 WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END"
_CRITERION = "concat(CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))"
_POS = "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + l_suppkey"

JUDGEMENTS = f"""SELECT l_orderkey AS task_id, {_CRITERION} AS criterion_id, {_POS} AS pos, {_WEIGHT} AS criterion_weight,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Yes' WHEN l_returnflag = 'R' THEN 'yes, though not fully'
       WHEN l_returnflag = 'A' THEN ' No ' WHEN l_linestatus = 'O' THEN 'unknown' ELSE 'maybe' END AS judgement,
  CASE l_suppkey % 5 WHEN 0 THEN 'identifying' WHEN 1 THEN 'logical process' WHEN 2 THEN 'clear process'
       WHEN 3 THEN 'helpful outcome' ELSE 'harmless outcome' END AS criterion_dimension,
  CASE l_orderkey % 3 WHEN 0 THEN 'daily_dilemmas' WHEN 1 THEN 'ai_risk_misuse' ELSE 'expert_case_long' END AS dilemma_source,
  CASE l_partkey % 4 WHEN 0 THEN 'law' WHEN 1 THEN 'health_care_home' WHEN 2 THEN 'public_life' ELSE 'work' END AS role_domain,
  CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE repeat('ab ', CAST(l_partkey % 23 AS INT)) END AS response,
  CAST(l_partkey % 997 AS INT) AS output_tokens, concat('model', CAST(l_suppkey % 11 AS STRING)) AS model, l_tax >= 0.04 AS changed
FROM lineitem"""

PAIRS = f"""SELECT l_orderkey AS c, {_POS} AS pos, concat('model', CAST(l_suppkey % 11 AS STRING)) AS md, 0.5 + 5 * l_discount AS cos,
  CASE WHEN l_returnflag = 'N' THEN 'NO' ELSE 'YES' END AS hj, CASE WHEN l_linestatus = 'F' THEN 'NO' ELSE 'YES' END AS mj,
  {_CRITERION} AS ha, concat('M', {_CRITERION}) AS ma, l_partkey AS h_part, l_suppkey AS m_part
FROM lineitem"""

STATUS_LOG = """SELECT user_id AS task_id, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status, value AS elapsed_sec FROM events"""

VERDICTS = """SELECT doc_id AS criterion_id, 'judge_a' AS judge, quality = 1 AS meets FROM labels
UNION ALL SELECT doc_id, 'judge_b', toxic = 0 FROM labels
UNION ALL SELECT doc_id, 'judge_c', doc_id % 3 <> 0 FROM labels WHERE doc_id % 7 <> 0"""

CONCEPTS = """SELECT vec_id AS pos, CASE WHEN label < 5 THEN 'human' ELSE 'model' END AS side,
  CASE WHEN label >= 5 THEN concat('m', CAST(label AS STRING)) END AS model, label AS grp, CAST(vec_id % 7 - 3 AS INT) AS weight, embedding AS vec
FROM embeddings"""

#: Each engine's rows (doc_id, source, line, t) of all lines of all documents.
LINES = {
    "spark": "(SELECT doc_id, source, posexplode(split(text, '\\n')) AS (line, t) FROM documents)",
    "duckdb": "(SELECT doc_id, source, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)",
}

#: Every line of every document is a title.
TITLES = "SELECT doc_id * 1000000 + line AS pos, source AS task_id, t AS title FROM :lines"

CRITERIA_TEXT = r"""SELECT doc_id * 1000000 + line AS pos, concat(CASE (doc_id + line) % 16 WHEN 0 THEN 'Clearly explains, in brief, ' WHEN 1 THEN 'The response should briefly note ' WHEN 2 THEN 'Avoids ' WHEN 3 THEN 'Acknowledges '
  WHEN 4 THEN '"Risk/benefit, cost or gain ' WHEN 5 THEN 'Suggests, oddly, failing ' WHEN 6 THEN 'Identifies a significant and severe ' WHEN 7 THEN 'Response must, explicitly state ' WHEN 8 THEN 'detrimental: '
  WHEN 9 THEN 'Names groups such as children, if any, including ' WHEN 10 THEN 'Lists (one, two, three) items. ' WHEN 11 THEN 'Advice , ' WHEN 12 THEN 'Weighs Major Harm whether ' WHEN 13 THEN '  Thoroughly  considers ( a ) , ' WHEN 14 THEN 'Mentions e.g. Paris; ' ELSE '' END,
  t) AS title FROM :lines"""

#: Whole documents.
TEXTS = "SELECT doc_id AS pos, source AS task_id, text AS title FROM documents"

TURNS = "SELECT conv_id, turn, role, text FROM conversations"

ORDERS = "SELECT o_orderkey AS task_id, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS cust FROM orders"

_TABLE_OF = {"judgements": "lineitem", "pairs": "lineitem", "status_log": "events", "verdicts": "labels", "concepts": "embeddings", "titles": "documents", "criteria_text": "documents", "texts": "documents", "turns": "conversations", "tasks": "orders"}
SHAPES = {"judgements": JUDGEMENTS, "pairs": PAIRS, "status_log": STATUS_LOG, "verdicts": VERDICTS, "concepts": CONCEPTS, "titles": TITLES, "criteria_text": CRITERIA_TEXT, "texts": TEXTS, "turns": TURNS, "tasks": ORDERS}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of SHAPES over the tables of sf_dir."""
    source = _TABLE_OF[name]
    sql = SHAPES[name].replace(":lines", LINES["spark"]).replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(sql, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def with_shapes(sql: str) -> str:
    """DuckDB SQL in which the names of SHAPES are tables: common table expressions before what sql defines itself."""
    used = [f"{n} AS ({s.replace(':lines', LINES['duckdb'])})" for n, s in SHAPES.items() if n in sql]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(used)}{', ' if used else ''}{sql[14:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join(used)}{', ' if used else ''}{sql[5:]}"
    return f"WITH {', '.join(used)} {sql}" if used else sql
