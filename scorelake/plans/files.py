"""Queries that go through files and streams (S, K, I), with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, matrix
from ..operators.rewrites import RewriteCache
from ..sources import readers, writers
from ..sources.durable import shared_dir
from ..sources.versions import Versioned
from ..streaming import incremental, keyed
from .catalog import query


def _place(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/scorelake-files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _text(df: DataFrame, lines, path: str) -> str:
    df.select(lines.alias("value")).write.text(path)
    return path


@query("s1_k1_k2_json_lines", "SELECT task_id, status, priority FROM tasks")
def s1(spark, tasks):
    """Half replaces what is there, half is appended."""
    path = _place(spark)
    rows = tasks.select("task_id", "status", "priority")
    writers.replace_json(rows.filter("task_id % 3 = 0"), path)
    writers.replace_json(rows.filter("task_id % 2 = 0"), path)
    writers.append_json(rows.filter("task_id % 2 = 1"), path)
    return readers.json_lines(spark, path, "task_id long, status string, priority string")


@query("s2_missing_file", "SELECT task_id FROM tasks WHERE task_id % 2 = 0")
def s2(spark, tasks):
    """Two outputs of a run, of which the second was never begun."""
    path = _place(spark)
    writers.append_json(tasks.filter("task_id % 2 = 0").select("task_id"), f"{path}/first")
    parts = [readers.json_lines_or_empty(spark, f"{path}/{name}", "task_id long") for name in ("first", "second")]
    return parts[0].unionByName(parts[1])


@query("k3_versions", "SELECT 1 AS version, task_id, status FROM tasks WHERE task_id % 2 = 0 UNION ALL SELECT 2, task_id, status FROM tasks UNION ALL SELECT 3, task_id, upper(priority) FROM tasks WHERE task_id % 3 = 0")
def k3(spark, tasks):
    """An output written, appended to and replaced by rows read from itself; every version as its readers have it."""
    out = Versioned(spark, _place(spark), "json", keep=3)
    rows, kind = tasks.select("task_id", "status"), "task_id long, status string"
    out.replace(rows.filter("task_id % 2 = 0"))
    out.append(rows.filter("task_id % 2 = 1"))
    out.replace(out.read(kind).filter("task_id % 3 = 0").join(tasks.select("task_id", F.upper("priority").alias("p")), "task_id").select("task_id", F.col("p").alias("status")))
    parts = [out.read(kind, v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SPECS = "s AS (SELECT priority || status AS label, 'r' || priority[1] AS response_tag, status AS rubric_tag, count(*) AS n FROM tasks WHERE status <> 'P' GROUP BY priority, status)"


@query("s15_run_matrix", f"WITH {_SPECS}, c AS (SELECT response_tag, count(*) AS k FROM s GROUP BY 1) SELECT label, CASE WHEN k > 1 THEN s.response_tag || '__rubric__' || rubric_tag ELSE s.response_tag END AS run_slug, n > 1000 AS reuse_rubric FROM s JOIN c ON c.response_tag = s.response_tag WHERE s.response_tag IN ('r1', 'r2', 'r3')")
def s15(spark, tasks):
    """A matrix document of all kinds of tasks, those of one status not enabled, read back for three tags."""
    path = _place(spark)
    kinds = tasks.groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.concat("priority", "status").alias("label"), F.concat(F.lit("r"), F.substring("priority", 1, 1)).alias("response_tag"), F.col("status").alias("rubric_tag"), (F.col("n") > 1000).alias("reuse_rubric"), (F.col("status") != "P").alias("enabled"))
    kinds.agg(F.collect_list(entry).alias("models")).select(F.to_json(F.struct("models")).alias("value")).write.text(path)
    return matrix.run_matrix(spark, path, "r1, r2, r3").select("label", "run_slug", "reuse_rubric")


@query("s17_resolved_paths", "SELECT task_id, CASE WHEN task_id % 4 = 0 THEN '' WHEN status = 'F' THEN 'release' WHEN status = 'O' THEN 'repository' WHEN task_id % 4 = 1 THEN 'release' ELSE 'repository' END AS root FROM tasks")
def s17(spark, tasks):
    """A path for each task, into folders of which the release has one and the repository two, one of the same name."""
    path = _place(spark)
    for root, found in (("release", ["F"]), ("repository", ["F", "O"])):
        tasks.filter(F.col("status").isin(found)).select("status", "task_id").repartition("status").write.partitionBy("status").parquet(f"{path}/{root}")
    name = F.when(F.col("task_id") % 4 == 0, F.concat(F.lit("/"), "status")).when(F.col("status").isin("F", "O"), F.concat(F.lit("status="), "status")).when(F.col("task_id") % 4 == 1, F.concat(F.lit("data/"), "status")).otherwise(F.col("status"))
    found = matrix.resolved_paths(tasks.select("task_id", name.alias("path")), f"{path}/release", f"{path}/repository")
    return found.select("task_id", F.regexp_extract("resolved", "/(release|repository)/", 1).alias("root"))


@query("i12_worker_shares", "WITH j AS (SELECT DISTINCT priority, status FROM tasks) SELECT priority, status, CAST((row_number() OVER (ORDER BY priority || status) - 1) // 4 AS INT) AS wave, 1 AS workers FROM j")
def i12(tasks):
    """The jobs of a matrix over four workers."""
    jobs = tasks.select("priority", "status", F.concat("priority", "status").alias("name")).distinct()
    return matrix.worker_shares(jobs, 4, "name").select("priority", "status", "wave", "workers")


@query("i9_cached_once", "SELECT status, count(*) AS n FROM tasks GROUP BY 1")
def i9(spark, tasks):
    """A table that one run makes and the next finds; it would fail if it were made again."""
    path = _place(spark)
    control.cached_once(spark, path, lambda: tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
    return control.cached_once(spark, path, lambda: tasks.select(F.raise_error(F.lit("made twice"))))


@query("s4_bad_lines", """WITH f AS (SELECT task_id // 5000 AS part, min(task_id) AS bad FROM tasks WHERE task_id % 97 = 0 GROUP BY 1)
SELECT part, count(*) AS line, max(bad) AS task_id FROM tasks JOIN f ON task_id // 5000 = part AND task_id <= bad GROUP BY 1""")
def s4_bad(spark, tasks):
    """A file for each 5,000 task numbers, in order, with torn lines: the first of each file and its number."""
    path, line = _place(spark), F.to_json(F.struct("task_id", "priority"))
    torn = F.when(F.col("task_id") % 97 == 0, F.concat(F.lit('{"task_id": '), F.col("task_id").cast("string"))).otherwise(line)
    tasks.select(F.expr("task_id div 5000").alias("part"), "task_id", torn.alias("value")).repartition("part").sortWithinPartitions("part", "task_id").select("part", "value").write.partitionBy("part").text(path)
    bad = readers.bad_lines(spark, f"{path}/*", "task_id long, priority string")
    return bad.select(F.regexp_extract("file", r"/part=([0-9]+)/", 1).cast("long").alias("part"), "line", F.regexp_extract("text", "([0-9]+)$", 1).cast("long").alias("task_id"))


@query("s12_compacted", "SELECT CAST(task_id // 1000 AS VARCHAR) AS c, CAST(count(*) AS BIGINT) AS n, max(CASE WHEN task_id // 1000 % 2 = 0 THEN 2 ELSE 1 END) AS run FROM tasks GROUP BY 1")
def s12_compacted(spark, tasks):
    """Case documents compacted twice: the second run adds those that have come since."""
    path, to = _place(spark), _place(spark)
    cases = tasks.groupBy(F.expr("task_id div 1000").alias("c")).agg(F.to_json(F.collect_list("task_id")).alias("value"))
    for run, rest in ((1, 1), (2, 0)):
        cases.filter(F.col("c") % 2 == rest).withColumn("run", F.lit(run)).repartition("c").write.mode("append").partitionBy("run", "c").text(path)
        docs = readers.compacted_documents(spark, f"{path}/*/*/*.txt", to, {"run": r"/run=([^/]+)/", "c": r"/c=([^/]+)/"})
    return docs.select("c", F.size(F.from_json("text", "array<long>")).cast("long").alias("n"), F.col("run").cast("int").alias("run"))


@query("i6_rewrite_cache", "SELECT pos, CASE WHEN title LIKE '%the%' THEN translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE title END AS final, title LIKE '%the%' AS changed FROM titles")
def i6_cache(spark, titles):
    """All lines of all documents, bucketed as the cache is, through one that is asked twice: the second time for nothing."""

    def judge(texts: list[str]) -> list[str | None]:
        return ["".join(c.upper() if "a" <= c <= "z" else c for c in t) if "the" in t else None for t in texts]

    name = f"rewrites_{uuid.uuid4().hex}"
    cache = RewriteCache(spark, name, buckets=16)
    plain = cache.bucketed(titles.select("pos", F.col("title").alias("text")), f"{name}_texts")
    cache.fill(plain, judge)
    if cache.fill(plain, judge):
        raise RuntimeError("a second run asked again")
    return cache.rewritten(plain).select("pos", "final", "changed")


@query("s3_torn_lines", "SELECT task_id, priority FROM tasks WHERE task_id % 10 <> 0")
def s3(spark, tasks):
    line = F.to_json(F.struct("task_id", "priority"))
    torn = F.when(F.col("task_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line)
    return readers.json_lines_tolerant(spark, _text(tasks, torn, _place(spark)), "task_id long, priority string")


@query("s6_k4_csv", "SELECT task_id, priority, CASE WHEN task_id % 2 = 0 THEN 'say \"' || status || '\"' || chr(10) || 'twice' END AS note FROM tasks")
def s6(spark, tasks):
    """Rows of two tables, one without the last column; quotes and line feeds inside fields."""
    path = _place(spark)
    note = F.concat(F.lit('say "'), "status", F.lit('"\ntwice'))
    odd = tasks.filter("task_id % 2 = 1").select("task_id", "priority")
    writers.write_csv([tasks.filter("task_id % 2 = 0").select("task_id", "priority", note.alias("note")), odd], path)
    return readers.csv_rows(spark, path, "task_id long, priority string, note string")


@query("s8_missing_embeddings", "SELECT DISTINCT title AS text FROM texts WHERE title NOT IN (SELECT title FROM texts WHERE pos % 3 = 0)")
def s8(texts):
    named = texts.select(F.col("title").alias("text"), "pos")
    return readers.missing_embeddings(named, named.filter("pos % 3 = 0"))


@query("s8_cache_fingerprint", """WITH h AS (SELECT pos, sha256(pos || '|' || title) AS h FROM texts), c AS (SELECT pos // 65536 AS c, sha256(string_agg(h, ',' ORDER BY pos)) AS h FROM h GROUP BY 1)
SELECT sha256(string_agg(h, ',' ORDER BY c)) AS fingerprint FROM c""")
def s8_fingerprint(texts):
    """One hash of the whole list of documents."""
    return readers.cache_fingerprint(texts.select(F.col("pos").alias("text_idx"), F.col("title").alias("text")))


@query("s11_judgement_tree", "SELECT model, 'human' AS rubric, count(*) AS n FROM judgements GROUP BY 1")
def s11(spark, judgements):
    """Folders by model and rubric, written in one pass, read as one table with both from their paths; files of errors and backups don't count."""
    path = _place(spark)
    rows = judgements.select(F.col("task_id").cast("string").alias("task_id"), "judgement", "model", F.lit("human").alias("rubric"))
    rows.write.partitionBy("model", "rubric").json(path)
    rows.filter("judgement = ' No '").write.json(f"{path}/model=model1/rubric=human/pilot")
    found = readers.judgement_tree(spark, path, suffix=".json", model=r"/model=([^/]+)/", rubric=r"/rubric=([^/]+)/", bad_folders=True)
    return found.groupBy(F.col("_model").alias("model"), F.col("_rubric").alias("rubric")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_strict_lines", "SELECT task_id, priority FROM tasks")
def s4(spark, tasks):
    return readers.json_lines_strict(spark, _text(tasks, F.to_json(F.struct("task_id", "priority")), _place(spark)), "task_id long, priority string")


@query("s5_s12_case_documents", "SELECT 'm' || (task_id // 1000 % 3) AS md, CAST(task_id // 1000 AS VARCHAR) AS c, CAST(count(*) AS BIGINT) AS n, sum(task_id) AS ids FROM tasks GROUP BY 1, 2")
def s12(spark, tasks):
    """A JSON document of several lines for each case, model and case in its path."""
    path = _place(spark)
    cases = tasks.groupBy(F.expr("task_id div 1000").alias("c")).agg(F.collect_list("task_id").alias("ids"))
    text = F.concat(F.lit('{\n "items": [\n'), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",\n"), F.lit("\n]}"))
    cases.select(F.concat(F.lit("m"), (F.col("c") % 3).cast("string")).alias("md"), F.col("c"), text.alias("value")).repartition("c").write.partitionBy("md", "c").text(path)
    docs = readers.case_documents(spark, f"{path}/*/*/*.txt", "items array<long>", r"/md=([^/]+)/", r"/c=([^/]+)/")
    return docs.select("md", "c", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x).cast("decimal(38,0)").alias("ids"))


@query("s9_k3_single_file", "SELECT DISTINCT status FROM tasks")
def s9(spark, tasks):
    """A file replaced as a whole, beside errors and a backup, found as the one that is data."""
    path = _place(spark)
    lines = tasks.select(F.to_json(F.struct("status")).alias("value")).distinct()
    for name in ("x.jsonl", "x.jsonl", "x.errors.jsonl", "x.bak.jsonl"):
        writers.replace_file(lines, f"{path}/{name}")
    return readers.json_lines(spark, readers.single_file(spark, path), "status string")


@query("s10_rubric_pair", "SELECT DISTINCT 'ai' AS side, status FROM tasks UNION ALL SELECT DISTINCT 'human', priority FROM tasks")
def s10(spark, tasks):
    """No pair of the exact names, so the only ones that are neither pilots nor backups."""
    path = _place(spark)
    for name, column in (("ai_rubric_a.jsonl", "status"), ("human_rubric_a.jsonl", "priority"), ("ai_rubric_a.backup.jsonl", "priority"), ("pilot_human_rubric_a.jsonl", "status")):
        writers.replace_file(tasks.select(F.to_json(F.struct(F.col(column).alias("status"))).alias("value")).distinct(), f"{path}/{name}")
    ai, human = readers.rubric_pair(spark, path, "ai_rubric_500cases.jsonl", "human_rubric_500cases.jsonl")
    read = lambda side, at: readers.json_lines(spark, at, "status string").select(F.lit(side).alias("side"), "status")
    return read("ai", ai).unionByName(read("human", human))


@query("d4_d5_inventory", "SELECT status AS section, CAST(1 AS BIGINT) AS files, true AS has_bytes, CASE WHEN status = 'P' THEN 'differs' ELSE 'same' END AS found FROM tasks GROUP BY 1")
def d4(spark, tasks):
    """Files and bytes of each section, held against how many there should be: one too many is asked of one section."""
    path = _place(spark)
    tasks.select("task_id", "status").repartition("status").write.partitionBy("status").json(path)
    stock = readers.inventory(readers.listed(spark, path, ".json"), F.regexp_extract("path", "/status=([^/]+)/", 1))
    expected = tasks.select(F.col("status").alias("section")).distinct().withColumn("expected", F.when(F.col("section") == "P", 2).otherwise(1).cast("long"))
    return readers.provenance(stock, expected).select("section", "files", (F.col("bytes") > 0).alias("has_bytes"), "found")


@query("k8_case_reports", """WITH s AS (SELECT task_id, model, avg(output_tokens) AS score, count(*) AS n FROM judgements GROUP BY 1, 2)
SELECT task_id, '# ' || task_id || chr(10) || string_agg('## ' || model || ' ' || n || chr(10), '' ORDER BY score, model) AS text FROM s GROUP BY 1""")
def k8(judgements):
    rows = judgements.groupBy("task_id", "model").agg(F.avg("output_tokens").alias("score"), F.count(F.lit(1)).cast("string").alias("text"))
    return writers.case_reports(rows, "task_id", "model", "score", "text")


@query("k10_saved_vectors", "SELECT pos, round(vec[1], 6) AS first, len(vec) AS n FROM concepts")
def k10(spark, concepts):
    path = _place(spark)
    writers.save_vectors(concepts, path, "pos", "model", "vec")
    return spark.read.parquet(path).select("pos", F.round(F.col("vec")[0].cast("double"), 6).alias("first"), F.size("vec").cast("long").alias("n"))


@query("s13_id_list", "SELECT task_id, status FROM tasks WHERE task_id % 40 = 0")
def s13(spark, tasks):
    """Ids listed twice, with white space and blank lines, then a semi join."""
    lines = tasks.filter("task_id % 40 = 0").select(F.explode(F.array(F.concat(F.lit(" "), F.col("task_id").cast("string")), F.lit(""), F.col("task_id").cast("string"))).alias("x"))
    ids = readers.id_list(spark, _text(lines, F.col("x"), _place(spark)))
    return tasks.join(ids.select(F.col("id").cast("long").alias("task_id")), "task_id", "left_semi").select("task_id", "status")


@query("s14_submissions", "SELECT 'p' || (task_id % 97) AS annotator, 't' || task_id AS trial_id, priority AS match FROM tasks")
def s14(spark, tasks):
    """Submissions for all tasks, a file for each annotator and range of tasks."""
    rows = tasks.groupBy(F.concat(F.lit("p"), (F.col("task_id") % 97).cast("string")).alias("annotator"), F.expr("task_id div 100000").alias("part"))
    docs = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t"), F.col("task_id").cast("string")), F.struct(F.col("priority").alias("match"))))).alias("answers"))
    path = _place(spark)
    docs.drop("part").repartition("annotator").write.option("maxRecordsPerFile", 1).json(path)
    return readers.submissions(spark, path, "match:string")


@query("k6_i7_dead_letters", "SELECT status = 'error' AS failed, count(*) AS n FROM status_log GROUP BY 1")
def k6(status_log):
    good, bad = writers.split_errors(status_log, F.col("status") == "error")
    return good.agg(F.lit(False).alias("failed"), F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit(True).alias("failed"), F.count(F.lit(1)).alias("n")))


@query("k5_annotation_sheet", "SELECT pos, substr(title, 1, 30) AS title, '' AS same, '' AS note FROM titles")
def k5(titles):
    return writers.annotation_sheet(titles.select("pos", "title"), "title", ["same", "note"], 30)


@query("k7_k8_report_rows", r"SELECT task_id || ' & ' || status || ' & ' || priority || ' \\' AS line FROM tasks")
def k7(tasks):
    return writers.report_rows(tasks, ["task_id", "status", "priority"])


@query("i4_i5_stream_last_status", "SELECT task_id, arg_max(status, seq) AS status, max(seq) AS seq FROM status_log GROUP BY 1")
def i4(spark, status_log):
    """The log as a stream of files: each batch writes the tasks that it changes, the first ones are then compacted."""
    path = _place(spark)
    log, cores = status_log.select("task_id", "status", "seq"), spark.sparkContext.defaultParallelism
    for rest in (0, 1):  # two runs of one stream, each of two batches of a file for every core
        log.filter(F.col("seq") % 2 == rest).repartition(2 * cores, "seq").write.mode("append").json(f"{path}/in")
        rows = incremental.row_stream(spark, f"{path}/in", "task_id long, status string, seq long", files=cores)
        incremental.run_to_end(keyed.changed_last(rows), keyed.changes_to(f"{path}/out"), f"{path}/checkpoint", "update")
        if not rest:
            keyed.compacted(spark, f"{path}/out")
    return keyed.current_last(spark, f"{path}/out")


_STALLS = """WITH e AS (SELECT event_id AS task_id, epoch_ms(ts) AS asked, CASE WHEN event_type <> 'error' THEN epoch_ms(ts) + CAST(round(value * 1000) AS BIGINT) END AS answered FROM events WHERE ts IS NOT NULL),
w AS (SELECT max(greatest(asked, coalesce(answered, asked))) - 3600000 AS upto FROM e)
SELECT task_id, 'answered' AS outcome, answered - asked AS waited FROM e WHERE answered <= asked + 20000
UNION ALL SELECT task_id, 'late', answered - asked FROM e WHERE answered > asked + 20000
UNION ALL SELECT task_id, 'timed out', 20000 FROM e, w WHERE answered > asked + 20000 OR answered IS NULL AND asked + 20000 <= upto"""


@query("i7_stall_timer", _STALLS)
def i7(spark, sf_dir):
    """Every event is a question that is answered after `value` seconds, errors never: those without an answer in 20 seconds time out, however late it comes."""
    path = _place(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("task_id"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ms"), F.when(F.col("event_type") != "error", F.round(F.col("value") * 1000).cast("long")).alias("takes")).filter("ms is not null")
    both = events.select("task_id", F.lit("ask").alias("kind"), "ms").unionByName(events.filter("takes is not null").select("task_id", F.lit("answer").alias("kind"), (F.col("ms") + F.col("takes")).alias("ms")))
    first, last = both.agg(F.min("ms"), F.max("ms")).head()
    step, cores = ((last or 0) - (first or 0)) // 4 + 1, spark.sparkContext.defaultParallelism
    for i in range(4):  # files in order of time, as they would appear: a run of the stream for each quarter, which is one batch
        part = both.filter(F.expr(f"(ms - {first or 0}) div {step}") == i)
        part.select("task_id", "kind", F.timestamp_millis("ms").alias("at")).coalesce(cores).write.mode("append").json(f"{path}/in")
        rows = incremental.row_stream(spark, f"{path}/in", "task_id long, kind string, at timestamp", files=cores)
        incremental.run_to_end(keyed.with_stall_limit(rows, 20, "1 hour"), lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/n={number}"), f"{path}/checkpoint", "update")
    return spark.read.parquet(f"{path}/out").select("task_id", "outcome", (F.unix_millis("at") - F.unix_millis("asked_at")).alias("waited"))


@query("i1_i2_stream_resume", "SELECT DISTINCT task_id FROM status_log WHERE status = 'ok'")
def i1(spark, status_log):
    """Tasks that are done, each once, from a stream that repeats them."""
    path = _place(spark)
    status_log.filter("status = 'ok'").select("task_id", "seq").repartition(2, "seq").write.json(f"{path}/in")
    done = incremental.completed_once(incremental.row_stream(spark, f"{path}/in", "task_id long, seq long"), ["task_id"])
    incremental.run_to_end(done.select("task_id"), lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/n={number}"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("task_id")
