import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import stats as M
from scorelake.functions import text as X
from scorelake.functions import verdicts as V
from scorelake.operators import relate as R
from scorelake.operators import rubric as P
from scorelake.operators import runs as O
from scorelake.operators import score as S
from scorelake.operators import vectors as C
from scorelake.sources import readers, writers

J = "task_id string, criterion_id string, pos int, criterion_weight int, judgement string"


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)
    return [r["y"] for r in rows.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def judged(spark, rows):
    return spark.createDataFrame([(t, f"c{i}", i, w, j) for i, (t, w, j) in enumerate(rows)], J)


# ---- scores: the traps of substring verdicts and empty tasks ----------------------------------


def test_substring_credit_and_empty_tasks(spark):
    rows = judged(spark, [("a", 2, "yes, but no"), ("a", -1, "Yes and NO"), ("a", -2, "unknown"), ("b", 0, "yes"), ("c", 3, None), ("c", 1, " Yes ")])
    got = {r["task_id"]: r["score"] for r in S.task_scores(rows).collect()}
    assert got == {"a": pytest.approx(100.0), "b": 0.0, "c": 25.0}
    assert {r["task_id"] for r in S.task_scores(rows, "drop").collect()} == {"a", "c"}
    assert {r["task_id"]: r["score"] for r in S.task_scores(rows, "null").collect()}["b"] is None


def test_a_no_on_a_positive_criterion_never_helps(spark):
    base = [("t", w, j) for w in (-3, -1, 1, 3) for j in ("yes", "no", "maybe")]
    score = lambda rows: S.task_scores(judged(spark, rows)).first()["score"]
    for i, (t, w, j) in enumerate(base):
        if w > 0 and j == "yes":
            assert score(base[:i] + [(t, w, "no")] + base[i + 1 :]) <= score(base)


def test_histogram_leaves_out_a_full_score(spark):
    rows = S.histogram(spark.createDataFrame([("a", 100.0), ("b", 99.9), ("c", 0.0), ("d", 10.0)], "task_id string, score double"))
    got = {r["bucket"]: r["percent"] for r in rows.collect()}
    assert got[90] == got[0] == got[10] == 25.0 and sum(got.values()) == 75.0 and len(got) == 10


def test_categories_come_from_first_rows_and_two_parts(spark):
    rows = judged(spark, [("a", 1, "yes"), ("a", 1, "no")]).withColumn("dilemma_source", F.when(F.col("pos") == 0, "ai_risk_misuse").otherwise("other")).withColumn("role_domain", F.lit("x"))
    got = {(r["category"], r["value"]): r["mean_score"] for r in S.category_means(rows).collect()}
    assert got == {("overall", "overall"): 50.0, ("dilemma_source", "ai_risk"): 50.0, ("role_domain", "x"): 50.0}


def test_guards(spark):
    with pytest.raises(ValueError, match=r"blank: \('0',\).*\(\+2 more\)"):
        P.require(spark.range(12).select(F.col("id").cast("string")).orderBy("id"), "blank")
    P.require(spark.range(0), "blank")
    with pytest.raises(ValueError, match="expected 3"):
        P.require_count(spark.range(2), 3)
    rubric = spark.createDataFrame([("t", [("a", "x", None)])], "task_id string, RUBRIC array<struct<id:string,title:string,weight:int>>")
    with pytest.raises(Exception, match="without weight: a"):
        P.explode_strict(rubric, "task_id").collect()


# ---- verdicts and parsers ---------------------------------------------------------------------


def test_verdict_readers_differ(spark):
    words = ["Yes", "not sure", "**no", "none", "I say yes", None, "NO", " no\n"]
    assert one(spark, V.contained_verdict, *words) == ["yes", "no", "no", "no", "yes", "other", "no", "no"]
    assert one(spark, V.leading_verdict, *words) == ["yes", "no", "**no", "no", "i say yes", "", "no", "no"]
    assert one(spark, V.marked_verdict, *words) == [True, False, False, False, None, None, False, False]
    assert one(spark, V.is_no, *words) == [False, False, False, False, False, False, True, True]


def test_ladder_on_tails_of_long_answers(spark):
    far = "it passes. " + "z" * 700
    assert one(spark, V.ladder_verdict, far, far + " it fails", "passes", "", '```json\n{"meets_requirements": false}\n```') == [None, False, True, None, False]


def test_flexible_rubrics(spark):
    texts = ['[{"id": "a", "title": "it\'s", "weight": 1}]', "[{'id': 'a', 'title': 't', 'weight': 2}]", "[{'id': None, 'title': 't', 'weight': 3}]", "not a list", None]
    got = one(spark, lambda c: F.transform(P.flexible_rubric(c), lambda x: x["weight"]), *texts)
    assert got[:3] == [[1], [2], [3]] and got[4] is None and not any(x for x in got[3] or [])


def test_numbered_lists_round_trip(spark):
    titles = ["first", " second. 2. x", "drittes äöü"]
    got = one(spark, lambda c: P.parsed_list(P.numbered_list(c)), titles, kind="array<string>")[0]
    assert got == {1: "first", 2: "second. 2. x", 3: "drittes äöü"}


def test_task_numbers_and_weights(spark):
    assert one(spark, P.task_number, "19", "case_019", " 19 ", "nan", "NULL", "", "x1", None) == [19, 19, 19, None, None, None, None, None]
    assert one(spark, P.valid_weight, "3", "-2.0", "1.5", "4", "", "two", "+1", None) == [3, -2, None, None, None, None, 1, None]


# ---- text: each case with the text that the description asks for -------------------------------


FORMS = {
    "Clearly explains risks": "Does the response consider risks",
    "Identifies, in brief, the risk": "Does the response consider the risk",
    "  'Quoted title here' ": "Does the response consider title here",
    "The response should clearly state a risk": "The response should clearly state a risk",
    "Risk/benefit, cost or gain matters": "Does the response consider cost or gain matters",
    "Risk/benefit or gain matters": "Does the response consider matters",
    "Avoids blame": "Avoids blame",
    "Overlooks": "Overlooks",
    "Advice, once given": "Advice, once given",
    "Suggests, oddly, that it fails": "Suggests, oddly, that it fails",
    "Suggests, oddly, a way out": "Does the response consider a way out",
    "émet des avis utiles": "Does the response consider des avis utiles",
    "detrimental: says no": "detrimental: says no",
    "": "",
}


def test_embedding_forms(spark):
    assert one(spark, X.embedding_form, *FORMS) == list(FORMS.values())


def test_spaces_and_degrees(spark):
    assert one(spark, X.normal_space, " a  b , ( c ) ;d ", "line\r\nbreak\there", "") == ["a b, (c);d", "line break here", ""]
    assert one(spark, X.without_degrees, "MAJOR and major Severe harm", "a grave risk", "plain", "majority") == ["and harm", "a risk", None, None]


def test_enumerations(spark):
    assert one(spark, X.without_enumerations, "Uses (a, b, c) lists", "Names groups such as a, b; and more", "Acts, e.g. well. Then ends", "Keeps (a, b) pairs") == ["Uses lists", "Names groups; and more", "Acts. Then ends", None]


def test_inner_capitals(spark):
    # the first capitalised word of the first 80 characters does not count, wherever it is met again
    assert one(spark, X.inner_capitals, "Fully supports Paris and London", "no capitals", "Paris or Paris", "x" * 90 + " Rome") == [2, 0, 0, 1]


def test_rewrites_take_each_step_that_changes_something(spark):
    rows = spark.createDataFrame([(1, "The response should clearly state a major risk (a, b, c)", "Weighs the cost"), (2, "Names it", ""), (3, "plain", "Weighs")], "pos int, h string, m string")
    got = {(r["pos"], r["factor"]): r["text"] for r in X.rewrites(rows, ["pos"], "h", "m").collect()}
    head = "The response should "
    assert {f: t for (p, f), t in got.items() if p == 1} == {
        "verb_model": head + "Weighs a major risk (a, b, c)", "degree_strip": head + "clearly state a risk (a, b, c)", "enum_strip": head + "clearly state a major risk",
        "verb_degree": head + "Weighs a risk (a, b, c)", "verb_enum": head + "Weighs a major risk", "degree_enum": head + "clearly state a risk", "verb_degree_enum": head + "Weighs a risk",
    }
    assert not any(t for (p, _), t in got.items() if p == 2) and len(got) == 21
    assert got[3, "verb_model"] == "Weighs" and got[3, "degree_strip"] is None


def test_openings(spark):
    got = one(spark, X.opening, "The response should clearly, gently state, the risk", "Response ", "clearly", "Names  it")
    assert (got[0]["shell"], got[0]["adverbs"], got[0]["verb"], got[0]["verb_token"], got[0]["rest"]) == ("The response should ", ["clearly,", "gently"], "state", "state,", " the risk")
    assert got[1]["verb"] is None and got[2]["adverbs"] == ["clearly"] and got[2]["verb_token"] is None and got[3]["verb"] == "names"
    assert one(spark, lambda c: X.with_verb(c, F.lit("Weighs")), "The response should clearly state the risk", "clearly") == ["The response should Weighs the risk", None]


# ---- statistics -------------------------------------------------------------------------------


def test_exact_tails(spark):
    cases = [(651, 887), (0, 5), (6, 5), (500, 1000), (2, 3)]
    rows = spark.createDataFrame(cases, "k int, n int").coalesce(1)
    got = [r["p"] for r in rows.select(M.binomial_tail("k", "n").alias("p")).collect()]
    for (k, n), p in zip(cases, got):
        assert p == pytest.approx(sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n, rel=1e-12)
    assert got[0] == pytest.approx(6.6375e-46, rel=1e-4)
    logs = [r["p"] for r in rows.filter("k <= n and k > 0").select(M.log_tail(F.col("k"), F.col("n")).alias("p")).collect()]
    assert logs == pytest.approx([math.log(p) for (k, n), p in zip(cases, got) if 0 < k <= n], rel=1e-9)
    signs = [r["p"] for r in spark.createDataFrame([(236, 651), (0, 0), (700, 800), (3, 3)], "a int, b int").coalesce(1).select(M.sign_test("a", "b").alias("p")).collect()]
    assert signs[0] < 1e-40 and signs[1] is None and 0 < signs[2] < 0.02 and signs[3] > 1


# ---- vectors ----------------------------------------------------------------------------------


def units(spark, n=160, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i]], f"m{i % 3}", (i * 7) % 7 - 3) for i in range(n)]
    return v, spark.createDataFrame(rows, "pos long, vec array<double>, model string, weight int")


@pytest.mark.parametrize("batch", [8, 64, 512])
def test_leaders_do_not_depend_on_batches_and_members_join_as_in_sequence(spark, batch):
    v, rows = units(spark)
    t, kept, joined = 0.7, [], {}
    cos = v @ v.T
    for i in range(len(v)):
        older = [k for k in kept if k // batch < i // batch and cos[i, k] >= t]
        same = [k for k in kept if k // batch == i // batch and cos[i, k] >= t]
        if older or same:
            joined[i] = max(older or same, key=lambda k: (cos[i, k], -k))
        else:
            kept.append(i)
    got = {r["pos"]: r["leader"] for r in C.global_dedupe(rows, t, batch=batch, block=32).collect()}
    assert got == {k: k for k in kept} | joined
    merged = {r["leader"]: r for r in C.merged_global(C.global_dedupe(rows, t, batch=batch, block=32), rows).collect()}
    assert sum(r["n_merged"] for r in merged.values()) == len(joined)
    assert all(cos[a, b] < t for a in kept for b in kept if a < b)


@pytest.mark.parametrize("few", [0, 50, 2_000_000])
def test_leaders_of_long_chains(spark, few):
    n = 12 if few == 0 else 1000  # a chain's every other node leads; without the last task each two take a round
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    if few == 50:
        edges = edges.filter("a % 10 <> 9")  # chains of ten
    got = {r["pos"] for r in C.leaders(spark.range(n).withColumnRenamed("id", "pos"), edges, few).collect()}
    assert got == {i for i in range(n) if i % 2 == 0}


def test_cases_are_deduped_in_order_of_rank(spark):
    unit = lambda *x: [float(v) / sum(t * t for t in x) ** 0.5 for v in x]
    rows = [(1, 2, 10, unit(1, 0), "b"), (1, 1, 11, unit(1, 0.1), "a"), (1, 3, 12, unit(0, 1), "a"), (1, 4, 13, unit(0.1, 1), "b"), (2, 1, 14, unit(1, 0), "c")]
    found = C.dedupe_by_case(spark.createDataFrame(rows, "case long, rank long, pos long, vec array<double>, model string"), 0.9, "model")
    assert {r["pos"]: r["leader"] for r in found.collect()} == {10: 11, 11: 11, 12: 12, 13: 12, 14: 14}
    merged = {r["leader"]: (r["tags"], r["n_merged"]) for r in C.merged(found).collect()}
    assert merged == {11: (["a", "b"], 1), 12: (["a", "b"], 1), 14: (["c"], 0)}


def test_empty_sides_and_zero_vectors(spark):
    _, rows = units(spark, 5)
    got = C.greatest_cosine(rows, rows.limit(0)).collect()
    assert {(r["cos"], r["other"]) for r in got} == {(0.0, None)}
    assert one(spark, C.unit, [0.0, 0.0], [3.0, 4.0], kind="array<double>") == [[0.0, 0.0], [0.6, 0.8]]


def test_a_failing_embedder_is_tried_again(spark):
    def embed(texts):
        import os
        import tempfile

        mark = os.path.join(tempfile.gettempdir(), f"embed-{os.getpid()}")
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    got = C.embedded(spark.createDataFrame([("a",), ("bcd",)], "text string"), embed, wait=0.01).collect()
    assert sorted(r["vec"][0] for r in got) == [1.0, 3.0]


# ---- relations --------------------------------------------------------------------------------


def test_argmax_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(5, 1.0), (2, 3.0), (7, 3.0)], "i int, v double")
    assert rows.agg(R.first_argmax(F.col("v"), F.col("i")).alias("a")).first()["a"] == 2


def test_tranches_are_disjoint_and_samples_nest(spark):
    rows = spark.range(300).withColumnRenamed("id", "k")
    got = R.tranches(rows, "k", [30, 20], 9).collect()
    assert [sum(r["tranche"] == t for r in got) for t in (1, 2)] == [30, 20] and len({r["k"] for r in got}) == 50
    assert {r["k"] for r in got} == {r["k"] for r in R.sample(rows, "k", 50, 9).collect()}


# ---- sources, sinks and streams ---------------------------------------------------------------


def test_readers(spark, tmp_path):
    good = '{"task_id": "a", "n": 1}\n\n{"task_id": "b", "n": 2}\n'
    (tmp_path / "x.jsonl").write_text(good)
    (tmp_path / "torn.jsonl").write_text(good + '{"task_id": "c", "n"')
    schema = "task_id string, n int"
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), schema).count() == 2
    assert readers.json_lines_or_empty(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    assert {r["task_id"] for r in readers.json_lines_tolerant(spark, str(tmp_path / "torn.jsonl"), schema).collect()} == {"a", "b"}
    with pytest.raises(Exception):
        readers.json_lines_strict(spark, str(tmp_path / "torn.jsonl"), schema).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.errors.jsonl").write_text("{}")
    with pytest.raises(RuntimeError):
        readers.single_file(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "a.jsonl").write_text(good)
    assert readers.single_file(spark, str(tmp_path / "d")).endswith("/a.jsonl")
    (tmp_path / "c.csv").write_text('a,b\n1,"two\nlines ""q"""\n')
    assert readers.csv_rows(spark, str(tmp_path / "c.csv")).first()["b"] == 'two\nlines "q"'
    (tmp_path / "ids.txt").write_text(" a \n\na\nb\n")
    assert readers.id_list(spark, str(tmp_path / "ids.txt")).count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.json").write_text(json.dumps({"annotator": "p", "answers": {"t1": {"match": "yes", "confidence": 3}}}, indent=1))
    (tmp_path / "s" / "key.json").write_text('{"t1": {"type": "POS"}}')
    (tmp_path / "s" / "bad.json").write_text('{"annotator": ')
    got = readers.submissions(spark, str(tmp_path / "s"), "match:string,confidence:int").collect()
    assert [(r["annotator"], r["trial_id"], r["match"], r["confidence"]) for r in got] == [("p", "t1", "yes", 3)]
    tree = tmp_path / "tree" / "m1" / "full" / "judgements" / "human"
    tree.mkdir(parents=True)
    (tree / "j.jsonl").write_text('{"task_id": "a", "judgement": "yes"}\n')
    (tree / "j.bak.jsonl").write_text('{"task_id": "b"}\n')
    got = readers.judgement_tree(spark, str(tmp_path / "tree")).collect()
    assert [(r["_model"], r["_rubric"], r["task_id"]) for r in got] == [("m1", "human", "a")]
    stock = readers.inventory(readers.listed(spark, str(tmp_path / "d"), ".jsonl"), F.lit("d")).first()
    assert stock["files"] == 2 and stock["bytes"] == len(good) + 2


def test_cache_fingerprints(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "text_idx long, text string")
    key = lambda df: readers.cache_fingerprint(df).first()["fingerprint"]
    assert key(texts) == key(texts.repartition(3)) != key(texts.withColumn("text_idx", 9 - F.col("text_idx")))
    assert readers.missing_embeddings(texts, texts.filter("text_idx < 7")).count() == 3


def test_writers(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 'q"z')], "i int, t string")
    writers.write_csv([a, b], str(tmp_path / "u"))
    got = readers.csv_rows(spark, str(tmp_path / "u"), "i int, s string, t string").orderBy("i").collect()
    assert [(r["i"], r["s"], r["t"]) for r in got] == [(1, "x", None), (2, None, 'q"z')]
    for _ in range(2):
        writers.append_json(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    good, bad = writers.split_errors(spark.createDataFrame([(1, None), (2, "late")], "i int, e string"), F.col("e").isNotNull())
    assert good.count() == bad.count() == 1
    assert writers.report_rows(a, ["i", "s"]).first()["line"] == r"1 & x \\"
    assert writers.annotation_sheet(spark.createDataFrame([("y" * 500,)], "s string"), "s", ["note"]).first().asDict() == {"s": "y" * 400, "note": ""}


def test_runs_are_named_apart_and_templates_by_name(spark, tmp_path):
    specs = spark.createDataFrame([("A", "r1", "x"), ("B", "r2", "x"), ("C", "r2", "y"), ("D", None, "z")], "label string, response_tag string, rubric_tag string")
    got = {r["label"]: (r["run_slug"], r["display_label"], r["selectors"]) for r in O.named_runs(specs).collect()}
    assert got["A"] == ("r1", "A", ["r1"]) and got["C"] == ("r2__rubric__y", "C | response=r2 rubric=y", ["r2", "r2__rubric__y"]) and got["D"][:2] == (None, None)
    (tmp_path / "one.txt").write_text("Say {a}\nand {b}.")
    (tmp_path / "two.txt").write_text("{b}")
    texts = readers.templates(spark, str(tmp_path))
    df = spark.createDataFrame([("one", 1, None), ("two", 2, "{a}"), (None, 3, "c")], "n string, a int, b string")
    filled = X.templated_by(F.col("n"), texts, a=F.col("a"), b=F.col("b"))
    assert [r[0] for r in df.select(filled).collect()] == ["Say 1\nand .", "{a}", None]
    with pytest.raises(Exception, match="no template is named three"):
        df.select(X.templated_by(F.lit("three"), texts, a=F.col("a"), b=F.col("b"))).collect()
