"""Costly steps are worked out once: counted in plans."""

from pyspark.sql import functions as F

from scorelake.functions import text as X
from scorelake.functions import verdicts as V
from scorelake.operators import trials as T
from scorelake.operators.compare import kind


def times(df, what):
    return df._jdf.queryExecution().analyzed().toString().count(what)


def of(spark, use):
    return spark.createDataFrame([("a", 4)], "r string, n int").select(use(F.col("r")).alias("o"))


def test_rewrites_leave_unchanged_texts_alone(spark):
    rows = spark.createDataFrame([("plain text ,as it is",), ("a (x, y, z) b",), ("such (p, q, r) as these",), (None,)], "r string")
    assert [r[0] for r in rows.select(X.without_enumerations(F.col("r"))).collect()] == [None, "a b", "", None]
    assert times(of(spark, lambda c: X.without_enumerations(c)), "such as") >= 2  # what is asked first


def test_degree_words_by_fixed_patterns(spark):
    rows = spark.createDataFrame([("A SEVERE, major thing",), ("severely",), (None,)], "r string")
    assert [r[0] for r in rows.select(F.array_join(X.degree_words(F.col("r")), ",")).collect()] == ["major,severe", "", ""]
    assert times(of(spark, X.degree_words), "concat(") == 0


def test_answers_are_parsed_once(spark):
    assert times(of(spark, V.ladder), "from_json") <= 3
    assert times(of(spark, lambda c: V.numbered_map(c, F.lit(2))), "regexp_extract(") == 1
    assert times(of(spark, V.batched), "regexp_extract(") == 2


def test_kinds_are_found_once(spark):
    assert times(of(spark, lambda c: kind(F.parse_json(c))), "schema_of_variant") == 1


def test_trials_are_drawn_from_a_written_table(spark):
    changed = spark.createDataFrame([(i, i // 2, "abc", "ab") for i in range(40)], "key long, task_id long, original string, final string")
    assert times(T.spot_trials(changed, 3, 3, 2, 2, 1), "LogicalRDD") == 0
