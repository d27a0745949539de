"""Weighted scores and fulfilment rates of judged criteria.

Input rows are judgements: task_id, criterion_id, pos (order in the file), criterion_weight, judgement and
whatever columns a grouping names. Everything is one scan and one or two hash aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.verdicts import contained_verdict, credit, leading_verdict, starts_y


def _weight() -> Column:
    return F.col("criterion_weight")


def _judgement() -> Column:
    return F.col("judgement")


def _ratio() -> tuple[Column, Column]:
    return F.sum(credit(_judgement(), _weight())).alias("achieved"), F.sum(F.abs(_weight())).alias("possible")


def task_scores(rows: DataFrame, empty: str = "zero", by: Sequence[str] = ()) -> DataFrame:
    """A1, A2: score of each task, 100 * credit / sum of weights' sizes, held to 0..100.

    empty: what a task without weight scores: "zero", "drop" it, or "null".
    """
    keys = [*by, "task_id"]
    totals = rows.groupBy(*keys).agg(*_ratio(), F.count(F.lit(1)).alias("criteria"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(100.0 * F.col("achieved"), F.col("possible"))))
    score = F.when(F.col("possible") > 0, score)
    if empty == "zero":
        score = F.coalesce(score, F.lit(0.0))
    out = totals.select(*keys, score.alias("score"), "criteria")
    return out.filter("score is not null") if empty == "drop" else out


def run_score(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A3: mean task score of a run, a task without weight counting 0."""
    return task_scores(rows, "zero", by).groupBy(*by).agg(F.avg("score").alias("score"))


def subset_score(rows: DataFrame, keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean task score over the criteria in keys (task_id, criterion_id) only; tasks left without weight go."""
    kept = rows.join(keys.select("task_id", "criterion_id").distinct(), ["task_id", "criterion_id"], "left_semi")
    return task_scores(kept, "drop", by).groupBy(*by).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("tasks"))


def pooled_score(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A5: credit over weight of all criteria of a group, without a task level; null for a group without weight."""
    return rows.groupBy(*by).agg(*_ratio(), F.count(F.lit(1)).alias("n")).select(*by, "n", F.try_divide(100.0 * F.col("achieved"), F.col("possible")).alias("score"))


def score_spread(rows: DataFrame) -> DataFrame:
    """Mean and sample deviation of task scores, counts, and how many (task, criterion) keys are repeated."""
    scores = task_scores(rows, "zero").agg(F.count(F.lit(1)).alias("tasks"), F.sum("criteria").alias("criteria"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("stdev"))
    twice = rows.groupBy("task_id", "criterion_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))
    return scores.join(F.broadcast(twice))  # one row beside one row


def first_value(column: str) -> Column:
    """The column's value in a group's first row."""
    return F.min_by(F.col(column), F.col("pos"))


def _long(grouped: DataFrame, categories: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """(category, value) of a grouping-sets result with one column a category."""
    level = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in categories], F.lit("overall"))
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")) for c in categories], F.lit("overall"))
    return grouped.select(level.alias("category"), value.alias("value"), *values)


def _sets(df: DataFrame, categories: Sequence[str], overall: bool, aggs: Sequence[Column]) -> DataFrame:
    sets = [[F.col(c)] for c in categories] + ([[]] if overall else [])
    marks = [F.grouping(c).alias(f"_g_{c}") for c in categories]
    return df.groupingSets(sets, *categories).agg(*marks, *aggs)


def category_means(rows: DataFrame, categories: Sequence[str] = ("dilemma_source", "role_domain")) -> DataFrame:
    """Mean task score overall and by category, in one pass. A task has its first row's category, of which the first two parts between underscores count."""
    named = rows.groupBy("task_id").agg(*_ratio(), *[F.substring_index(first_value(c), "_", 2).alias(c) for c in categories])
    scored = named.withColumn("score", F.coalesce(F.try_divide(100.0 * F.col("achieved"), F.col("possible")), F.lit(0.0)))
    return _long(_sets(scored, categories, True, [F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("tasks")]), categories, ["tasks", "mean_score"])


def fulfilment(rows: DataFrame, categories: Sequence[str] = ("criterion_dimension", "criterion_weight")) -> DataFrame:
    """Share of criteria fulfilled, in percent, by category."""
    done = rows.withColumn("done", (credit(_judgement(), _weight()) > 0).cast("int"))
    return _long(_sets(done, categories, False, [(100 * F.avg("done")).alias("rate"), F.count(F.lit(1)).alias("n")]), categories, ["n", "rate"])


def field_averages(rows: DataFrame, fields: Sequence[str] = ("output_tokens",), text: str = "response") -> DataFrame:
    """Mean of fields, and of the text's length as len (0 for null), over tasks' first rows, rounded half to even."""
    first = rows.groupBy("task_id").agg(*[first_value(f).alias(f) for f in fields], F.min_by(F.coalesce(F.length(text), F.lit(0)), F.col("pos")).alias("len"))
    means = first.agg(*[F.bround(F.avg(f)).alias(f) for f in (*fields, "len")])
    return means.unpivot([], [*fields, "len"], "field", "value")


def histogram(scores: DataFrame, width: int = 10) -> DataFrame:
    """A10: share of tasks, in percent, in each bucket from 0 to under 100. A score of 100 is in no bucket but counts in the whole."""
    spark = scores.sparkSession
    counts = scores.groupBy((F.floor(F.col("score") / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = scores.agg(F.count(F.lit(1)).alias("total"))
    every = spark.range(0, 100, width).withColumnRenamed("id", "bucket")
    return every.join(counts, "bucket", "left").join(F.broadcast(total)).select("bucket", F.coalesce(100.0 * F.try_divide(F.col("n"), F.col("total")), F.lit(0.0)).alias("percent"))


def normalized_score(rows: DataFrame) -> DataFrame:
    """Mean task score for a thousand characters of mean response."""
    overall = category_means(rows, ["dilemma_source"]).filter("category = 'overall'").select("mean_score")
    length = field_averages(rows, []).select(F.col("value").alias("len"))
    return overall.join(F.broadcast(length)).select(F.try_divide(F.bround("mean_score", 1) * 1000, F.col("len")).alias("score"))


def all_metrics(rows: DataFrame) -> DataFrame:
    """Every metric as (category, value, metric); unlike one flat mapping, equal values of two categories can't overwrite each other."""
    parts = [
        category_means(rows).select("category", "value", F.col("mean_score").alias("metric")),
        fulfilment(rows).select("category", "value", F.col("rate").alias("metric")),
        field_averages(rows).select(F.lit("field").alias("category"), F.col("field").alias("value"), F.col("value").cast("double").alias("metric")),
        histogram(task_scores(rows)).select(F.lit("histogram").alias("category"), F.col("bucket").cast("string").alias("value"), F.col("percent").alias("metric")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capture(rows: DataFrame) -> DataFrame:
    """A yes earns the weight's size, whatever its sign: overall, by task, dimension and weight. Rows of no weight name their group but count for nothing; a group without weight has a null share."""
    weight = F.coalesce(_weight().try_cast("int"), F.lit(0))
    ready = rows.select("task_id", F.lower(F.coalesce("criterion_dimension", F.lit("unknown"))).alias("dimension"), weight.alias("weight"), F.abs(weight).alias("size"), ((leading_verdict(_judgement()) == "yes") & (weight != 0)).alias("yes"))
    categories = ["task_id", "dimension", "weight"]
    sums = [F.sum(F.when(F.col("yes"), F.col("size")).otherwise(0)).alias("yes_weight"), F.sum("size").alias("total_weight"), F.count_if("yes").alias("n_yes"), F.count_if(F.col("size") > 0).alias("n")]
    return _long(_sets(ready, categories, True, sums), categories, ["yes_weight", "total_weight", "n_yes", "n", F.try_divide(100.0 * F.col("yes_weight"), F.col("total_weight")).alias("capture")])


def positive_pass_rate(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of yes among criteria of positive weight, in percent."""
    return rows.filter(_weight() > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((leading_verdict(_judgement()) == "yes").cast("int"))).alias("pass_rate"))


def pass_by_author(rows: DataFrame) -> DataFrame:
    """Pass rates of each model on changed and unchanged criteria, and how far each model's difference is from all models' mean difference."""
    rates = rows.groupBy("model").agg(*[(100 * F.avg(F.when(F.col("changed") == c, (credit(_judgement(), _weight()) > 0).cast("int")))).alias(n) for c, n in ((True, "changed_rate"), (False, "unchanged_rate"))])
    mean = rates.agg(F.avg(F.col("changed_rate") - F.col("unchanged_rate")).alias("mean_diff"))
    diff = F.col("changed_rate") - F.col("unchanged_rate")
    return rates.join(F.broadcast(mean)).select("model", "changed_rate", "unchanged_rate", (diff - F.col("mean_diff")).alias("diff_in_diff"))


def abilities(rows: DataFrame, of: dict[str, str], by: str = "model") -> DataFrame:
    """Scores of the abilities that dimensions roll up to, of groups that have them all, with a row of means (group null)."""
    table = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    names = sorted(set(of.values()))
    scored = pooled_score(rows.withColumn("ability", table[F.col("criterion_dimension")]).filter("ability is not null"), [by, "ability"])
    full = scored.groupBy(by).pivot("ability", names).agg(F.first("score")).dropna(subset=names)
    return full.rollup(by).agg(*[F.avg(n).alias(n) for n in names])


def changed_by_sign(rows: DataFrame) -> DataFrame:
    """Criteria by whether they changed and by their weight's sign."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"), F.count_if(F.col("changed") & (_weight() > 0)).alias("changed_positive"), F.count_if(F.col("changed") & (_weight() < 0)).alias("changed_negative"))


def score_ranges(rows: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Least, greatest and mean score of named groups of models, on changed and unchanged criteria."""
    scores = task_scores(rows, "drop", ["model", "changed"]).groupBy("model", "changed").agg(F.avg("score").alias("score"))
    parts = [scores.filter(F.col("model").isin(*m)).withColumn("models", F.lit(n)) for n, m in groups.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("models", "changed").agg(F.min("score").alias("least"), F.max("score").alias("greatest"), F.avg("score").alias("mean"))


def universal_failures(rows: DataFrame, key: Sequence[str] = ("criterion_id",)) -> DataFrame:
    """Positive criteria (by key) failed by every model that answered, and answered by all models but one at least."""
    models = rows.agg(F.count_distinct("model").alias("models"))
    failed = rows.filter(_weight() > 0).groupBy(*key).agg(F.count_distinct("model").alias("seen"), F.count_distinct(F.when(contained_verdict(_judgement()) == "yes", F.col("model"))).alias("passed"))
    return failed.join(F.broadcast(models)).filter((F.col("passed") == 0) & (F.col("seen") >= F.col("models") - 1)).select(*key, "seen")


def tasks_with_criteria(rows: DataFrame, missed: int = 5) -> DataFrame:
    """Score of each task, its first response, and its first `missed` criteria without credit, in order."""
    lost = F.array_sort(F.collect_list(F.when(credit(_judgement(), _weight()) <= 0, F.struct("pos", "criterion_id"))))
    gathered = rows.groupBy("task_id").agg(*_ratio(), F.min_by(F.coalesce(F.length("response"), F.lit(0)), F.col("pos")).alias("response_length"), F.slice(F.transform(lost, lambda x: x["criterion_id"]), 1, missed).alias("missed"))
    return gathered.select("task_id", F.coalesce(F.try_divide(100.0 * F.col("achieved"), F.col("possible")), F.lit(0.0)).alias("score"), "response_length", F.array_join("missed", ",").alias("missed"))


# ---- paired verdicts --------------------------------------------------------------------------


def cosine_bin(cos: Column, edges: Sequence[float] = (0.60, 0.70, 0.80, 0.85)) -> Column:
    """Half-open bins, named by their lower edge."""
    out = F.when(cos < edges[0], f"<{edges[0]:.2f}")
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(cos < high, f"{low:.2f}-{high:.2f}")
    return out.otherwise(f">={edges[-1]:.2f}")


def residual_band(cos: Column) -> Column:
    """Three bands of near misses; the upper has no upper bound."""
    return F.when(cos >= 0.65, "0.65-0.70").when(cos >= 0.60, "0.60-0.65").otherwise("<0.60")


def paired_rates(pairs: DataFrame) -> DataFrame:
    """Verdicts on matched pairs overall, by cosine bin and by model: shares of yes, their gap in points, and how often just one side passes."""
    ready = pairs.select(cosine_bin(F.col("cos")).alias("bin"), F.col("md").alias("model"), (F.col("hj") == "YES").alias("h"), (F.col("mj") == "YES").alias("m"))
    sums = [F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col("h").cast("int"))).alias("human_yes"), (100 * F.avg(F.col("m").cast("int"))).alias("model_yes"), F.count_if(~F.col("h") & F.col("m")).alias("model_only"), F.count_if(F.col("h") & ~F.col("m")).alias("human_only")]
    out = _long(_sets(ready, ["bin", "model"], True, sums), ["bin", "model"], ["n", "human_yes", "model_yes", "model_only", "human_only"])
    return out.withColumn("gap", F.col("model_yes") - F.col("human_yes"))


def label_shares(rows: DataFrame, group: str, side: str, label: str) -> DataFrame:
    """Each label's share within its side over all groups together (pooled), and the mean of its shares in the groups where it occurs (mean), in percent."""
    counts = rows.groupBy(side, group, label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(side, group).agg(F.sum("n").alias("whole"))
    means = counts.join(whole, [side, group]).groupBy(side, label).agg(F.avg(100.0 * F.col("n") / F.col("whole")).alias("mean"), F.sum("n").alias("n"))
    sides = rows.groupBy(side).agg(F.count(F.lit(1)).alias("total"))
    return means.join(sides, side).select(side, label, (100.0 * F.col("n") / F.col("total")).alias("pooled"), "mean")


def share_difference(rows: DataFrame, group: str, label: str, tagged: str) -> DataFrame:
    """model's less human's share of each label, in points, by group; the side is the tag at the end of a name."""
    side = F.regexp_extract(tagged, r"\[(human|model)-only\]$", 1)
    ready = rows.select(F.regexp_replace(tagged, r"\s*\[(human|model)-only\]$", "").alias(group), side.alias("side"), F.col(label)).filter("side <> ''")
    share = lambda s: F.try_divide(100.0 * F.col(f"n_{s}"), F.sum(f"n_{s}").over(Window.partitionBy(group)))
    counts = ready.groupBy(group, label).agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("human", "model")])
    return counts.select(group, label, (share("model") - share("human")).alias("difference"))


def first_letter_verdict(pairs: DataFrame) -> DataFrame:
    """V7: pairs on which reading exactly YES and reading a leading Y disagree."""
    return pairs.agg(*[F.count_if(starts_y(F.col(c)) != (F.col(c) == "YES")).alias(f"{c}_differs") for c in ("hj", "mj")])
