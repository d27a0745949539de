"""Joins, set operations, orders and samples by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import table
from .containment import least_related
from .containment import numbered as numbered_texts


def resume(todo: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(*on).distinct(), list(on), "left_anti")


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join, and what either side has alone."""
    return left.join(right, list(on), how), left.join(right, list(on), "left_anti"), right.join(left, list(on), "left_anti")


def judge_pairs(verdicts: DataFrame, key: str = "criterion_id", judge: str = "judge", value: str = "meets") -> DataFrame:
    """Share of equal verdicts of every two judges on criteria that both judged."""
    a = verdicts.select(key, F.col(judge).alias("judge_1"), F.col(value).alias("v1"))
    b = verdicts.select(key, F.col(judge).alias("judge_2"), F.col(value).alias("v2"))
    return a.join(b, key).filter("judge_1 < judge_2").groupBy("judge_1", "judge_2").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("v1") == F.col("v2")).cast("int"))).alias("agreement"))


def judged_by_all(verdicts: DataFrame, judges: Sequence[str], key: str = "criterion_id") -> DataFrame:
    """One row for each criterion that all judges judged, a column a judge."""
    wide = verdicts.groupBy(key).pivot("judge", list(judges)).agg(F.first("meets"))
    return wide.dropna(subset=list(judges))


def unanimity(verdicts: DataFrame, judges: Sequence[str], key: str = "criterion_id") -> DataFrame:
    """M7: shares of criteria judged by all that all fail, all pass, and on which all agree."""
    wide = judged_by_all(verdicts, judges, key)
    passed, failed = F.lit(True), F.lit(True)
    for j in judges:
        passed, failed = passed & F.col(j), failed & ~F.col(j)
    share = lambda c: 100 * F.avg(c.cast("int"))
    return wide.agg(F.count(F.lit(1)).alias("n"), share(failed).alias("all_fail"), share(passed).alias("all_pass"), share(passed | failed).alias("all_same"))


def coverage_agreement(verdicts: DataFrame, a: str, b: str, key: str = "criterion_id") -> DataFrame:
    """M8: Jaccard of what two judges cover, one-sided counts, and the share of equal items among both's yes with item numbers."""
    wide = verdicts.groupBy(key).agg(*[F.max(F.when(F.col("judge") == j, F.col(c))).alias(f"{n}_{c}") for n, j in (("a", a), ("b", b)) for c in ("meets", "item")])
    both = wide.filter("a_meets is not null and b_meets is not null")
    numbered = F.col("a_meets") & F.col("b_meets") & F.col("a_item").isNotNull() & F.col("b_item").isNotNull()
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a_meets and b_meets")).alias("both_yes"), F.count_if(F.expr("a_meets or b_meets")).alias("either"), F.count_if(F.expr("a_meets and not b_meets")).alias("a_only"), F.count_if(F.expr("b_meets and not a_meets")).alias("b_only"), F.count_if(numbered).alias("numbered"), F.count_if(numbered & (F.col("a_item") == F.col("b_item"))).alias("same"))
    return sums.select("n", "both_yes", F.coalesce(F.try_divide("both_yes", "either"), F.lit(0.0)).alias("jaccard"), "numbered", F.coalesce(F.try_divide("same", "numbered"), F.lit(0.0)).alias("same_item"), "a_only", "b_only")


def verdict_rates(verdicts: DataFrame, source: str, human: str, judges: Sequence[str]) -> DataFrame:
    """Pass rates by source and judge and their mean; the AI sources pooled, the human one, and their gap (of rates rounded to a tenth)."""
    rate = lambda rows, *by: rows.groupBy(*by, "judge").agg((100 * F.avg(F.col("meets").cast("int"))).alias("rate"), F.count(F.lit(1)).alias("n"))
    wide = lambda rows: rows.groupBy("source").agg(F.avg("rate").alias("mean"), *[F.max(F.when(F.col("judge") == j, F.col("rate"))).alias(j) for j in judges])
    each = wide(rate(verdicts.withColumnRenamed(source, "source"), "source"))
    side = F.when(F.col(source) == human, "Human").otherwise("Pooled AI")
    pooled = wide(rate(verdicts.withColumn("source", side), "source"))
    columns = ["mean", *judges]
    gap = pooled.agg(*[F.max(F.when(F.col("source") == "Pooled AI", F.bround(c, 1))).alias(f"a_{c}") for c in columns], *[F.max(F.when(F.col("source") == "Human", F.bround(c, 1))).alias(f"h_{c}") for c in columns])
    return each.unionByName(pooled).unionByName(gap.select(F.lit("Gap").alias("source"), *[(F.col(f"a_{c}") - F.col(f"h_{c}")).alias(c) for c in columns]))


def first_label_wins(pairs: DataFrame, labels: DataFrame, on: Sequence[str], order: str) -> DataFrame:
    """Pairs with the first of their labels, or null."""
    first = labels.groupBy(*on).agg(F.min_by("status", order).alias("status"))
    return pairs.join(first, list(on), "left")


def resolved_ids(concepts: DataFrame, criteria: DataFrame, norm) -> DataFrame:
    """The criterion a concept's title names: equal title (the last such criterion), else equal in normal form, else the first whose title holds the concept's or is held by it; else null. The last step is on distinct texts.

    Titles are equal if 128 bits of their and their task's SHA-256 are: whole texts are shuffled only for the last step.
    """
    task = F.col("task_id").cast("string")
    same = lambda text: F.unhex(F.substring(F.sha2(F.concat(F.length(task).cast("string"), F.lit(":"), task, text), 256), 1, 32))
    title, low = F.col("title"), F.lower("title")
    by_title = criteria.groupBy(same(title).alias("title_key")).agg(F.max_by("criterion_id", "place").alias("exact"))
    by_norm = criteria.groupBy(same(norm(title)).alias("norm_key")).agg(F.max_by("criterion_id", "place").alias("normal"))
    keyed = concepts.select("concept_id", same(title).alias("title_key"), same(norm(title)).alias("norm_key"), same(low).alias("low_key"))
    found = keyed.join(by_title, "title_key", "left").join(by_norm, "norm_key", "left")
    found = table(found.select("concept_id", F.coalesce("exact", "normal").alias("criterion_id"), F.when(F.coalesce("exact", "normal").isNull(), F.col("low_key")).alias("low_key")))
    rest = found.filter("low_key is not null")
    texts = concepts.select(same(low).alias("low_key"), "task_id", low.alias("text")).join(rest.select("low_key").distinct(), "low_key", "left_semi").dropDuplicates(["low_key"])
    texts = numbered_texts(texts)
    first = numbered_texts(criteria.groupBy("task_id", low.alias("text")).agg(F.min(F.struct("place", "criterion_id")).alias("first")))
    partial = texts.select("id", "low_key").join(least_related(texts, first), "id").select("low_key", F.col("first.criterion_id").alias("part"))
    known = rest.join(partial, "low_key", "left").select("concept_id", F.col("part").alias("criterion_id"))
    return found.filter("low_key is null").select("concept_id", "criterion_id").unionByName(known)


def paired_conditions(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """Tasks of both or of one side, mean difference with standard error and 95 % interval, and how many rose, fell or tied."""
    both = left.select(on, F.col(value).alias("a")).join(right.select(on, F.col(value).alias("b")), on, "full")
    d = F.col("b") - F.col("a")
    out = both.agg(F.count_if(F.expr("b is null")).alias("left_only"), F.count_if(F.expr("a is null")).alias("right_only"), F.count(d).alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0)).alias("se"), F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("tied"))
    return out.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


# ---- order and top-n --------------------------------------------------------------------------


def top_groups(df: DataFrame, group: str, pos: str, n: int) -> DataFrame:
    """The n largest groups, of equal ones the one that came first."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def first_argmax(value: Column, index: Column) -> Column:
    """Index of the greatest value, of equal ones the least."""
    return -F.max(F.struct(value, -index)).getField("col2")


def interleaved(df: DataFrame, kind: str, order: str, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows of each kind spread evenly over the whole: order by share, (rank + 1/2) / size of the kind, moved by up to `jitter` either way by a seeded draw. order: a whole number that is unique; ranks are prefix sums, so no task gathers a kind."""
    ranked = numbered(df, order, "_rank", by=[kind])
    sizes = df.groupBy(kind).agg(F.count(F.lit(1)).alias("_size"))
    moved = (F.conv(F.substring(draw(F.col(order), seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 31)) - 1) * jitter
    return ranked.join(sizes, ranked[kind].eqNullSafe(sizes[kind])).select(*[ranked[c] for c in df.columns], ((F.col("_rank") + 0.5) / F.col("_size") + (moved if jitter else 0.0)).alias("share"))


def ordered_by_list(column: str, values: Sequence[str]) -> Column:
    """Place of a value in a fixed order, those not in it last."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return F.when(place > 0, place).otherwise(len(values) + 1)


# ---- samples ----------------------------------------------------------------------------------


def draw(key: Column, seed: int) -> Column:
    """The order of a seeded draw: a hash that Spark and other engines agree on."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N rows without replacement, the same ones for a seed."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def tranches(df: DataFrame, key: str, sizes: Sequence[int], seed: int) -> DataFrame:
    """R2, U4: disjoint tranches of one draw, in its order."""
    drawn = sample(df, key, sum(sizes), seed).withColumn("n", F.row_number().over(Window.orderBy(draw(F.col(key), seed), key)))
    out, upto = F.lit(None).cast("int"), 0
    for i, size in reversed(list(enumerate(sizes, 1))):
        out = F.when(F.col("n") <= sum(sizes[:i]), F.lit(i)).otherwise(out)
    return drawn.withColumn("tranche", out).drop("n")


def stratified(df: DataFrame, strata: Sequence[str], key: str, target: Column | int, seed: int) -> DataFrame:
    """Up to target rows of each stratum. Ranked by a window whose first rows are kept before the shuffle, so a large stratum is not gathered."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(draw(F.col(key), seed), key))
    return df.withColumn("_n", rank).filter(F.col("_n") <= (F.lit(target) if isinstance(target, int) else target)).drop("_n")


def judge_stratum(yes: Column, no: Column, same_item: Column) -> Column:
    """Ordered rules on how many judges say yes and no, and whether the yeses name one item."""
    return F.when((yes > 0) & (no > 0), "SPLIT").when(yes == 0, "FRONTIER_NO").when(~same_item, "SAMEITEM_SPLIT").otherwise("UNANIMOUS_YES")


def foils(items: DataFrame, seed: int, each: int) -> DataFrame:
    """Positives, hard foils (an item of the same task) and easy foils (one of another task), every item used once at most.

    Each task's items are drawn in order: its first is a positive, its second a hard foil for it; easy
    foils pair third items of different tasks by rank. `each` bounds every kind.
    """
    ranked = items.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy(draw(F.col("item_id"), seed), "item_id")))
    anchor = ranked.filter("n = 1").select("task_id", F.col("item_id").alias("anchor"))
    kinds = [("POS", ranked.filter("n = 1").select("task_id", F.col("item_id").alias("anchor"), "item_id")), ("FOIL_HARD", anchor.join(ranked.filter("n = 2").select("task_id", "item_id"), "task_id"))]
    third = ranked.filter("n = 3").withColumn("d", draw(F.col("item_id"), seed + 1)).orderBy("d", "item_id").limit(2 * each).withColumn("k", F.row_number().over(Window.orderBy("d", "item_id")))
    asks, donors = third.filter("k % 2 = 1"), third.filter("k % 2 = 0")
    kinds.append(("FOIL_EASY", asks.select("task_id", F.col("item_id").alias("anchor"), "k").join(donors.select((F.col("k") - 1).alias("k"), "item_id"), "k").drop("k")))
    out = None
    for name, rows in kinds:
        part = sample(rows, "item_id", each, seed).withColumn("kind", F.lit(name)).select("kind", "task_id", "anchor", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


# ---- sets -------------------------------------------------------------------------------------


def registry(df: DataFrame, text: Column, pos: str) -> DataFrame:
    """Distinct texts numbered from 0 by first appearance: ranks are prefix sums of ranges, so no task sorts all texts."""
    first = df.groupBy(text.alias("text")).agg(F.min(pos).alias("first"))
    return numbered(first, "first", "text_idx", chunk=1 << 16)


def numbered(df: DataFrame, order: str, name: str, chunk: int = 1 << 26, by: Sequence[str] = ()) -> DataFrame:
    """Rows (of each group `by`) numbered from 0 in order of a whole number that is unique: chunks of its range are counted, then numbered inside."""
    chunked = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk}"))
    counts = chunked.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(order))
    on = F.col("_chunk") == F.col("_c")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    return chunked.withColumn("_i", inside).join(before, on).select(*df.columns, (F.col("_before") + F.col("_i") - 1).cast("long").alias(name))


def convergence(a: Column, b: Column) -> Column:
    """What two classifiers agree on, and what either has alone, sorted."""
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("agree"), F.array_sort(F.array_except(a, b)).alias("extra"), F.array_sort(F.array_except(b, a)).alias("missed"))


def repeated_keys(df: DataFrame, *keys: Column) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
