"""Annotators and judges: confusion, sensitivity, tallies, majorities, and rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _percent(part: str, whole: str) -> Column:
    return F.try_divide(100.0 * F.col(part), F.col(whole))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of said against truth (booleans; a null said is unparsed and in no cell), accuracy and capture in percent."""
    out = rows.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in (("tp", "said and truth"), ("tn", "not said and not truth"), ("fp", "said and not truth"), ("fn", "not said and truth"), ("unparsed", "said is null"))], F.count("said").alias("n"))
    return out.select("tp", "tn", "fp", "fn", "unparsed", F.try_divide(100.0 * (F.col("tp") + F.col("tn")), F.col("n")).alias("accuracy"), F.try_divide(100.0 * (F.col("tp") + F.col("fp")), F.col("n")).alias("capture"))


def foil_scores(trials: DataFrame) -> DataFrame:
    """Matches on positives (sensitivity) and rejections of foils (specificity), overall and by kind; unanswered trials count for neither."""
    answered = trials.filter("match is not null")
    right = F.when(F.col("kind") == "POS", F.col("match")).otherwise(~F.col("match"))
    rows = answered.select(F.when(F.col("kind") == "POS", "sensitivity").otherwise("specificity").alias("measure"), "kind", right.alias("right"))
    marks = F.grouping("kind").alias("_g")
    out = rows.groupingSets([[F.col("measure")], [F.col("measure"), F.col("kind")]], "measure", "kind").agg(marks, F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right"))
    return out.select("measure", F.when(F.col("_g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n", _percent("right", "n").alias("rate"))


def spot_tallies(rows: DataFrame) -> DataFrame:
    """By stratum, answers that the two texts mean the same, those of them that find the rewrite more general, and cases opened."""
    out = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"), F.count_if(F.expr("same and more_general")).alias("general"), F.count_if("opened").alias("opened"))
    return out.select("stratum", "n", _percent("same", "n").alias("same_rate"), _percent("general", "same").alias("general_rate"), "opened")


def majorities(votes: DataFrame, item: str = "item", vote: str = "vote") -> DataFrame:
    """Items of two votes or more, and how many have a majority of yes and one answer only."""
    per = votes.groupBy(item).agg(F.count(vote).alias("n"), F.count_if(vote).alias("yes")).filter("n >= 2")
    out = per.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("yes") * 2 > F.col("n")).alias("majority"), F.count_if((F.col("yes") == 0) | (F.col("yes") == F.col("n"))).alias("unanimous"))
    return out.select("items", _percent("majority", "items").alias("majority_rate"), _percent("unanimous", "items").alias("unanimous_rate"))


def threshold_verdict(first: Column, second: Column) -> Column:
    """M9: what two rates together say."""
    return (
        F.when(first.isNull() | second.isNull(), "insufficient").when((first >= 0.6) & (second >= 0.6), "confirmed").when((first >= 0.6) & (second <= 0.4), "meaning kept only")
        .when((first > 0.4) & (first < 0.6), "middle").otherwise("mixed")
    )


def weak_floor(gaps: DataFrame, floor: float, margin: float) -> DataFrame:
    """Gap kept by a weak model in percent of a strong one's, whether all weak ones are below the floor, and whether the gap also reaches the margin."""
    out = gaps.agg(F.max("weak").alias("highest_weak"), F.min("strong").alias("lowest_strong"), F.avg(F.try_divide(100.0 * F.col("weak"), F.col("strong"))).alias("retention"))
    below = F.col("highest_weak") < floor
    return out.select("retention", below.alias("below_floor"), (below & (F.col("lowest_strong") - F.col("highest_weak") >= margin)).alias("below_with_margin"))
