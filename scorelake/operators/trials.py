"""Trials for annotators: blind sheets, foils, controls and their running order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import table
from .relate import draw, interleaved, sample, stratified


def _places(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first n rows of a draw, with their place in it from 1: a sample is small, whatever it is drawn from."""
    return sample(rows, key, n, seed).withColumn("place", F.row_number().over(Window.orderBy(draw(F.col(key), seed), key)))


def blinded(rows: DataFrame, key: str, shown: list[str], seed: int, prefix: str = "T") -> tuple[DataFrame, DataFrame]:
    """A sample's rows shuffled under blind ids (T001 and so on): the sheet that is shown, and the key that is kept."""
    order = F.row_number().over(Window.orderBy(draw(F.col(key), seed), key))
    named = rows.withColumn("trial_id", F.format_string(f"{prefix}%03d", order))
    return named.select("trial_id", *shown), named.select("trial_id", *[c for c in rows.columns if c not in shown])


def foil_trials(positives: DataFrame, negatives: DataFrame, rest: DataFrame, n_positive: int, n_foils: int, most_hard: int, seed: int, key: str = "cid") -> DataFrame:
    """Kind, key, task_id and item of positives, hard foils and easy foils, each key used once.

    positives, negatives and rest: key, task_id, item. n_positive positives; of negatives (no, but matched
    by a lenient judge) most_hard at most; easy foils make up n_foils: the next of rest, with the item of
    the first drawn row of another task.
    """
    yes = sample(positives, key, n_positive, seed).select(F.lit("POS").alias("kind"), key, "task_id", "item")
    hard = sample(negatives.join(yes.select(key), key, "left_anti"), key, min(most_hard, n_foils), seed + 1).select(F.lit("FOIL_HARD").alias("kind"), key, "task_id", "item")
    used = yes.unionByName(hard)
    free = rest.join(used.select(key), key, "left_anti")
    first = sample(free, key, 1, seed + 2).select(F.col("task_id").alias("t1"), F.col("item").alias("i1"))
    other = free.join(F.broadcast(first.select("t1")), F.col("task_id") != F.col("t1")).drop("t1")
    second = sample(other, key, 1, seed + 2).select(F.col("item").alias("i2"))
    donors = first.join(F.broadcast(second))
    asked = _places(free, key, seed + 2, n_foils).join(F.broadcast(hard.agg(F.count(F.lit(1)).alias("hard")))).filter(F.col("place") <= n_foils - F.col("hard"))
    easy = asked.join(F.broadcast(donors)).select(F.lit("FOIL_EASY").alias("kind"), key, "task_id", F.when(F.col("task_id") != F.col("t1"), F.col("i1")).otherwise(F.col("i2")).alias("item"))
    return used.unionByName(easy)


def spot_trials(changed: DataFrame, n_real: int, n_control: int, n_hard: int, n_easy: int, seed: int) -> DataFrame:
    """Kind, task_id, original, final, flipped of trials that compare an original with a rewrite.

    changed: key (unique), task_id, original, final. REAL: a draw. REAL_CONTROL: rewrites shorter than their
    originals, of tasks that REAL lacks. FOIL_HARD: an original with the rewrite of another criterion of its
    task; FOIL_EASY: with one of another task; both of tasks that neither of the others has. flipped: on
    which side the rewrite is shown.
    """
    name = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "key", "task_id", "original", "final")
    changed = table(changed)  # each draw would work it out again
    real = table(name(sample(changed, "key", n_real, seed), "REAL"))
    shorter = changed.filter(F.length("final") < F.length("original")).join(real.select("task_id").distinct(), "task_id", "left_anti")
    control = table(name(sample(shorter, "key", n_control, seed + 1), "REAL_CONTROL"))
    free = changed.join(real.unionByName(control).select("task_id").distinct(), "task_id", "left_anti")
    best = F.sort_array(F.collect_list(F.struct(draw(F.col("key"), seed + 2).alias("d"), "key", "original", "final")))
    # two rows of each task are enough: ranked by a window whose first rows are kept before the shuffle
    two = table(stratified(free, ["task_id"], "key", 2, seed + 2).groupBy("task_id").agg(best.alias("x")))
    hard_tasks = table(sample(two.filter("size(x) = 2"), "task_id", n_hard, seed + 3))
    hard = hard_tasks.select(F.lit("FOIL_HARD").alias("kind"), F.col("x")[1]["key"].alias("key"), "task_id", F.col("x")[0]["original"].alias("original"), F.col("x")[1]["final"].alias("final"))
    pool = two.join(hard_tasks.select("task_id"), "task_id", "left_anti")
    a, b = _places(pool, "task_id", seed + 4, n_easy), _places(pool, "task_id", seed + 5, n_easy)
    pairs = a.select("place", "task_id", F.col("x")[0]["original"].alias("original")).join(b.select("place", F.col("task_id").alias("donor"), F.col("x")[0]["key"].alias("key"), F.col("x")[0]["final"].alias("final")), "place").filter("task_id <> donor")
    every = real.unionByName(control).unionByName(hard).unionByName(name(pairs, "FOIL_EASY"))
    return every.withColumn("flipped", F.conv(F.substring(draw(F.col("key"), seed + 6), 1, 1), 16, 10).cast("int") >= 8)


def foils_apart(kinds: list[str]) -> list[int]:
    """Places of trials in an order in which a foil right after a foil changes places with the first later trial that is none and follows none."""
    places = list(range(len(kinds)))
    foil = [k.startswith("FOIL") for k in kinds]
    for i in range(1, len(places)):
        if foil[i] and foil[i - 1]:
            later = next((j for j in range(i + 1, len(places)) if not (foil[j] or foil[j - 1])), None)
            if later is not None:
                places[i], places[later] = places[later], places[i]
                foil[i], foil[later] = foil[later], foil[i]
    return places


def running_order(trials: DataFrame, key: str, order: str, seed: int, jitter: float = 0.01) -> DataFrame:
    """Trials (a sample: its order is settled in one task) with their place from 0: kinds spread evenly, foils not side by side where that can be helped. order: a whole number that is unique."""
    spread = interleaved(table(trials), "kind", order, jitter, seed).select(key, "kind", "share")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["share", key])
        pdf = pdf.iloc[foils_apart(pdf["kind"].tolist())]
        return pd.DataFrame({key: pdf[key].to_numpy(), "kind": pdf["kind"].to_numpy(), "place": range(len(pdf))})

    kind = spread.schema[key].dataType.simpleString()
    return spread.groupBy(F.lit(0).alias("all")).applyInPandas(run, f"{key} {kind}, kind string, place long")


def ordered_clusters(rows: DataFrame, cluster: str, member: str) -> DataFrame:
    """Each cluster's human (H...) and model (M...) members, sorted, and what clusters are ordered by: the first human member, else Z."""
    side = lambda letter: F.array_sort(F.collect_set(F.when(F.col(member).startswith(letter), F.col(member))))
    out = rows.groupBy(cluster).agg(side("H").alias("human"), side("M").alias("model"))
    return out.withColumn("ordered_by", F.coalesce(F.get("human", F.lit(0)), F.lit("Z"))).orderBy("ordered_by", cluster)
