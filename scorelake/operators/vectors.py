"""Cosines, similarity joins, greedy de-duplication and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import once
from ..sources.durable import exists, table
from .similarity import case_pairs, greatest_cosine, similar_pairs

__all__ = ["case_components", "case_pairs", "components", "dedupe_appended", "dedupe_by_case", "dot", "embedded", "global_dedupe", "greatest_cosine", "leaders", "merged", "merged_global", "side_label", "similar_pairs", "unit"]


def dot(a: Column, b: Column) -> Column:
    """Inner product, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return once(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def side_label(cos: Column, side: str, threshold: float) -> Column:
    """Shared, or this side only."""
    return F.when(cos >= threshold, "shared").otherwise(f"{side}_only")


def _greedy(threshold: float, tags: str):
    """Sequential leaders of one case: a row joins its most similar earlier leader at the threshold, else leads."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        leaders: list[int] = []
        matrix = np.zeros((len(pdf), len(pdf["vec"].iloc[0])))
        out = []
        for p, v, tag in zip(pdf["pos"], pdf["vec"], pdf[tags], strict=True):
            v = np.asarray(v, dtype=np.float64)
            if leaders:
                cos = matrix[: len(leaders)] @ v
                best = int(cos.argmax())
                if cos[best] >= threshold:
                    out.append((p, leaders[best], float(cos[best]), tag))
                    continue
            matrix[len(leaders)] = v
            leaders.append(p)
            out.append((p, p, 0.0, tag))
        return pd.DataFrame(out, columns=["pos", "leader", "cos", "tag"]).assign(case=pdf["case"].iloc[0])

    return run


def _large(rows: DataFrame, most: int) -> DataFrame:
    """Cases of over `most` rows."""
    return table(rows.groupBy("case").count().filter(F.col("count") > most).select(F.col("case").alias("_large")))


def _of_cases(rows: DataFrame, cases: DataFrame, how: str) -> DataFrame:
    """Rows of these cases (left_semi), or of all others (left_anti)."""
    return rows.join(cases, rows["case"].eqNullSafe(cases["_large"]), how)


def dedupe_by_case(rows: DataFrame, threshold: float, tag: str, most: int = 4096, block: int = 1024) -> DataFrame:
    """Greedy de-duplication within each case, in order of rank: pos, leader, cos (0 for leaders) and tag of every row.

    rows: case, rank (unique in a case), pos, vec and the tag that groups collect (a side or a model). A case is one rubric, so
    nearly all are groups that a task goes through in order. A case of over `most` rows is not gathered: its pairs are found
    in blocks, and its leaders by rounds over them, as `leaders` does; both ways give the same.
    """
    case, kind = rows.schema["case"].dataType.simpleString(), rows.schema[tag].dataType.simpleString()
    rows = table(rows.select("case", "rank", F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec"), F.col(tag).alias(tag)))
    large = _large(rows, most)
    found = _of_cases(rows, large, "left_anti").groupBy("case").applyInPandas(_greedy(threshold, tag), f"pos long, leader long, cos double, tag {kind}, case {case}")
    if large.isEmpty():
        return found
    # numbers in order of case and rank, given where range partitions have sorted them
    named = table(_of_cases(rows, large, "left_semi").orderBy("case", "rank").withColumn("at", F.monotonically_increasing_id()))
    nodes = named.select("case", F.col("at").alias("pos"), "vec")
    joins = _settled(nodes, table(case_pairs(nodes, threshold, block=block).select("a", "b", "cos")), F.lit(False))
    names = named.select(F.col("at").alias("_at"), F.col("pos").alias("_pos"))
    more = joins.join(named.select("at", "case", F.col("pos").alias("_own"), F.col(tag).alias("tag")), joins["pos"] == F.col("at")).join(names, F.col("leader") == F.col("_at"))
    return found.unionByName(more.select(F.col("_own").alias("pos"), F.col("_pos").alias("leader"), "cos", "tag", "case"))


def merged(found: DataFrame) -> DataFrame:
    """One row a leader: the tags of its group, sorted, how many joined it and their greatest cosine."""
    return found.groupBy("case", "leader").agg(F.array_sort(F.collect_set("tag")).alias("tags"), (F.count(F.lit(1)) - 1).alias("n_merged"), F.max("cos").alias("max_cos_merged"))


def _first_come(rows: pd.DataFrame) -> pd.DataFrame:
    """Leaders among open nodes by their edges (a < b; a = b for a node by itself), in order."""
    covered: set[int] = set()
    by: dict[int, list[int]] = {}
    for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
        by.setdefault(a, []).append(b)
    for a in sorted(by):
        if a not in covered:
            covered.update(b for b in by[a] if b != a)
    return pd.DataFrame({"pos": [p for p in by if p not in covered]}, dtype="int64")


def leaders(nodes: DataFrame, edges: DataFrame, few: int = 100_000) -> DataFrame:
    """Of nodes (pos) and edges (a < b): the nodes that greedy de-duplication in order of pos would keep.

    A node leads just when no earlier leader is its neighbour: the first maximal independent set. Each
    round settles every node whose earlier neighbours are settled enough; each round's state is a written
    table. Rounds would follow the longest chain of neighbours, so once the nodes still open and the edges
    between them are `few` (16 bytes each), one task settles them in order.
    """
    edges = table(edges.select("a", "b"))
    state = table(nodes.select("pos", F.lit(1).alias("state")))  # 2 leads, 1 open, 0 covered
    while True:
        undecided = state.filter("state = 1").select("pos")
        between = edges.join(undecided.select(F.col("pos").alias("a")), "a", "left_semi").join(undecided.select(F.col("pos").alias("b")), "b", "left_semi").select("a", "b")
        left = table(between.unionByName(undecided.select(F.col("pos").alias("a"), F.col("pos").alias("b"))))
        lead = state.filter("state = 2").select("pos")
        if left.count() <= few:
            return lead.unionByName(left.groupBy(F.lit(0).alias("all")).applyInPandas(_first_come, "pos long"))
        earlier = left.filter("a <> b").groupBy(F.col("b").alias("pos")).agg(F.min("a").alias("before"))
        new = table(undecided.join(earlier, "pos", "left_anti"))
        covered = edges.join(new.select(F.col("pos").alias("a")), "a", "left_semi").select(F.col("b").alias("pos")).distinct().withColumn("gone", F.lit(0))
        state = table(state.join(new.withColumn("leads", F.lit(2)), "pos", "left").join(covered, "pos", "left").select("pos", F.coalesce("leads", F.when(F.col("state") == 1, F.col("gone")), "state").alias("state")))


def _settled(rows: DataFrame, edges: DataFrame, older: Column) -> DataFrame:
    """Leaders among rows (pos) with edges (a < b, cos), and the leader that every other joins: of those that `older` marks (a before b) the most similar, else of the others; of equal ones the first."""
    lead = table(leaders(rows, edges))
    options = edges.join(lead.withColumnRenamed("pos", "a"), "a").join(lead.withColumnRenamed("pos", "b"), "b", "left_anti")
    best = options.groupBy("b").agg(F.max(F.struct(older.alias("older"), "cos", (-F.col("a")).alias("a"))).alias("m"))
    joined = best.select(F.col("b").alias("pos"), (-F.col("m.a")).alias("leader"), F.col("m.cos").alias("cos"))
    return joined.unionByName(lead.select("pos", F.col("pos").alias("leader"), F.lit(0.0).alias("cos")))


def _joined(rows: DataFrame, threshold: float, older: Column, block: int, first: int = 4096) -> DataFrame:
    """What `_settled` gives of all pairs of rows (pos, vec) at the threshold, of which only those with a leader are made.

    Rows come in slices in order of pos, the first of about `first` rows, each later one three times as many as all before it. A row that
    is near a leader of the slices before it is settled; only the rest of a slice meet each other. Then all rows meet the leaders. So what is
    written grows with rows and what is near leaders, not with all pairs of rows that are near each other.
    """
    rows = table(rows.select(F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec")))
    n, shares = rows.count(), []
    while first * 4 ** len(shares) < n:
        shares.append(first * 4 ** len(shares) / n)
    ends = rows.agg(F.percentile_approx("pos", shares, 100_000)).head()[0] if shares else []
    lead, last = None, None
    for end in [*sorted(set(ends)), None]:
        here = F.lit(True) if last is None else F.col("pos") > last
        part = rows.filter(here if end is None else here & (F.col("pos") <= end))
        if lead is not None:
            near = greatest_cosine(part, lead, block).filter(F.col("other").isNotNull() & (F.col("cos") >= threshold))
            part = table(part.join(near.select("pos"), "pos", "left_anti"))
        new = part.join(leaders(part, table(similar_pairs(part, part, threshold, block=block, ordered=True))), "pos", "left_semi").select("pos", "vec")
        lead, last = table(new if lead is None else lead.unionByName(new)), end
    rest = rows.join(lead.select("pos"), "pos", "left_anti")
    # products of other shapes may round to the other side of the threshold
    best = similar_pairs(lead, rest, threshold - 1e-9, block=block).filter("a < b").groupBy("b").agg(F.max(F.struct((F.col("cos") >= threshold).alias("near"), older.alias("older"), "cos", (-F.col("a")).alias("a"))).alias("m"))
    joined = best.select(F.col("b").alias("pos"), (-F.col("m.a")).alias("leader"), F.col("m.cos").alias("cos"))
    return table(joined.unionByName(lead.select("pos", F.col("pos").alias("leader"), F.lit(0.0).alias("cos"))))


def global_dedupe(rows: DataFrame, threshold: float, batch: int = 512, block: int = 1024) -> DataFrame:
    """Leader of every row (pos, vec, and what `merged_global` sums) under batched greedy de-duplication.

    Leaders don't depend on the batch. Which leader a row joins does: the most similar one of earlier
    batches if that is at the threshold, else the most similar earlier one of its own batch.
    """
    return _joined(rows, threshold, F.expr(f"a div {batch} < b div {batch}"), block)


def dedupe_appended(folder: str, number: int, rows: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """C6, batch by batch: leader and cos of every row (pos, vec) of batch `number`, given the leaders of the batches before it, which `folder` keeps.

    A row joins the most similar earlier leader at the threshold; only rows without one meet each other, and
    those that lead are added to the folder. So a batch costs a search in the leaders and its own rest, and all
    batches, in order of pos, give what `global_dedupe` gives for them at once. A batch done again
    replaces its own part and gives the same. An empty batch is one without leaders.
    """
    spark, kind = rows.sparkSession, "pos long, vec array<double>"
    rows = table(rows.select(F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec")))
    earlier = spark.createDataFrame([], f"{kind}, batch int")
    if exists(spark, folder):
        earlier = spark.read.schema(f"{kind}, batch int").parquet(folder)
    near = table(greatest_cosine(rows, earlier.filter(F.col("batch") < number), block))
    joined = near.filter(F.col("other").isNotNull() & (F.col("cos") >= threshold)).select("pos", F.col("other").alias("leader"), "cos")
    rest = table(rows.join(joined, "pos", "left_anti"))
    found = table(joined.unionByName(_joined(rest, threshold, F.lit(False), block)))
    lead = rest.join(found.filter("pos = leader").select("pos"), "pos", "left_semi")
    lead.select("pos", "vec").write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return found


def merged_global(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a leader: models of its group, sorted, how many joined, and the weight of greatest size (of equal ones the first)."""
    both = found.join(rows.select("pos", "model", "weight"), "pos")
    # the leader's own weight comes first, then those that joined, in order
    weight = F.max(F.struct(F.abs("weight").alias("size"), (F.col("pos") == F.col("leader")).alias("own"), (-F.col("pos")).alias("p"), "weight"))
    out = both.groupBy("leader").agg(F.array_sort(F.collect_set("model")).alias("models"), (F.count(F.lit(1)) - 1).alias("n_merged"), weight.alias("w"))
    return out.select("leader", "models", "n_merged", F.col("w.weight").alias("weight"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least node reachable from each: nodes (pos), edges (a, b) in either direction: pos, component.

    Each round gives every node the least label around it and then the label of that label, so labels travel in jumps that
    double; rounds are written tables, about as many as the logarithm of the longest path. Labels of a common node are
    joined, not gathered.
    """
    both = table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = table(nodes.select("pos", F.col("pos").alias("component")))
    while True:
        around = both.join(labels.select(F.col("pos").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        hooked = table(labels.join(around.withColumnRenamed("a", "pos"), "pos", "left").select("pos", "component", F.least("component", "near").alias("new")))
        # a label's own node takes the least that any of its members has found
        told = hooked.groupBy(F.col("component").alias("pos")).agg(F.min("new").alias("told"))
        better = table(hooked.join(told, "pos", "left").select("pos", "component", F.least("new", "told").alias("new")))
        jump = better.select(F.col("pos").alias("new"), F.col("new").alias("far"))
        after = table(better.join(jump, "new").select("pos", "component", F.least("new", "far").alias("new")))
        labels = after.select("pos", F.col("new").alias("component"))
        if after.filter("component <> new").isEmpty():
            return labels


def case_components(nodes: DataFrame, edges: DataFrame, most: int = 100_000) -> DataFrame:
    """Component of every node of each case: nodes (case, pos), edges (case, a, b); its least node names it.

    Cases of up to `most` nodes and edges are groups of their own; a larger one goes through `components`, in rounds.
    """

    def run(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        parent = {int(p): int(p) for p in nodes["pos"]}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(edges["a"], edges["b"], strict=True):
            a, b = find(int(a)), find(int(b))
            if a != b:
                parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"case": [key[0]] * len(parent), "pos": list(parent), "component": [find(p) for p in parent]})

    # fresh columns: both sides often come from one table
    nodes, edges = table(nodes.toDF("case", "pos")), table(edges.select("case", "a", "b"))
    large = _large(nodes.select("case").unionByName(edges.select("case")), most)
    small = _of_cases(edges, large, "left_anti").toDF("of", "a", "b")
    found = _of_cases(nodes, large, "left_anti").groupBy("case").cogroup(small.groupBy("of")).applyInPandas(run, "case long, pos long, component long")
    if large.isEmpty():
        return found
    named = lambda *c: F.struct(F.col("case"), *c)
    many = components(_of_cases(nodes, large, "left_semi").select(named("pos").alias("pos")), _of_cases(edges, large, "left_semi").select(named(F.col("a").alias("pos")).alias("a"), named(F.col("b").alias("pos")).alias("b")))
    return found.unionByName(many.select(F.col("pos.case").cast("long").alias("case"), F.col("pos.pos").cast("long").alias("pos"), F.col("component.pos").cast("long").alias("component")))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 100, retries: int = 5, wait: float = 1.0) -> DataFrame:
    """Texts with the vectors that `embed` gives for batches of them, in their order; a failing call is tried again after 1, 2, 4 ... times `wait` seconds."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                for attempt in range(retries):
                    try:
                        vectors = embed(part[text].tolist())
                        break
                    except Exception:
                        if attempt == retries - 1:
                            raise
                        time.sleep(wait * 2**attempt)
                yield part.assign(vec=vectors)

    return texts.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in texts.schema.fields)}, vec array<double>")
