"""Queries of vectors and clusters (C), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as C
from ..sources.durable import new_path, table
from .catalog import query
from .scoring import rounded

_V = "v AS (SELECT pos, side, model, weight, pos // 40 AS \"case\", CAST(vec AS DOUBLE[]) AS vec FROM concepts)"
_U = "u AS (SELECT * EXCLUDE (vec), list_transform(vec, lambda x: x / CASE WHEN list_inner_product(vec, vec) = 0 THEN 1 ELSE sqrt(list_inner_product(vec, vec)) END) AS vec FROM v)"


def _unit(concepts):
    return concepts.withColumn("vec", C.unit(F.col("vec"))).withColumn("case", F.expr("pos div 40"))


@query("c1_c2_unit", f"WITH {_V}, {_U} SELECT pos, round(list_inner_product(vec, vec), 6) AS norm, round(vec[1], 6) AS first FROM u")
def c1(concepts):
    return rounded(_unit(concepts).select("pos", C.dot(F.col("vec"), F.col("vec")).alias("norm"), F.col("vec")[0].alias("first")), "norm", "first")


_V_GRP = _V.replace("weight, pos //", "weight, grp, pos //")
_GREEDY = f"""WITH RECURSIVE {_V_GRP}, {_U}, o AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY side, pos) AS i FROM u),
s(k, i, kept, ids) AS (SELECT DISTINCT "case", CAST(0 AS BIGINT), CAST([] AS DOUBLE[][]), CAST([] AS BIGINT[]) FROM o UNION ALL
SELECT s.k, o.i, CASE WHEN len(list_filter(s.kept, lambda x: list_inner_product(x, o.vec) >= 0.3)) > 0 THEN s.kept ELSE list_append(s.kept, o.vec) END,
CASE WHEN len(list_filter(s.kept, lambda x: list_inner_product(x, o.vec) >= 0.3)) > 0 THEN s.ids ELSE list_append(s.ids, o.pos) END FROM s JOIN o ON o."case" = s.k AND o.i = s.i + 1),
l AS (SELECT k, unnest(arg_max(ids, i)) AS leader FROM s GROUP BY k),
j AS (SELECT o."case", o.pos, o.side, o.i, b.pos AS lead, list_inner_product(o.vec, b.vec) AS cos FROM o JOIN l ON l.k = o."case" JOIN o b ON b.pos = l.leader AND b.i < o.i WHERE o.pos NOT IN (SELECT leader FROM l)),
w AS (SELECT "case", pos, side, arg_max(lead, cos) AS leader, max(cos) AS cos FROM j GROUP BY ALL UNION ALL SELECT "case", pos, side, pos, 0 FROM o WHERE pos IN (SELECT leader FROM l))"""


@query("c3_dedupe_by_case", _GREEDY + """ SELECT "case", leader, array_to_string(list_sort(list(DISTINCT side)), ',') AS tags, count(*) - 1 AS n_merged, round(max(cos), 6) AS max_cos_merged FROM w GROUP BY 1, 2""")
def c3(concepts):
    rows = _unit(concepts).withColumn("rank", F.when(F.col("side") == "human", F.col("pos")).otherwise(F.col("pos") + 10**12))
    found = C.merged(C.dedupe_by_case(rows.select("case", "rank", "pos", "vec", "side"), 0.3, "side"))
    return rounded(found.withColumn("tags", F.array_join("tags", ",")), "max_cos_merged")


_BY_MODEL = _GREEDY.replace("ORDER BY side, pos) AS i FROM u)", "ORDER BY grp, pos) AS i FROM u WHERE side = 'model')").replace("o.side, o.i", "o.model AS side, o.i").replace('"case", pos, side, pos, 0 FROM o', '"case", pos, model, pos, 0 FROM o')


@query("c4_c5_merge_models", _BY_MODEL + """ SELECT "case", leader, array_to_string(list_sort(list(DISTINCT side)), ',') AS tags, count(*) - 1 AS n_merged, round(max(cos), 6) AS max_cos_merged FROM w GROUP BY 1, 2""")
def c5(concepts):
    rows = _unit(concepts).filter("side = 'model'").withColumn("rank", F.col("grp").cast("long") * 10**9 + F.col("pos"))
    return rounded(C.merged(C.dedupe_by_case(rows.select("case", "rank", "pos", "vec", "model"), 0.3, "model")).withColumn("tags", F.array_join("tags", ",")), "max_cos_merged")


_GLOBAL = f"""WITH RECURSIVE {_V}, {_U}, o AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM u WHERE side = 'model'),
s(i, kept, ids) AS (SELECT CAST(0 AS BIGINT), CAST([] AS DOUBLE[][]), CAST([] AS BIGINT[]) UNION ALL
SELECT o.i, CASE WHEN len(list_filter(s.kept, lambda x: list_inner_product(x, o.vec) >= 0.3)) > 0 THEN s.kept ELSE list_append(s.kept, o.vec) END,
CASE WHEN len(list_filter(s.kept, lambda x: list_inner_product(x, o.vec) >= 0.3)) > 0 THEN s.ids ELSE list_append(s.ids, o.pos) END FROM s JOIN o ON o.i = s.i + 1),
l AS (SELECT unnest(arg_max(ids, i)) AS leader FROM s),
j AS (SELECT o.pos, o.model, o.weight, b.pos AS lead, list_inner_product(o.vec, b.vec) AS cos, b.pos // :size < o.pos // :size AS older FROM o JOIN o b ON b.pos < o.pos JOIN l ON l.leader = b.pos WHERE o.pos NOT IN (SELECT leader FROM l)),
w AS (SELECT pos, model, weight, lead AS leader FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY older DESC, cos DESC, lead) AS r FROM j WHERE cos >= 0.3) WHERE r = 1 UNION ALL SELECT pos, model, weight, pos FROM o WHERE pos IN (SELECT leader FROM l))
SELECT leader, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, count(*) - 1 AS n_merged, arg_max(weight, abs(weight) * 1e9::DOUBLE + CASE WHEN pos = leader THEN 1e8::DOUBLE ELSE -pos END) AS weight FROM w GROUP BY 1"""


@query("c6_a29_global_dedupe", _GLOBAL.replace(":size", "64"))
def c6(concepts):
    rows = _unit(concepts).filter("side = 'model'")
    return C.merged_global(C.global_dedupe(rows, 0.3, batch=64, block=128), rows).withColumn("models", F.array_join("models", ","))


@query("c6_appended_batches", _GLOBAL.replace(":size", "(SELECT max(pos) // 4 + 1 FROM v)"))
def c6_batches(concepts):
    """Four batches one after the other, each against the leaders kept so far."""
    rows, folder = table(_unit(concepts).filter("side = 'model'")), new_path(concepts.sparkSession)
    size = (concepts.agg(F.max("pos")).head()[0] or 0) // 4 + 1
    found = [C.dedupe_appended(folder, i, rows.filter(F.expr(f"pos div {size}") == i), 0.3, block=128) for i in range(4)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return C.merged_global(every, rows).withColumn("models", F.array_join("models", ","))


@query("j16_similar_pairs", f"""WITH {_V}, {_U} SELECT a.pos AS a, b.pos AS b, round(list_inner_product(a.vec, b.vec), 6) AS cos
FROM u a JOIN u b ON a.side = 'human' AND b.side = 'model' AND list_inner_product(a.vec, b.vec) >= 0.35""")
def j16(concepts):
    rows = _unit(concepts)
    return rounded(C.similar_pairs(rows.filter("side = 'human'"), rows.filter("side = 'model'"), 0.35, block=128), "cos")


@query("c7_c8_j16_sides", f"""WITH {_V}, {_U}, m AS (SELECT a.pos, a.side, max(list_inner_product(a.vec, b.vec)) AS cos FROM u a JOIN u b ON a.side <> b.side GROUP BY 1, 2)
SELECT pos, round(cos, 6) AS cos, CASE WHEN cos >= 0.35 THEN 'shared' ELSE side || '_only' END AS side FROM m""")
def c7(concepts):
    rows = _unit(concepts)
    human, model = rows.filter("side = 'human'"), rows.filter("side = 'model'")
    parts = [C.greatest_cosine(a, b, block=128).select("pos", "cos", C.side_label(F.col("cos"), n, 0.35).alias("side")) for a, b, n in ((human, model, "human"), (model, human, "model"))]
    return rounded(parts[0].unionByName(parts[1]), "cos")


@query("a28_a30_distributions", """SELECT side, weight, count(*) AS n, (SELECT count(*) FROM concepts) AS total, round_even(100.0::DOUBLE * (SELECT count(*) FROM concepts x WHERE x.side = 'human') / (SELECT count(*) FROM concepts), 1) AS human_pct FROM concepts GROUP BY 1, 2""")
def a28(concepts):
    from ..operators.runs import side_shares, weight_distribution

    shares = side_shares(concepts, ["human", "model"]).select("total", "human_pct")
    return weight_distribution(concepts).join(F.broadcast(shares))


@query("c10_case_components", f"""WITH RECURSIVE {_V}, {_U}, e AS (SELECT a."case" AS k, a.pos AS a, b.pos AS b FROM u a JOIN u b ON a."case" = b."case" AND a.pos <> b.pos AND list_inner_product(a.vec, b.vec) >= 0.3),
r(pos, k, reach) AS (SELECT pos, "case", pos FROM u UNION SELECT r.pos, r.k, e.b FROM r JOIN e ON e.a = r.reach AND e.k = r.k)
SELECT k AS "case", pos, min(reach) AS component FROM r GROUP BY 1, 2""")
def c10(concepts):
    rows = _unit(concepts).select("case", "pos", "vec")
    return C.case_components(rows.select("case", "pos"), C.case_pairs(rows, 0.3))


@query("c11_embedded", "SELECT pos, " + ", ".join(f"round((len(lower(title)) - len(replace(lower(title), '{c}', ''))) / greatest(1, len(title)), 9) AS {c}" for c in "aeiou") + " FROM texts")
def c11(texts):
    """Letter shares in place of a paid embedder; the interface is the same."""

    def letters(texts: list[str]) -> list[list[float]]:
        return [[t.lower().count(c) / max(1, len(t)) for c in "aeiou"] for t in texts]

    found = C.embedded(texts.select("pos", F.col("title").alias("text")), letters)
    return found.select("pos", *[F.round(F.col("vec")[i], 9).alias(c) for i, c in enumerate("aeiou")])
