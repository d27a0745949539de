"""Deep comparison of nested documents, as variants, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import once
from ..sources.durable import table


def documents(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """Id and v, the named columns (all but the id, if none is named) as one document: structs and maps are objects, arrays lists, SQL nulls null."""
    named = columns or tuple(c for c in df.columns if c != id_col)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in named])).alias("v"))


def json_documents(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Id and v, the document of a column of JSON texts; a null text is the document null."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.parse_json(F.coalesce(F.col(f"`{json_col}`"), F.lit("null"))).alias("v"))


def kind(v: Column) -> Column:
    """object, list, str, bool, int, float or null; decimals without places are int, others float; other types by their names."""
    return once(F.schema_of_variant(v), _named)


def _named(s: Column) -> Column:
    named = [(s.startswith("OBJECT"), "object"), (s.startswith("ARRAY"), "list"), (s == "STRING", "str"), (s == "BOOLEAN", "bool"), (s == "VOID", "null")]
    named += [(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | s.rlike(r"^DECIMAL\(\d+,0\)$"), "int"), (s.isin("DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "float")]
    out = F.when(named[0][0], named[0][1])
    for test, name in named[1:]:
        out = out.when(test, name)
    return out.otherwise(F.lower(s))


def _length(v: Column) -> Column:
    return F.size(v.cast("array<variant>"))


def _shown(path: Column) -> Column:
    """`a.b[0]` of a path's steps: k and a key, or i and a place."""
    steps = F.transform(path, lambda p, i: F.when(F.substring(p, 1, 1) == "i", F.concat(F.lit("["), F.substr(p, F.lit(2)), F.lit("]"))).when(i == 0, F.substr(p, F.lit(2))).otherwise(F.concat(F.lit("."), F.substr(p, F.lit(2)))))
    return F.array_join(steps, "")


def _children(pairs: DataFrame, side: str) -> DataFrame:
    """Every member of one side's objects and lists: id, path and value."""
    spark = pairs.sparkSession
    each = pairs.select("id", "path", side).lateralJoin(spark.tvf.variant_explode(F.col(side).outer()))
    step = F.coalesce(F.concat(F.lit("k"), "key"), F.concat(F.lit("i"), F.col("pos").cast("string")))
    return each.select("id", F.concat("path", F.array(step)).alias("path"), F.col("value").alias(side), F.lit(True).alias(f"in_{side}"))


def differences(actual: DataFrame, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Where the documents (id, v) of both sides differ: id, path, problem, and each side's value, kind or length as text.

    Objects are compared key by key and lists place by place. A key or document that one side lacks is reported once, not
    its members; so are two kinds at one path (`type mismatch`: an int is no float, null no text) and
    lists of two lengths. Floats differ by more than the tolerance, or if only one is not a number; other scalars
    if they are not equal. Paths are like `a.b[0].c`, '' for a whole document.

    Each level of nesting is one join of both sides' members by id and path, so documents of any shape and size are split
    over tasks, and members of equal parts are never taken apart. Levels are written tables; there are as
    many as the deepest documents that differ have. Ids are unique on each side; null ids match null ids.
    """
    sides = [df.select("id", F.coalesce("v", F.parse_json(F.lit("null"))).alias(s), F.lit(True).alias(f"in_{s}"), F.array().cast("array<string>").alias("path")) for df, s in ((actual, "a"), (expected, "e"))]
    left, right = sides
    found = []
    while True:
        right = right.select(F.col("id").alias("_id"), F.col("path").alias("_path"), "e", "in_e")
        both = left.join(right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("path") == F.col("_path")), "full")
        both = both.select(F.when(F.col("in_a"), F.col("id")).otherwise(F.col("_id")).alias("id"), F.coalesce("path", "_path").alias("path"), "a", "e", "in_a", "in_e")
        both = both.filter(F.col("in_a").isNull() | F.col("in_e").isNull() | ~F.to_json("a").eqNullSafe(F.to_json("e")))
        both = both.withColumns({"kind_a": kind(F.col("a")), "kind_e": kind(F.col("e"))})
        both = both.withColumns({f"n_{s}": F.when(F.col(f"kind_{s}") == "list", _length(F.col(s))) for s in "ae"})
        as_double = {s: F.when(F.col(f"kind_{s}") == "float", F.col(s).cast("double")) for s in "ae"}
        far = (F.isnan(as_double["a"]) != F.isnan(as_double["e"])) | (F.abs(as_double["a"] - as_double["e"]) > tolerance) & ~F.isnan(as_double["a"]) & (as_double["a"] != as_double["e"])
        scalar = ~F.col("kind_a").isin("object", "list")
        problem = (
            F.when(F.col("in_e").isNull(), "missing from expected").when(F.col("in_a").isNull(), "missing from actual")
            .when(F.col("kind_a") != F.col("kind_e"), "type mismatch").when(F.col("n_a") != F.col("n_e"), "length mismatch")
            .when(F.col("kind_a") == "float", F.when(far, "differs"))
            .when(scalar & (F.col("a").cast("string") != F.col("e").cast("string")), "differs")
        )
        level = table(both.withColumn("problem", problem))

        def said(s: str) -> Column:
            text = F.when(F.col(f"kind_{s}").isin("object", "list"), F.to_json(s)).otherwise(F.col(s).cast("string"))
            return F.when(F.col("problem") == "type mismatch", F.col(f"kind_{s}")).when(F.col("problem") == "length mismatch", F.col(f"n_{s}").cast("string")).otherwise(text).alias(s)

        found.append(level.filter("problem is not null").select("id", _shown(F.col("path")).alias("path"), "problem", said("a"), said("e")))
        deeper = level.filter("problem is null and kind_a in ('object', 'list')")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left, right = _children(deeper, "a"), _children(deeper, "e")
