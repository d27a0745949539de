"""Rubrics: nested criteria, their flat rows, ids, filters and serial forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.verdicts import marked_item, marked_verdict, strip

#: The weights that a criterion may have.
WEIGHTS = (-3, -2, -1, 1, 2, 3)
CRITERION = "struct<id:string,title:string,weight:int,annotations:struct<rubric_dimension:string>>"


def nest(rows: DataFrame, key: str, pos: str, fields: Sequence[str]) -> DataFrame:
    """Flat criteria to one row a task, with its criteria as an array in order of pos."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, *fields))).alias("RUBRIC"))


def explode_rubric(df: DataFrame, keep: Sequence[str], rubric: str = "RUBRIC") -> DataFrame:
    """One row a criterion, with its place from 0; optional columns are kept if there are any."""
    have = [c for c in keep if c in df.columns]
    return df.select(*have, F.posexplode(rubric).alias("place", "criterion")).select(*have, "place", "criterion.*")


def explode_strict(df: DataFrame, key: str, rubric: str = "RUBRIC") -> DataFrame:
    """As P1, without criteria that lack an id or title; a missing weight fails the query."""
    rows = explode_rubric(df, [key], rubric).filter("coalesce(id, '') <> '' and coalesce(title, '') <> ''")
    return rows.withColumn("weight", F.coalesce("weight", F.raise_error(F.concat(F.lit("criterion without weight: "), "id")).cast("int")))


def flexible_rubric(raw: Column) -> Column:
    """A rubric as JSON text or as a literal with single quotes, to its array; null where neither parses."""
    shape = f"array<{CRITERION}>"
    bare = F.regexp_replace(F.regexp_replace(raw, r"\bNone\b", "null"), r"\b(True|False)\b", "$1")
    return F.coalesce(F.from_json(raw, shape, {"allowSingleQuotes": "false"}), F.from_json(bare, shape, {"allowSingleQuotes": "true"}))


def alias_id(prefix: str, place: Column) -> Column:
    """H001, H002 and so on by place from 0."""
    number = (place + 1).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))


def alias_map(rubric: Column, prefix: str) -> Column:
    """Aliases of a rubric's criteria, to their ids."""
    return F.map_from_entries(F.transform(rubric, lambda c, i: F.struct(alias_id(prefix, i), c["id"])))


def renamed_criteria(raw: Column) -> Column:
    """Description and dimension of generated criteria to title and lower-case annotation; weight 1 if missing."""
    return F.transform(raw, lambda c: F.struct(c["id"].alias("id"), c["description"].alias("title"), F.coalesce(c["weight"], F.lit(1)).alias("weight"), F.struct(F.lower(c["dimension"]).alias("rubric_dimension")).alias("annotations")))


def completed(response: Column | None, judgement: Column | None) -> Column:
    """Whether a row is done: by its response if it has that field, else by its judgement, else yes. A field that the table lacks is None here."""
    if response is not None:
        return F.length(strip(F.coalesce(response, F.lit("")))) > 0
    if judgement is not None:
        return F.length(strip(F.coalesce(judgement, F.lit("")))) > 0
    return F.lit(True)


def weight_sign(weight: Column, which: str) -> Column:
    """P5: all, negative, positive or nonnegative; an unreadable weight is 0."""
    w = F.coalesce(weight.try_cast("int"), F.lit(0))
    return {"all": F.lit(True), "negative": w < 0, "positive": w > 0, "nonnegative": w >= 0}[which]


def neutral(theory: Column, strict: bool) -> Column:
    """The theory is neutral, or (not strict) empty."""
    exact = F.coalesce(theory == "neutral", F.lit(False))
    return exact if strict else exact | (F.length(strip(F.coalesce(theory, F.lit("")))) == 0)


def valid_weight(raw: Column) -> Column:
    """A whole number, as a number or as text, among WEIGHTS; else null."""
    text = strip(raw.cast("string"))
    whole = F.when(text.rlike(r"^[+-]?\d+(\.0+)?$"), F.regexp_replace(text, r"\.0+$", "").try_cast("int"))
    return F.when(whole.isin(*WEIGHTS), whole)


def task_number(raw: Column) -> Column:
    """19, "19" and case_019 are task 19; null-like words are no task."""
    text = F.lower(strip(raw.cast("string")))
    return F.when(~text.isin("none", "null", "nan", ""), F.coalesce(text.try_cast("long"), F.nullif(F.regexp_extract(text, r"^case_0*(\d+)$", 1), F.lit("")).try_cast("long")))


def case_name(number: Column) -> Column:
    """case_019 for 19."""
    return F.format_string("case_%03d", number)


def truthy(value: Column) -> Column:
    """P20: a boolean, or its name in any case."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def numbered_list(titles: Column) -> Column:
    """Titles as lines "1. title"."""
    return F.array_join(F.transform(titles, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), strip(t))), "\n")


def parsed_list(text: Column) -> Column:
    """The inverse: number to text of each line that starts with a number and a dot."""
    pattern = r"(?m)^\s*(\d+)\.\s+(.*)$"
    numbers, texts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.map_from_entries(F.transform(F.arrays_zip(numbers.alias("n"), texts.alias("t")), lambda x: F.struct(x["n"].cast("int"), strip(x["t"]))))


def id_lines(criteria: Column, overrides: Column | None = None) -> Column:
    """P25: lines "id | title", the title replaced where overrides (a map) has the id."""
    title = (lambda c: c["title"]) if overrides is None else (lambda c: F.coalesce(F.try_element_at(overrides, c["id"]), c["title"]))
    return F.array_join(F.transform(criteria, lambda c: F.concat_ws(" | ", c["id"], title(c))), "\n")


def last_row_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """S18, S19, J-keys: of the rows of a key the last by order."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_last")).select(key, "_last.*")


def keyed_verdicts(df: DataFrame, key: str, judgement: str, order: str) -> DataFrame:
    """Of each key's rows with a readable verdict the last by order, with its verdict and item number; others are left out."""
    said = df.withColumn("verdict", marked_verdict(F.col(judgement))).withColumn("item", marked_item(F.col(judgement))).filter("verdict is not null")
    return last_row_wins(said, key, order)


def first_n_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def id_slice(df: DataFrame, key: str, start: int, count: int) -> DataFrame:
    """Ids start .. start + count of the sorted distinct ids."""
    return df.select(key).distinct().orderBy(key).offset(start).limit(count)


def blank_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows without a text, which a run refuses (see require)."""
    return df.filter(F.length(strip(F.coalesce(F.col(column), F.lit("")))) == 0)


def require(violations: DataFrame, what: str, shown: int = 10) -> None:
    """Fail with the first offenders and how many more there are."""
    some = [str(tuple(r)) for r in violations.limit(shown).collect()]
    if some:
        more = violations.count() - len(some)
        raise ValueError(f"{what}: {', '.join(some)}" + (f" (+{more} more)" if more else ""))


def require_count(df: DataFrame, expected: int) -> None:
    """Fail unless df has just so many rows."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} rows, found {found}")


def match_none(criteria: Column) -> Column:
    """Rows that match nothing, for a rubric whose other side is empty."""
    return F.transform(criteria, lambda c: F.struct(c["id"].alias("atom_id"), F.lit("none").alias("status"), F.array().cast("array<string>").alias("matched_atom_ids"), c["weight"].alias("weight")))
