"""Readers of judges' answers: seven that are deliberately different, and parsers of models' raw output."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's strip() and Unicode classes, which Java's regular expressions have under (?U) only.
_STRIP = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def _plain(judgement: Column) -> Column:
    return F.lower(strip(F.coalesce(judgement.cast("string"), F.lit(""))))


def credit(judgement: Column, weight: Column) -> Column:
    """V1: the weight's size for an answer holding yes to a positive criterion, or no (and not taken by yes) to a negative one."""
    j = _plain(judgement)
    return F.when(j.contains("yes") & (weight > 0), weight).when(j.contains("no") & (weight < 0), -weight).otherwise(F.lit(0))


def leading_verdict(judgement: Column) -> Column:
    """V2: yes or no by how the answer starts; other answers stay, stripped and lower-cased."""
    j = _plain(judgement)
    return F.when(j.startswith("yes"), "yes").when(j.startswith("no"), "no").otherwise(j)


def contained_verdict(judgement: Column) -> Column:
    """V3: yes if the answer holds yes, else no if it holds no, else other; null is as an empty answer, so other."""
    j = _plain(judgement)
    return F.when(j.contains("yes"), "yes").when(j.contains("no"), "no").otherwise("other")


def is_no(judgement: Column) -> Column:
    """V4: exactly NO but for case and outer white space."""
    return F.upper(strip(F.coalesce(judgement, F.lit("")))) == "NO"


def marked_verdict(judgement: Column) -> Column:
    """V6, and the first part of V5: null, or whether the answer starts with yes; list and heading marks before it don't count, and no is tried first."""
    j = F.regexp_replace(_plain(judgement), r"^[*# ]+", "")
    return F.when(j.startswith("no"), F.lit(False)).when(j.startswith("yes"), F.lit(True))


def marked_item(judgement: Column) -> Column:
    """The second part of V5: the first whole number of a yes."""
    return F.when(marked_verdict(judgement), F.nullif(F.regexp_extract(judgement, r"\d+", 0), F.lit("")).try_cast("long"))


def is_exact_yes(judgement: Column) -> Column:
    """V7: exactly YES."""
    return judgement == "YES"


def starts_y(judgement: Column) -> Column:
    """V7's sibling: starts with Y in either case."""
    return F.upper(judgement).startswith("Y")


# ---- raw model output -------------------------------------------------------------------------


def unfenced(raw: Column) -> Column:
    """L1: the inside of the first code fence, else the text, stripped."""
    return once(F.regexp_extract(raw, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1), lambda inside: strip(F.when(F.length(inside) > 0, inside).otherwise(raw)))


def repaired(text: Column) -> Column:
    """L2: no comma before a closing bracket."""
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def first_object(raw: Column) -> Column:
    """L1: from the first brace to the last, inside a fence if there is one; null without."""
    return once(F.regexp_extract(unfenced(raw), r"(?s)\{.*\}", 0), lambda t: F.nullif(t, F.lit("")))


def first_array(raw: Column) -> Column:
    """L3: from the first square bracket to the last, inside a fence if there is one; null without."""
    return once(F.regexp_extract(unfenced(raw), r"(?s)\[.*\]", 0), lambda t: F.nullif(t, F.lit("")))


def rubric_array(raw: Column) -> Column:
    """L3: criteria (id, title, weight) of the array in a model's answer; null where it doesn't parse."""
    return F.from_json(repaired(first_array(raw)), "array<struct<id:string,title:string,weight:int>>")


_VERDICT = "struct<meets_requirements:boolean,passes_generality:boolean,reason:string,rewrite:string>"


def _keyed(raw: Column, key: str) -> Column:
    low = F.lower(raw)
    said = lambda what: low.contains(f'"{key}": {what}') | low.contains(f"'{key}': {what}")
    return F.when(said("true"), True).when(said("false"), False)


def ladder(raw: Column) -> Column:
    """L4: verdict, reason and rewrite by the first step that gives a verdict: fenced or bare JSON, an object inside the text, a key and value as text, words of the last 600 characters, words after a leading "Reason:". Without JSON the reason is 200 characters of the answer: its end where its end decided, else its start."""
    of = lambda text: F.from_json(text, _VERDICT)
    inner = once(F.regexp_extract(raw, r'(?s)\{[^{}]*"(?:meets_requirements|passes_generality)"[^{}]*\}', 0), lambda t: F.nullif(t, F.lit("")))
    tail, low = F.lower(F.substring(raw, -600, 600)), F.lower(raw)
    #: The words that decide.
    words = F.when(tail.rlike(r"\bpasses\b|\bpass\b|\byes,? it (passes|satisfies)\b"), True).when(
        tail.rlike(r"\bfails?\b|\bdoes not (pass|satisfy)\b|\btoo specific\b|\boverly specific\b|\bnarrow\b|\bmandates a specific\b|\brequires a specific\b"), False)
    reason = F.when(raw.rlike(r"(?i)^\s*reason\s*:"), F.when(low.rlike(r"\bspecific\b|\bnarrow\b|\bmandates\b|\bparticular\b|\brequires\b"), False).when(low.rlike(r"\bbroad\b|\bgeneral\b|\bmost good\b|\bcommonly\b|\bnatural\b"), True))
    out = lambda verdict, why, rewrite: F.struct(verdict.alias("verdict"), why.alias("reason"), rewrite.alias("rewrite"))
    start, end, none = F.substring(raw, 1, 200), F.substring(raw, -200, 200), F.lit("")

    def parsed(d: Column) -> Column:
        return once(F.coalesce(d["meets_requirements"], d["passes_generality"]), lambda said: F.when(said.isNotNull(), out(said, F.coalesce(d["reason"], none), F.coalesce(d["rewrite"], none))))

    found = [once(of(text), parsed) for text in (unfenced(raw), strip(raw), inner)]
    for said, why in ((_keyed(raw, "meets_requirements"), start), (_keyed(raw, "passes_generality"), start), (words, end), (reason, start)):
        found.append(F.when(said.isNotNull(), out(said, why, none)))
    return F.coalesce(*found, out(F.lit(None).cast("boolean"), F.coalesce(start, none), none))


def ladder_verdict(raw: Column) -> Column:
    """L4: the verdict alone; null if no step gives one."""
    return ladder(raw)["verdict"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entry(key: Column, value: Column) -> Column:
    return F.named_struct(F.lit("key"), key, F.lit("value"), value)


def last_entries(entries: Column) -> Column:
    """A map of an array of (key, value) in which the last of a repeated key wins; null keys are left out."""

    def kept(some: Column) -> Column:
        keys = F.array_distinct(F.transform(some, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(some, lambda e: e["key"] == k), -1)["value"]))

    return once(F.filter(entries, lambda e: e["key"].isNotNull()), kept)


def batched(raw: Column) -> Column:
    """Idx to verdict (true, yes and pass count, in any case; null if none is said) and reason of an array of objects, of a repeated idx the last; null where there is none."""
    rows = F.from_json(repaired(first_array(raw)), "array<struct<idx:int,verdict:string,meets_requirements:string,reason:string>>")
    said = lambda r: F.lower(strip(F.coalesce(r["verdict"], r["meets_requirements"]))).isin("true", "yes", "pass")
    return last_entries(F.transform(rows, lambda r: _entry(r["idx"], F.named_struct(F.lit("verdict"), said(r), F.lit("reason"), F.coalesce(r["reason"], F.lit(""))))))


def batched_answer(found: Column, idx: Column) -> Column:
    """Verdict and reason of one idx; a missing one has no verdict, and says so."""
    missing = F.concat(F.lit("missing idx="), idx.cast("string"), F.lit(" in batched response"))
    return F.coalesce(F.try_element_at(found, idx), F.struct(F.lit(None).cast("boolean").alias("verdict"), missing.alias("reason")))


def numbered_map(raw: Column, n: Column) -> Column:
    """Item number to yes or no of an object of answers, of a repeated number the last; null with answers for fewer than half of n items."""
    found = F.from_json(once(F.regexp_extract(raw, r"(?s)\{.*\}", 0), lambda t: F.nullif(t, F.lit(""))), "map<string,string>")
    entries = F.filter(F.transform(F.map_entries(found), lambda e: _entry(strip(e["key"]), e["value"])), lambda e: e["key"].rlike(r"^[+-]?\d+$"))
    out = last_entries(F.transform(entries, lambda e: _entry(e["key"].cast("int"), F.when(F.lower(strip(e["value"])).startswith("yes"), "yes").otherwise("no"))))
    return once(out, lambda m: F.when(F.size(m) >= F.greatest(F.lit(1), (n / 2).cast("int")), m))


def _objects(text: str) -> list[str]:
    """What may be the object of an answer: inside fences; then objects that are not inside others, the last one first; then from the first brace to the last."""
    found, depth, start = [], 0, 0
    for mark in re.finditer(r"[{}]", text):
        if mark[0] == "{":
            start = start if depth else mark.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                found.insert(0, text[start : mark.end()])
    return [*re.findall(r"(?s)```(?:json)?\s*(\{.*?\})\s*```", text), *found, text[text.find("{") : text.rfind("}") + 1]]


def _item_numbers(value: object, most: int) -> list[int]:
    """The least `most` item numbers that a value names; none of a boolean."""
    if isinstance(value, bool):
        return []
    if isinstance(value, (int, float)):
        return [int(value)]
    if isinstance(value, list):
        numbers = {int(t) for t in (str(x).strip() for x in value) if re.fullmatch(r"-?\d+", t)}
    else:
        numbers = {int(t) for t in re.findall(r"\d+", str(value))}
    return sorted(numbers)[:most]


@F.pandas_udf(T.MapType(T.IntegerType(), T.ArrayType(T.IntegerType())))
def blind_map(raw: pd.Series, n: pd.Series) -> pd.Series:
    """Item number to the numbers (two at most, in order; none is empty) that it matches, by the first of an answer's objects that has half of n items; null without. Values may be lists, numbers, or words."""

    def read(text: str | None, items: int) -> dict[int, list[int]] | None:
        for candidate in _objects(text or ""):
            try:
                got = json.loads(candidate)
            except ValueError:
                continue
            found = {int(k): _item_numbers(v, 2) for k, v in got.items() if re.fullmatch(r"\s*[+-]?\d+\s*", k)} if isinstance(got, dict) else {}
            if len(found) >= max(1, items // 2):
                return found
        return None

    return pd.Series([read(t, int(k)) for t, k in zip(raw, n, strict=True)], dtype=object)


def only_side(rows: Column, aliases: Column) -> Column:
    """criterion_id, status (unique), reason and scenario of one side of a find-only answer (an array of criterion_id, status, reason, scenario).

    Ids are stripped and upper-cased, and aliases (a map) replaced. Of a repeated id the last row counts; then rows whose status is neither empty nor begins with uniq go."""
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    name = lambda r: F.upper(text(r["criterion_id"]))
    named = F.transform(rows, lambda r: _entry(F.coalesce(F.try_element_at(aliases, name(r)), name(r)), r))
    last = F.map_entries(last_entries(F.filter(named, lambda e: e["key"] != "")))
    status = lambda r: F.lower(text(r["status"]))
    kept = F.filter(last, lambda e: (status(e["value"]) == "") | status(e["value"]).startswith("uniq"))
    return F.transform(kept, lambda e: F.struct(e["key"].alias("criterion_id"), F.lit("unique").alias("status"), text(e["value"]["reason"]).alias("reason"), text(e["value"]["scenario"]).alias("scenario")))


ONLY_SIDE = "array<struct<criterion_id:string,status:string,reason:string,scenario:string>>"


def match_status(raw: Column) -> Column:
    """Matched, nearby or none by how the word starts; anything else is none."""
    s = _plain(raw)
    return F.when(s.rlike("^(matched|cover)"), "matched").when(s.rlike("^(near|partial)"), "nearby").otherwise("none")


def matched_ids(raw: Column) -> Column:
    """Ids stripped, upper-cased, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.upper(strip(F.coalesce(x, F.lit(""))))), lambda x: x != ""))


def settled_match(raw_status: Column, ids: Column, valid: Column) -> Column:
    """Status and ids together: ids without a status mean matched, unknown ids go, no ids mean none."""
    status = F.when(raw_status.isNull() & (F.size(ids) > 0), "matched").otherwise(match_status(raw_status))
    known = F.array_intersect(ids, valid)
    final = F.when((F.size(known) == 0) | (status == "none"), "none").otherwise(status)
    return F.struct(final.alias("status"), F.when(final == "none", F.array().cast("array<string>")).otherwise(known).alias("ids"))


def positional_verdict(found: Column, position: Column, missing: str) -> Column:
    """The verdict at a 1-based position of a map, `missing` where it has none (or there is no map)."""
    return F.coalesce(F.try_element_at(found, position), F.lit(missing))
