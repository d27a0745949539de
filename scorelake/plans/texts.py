"""Queries of text functions (X), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .catalog import query

_NS = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '\\s+([,.;:!?])', '\\1', 'g'), '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g')"


def _ns(t: str) -> str:
    return _NS.format(t=t)


_NEG = X.NEGATIONS.replace("'", "''")


@query("x1_embedding_form", rf"""WITH s AS (SELECT pos, trim(regexp_replace(trim(title), '^[''"]+|[''"]+$', '', 'g')) AS t FROM criteria_text),
b AS (SELECT *, regexp_replace(t, '(?i)^({"|".join(X.LEADING_ADVERBS)})\s+', '') AS bare FROM s)
SELECT pos, CASE WHEN t = '' OR regexp_matches(t, '(?i)^(the )?response\b') OR regexp_matches(t, '(?i)^advice\s*,') OR regexp_matches(t, '(?i)^suggests?\s*,.*\bfails?\b') OR regexp_matches(t, '(?i)^({_NEG})') OR regexp_matches(t, '(?i)^detrimental\s*:') THEN t
WHEN regexp_matches(t, '^\S*[-/]') AND regexp_matches(t, '(?s)^\S+(?:\s*,\s*[\p{{L}}\p{{N}}_]+)*(?:\s+or\s+[\p{{L}}\p{{N}}_]+)?\s+(.+)$') THEN '{X.QUESTION}' || regexp_extract(t, '(?s)^\S+(?:\s*,\s*[\p{{L}}\p{{N}}_]+)*(?:\s+or\s+[\p{{L}}\p{{N}}_]+)?\s+(.+)$', 1)
WHEN regexp_matches(bare, '(?s)^([\p{{L}}\p{{N}}_]+),\s*[^,]+,\s*(.+)$') THEN '{X.QUESTION}' || regexp_extract(bare, '(?s)^([\p{{L}}\p{{N}}_]+),\s*[^,]+,\s*(.+)$', 2)
WHEN regexp_matches(bare, '(?s)^[\p{{L}}\p{{N}}_]+\s+(.+)$') THEN '{X.QUESTION}' || regexp_extract(bare, '(?s)^[\p{{L}}\p{{N}}_]+\s+(.+)$', 1) ELSE t END AS text FROM b""")
def x1(criteria_text):
    return criteria_text.select("pos", X.embedding_form(F.col("title")).alias("text"))


@query("x2_x3_normal_space", f"SELECT pos, {_ns('title')} AS spaced, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS folded FROM criteria_text")
def x2(criteria_text):
    return criteria_text.select("pos", X.normal_space(F.col("title")).alias("spaced"), X.folded(F.col("title")).alias("folded"))


@query("x4_shell", "SELECT pos, CASE " + " ".join(f"WHEN starts_with(title, '{p}') THEN '{p}'" for p in X.SHELL_PREFIXES) + " ELSE '' END AS shell FROM criteria_text")
def x4(criteria_text):
    return criteria_text.select("pos", X.shell(F.col("title")).alias("shell"))


_SHELL = "CASE " + " ".join(f"WHEN starts_with(title, '{p}') THEN '{p}'" for p in X.SHELL_PREFIXES) + " ELSE '' END"
_ADVERBS = "(" + ", ".join(f"'{a}'" for a in X.OPENING_ADVERBS) + ")"


_OPENED = rf"""WITH w AS (SELECT pos, title, ltrim(substr(title, length({_SHELL}) + 1)) AS working FROM criteria_text), t AS (SELECT *, list_filter(regexp_split_to_array(working, '\s+'), lambda x: x <> '') AS tokens FROM w),
a AS (SELECT *, coalesce(list_position(list_transform(tokens, lambda x: NOT (lower(trim(x, ' ,.;:!?')) IN {_ADVERBS})), true), 0) AS k FROM t)"""


@query("x5_opening", _OPENED + f"""
SELECT pos, substr(title, 1, length(title) - length(working)) AS shell, array_to_string(CASE WHEN k > 0 THEN tokens[1:k - 1] ELSE tokens END, ' ') AS adverbs, CASE WHEN k > 0 THEN lower(trim(tokens[k], ' ,.;:!?')) END AS verb, CASE WHEN k > 0 THEN tokens[k] END AS verb_token,
CASE WHEN k > 0 THEN substr(working, length(array_to_string(tokens[1:k], ' ')) + 1) ELSE '' END AS rest FROM a""")
def x5(criteria_text):
    rows = criteria_text.select("pos", X.opening(F.col("title")).alias("o")).select("pos", "o.*")
    return rows.withColumn("adverbs", F.array_join("adverbs", " "))


_OTHER_VERB = _ns("substr(title, 1, length(title) - length(working)) || 'Weighs' || substr(working, length(array_to_string(tokens[1:k], ' ')) + 1)")


@query("x6_with_verb", f"{_OPENED} SELECT pos, CASE WHEN k > 0 THEN {_OTHER_VERB} END AS text FROM a")
def x6(criteria_text):
    return criteria_text.select("pos", X.with_verb(F.col("title"), F.lit("Weighs")).alias("text"))


_STRIPPED = rf"regexp_replace(title, '(?i)\b(?:{'|'.join(X.DEGREE_WORDS)})\b\s*', '', 'g')"


@query("x7_degree_words", f"""SELECT pos, array_to_string(list_filter([{', '.join(f"'{w}'" for w in X.DEGREE_WORDS)}], lambda w: regexp_matches(title, '(?i)\\b' || w || '\\b')), ',') AS words,
CASE WHEN {_ns(_STRIPPED)} <> {_ns('title')} THEN {_ns(_STRIPPED)} END AS text FROM criteria_text""")
def x7(criteria_text):
    return criteria_text.select("pos", F.array_join(X.degree_words(F.col("title")), ",").alias("words"), X.without_degrees(F.col("title")).alias("text"))


@query("x8_enumerations", r"""SELECT pos, array_to_string(list_filter([CASE WHEN contains(lower(title), 'including') THEN 'including' END, CASE WHEN contains(lower(title), 'such as') THEN 'such as' END, CASE WHEN contains(lower(title), 'e.g.') THEN 'e.g.' END,
CASE WHEN contains(lower(title), 'for example') THEN 'for example' END, CASE WHEN contains(lower(title), 'i.e.') THEN 'i.e.' END, CASE WHEN regexp_matches(title, '\([^)]*,[^)]*,[^)]*\)') THEN 'parenthetical_list' END], lambda x: x IS NOT NULL), ',') AS marks FROM criteria_text""")
def x8(criteria_text):
    return criteria_text.select("pos", F.array_join(X.enumeration_marks(F.col("title")), ",").alias("marks"))


def _without_lists(t: str) -> str:
    """X8 in SQL: no look-ahead there, so a marker takes what is neither stop nor semicolon."""
    out = f"regexp_replace({t}, '\\s*\\((?:[^)]*,){{2,}}[^)]*\\)', '', 'g')"
    for m in X.ENUM_MARKERS:
        out = f"regexp_replace({out}, '(?i),?\\s*{m.replace('.', chr(92) + '.')}\\s*[^.;]*', '', 'g')"
    return out


def _if_changed(out: str, t: str) -> str:
    return f"CASE WHEN {_ns(out)} <> {_ns(t)} THEN {_ns(out)} END"


@query("x8_without_enumerations", f"SELECT pos, {_if_changed(_without_lists('title'), 'title')} AS text FROM criteria_text")
def x8b(criteria_text):
    return criteria_text.select("pos", X.without_enumerations(F.col("title")).alias("text"))


@query("x9_counts", r"""SELECT pos, CAST(1 + len(regexp_extract_all(title, '(?i),|\bif\b|\bwhether\b|\bincluding\b|\bsuch as\b')) AS INTEGER) AS units FROM criteria_text""")
def x9(criteria_text):
    return criteria_text.select("pos", X.info_units(F.col("title")).alias("units"))


@query("x9_inner_capitals")
def x9b(criteria_text):
    return criteria_text.select("pos", X.inner_capitals(F.col("title")).alias("capitals"))


def _stripped(t: str) -> str:
    return rf"regexp_replace({t}, '(?i)\b(?:{'|'.join(X.DEGREE_WORDS)})\b\s*', '', 'g')"


def _rewrites() -> str:
    """X10 in SQL: a table of each intermediate text, from the one that it shares its first steps with."""
    step = {"degree": lambda t: f"coalesce({_if_changed(_stripped(t), t)}, {t})", "enum": lambda t: f"coalesce({_if_changed(_without_lists(t), t)}, {t})"}
    out, made, last = [f"{_OPENED}, s0 AS MATERIALIZED (SELECT pos, title AS at_first, {_ns('title')} AS plain, pos % 5 <> 0 AS said, CASE WHEN k > 0 AND pos % 5 <> 0 THEN {_OTHER_VERB} ELSE title END AS at_verb FROM a)"], {(): "at_first", ("verb",): "at_verb"}, "s0"
    for taken in sorted(X.FACTORS.values(), key=len):
        if taken in made:
            continue
        made[taken] = "at_" + "_".join(taken)
        new = f"s{len(out)}"
        out.append(f"{new} AS MATERIALIZED (SELECT *, {step[taken[-1]](made[taken[:-1]])} AS {made[taken]} FROM {last})")
        last = new
    rows = [f"SELECT pos, '{factor}' AS factor, CASE WHEN {'said AND ' if 'verb' in taken else ''}{_ns(made[taken])} <> plain THEN {_ns(made[taken])} END AS text FROM {last}" for factor, taken in X.FACTORS.items()]
    return ", ".join(out) + " " + " UNION ALL ".join(rows)


@query("x10_rewrites", _rewrites())
def x10(criteria_text):
    pairs = criteria_text.withColumn("model", F.when(F.col("pos") % 5 == 0, "").otherwise("Weighs the cost"))
    return X.rewrites(pairs, ["pos"], "title", "model")


@query("x11_length_order", "SELECT a.pos, CASE WHEN length(a.title) < length(b.title) THEN '<' WHEN length(a.title) > length(b.title) THEN '>' ELSE '=' END AS o FROM criteria_text a JOIN titles b USING (pos)")
def x11(criteria_text, titles):
    both = criteria_text.join(titles.select("pos", F.col("title").alias("original")), "pos")
    return both.select("pos", X.length_order(F.col("title"), F.col("original")).alias("o"))


@query("x12_slug", "SELECT task_id, regexp_replace(lower('Model ' || priority || '.v1'), '[^a-z0-9]+', '_', 'g') AS slug FROM tasks")
def x12(tasks):
    return tasks.select("task_id", X.slug(F.concat(F.lit("maker/Model "), "priority", F.lit(".v1"))).alias("slug"))


@query("x12_run_labels", """WITH s AS (SELECT task_id, priority AS label, 'r' || (task_id % 7001) AS response_tag, status AS rubric_tag FROM tasks), n AS (SELECT response_tag, count(*) > 1 AS shared FROM s GROUP BY 1)
SELECT task_id, CASE WHEN shared THEN s.response_tag || '__rubric__' || rubric_tag ELSE s.response_tag END AS run_slug, CASE WHEN shared THEN label || ' | response=' || s.response_tag || ' rubric=' || rubric_tag ELSE label END AS display_label,
CASE WHEN shared THEN 2 ELSE 1 END AS selectors FROM s JOIN n ON s.response_tag = n.response_tag""")
def x12_labels(tasks):
    from ..operators.runs import named_runs

    specs = tasks.select("task_id", F.col("priority").alias("label"), F.concat(F.lit("r"), (F.col("task_id") % 7001).cast("string")).alias("response_tag"), F.col("status").alias("rubric_tag"))
    return named_runs(specs).select("task_id", "run_slug", "display_label", F.size("selectors").alias("selectors"))


@query("x15_named_templates", "SELECT task_id, CASE status WHEN 'F' THEN 'Closed: ' || priority || '?' WHEN 'O' THEN 'Open task ' || task_id || chr(10) || 'by ' || priority ELSE 'Part of ' || task_id END AS prompt FROM tasks")
def x15_named(spark, tasks):
    """Templates kept in files, by the name that each row's status gives."""
    from ..functions.text import templated_by
    from ..sources.durable import new_path
    from ..sources.readers import templates

    folder = new_path(spark)
    for name, text in (("F", "Closed: {who}?"), ("O", "Open task {task}\nby {who}"), ("P", "Part of {task}")):
        tasks.limit(1).select(F.lit(text).alias("value")).coalesce(1).write.option("lineSep", "\x01").text(f"{folder}/{name}")
    texts = {n: next(iter(templates(spark, f"{folder}/{n}").values()), "").removesuffix("\x01") for n in "FOP"}
    return tasks.select("task_id", templated_by(F.col("status"), texts, task=F.col("task_id"), who=F.col("priority")).alias("prompt"))


@query("x13_redacted", "SELECT task_id, 'run --api_key ***' || ' --n ' || cust AS command FROM tasks")
def x13(tasks):
    return tasks.select("task_id", X.redacted(F.concat(F.lit("run --api_key k"), F.col("cust").cast("string"), F.lit(" --n "), F.col("cust").cast("string"))).alias("command"))


@query("x14_d3_forbidden", r"""WITH l AS (SELECT conv_id, turn, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS t FROM turns)
SELECT conv_id * 1000 + turn AS path, line, 'th_word' AS pattern, substr(trim(t), 1, 240) AS excerpt FROM l WHERE regexp_matches(t, '\bthe\b') UNION ALL SELECT conv_id * 1000 + turn, line, 'digits', substr(trim(t), 1, 240) FROM l WHERE regexp_matches(t, '[0-9]{3}')""")
def x14(turns):
    files = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("path"), "text")
    return X.forbidden(files, {"th_word": r"\bthe\b", "digits": r"[0-9]{3}"})


@query("x15_x16_prompts", "SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'Judge task ' ELSE 'Rubric as response: task ' END || task_id || ' by ' || priority || '.' AS prompt FROM tasks")
def x15(tasks):
    model = F.when(F.col("task_id") % 2 == 0, "m").otherwise("m__rubricasresp")
    variants = {"standard": "Judge task ", "careful": "Rubric as response: task "}
    return tasks.select("task_id", F.concat(X.prompt_variant(model, variants, "careful"), X.templated("{task} by {who}.", task=F.col("task_id"), who=F.col("priority"))).alias("prompt"))
