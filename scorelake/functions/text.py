"""Text of criteria: normal forms, openings, degree words, enumerations, slugs and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import strip

#: The lists and patterns that results depend on.
SHELL_PREFIXES = (
    "The response should ",
    "The response must ",
    "The response needs to ",
    "The response ought to ",
    "The response ",
    "Response should ",
    "Response must ",
    "Response needs to ",
    "Response ",
)
OPENING_ADVERBS = (
    "briefly", "clearly", "carefully", "explicitly", "directly", "systematically", "honestly", "accurately", "logically",
    "flatly", "gently", "completely", "enthusiastically", "transparently", "critically", "appropriately", "uncritically", "dogmatically",
)
LEADING_ADVERBS = ("briefly", "clearly", "explicitly", "carefully", "accurately", "thoroughly", "directly", "fully", "properly", "appropriately")
DEGREE_WORDS = ("massive", "significant", "substantial", "major", "serious", "severe", "grave", "critical", "catastrophic", "considerable", "extreme", "dramatic")
ENUM_MARKERS = ("including", "such as", "e.g.", "for example", "i.e.")
NEGATIONS = (
    r"does not|do not|don'?t|doesn'?t|avoids?|never|fails?|ignores?|omits?|overlooks?|dismisses?|penaliz"
    r"|guilt-|over-center|over-focus|over-empha"
    r"|assumes?\b|blames?\b|downplays?\b|endorses?\b|minimizes?\b|mocks?\b|shames?\b|trivializes?\b"
    r"|validates?\b|encourages?\b"
)
QUESTION = "Does the response consider "


def embedding_form(title: Column) -> Column:
    """A criterion as the question that is embedded.

    Titles on the response, advice, failing suggestions, negations and detriments stay as they are. Else
    the opening goes: a first token with a hyphen or slash and what is listed with it; a leading adverb;
    "verb, aside, rest"; or just the verb. Titles of one word stay.
    """
    t = strip(F.regexp_replace(strip(title), r"""^['"]+|['"]+$""", ""))
    as_is = (
        (t == "") | t.rlike(r"(?iU)^(the )?response\b") | t.rlike(r"(?iU)^advice\s*,") | t.rlike(r"(?iU)^suggests?\s*,.*\bfails?\b")
        | t.rlike(rf"(?iU)^({NEGATIONS})") | t.rlike(r"(?iU)^detrimental\s*:")
    )
    listed = r"(?sU)^\S+(?:\s*,\s*\w+)*(?:\s+or\s+\w+)?\s+(.+)$"
    bare = F.regexp_replace(t, rf"(?iU)^({'|'.join(LEADING_ADVERBS)})\s+", "")
    aside, verb = r"(?sU)^(\w+),\s*[^,]+,\s*(.+)$", r"(?sU)^\w+\s+(.+)$"
    question = lambda text, pattern, group: F.concat(F.lit(QUESTION), F.regexp_extract(text, pattern, group))
    return (
        F.when(as_is, t).when(t.rlike(r"(?U)^\S*[-/]") & t.rlike(listed), question(t, listed, 1))
        .when(bare.rlike(aside), question(bare, aside, 2)).when(bare.rlike(verb), question(bare, verb, 1)).otherwise(t)
    )


#: What spaces go from, lists and capitals.
SPACES = ((r"\s+([,.;:!?])", "$1"), (r"\(\s+", "("), (r"\s+\)", ")"))
_LIST = r"\([^)]*,[^)]*,[^)]*\)"
_LONG_LIST = r"\s*\((?:[^)]*,){2,}[^)]*\)"
_CAPITAL = r"\b[A-Z][A-Za-z0-9'’.-]*\b"
_UNITS = r"(?i),|\bif\b|\bwhether\b|\bincluding\b|\bsuch as\b"


def normal_space(text: Column) -> Column:
    """Single spaces, none before punctuation or inside the ends of parentheses."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))  # only plain spaces are left
    for pattern, to in SPACES:
        t = F.regexp_replace(t, pattern, to)
    return t


def folded(text: Column) -> Column:
    """Single spaces and lower case."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def shell(text: Column) -> Column:
    """The first of the standing openings that the text has, or empty."""
    out = F.when(text.startswith(SHELL_PREFIXES[0]), SHELL_PREFIXES[0])
    for p in SHELL_PREFIXES[1:]:
        out = out.when(text.startswith(p), p)
    return out.otherwise("")


def _let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Fixed value: signs that a token's bare form lacks at either end.
_EDGE = " ,.;:!?"


def opening(text: Column) -> Column:
    """Shell (with the space after it), adverbs, verb (bare and lower-case), verb_token and rest of a criterion; verb and token are null without one."""
    bare = lambda w: F.lower(F.btrim(w, F.lit(_EDGE)))
    after = F.substr(text, F.length(shell(text)) + 1)

    def parts(working: Column, tokens: Column, at: Column) -> Column:
        some = at > 0
        token = F.when(some, F.try_element_at(tokens, F.when(some, at).otherwise(1)))
        consumed = F.length(F.array_join(F.slice(tokens, 1, F.greatest(at, F.lit(0))), " "))
        return F.struct(
            F.substr(text, F.lit(1), F.length(text) - F.length(working)).alias("shell"), F.when(some, F.slice(tokens, 1, F.greatest(at - 1, F.lit(0)))).otherwise(tokens).alias("adverbs"),
            F.when(some, bare(token)).alias("verb"), token.alias("verb_token"), F.when(some, F.substr(working, consumed + 1)).otherwise(F.lit("")).alias("rest"),
        )

    def split(working: Column) -> Column:
        tokens = F.filter(F.split(working, r"(?U)\s+"), lambda w: w != "")
        at = lambda t: F.array_position(F.transform(t, lambda w: ~bare(w).isin(*OPENING_ADVERBS)), True).cast("int")
        return _let(tokens, lambda t: _let(at(t), lambda n: parts(working, t, n)))

    return _let(F.regexp_replace(after, r"(?U)^\s+", ""), split)


def with_verb(text: Column, token: Column) -> Column:
    """The text opened by another verb, without its adverbs; null if either has no verb."""
    return _let(opening(text), lambda o: F.when(o["verb_token"].isNotNull() & token.isNotNull(), normal_space(F.concat(o["shell"], token, o["rest"]))))


def _changed(out: Column, text: Column) -> Column:
    return _let(normal_space(out), lambda v: F.when(v != normal_space(text), v))


_DEGREES = rf"(?i)\b(?:{'|'.join(DEGREE_WORDS)})\b"
#: What any text has that loses an enumeration.
_MAY_LIST = r"(?i)\(|" + "|".join(m.replace(".", r"\.") for m in ENUM_MARKERS)


def degree_words(text: Column) -> Column:
    """Which of the degree words the text has, in their fixed order."""
    # fixed patterns, which are compiled once; most texts have none
    found = F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{w}\b"), F.lit(w)) for w in DEGREE_WORDS]))
    return F.when(text.rlike(_DEGREES), found).otherwise(F.array().cast("array<string>"))


def without_degrees(text: Column) -> Column:
    """The text without them; null if that changes nothing."""
    return F.when(text.rlike(_DEGREES), _changed(F.regexp_replace(text, rf"{_DEGREES}\s*", ""), text))


def enumeration_marks(text: Column) -> Column:
    """Which markers the text has, and whether a list of three in parentheses."""
    low = F.lower(text)
    marks = [F.when(low.contains(m), F.lit(m)) for m in ENUM_MARKERS]
    return F.array_compact(F.array(*marks, F.when(text.rlike(_LIST), F.lit("parenthetical_list"))))


def without_enumerations(text: Column) -> Column:
    """The text without such lists, and without what follows a marker up to a stop or semicolon; null if that changes nothing."""
    out = F.regexp_replace(text, _LONG_LIST, "")
    for m in ENUM_MARKERS:
        out = F.regexp_replace(out, rf"(?i),?\s*\Q{m}\E\s*.*?(?=[.;]|$)", "")
    return F.when(text.rlike(_MAY_LIST), _changed(out, text))


def inner_capitals(text: Column) -> Column:
    """Capitalised words other than the first one of the opening 80 characters."""
    first = F.regexp_extract(F.substring(text, 1, 80), rf"({_CAPITAL})", 1)
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(f"({_CAPITAL})"), F.lit(1)), lambda w: w != first))


def info_units(text: Column) -> Column:
    """One more than its commas, ifs, whethers and list markers."""
    return F.regexp_count(text, F.lit(_UNITS)) + 1


#: Rewrite factors and their steps.
FACTORS = {
    "verb_model": ("verb",),
    "degree_strip": ("degree",),
    "enum_strip": ("enum",),
    "verb_degree": ("verb", "degree"),
    "verb_enum": ("verb", "enum"),
    "degree_enum": ("degree", "enum"),
    "verb_degree_enum": ("verb", "degree", "enum"),
}


def rewrites(df: DataFrame, keep: list[str], human: str, model: str) -> DataFrame:
    """One row for each criterion and factor: the criterion under the factor's steps, each taken where it changes something; null if none does, or if a verb is asked for that the model's text lacks.

    Every text on the way is a column of its own, from the one that it shares its first steps with, so that no step is worked out twice.
    """
    steps = {"verb": lambda t: with_verb(t, F.col("_verb")), "degree": without_degrees, "enum": without_enumerations}
    out = df.withColumn("_verb", opening(F.col(model))["verb_token"]).withColumn("_at", F.col(human)).withColumn("_plain", normal_space(F.col(human)))
    made = {(): "_at"}
    for taken in sorted(FACTORS.values(), key=len):
        name = "_at_" + "_".join(taken)
        out = out.withColumn(name, F.coalesce(steps[taken[-1]](F.col(made[taken[:-1]])), F.col(made[taken[:-1]])))
        made[taken] = name
    found = []
    for factor, taken in FACTORS.items():
        changed = F.when(F.col(made[taken]) != F.col("_at"), _let(normal_space(F.col(made[taken])), lambda text: F.when(text != F.col("_plain"), text)))
        if "verb" in taken:
            changed = F.when(F.col("_verb").isNotNull(), changed)
        found.append(F.struct(F.lit(factor).alias("factor"), changed.alias("text")))
    return out.select(*keep, F.explode(F.array(*found)).alias("f")).select(*keep, "f.*")


def length_order(text: Column, original: Column) -> Column:
    """X11: <, = or > by numbers of characters."""
    return F.when(F.length(text) < F.length(original), "<").when(F.length(text) > F.length(original), ">").otherwise("=")


def slug(name: Column) -> Column:
    """A model's name as part of a file name: its last path element, other signs as underscores."""
    return F.regexp_replace(F.lower(F.element_at(F.split(name, "/"), -1)), r"[^a-z0-9]+", "_")


def redacted(text: Column) -> Column:
    """Without the values of key and token arguments."""
    return F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret)[= ]+)\S+", "$1***")


def forbidden(texts: DataFrame, patterns: dict[str, str], path: str = "path", text: str = "text") -> DataFrame:
    """Every line that has a forbidden pattern: path, line from 1, pattern, and the line's first 240 characters."""
    lines = texts.select(path, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in patterns.items()]))
    return lines.select(path, (F.col("n") + 1).alias("line"), F.explode(hits).alias("pattern"), F.substring(strip(F.col("line")), 1, 240).alias("excerpt"))


def templated(template: str, **fields: Column) -> Column:
    """A template with {fields} filled in; an unknown field fails."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(fields[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def templated_by(name: Column, templates: dict[str, str], **fields: Column) -> Column:
    """The template that each row names, filled in; a name that there is none of fails, a null name is null."""
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for n, template in templates.items():
        out = out.when(name == n, templated(template, **fields))
    return out.otherwise(F.raise_error(F.concat(F.lit("no template is named "), name)))


def prompt_variant(model: Column, variants: dict[str, str], name: str, suffix: str = "__rubricasresp") -> Column:
    """The named variant of a prompt for models with a suffix, the standard one for others."""
    return F.when(model.endswith(suffix), F.lit(variants[name])).otherwise(F.lit(variants["standard"]))


