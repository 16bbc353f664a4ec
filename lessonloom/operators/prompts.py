"""Prompt tables: batch rendering of request parameters. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.lookups import pick
from lessonloom.functions.text import WS, or_default
from lessonloom.schemas import CLASS_SIZES, DIFFICULTY_LEVELS, DURATIONS

# Defaults of optional request fields.
DEFAULTS = {"duration": "60", "classSize": "35", "difficultyLevel": "average"}

# What is expected of pupils at each taxonomy level.
BLOOM_EXPECTATIONS = {
    "remember": "Recall, list, define, or identify terms, facts, and basic concepts.",
    "understand": (
        "Explain ideas or concepts, interpret details, and summarise reading passages."
    ),
    "apply": (
        "Use information or concepts in new situations, solve problems, and apply worked examples."
    ),
    "analyse": (
        "Draw connections among ideas, examine mathematical structures, and break down components."
    ),
    "evaluate": "Justify a stand or decision, critique methods, and check solutions.",
    "create": (
        "Produce new or original work, design posters, construct diagrams, and assemble materials."
    ),
}
BLOOM_DEFAULT = "Instructional standard expectation aligned with Bloom's taxonomy."

LANGUAGE_NOTES = {"English": "Use plain English that learners of this grade read with ease."}
DIFFICULTY_NOTES = {
    "struggling": "Go in small steps, keep sentences short and show three examples.",
    "average": "Explain at grade level, show two examples and move from easy to moderate.",
    "advanced": "Extend beyond the standard and close with one open problem.",
}

LESSON_TEMPLATE = """Prepare a lesson for this standard.
Subject: {subject}
Grade: {grade}
Strand: {strand} / {subStrand}
Standard {indicatorCode}: {indicatorText}
Taxonomy level: {bloomsLevel}
Time: {duration} minutes, of which {main_minutes} teaching and {practice_minutes} practice
Class: {classSize} learners
Language: {language_note}
Level ({difficultyLevel}): {difficulty_note}
{grounding}
Answer in three parts under these markers:
---TEACHER NOTES---
---VISUAL CONTENT PROMPTS---
---STUDENT READING MATERIAL---
Write the reading part in {language}."""
GROUNDING = "Source material:\n{foundryContext}\n"

ACTIVITY_TEMPLATE = """Write an assessment for this standard as one JSON object.
Subject: {subject}
Grade: {grade}
Strand: {strand}
Standard {indicatorCode}: {indicatorText}
Taxonomy level: {bloomsLevel}
Keys: mcqs (5, options A to D, one correct), writingPrompts (2), rubric (4)."""

MAPPING_TEMPLATE = """Break this standard down by taxonomy level as one JSON object.
Subject: {subject}
Grade: {grade}
Standard {indicatorCode}: {indicatorText}
Keys: primaryLevel, levels (all six), teachingSequence, successCriteria."""


def apply_defaults(df: DataFrame, defaults: dict[str, str | Column]) -> DataFrame:
    """Missing values (null or empty) replaced, per column."""
    return df.withColumns({c: or_default(F.col(c), d) for c, d in defaults.items()})


def request_defaults(df: DataFrame) -> DataFrame:
    """A request with its optional fields filled in."""
    return apply_defaults(df, {"subStrand": F.col("strand"), **DEFAULTS})


def bloom_expectation(level: Column) -> Column:
    """Expectation of a level, whatever its case; a missing level is Understand."""
    return pick(F.lower(F.coalesce(level, F.lit("Understand"))), BLOOM_EXPECTATIONS, BLOOM_DEFAULT)


def allocate_minutes(duration: Column, share: float) -> Column:
    """``share`` of the leading whole number of ``duration``, rounded half up; null if
    there is none or the result does not fit 64 bits."""
    digits = F.regexp_extract(duration, rf"^[{WS}]*([+-]?\d+)", 1)
    minutes = digits.try_cast("double") * F.lit(share) + F.lit(0.5)
    return F.when(F.abs(minutes) < F.lit(9e18), F.floor(minutes))


def _fill(template: str, slots: dict[str, Column]) -> Column:
    """``template`` with its ``{slot}``s filled; a missing value prints as empty."""
    parts, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        parts += [F.lit(text), F.coalesce(slots[slot].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def render_lesson(requests: DataFrame) -> DataFrame:
    """Adds ``prompt`` to grounded requests; defaults are applied first."""
    filled = request_defaults(requests)
    slots = {c: F.col(c) for c in filled.columns}
    slots["language"] = F.coalesce(slots["language"], F.lit("English"))
    slots["language_note"] = pick(slots["language"], LANGUAGE_NOTES, LANGUAGE_NOTES["English"])
    slots["difficulty_note"] = pick(
        slots["difficultyLevel"], DIFFICULTY_NOTES, DIFFICULTY_NOTES["average"]
    )
    nan = F.lit("NaN")
    slots["main_minutes"] = F.coalesce(
        allocate_minutes(slots["duration"], 0.4).cast("string"), nan
    )
    slots["practice_minutes"] = F.coalesce(
        allocate_minutes(slots["duration"], 0.3).cast("string"), nan
    )
    context = slots["foundryContext"]
    slots["grounding"] = F.when(
        F.coalesce(context, F.lit("")) != "", _fill(GROUNDING, {"foundryContext": context})
    )
    return filled.withColumn("prompt", _fill(LESSON_TEMPLATE, slots))


def render(requests: DataFrame, template: str) -> DataFrame:
    """Adds ``prompt``, filling the template from columns of the same names."""
    return requests.withColumn("prompt", _fill(template, {c: F.col(c) for c in requests.columns}))


def request_grid(
    rows: DataFrame,
    durations: list[str] = DURATIONS,
    sizes: list[str] = CLASS_SIZES,
    levels: list[str] = DIFFICULTY_LEVELS,
) -> DataFrame:
    """Every row with every choice of duration, class size and level.

    The choices are literals, so this is an explode inside each row, not a join.
    """

    def choices(values: list[str]) -> Column:
        return F.explode(F.array(*(F.lit(v) for v in values)))

    return (
        rows.withColumn("duration", choices(durations))
        .withColumn("classSize", choices(sizes))
        .withColumn("difficultyLevel", choices(levels))
    )
