"""Assessment JSON: strict parsing, explosion into rows, contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.rows import each
from lessonloom.functions.text import strict_object, trimmed
from lessonloom.schemas import ACTIVITY, BLOOMS_LEVELS, BREAKDOWN

# The contract stated for generated activities.
MCQ_COUNT = 5
OPTION_LABELS = ["A", "B", "C", "D"]
WRITING_PROMPT_COUNT = 2
CRITERION_COUNT = 4


def without_fences(col: Column) -> Column:
    """Code fences removed wherever they stand, ends trimmed."""
    opened = F.regexp_replace(col, "```json\n?", "")
    return trimmed(F.regexp_replace(opened, "```\n?", ""))


def _parsed(df: DataFrame, text: str, ddl: str, out: str) -> DataFrame:
    cleaned = df.withColumn("_clean", without_fences(F.col(text))).drop(text)
    parsed = cleaned.withColumn(out, strict_object(F.col("_clean"), ddl)).drop("_clean")
    return parsed.withColumn(
        "status", F.when(F.col(out).isNotNull(), "ok").otherwise("failed")
    )


def parse_activities(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by ``activity`` and ``status``; bad JSON is ``failed``."""
    return _parsed(df, text, ACTIVITY, "activity")


def parse_breakdown(df: DataFrame, text: str = "text") -> DataFrame:
    """Taxonomy breakdowns, parsed as strictly as activities."""
    return _parsed(df, text, BREAKDOWN, "breakdown")


def explode_questions(parsed: DataFrame, key: str) -> DataFrame:
    """One row per question with its explanation and number of options."""
    return each(parsed, [key], "activity.mcqs", "q", "mcq").select(
        key,
        (F.col("q") + 1).alias("mcq_no"),
        F.col("mcq.question").alias("question"),
        F.array_size("mcq.options").alias("options"),
        F.col("mcq.explanation").alias("explanation"),
    )


def explode_options(parsed: DataFrame, key: str) -> DataFrame:
    """One row per option, with the ordinals of question and option from 1."""
    questions = each(parsed, [key], "activity.mcqs", "q", "mcq")
    options = each(
        questions,
        [key, "q", F.col("mcq.question").alias("question")],
        "mcq.options",
        "o",
        "option",
    )
    return options.select(
        key,
        (F.col("q") + 1).alias("mcq_no"),
        "question",
        (F.col("o") + 1).alias("option_no"),
        F.col("option.label").alias("label"),
        F.col("option.text").alias("option_text"),
        F.col("option.isCorrect").alias("is_correct"),
    )


def explode_prompts(parsed: DataFrame, key: str) -> DataFrame:
    """One row per writing prompt."""
    return each(parsed, [key], "activity.writingPrompts", "p", "w").select(
        key,
        (F.col("p") + 1).alias("prompt_no"),
        F.col("w.prompt").alias("prompt"),
        F.col("w.sampleAnswer").alias("sample_answer"),
    )


def explode_rubric(parsed: DataFrame, key: str) -> DataFrame:
    """One row per rubric criterion."""
    return each(parsed, [key], "activity.rubric", "p", "r").select(
        key,
        (F.col("p") + 1).alias("criterion_no"),
        F.col("r.criterion").alias("criterion"),
        F.col("r.excellent").alias("excellent"),
        F.col("r.satisfactory").alias("satisfactory"),
        F.col("r.needsWork").alias("needs_work"),
    )


def check_activities(parsed: DataFrame, key: str) -> DataFrame:
    """Contract violations of each document, comma separated; empty if none, null if
    the document did not parse."""
    a = F.col("activity")
    labels = F.array(*(F.lit(label) for label in OPTION_LABELS))

    def bad_labels(mcq: Column) -> Column:
        return ~F.transform(mcq["options"], lambda o: o["label"]).eqNullSafe(labels)

    def bad_key(mcq: Column) -> Column:
        return F.coalesce(F.size(F.filter(mcq["options"], lambda o: o["isCorrect"])), F.lit(0)) != 1

    def length(col: Column) -> Column:
        return F.coalesce(F.array_size(col), F.lit(0))

    found = F.array_compact(
        F.array(
            F.when(length(a["mcqs"]) != MCQ_COUNT, "mcq_count"),
            F.when(F.exists(a["mcqs"], bad_labels), "option_labels"),
            F.when(F.exists(a["mcqs"], bad_key), "correct_options"),
            F.when(length(a["writingPrompts"]) != WRITING_PROMPT_COUNT, "writing_prompt_count"),
            F.when(length(a["rubric"]) != CRITERION_COUNT, "criterion_count"),
        )
    )
    # The test of the result comes after parsing, or it would parse once more.
    joined = F.when(a.isNotNull(), F.array_join(found, ","))
    return parsed.select(key, joined.alias("violations"))


def breakdown_levels(parsed: DataFrame, key: str) -> DataFrame:
    """One row per taxonomy level of a breakdown; ``complete`` if all six occur."""
    b = F.col("breakdown")
    names = F.transform(b["levels"], lambda x: x["level"])
    expected = F.array(*(F.lit(level) for level in BLOOMS_LEVELS))
    complete = F.size(F.array_except(expected, names)) == 0
    rows = each(
        parsed,
        [
            key,
            b["primaryLevel"].alias("primary_level"),
            complete.alias("complete"),
            F.array_size(b["teachingSequence"]).alias("teaching_steps"),
            F.array_size(b["successCriteria"]).alias("success_criteria"),
        ],
        b["levels"],
        "p",
        "l",
    )
    return rows.select(
        key,
        "primary_level",
        "complete",
        "teaching_steps",
        "success_criteria",
        (F.col("p") + 1).alias("level_no"),
        F.col("l.level").alias("level"),
        F.col("l.active").alias("active"),
        F.col("l.description").alias("description"),
        F.col("l.sampleActivity").alias("sample_activity"),
    )
