"""Reading passage and comprehension questions of a student text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.rows import each
from lessonloom.functions.text import WS, at_line_start, trimmed

# The question heading, and what opens a question.
HEADING = rf"(?i)###?[{WS}]*Check Your Understanding"
BOLD_HEADING = rf"(?i)(?:###?[{WS}]*|\*\*)Check Your Understanding(?:\*\*)?"
QUESTION_START = rf"{at_line_start('[0-9]')}\d*[.)]|{at_line_start('-')}[{WS}]+"


def split_worksheet(df: DataFrame, text: str = "text", accept_bold: bool = False) -> DataFrame:
    """Replaces ``text`` by ``reading`` and ``questions`` (an array).

    Without numbering, a non-empty question section is one question. A heading
    that is bold only counts when ``accept_bold``.
    """
    heading = BOLD_HEADING if accept_bold else HEADING
    others = [c for c in df.columns if c != text]
    parts = df.select(
        *others, F.split(F.coalesce(F.col(text), F.lit("")), heading).alias("_parts")
    )
    section = F.coalesce(trimmed(F.get("_parts", F.lit(1))), F.lit(""))
    cut = parts.select(
        *others, trimmed(F.get("_parts", F.lit(0))).alias("reading"), section.alias("_section")
    )
    found = F.filter(
        F.transform(F.split("_section", QUESTION_START), trimmed), lambda q: q != ""
    )
    questions = F.when(F.col("_section") == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(
        F.when(F.size(found) > 0, found).otherwise(F.array("_section"))
    )
    return cut.select(*others, "reading", questions.alias("questions"))


def worksheet_questions(
    df: DataFrame, key: str, text: str = "text", accept_bold: bool = False
) -> DataFrame:
    """One row per question, numbered from 1."""
    cut = split_worksheet(df.select(key, text), text, accept_bold)
    return each(cut, [key], "questions", "p", "question").select(
        key, (F.col("p") + 1).alias("question_no"), "question"
    )
