"""Splitting generated responses into lesson sections, and assembling lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.lookups import left_match
from lessonloom.functions.rows import each
from lessonloom.functions.text import or_default, trimmed

# The markers between the sections, and the parse error.
TEACHER_MARK = "---TEACHER NOTES---"
VISUAL_MARK = "---VISUAL CONTENT PROMPTS---"
READING_MARK = "---STUDENT READING MATERIAL---"
MARKERS = (TEACHER_MARK, VISUAL_MARK, READING_MARK)
PARSE_ERROR = "Failed to parse lesson sections from response"

# The citation attached to every lesson.
CITATION_ID_PREFIX = "foundry-"
CITATION_TEXT_PREFIX = "NaCCA Indicator "
CITATION_SOURCE = "Azure Foundry IQ — NaCCA Curriculum Database"
CITATION_TYPE = "foundry"

SECTIONS = ["teacherNotes", "visualPrompts", "studentReading"]


def _without_first(col: Column, mark: str) -> Column:
    at = F.instr(col, mark)
    cut = F.concat(F.substr(col, F.lit(1), at - 1), F.substr(col, at + len(mark)))
    return F.when(at > 0, cut).otherwise(col)


def section_responses(
    df: DataFrame, text: str = "text", markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """Adds the three sections, ``status`` (ok / failed), ``error`` and ``rawText``.

    What stands before the visual marker is the notes, less the first teacher
    marker; the reading follows the first reading marker after it. Text behind
    a repeated marker is dropped. One empty section fails the response, whose
    text stays in ``rawText`` so that it can be run again. A narrow projection: no shuffle, in batch or in a stream.
    """
    teacher, visual, reading = markers
    body = F.coalesce(F.col(text), F.lit(""))
    rest = F.split_part(body, F.lit(visual), F.lit(2))
    found = {
        "teacherNotes": trimmed(
            _without_first(F.split_part(body, F.lit(visual), F.lit(1)), teacher)
        ),
        "visualPrompts": trimmed(F.split_part(rest, F.lit(reading), F.lit(1))),
        "studentReading": trimmed(F.split_part(rest, F.lit(reading), F.lit(2))),
    }
    others = [c for c in df.columns if c != text]
    cut = df.select(*others, F.col(text).alias("rawText"), *(col.alias(name) for name, col in found.items()))
    ok = (F.col(SECTIONS[0]) != "") & (F.col(SECTIONS[1]) != "") & (F.col(SECTIONS[2]) != "")
    return cut.select(
        *others,
        *(F.when(ok, F.col(c)).alias(c) for c in SECTIONS),
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(~ok, PARSE_ERROR).alias("error"),
        F.when(~ok, F.col("rawText")).alias("rawText"),
    )


def citation(code: Column) -> Column:
    """The citation of an indicator code."""
    return F.struct(
        F.concat(F.lit(CITATION_ID_PREFIX), code).alias("id"),
        F.concat(F.lit(CITATION_TEXT_PREFIX), code).alias("text"),
        F.lit(CITATION_SOURCE).alias("source"),
        F.lit(CITATION_TYPE).alias("type"),
    )


def with_citation(df: DataFrame, code: str = "indicatorCode") -> DataFrame:
    """Adds ``citations``, one per lesson, grounded or not."""
    return df.withColumn("citations", F.array(citation(F.col(code))))


def ground(requests: DataFrame, contexts: DataFrame, order: str = "position") -> DataFrame:
    """Adds ``foundryContext`` where a context exists, and ``grounded``.

    ``contexts``: code, context and ``order``, which tells the contexts of a code
    apart. A request without one goes on ungrounded, and an empty context counts
    as none. Of several the first by ``order`` is taken, so requests never
    multiply. It is found on code and ``order`` alone; the texts are joined to
    the requests once, without being sorted or combined before.
    """
    usable = contexts.where(F.col("context") != "")
    first = usable.groupBy(F.col("code").alias("_code")).agg(F.min(order).alias("_at"))
    placed = left_match(requests, first, "indicatorCode", "_code")

    def pair(code: str, at: str) -> Column:
        return F.concat_ws("\u001f", code, F.col(at).cast("string"))

    texts = usable.select(pair("code", order).alias("_pair_key"), F.col("context").alias("foundryContext"))
    wanted = F.when(F.col("_at").isNotNull(), pair("indicatorCode", "_at"))
    matched = left_match(placed.withColumn("_pair", wanted), texts, "_pair", "_pair_key")
    return matched.drop("_at", "_pair").withColumn("grounded", F.col("foundryContext").isNotNull())


def assemble(requests: DataFrame, sections: DataFrame, key: str = "request_id") -> DataFrame:
    """Lesson records: well-formed sections joined to their (grounded) requests.

    Failed ones are dropped by exploding none-or-one: a filter on the status
    would be pushed below the sectioning and do that work a second time.
    """
    whole = F.when(F.col("status") == "ok", F.array(F.struct(*SECTIONS)))
    good = each(sections, [key], whole, "_p", "_s").select(key, "_s.*")
    joined = requests.join(good, key)
    return with_citation(joined).select(
        key,
        *SECTIONS,
        "indicatorCode",
        "subject",
        "grade",
        "strand",
        or_default(F.col("difficultyLevel"), "average").alias("difficultyLevel"),
        "citations",
        "foundryContext",
    )
