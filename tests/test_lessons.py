"""The lesson store, validation, defaults, grading and prompts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lessonloom.functions.lookups import lookup
from lessonloom.operators import errors, grading, lessons, prompts, quality, sections
from lessonloom.schemas import GENERATE_REQUIRED, LESSON_BODY, LESSON_REQUEST, LESSON_REQUIRED

T = [dt.datetime(2024, 1, 1, h) for h in range(5)]


def test_latest_row_decides(spark):
    log = spark.createDataFrame(
        [
            ("a", "save", T[0], 1), ("a", "delete", T[1], 2),
            ("b", "delete", T[0], 3), ("b", "save", T[1], 4),
            ("c", "save", T[2], 5), ("c", "save", T[2], 6),
            ("d", "delete", T[0], 7),
            ("e", "save", T[0], 8), ("e", "delete", T[1], 9), ("e", "save", T[2], 10),
        ],
        "id STRING, op STRING, ts TIMESTAMP_NTZ, seq BIGINT",
    )
    assert {(r.id, r.seq) for r in lessons.lesson_state(log).collect()} == {
        ("b", 4), ("c", 6), ("e", 10),
    }
    twice = log.unionByName(log)
    assert lessons.lesson_state(twice).count() == 3


def test_saving_twice_gives_two_rows_and_survives_the_disk(spark, tmp_path):
    body = ("C", "S", "B7", "Strand", "", "n", "v", "r")
    df = spark.createDataFrame([body, body], LESSON_BODY).withColumn(
        "request", F.monotonically_increasing_id()
    )
    events = lessons.save_event(df, ["request"], F.lit(T[0]).cast("timestamp_ntz"), F.col("request"))
    lessons.append_log(events, str(tmp_path / "log"))
    state = lessons.lesson_state(spark.read.parquet(str(tmp_path / "log")))
    assert state.count() == 2
    assert {r.sub_strand for r in state.collect()} == {"Strand"}


def test_delete_needs_an_id(spark):
    ids = spark.createDataFrame([("a",), ("",), (None,)], "id STRING")
    good, bad = lessons.delete_event(ids, F.lit(T[0]), F.lit(1))
    assert [r.id for r in good.collect()] == ["a"]
    assert {r.error for r in bad.collect()} == {"Lesson ID is required"} and bad.count() == 2


def test_validation_lists_missing_fields_in_order(spark):
    rows = [
        ("C", "S", "B7", "T", None, "n", "v", "r"),
        ("", "S", None, "T", "x", "n", "v", ""),
        (" ", "S", "B7", "T", "x", "n", "v", "r"),
    ]
    good, bad = quality.validate(spark.createDataFrame(rows, LESSON_BODY), LESSON_REQUIRED)
    assert good.count() == 2  # white space is not missing, the sub-strand is not required
    assert bad.first().error == "Missing required fields: indicatorCode, grade, studentReading"


def test_domain_counts_null_as_violation(spark):
    df = spark.createDataFrame([("B7",), ("B7",), ("X",), (None,)], "grade STRING")
    got = {r.value: r.violations for r in quality.domain_violations(df, {"grade": ["B7"]}).collect()}
    assert got == {"X": 1, None: 1}


def test_only_the_first_answer_counts(spark):
    answers = spark.createDataFrame(
        [(1, "q", "A", T[1], 1), (1, "q", "B", T[0], 2), (1, "r", "Z", T[0], 3)],
        "session INT, question STRING, label STRING, ts TIMESTAMP_NTZ, seq INT",
    )
    options = spark.createDataFrame(
        [("q", "A", False), ("q", "B", True), ("r", "A", True)],
        "question STRING, label STRING, is_correct BOOLEAN",
    )
    graded = grading.grade_answers(answers, options)
    assert {(r.question, r.label, r.is_correct) for r in graded.collect()} == {
        ("q", "B", True), ("r", "Z", False),
    }
    assert tuple(grading.scores(graded).first()) == (1, 1, 2)


def test_error_classes(value):
    cls = errors.error_class(F.col("x"))
    assert value(cls, "Failed to fetch lesson: invalid key") == "network"
    assert value(cls, "RATE LIMIT, timeout") == "quota"
    assert value(cls, "HTTP 504") == "timeout"
    assert value(cls, "403") == "api_key"
    assert value(cls, "boom") == "other"


def test_british_dates(value):
    ts = F.col("x").cast("timestamp_ntz")
    assert value(lessons.short_date(ts), "2024-09-03 10:00:00") == "3 Sept 2024"
    assert value(lessons.short_date(ts), "2024-05-13 10:00:00") == "13 May 2024"
    assert value(lessons.long_date(ts), "2024-09-03 10:00:00") == "3 September 2024"


def test_minutes(value):
    def both(x):
        return tuple(value(prompts.allocate_minutes(F.col("x"), s), x) for s in (0.4, 0.3))

    assert both("40") == (16, 12)
    assert both("60 min") == (24, 18)
    assert both("80") == (32, 24)
    assert both("abc") == (None, None) and both("") == (None, None)
    assert both(" -5") == (-2, -1)  # half rounds up


def test_lesson_prompt(spark):
    full = ("C1", "Add", "Maths", "B7", "Number", "", None, "", "", "gifted", "Twi")
    df = spark.createDataFrame([full], LESSON_REQUEST)
    contexts = spark.createDataFrame([("C1", "Facts.", 1)], "code STRING, context STRING, position INT")
    grounded = prompts.render_lesson(sections.ground(df, contexts)).first().prompt
    bare = prompts.render_lesson(sections.ground(df, contexts.where("false"))).first().prompt
    assert "Source material:\nFacts.\n" in grounded and "Source material" not in bare
    assert "Strand: Number / Number" in bare and "Taxonomy level: \n" in bare
    assert "60 minutes, of which 24 teaching and 18 practice" in bare
    assert prompts.DIFFICULTY_NOTES["average"] in bare and "Level (gifted)" in bare
    assert bare.endswith("Write the reading part in Twi.")
    assert "{" not in bare


def test_grid_and_citation(spark):
    df = spark.createDataFrame([("C1",)], "indicatorCode STRING")
    assert prompts.request_grid(df).distinct().count() == 36
    cited = sections.with_citation(df).first().citations
    assert (cited[0]["id"], cited[0]["type"]) == ("foundry-C1", "foundry")


def test_grounding_never_multiplies(spark):
    df = spark.createDataFrame([("C1",), ("C2",)], "indicatorCode STRING")
    contexts = spark.createDataFrame(
        [("C1", "b", 1), ("C1", "a", 2), ("C1", "", 0), ("C2", "", 3)],
        "code STRING, context STRING, position INT",
    )
    got = {r.indicatorCode: (r.foundryContext, r.grounded) for r in sections.ground(df, contexts).collect()}
    assert got == {"C1": ("b", True), "C2": (None, False)}
    assert GENERATE_REQUIRED[0] == "indicatorCode"


def test_lookup_falls_back_to_the_key(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "slug STRING")
    dim = spark.createDataFrame([("a", "A", 2), ("a", "First", 1), ("c", "C", 1)], "k STRING, v STRING, n INT")
    got = {r.slug: r.out for r in lookup(df, dim, "slug", "k", "v", "out", ["n"]).collect()}
    assert got == {"a": "First", "b": "b", "c": "C"}
