"""Explicit schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

# Stored tables of the standards tree and the lesson store.
SUBJECTS = "id STRING, name STRING, slug STRING, created_at TIMESTAMP_NTZ"
STRANDS = "id STRING, subject_id STRING, name STRING"
SUB_STRANDS = "id STRING, strand_id STRING, name STRING"
INDICATORS = (
    "id STRING, sub_strand_id STRING, code STRING, text STRING, blooms_level STRING, grade STRING"
)
REJECTED = "level STRING, parent STRING, name STRING"
LESSON_LOG = (
    "id STRING, op STRING, ts TIMESTAMP_NTZ, seq BIGINT, indicator_code STRING, subject STRING, "
    "grade STRING, strand STRING, sub_strand STRING, teacher_notes STRING, visual_prompts STRING, "
    "student_reading STRING"
)

# Column that keeps a request line which is not JSON.
MALFORMED = "malformed"

# Nested documents.
STANDARDS_DOC = (
    "subject STRUCT<name: STRING, slug: STRING>, "
    "strands ARRAY<STRUCT<name: STRING, subStrands: ARRAY<STRUCT<name: STRING, "
    "indicators: ARRAY<STRUCT<code: STRING, text: STRING, bloomsLevel: STRING, grade: STRING>>>>>>"
)
LESSON_BODY = (
    "indicatorCode STRING, subject STRING, grade STRING, strand STRING, subStrand STRING, "
    "teacherNotes STRING, visualPrompts STRING, studentReading STRING"
)
LESSON_REQUEST = (
    "indicatorCode STRING, indicatorText STRING, subject STRING, grade STRING, strand STRING, "
    "subStrand STRING, bloomsLevel STRING, duration STRING, classSize STRING, "
    "difficultyLevel STRING, language STRING"
)
ACTIVITY = (
    "STRUCT<mcqs: ARRAY<STRUCT<question: STRING, "
    "options: ARRAY<STRUCT<label: STRING, text: STRING, isCorrect: BOOLEAN>>, "
    "explanation: STRING>>, "
    "writingPrompts: ARRAY<STRUCT<prompt: STRING, sampleAnswer: STRING>>, "
    "rubric: ARRAY<STRUCT<criterion: STRING, excellent: STRING, satisfactory: STRING, "
    "needsWork: STRING>>>"
)
BREAKDOWN = (
    "STRUCT<primaryLevel: STRING, levels: ARRAY<STRUCT<level: STRING, active: BOOLEAN, "
    "description: STRING, sampleActivity: STRING>>, teachingSequence: ARRAY<STRING>, "
    "successCriteria: ARRAY<STRING>>"
)

# The declared vocabularies of the data model.
BLOOMS_LEVELS = ["Remember", "Understand", "Apply", "Analyse", "Evaluate", "Create"]
DIFFICULTY_LEVELS = ["struggling", "average", "advanced"]
DURATIONS = ["40", "60", "80"]
CLASS_SIZES = ["25", "35", "45", "60"]

# Required fields of each request, in reporting order.
LESSON_REQUIRED = [
    "indicatorCode",
    "subject",
    "grade",
    "strand",
    "teacherNotes",
    "visualPrompts",
    "studentReading",
]
GENERATE_REQUIRED = ["indicatorCode", "indicatorText", "subject", "grade", "strand"]
ACTIVITY_REQUIRED = ["indicatorCode", "indicatorText", "subject", "grade"]

# Files of the shared test tables that the registered queries read.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}
