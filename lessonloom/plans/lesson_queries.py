"""Queries over the lesson store, requests and answers, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.operators import errors, grading, lessons, quality, sections
from lessonloom.operators import prompts as p
from lessonloom.plans import bindings as b
from lessonloom.schemas import (
    ACTIVITY_REQUIRED,
    BLOOMS_LEVELS,
    CLASS_SIZES,
    DIFFICULTY_LEVELS,
    DURATIONS,
    GENERATE_REQUIRED,
    LESSON_REQUIRED,
)
from lessonloom.session import fresh_dir
from lessonloom.sources import lesson_log
from lessonloom.sources.json_docs import read_requests
from lessonloom.sources.tables import read_table, read_texts

SUBJECT, GRADE, LESSON_ID = "purchase", "B8", 42
NOON = "TIMESTAMP_NTZ'2024-06-01 12:00:00'"


def _events(spark, folder) -> DataFrame:
    return read_table(spark, folder, "events")


def _lessons(build):
    return lambda spark, folder: build(b.lessons(_events(spark, folder)))


def _requests(build):
    return lambda spark, folder: build(b.requests(read_table(spark, folder, "part")))


def lesson_append(spark, folder) -> DataFrame:
    bodies = b.lesson_bodies(read_table(spark, folder, "part"))
    good, _ = quality.validate(bodies, LESSON_REQUIRED)
    return lessons.save_event(good, ["request_id"], F.expr(NOON), F.col("request_id"))


def lesson_delete(spark, folder) -> DataFrame:
    """Every event saved a lesson; the failed ones are deleted an hour later."""
    events = _events(spark, folder)
    saved = events.select(
        F.col("event_id").alias("id"),
        F.lit("save").alias("op"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("subject"),
    )
    failed = events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), F.expr("ts + INTERVAL 1 HOUR").alias("at")
    )
    deleted, _ = lessons.delete_event(failed, F.col("at"), F.col("id"))
    log = saved.unionByName(deleted, allowMissingColumns=True)
    return lessons.lesson_state(log)


def lesson_store(spark, folder) -> DataFrame:
    """Saves appended to the stored log, delivered once more, some deleted; read back as state."""
    path = fresh_dir(spark, "lessons")
    saved = lesson_append(spark, folder)
    lessons.append_log(saved, path)
    lessons.append_log(saved, path)
    unwanted = read_table(spark, folder, "part").where(F.col("p_partkey") % 9 == 0).select(
        F.sha2(F.col("p_partkey").cast("string"), 256).alias("id"), F.col("p_partkey").alias("seq")
    )
    deleted, _ = lessons.delete_event(unwanted, F.expr(f"{NOON} + INTERVAL 1 HOUR"), F.col("seq"))
    lessons.append_log(deleted, path)
    return lessons.lesson_state(lessons.read_log(spark, path))


def lesson_compacted(spark, folder) -> DataFrame:
    """The stored log with a compaction between the saves and the deletes, and one after a
    second delivery; what the last does not reach is merged when read."""
    path = fresh_dir(spark, "lessons")
    saved = lesson_append(spark, folder)
    lesson_log.append(saved, path)
    lesson_log.compact(spark, path)
    unwanted = read_table(spark, folder, "part").where(F.col("p_partkey") % 9 == 0).select(
        F.sha2(F.col("p_partkey").cast("string"), 256).alias("id"), F.col("p_partkey").alias("seq")
    )
    deleted, _ = lessons.delete_event(unwanted, F.expr(f"{NOON} + INTERVAL 1 HOUR"), F.col("seq"))
    lesson_log.append(deleted.where(F.col("seq") % 2 == 0), path)
    lesson_log.append(saved, path)
    lesson_log.compact(spark, path)
    lesson_log.vacuum(spark, path)
    lesson_log.append(deleted, path)
    return lesson_log.read_state(spark, path)


def json_requests(spark, folder) -> DataFrame:
    """Request bodies as JSON lines, some of them no JSON, written, read back and checked."""
    path = fresh_dir(spark, "requests")
    requests = b.requests(read_table(spark, folder, "part"))
    body = F.to_json(F.struct(*(c for c in requests.columns if c != "request_id")))
    broken = F.concat(F.lit("request "), F.col("request_id").cast("string"), F.lit(" {"))
    requests.select(F.when(F.col("request_id") % 17 == 3, broken).otherwise(body).alias("value")).write.text(path)
    return quality.with_status(read_requests(spark, path), GENERATE_REQUIRED)


def lesson_dates(spark, folder) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        lessons.short_date(F.col("o_orderdate")).alias("short_date"),
        lessons.long_date(F.col("o_orderdate")).alias("long_date"),
    )


def validate_lessons(spark, folder) -> DataFrame:
    bodies = b.lesson_bodies(read_table(spark, folder, "part"))
    return quality.with_status(bodies, LESSON_REQUIRED).select("request_id", "valid", "error")


def _checked(required, listed):
    return _requests(
        lambda r: quality.with_status(r, required, listed).select("request_id", "valid", "error")
    )


def graded(spark, folder) -> DataFrame:
    events = _events(spark, folder)
    return grading.grade_answers(b.answers(events), b.options(events))


def citations(spark, folder) -> DataFrame:
    """Citations of the valid requests; the others keep a row with their error."""
    requests = b.requests(read_table(spark, folder, "part"))
    checked = sections.with_citation(quality.with_status(requests, GENERATE_REQUIRED))
    cited = F.when(F.col("valid"), F.col("citations"))
    return checked.select("request_id", "error", F.inline_outer(cited))


def ground_requests(spark, folder) -> DataFrame:
    requests = b.requests(read_table(spark, folder, "part"))
    return sections.ground(requests, b.contexts(read_texts(spark, folder, "documents", "doc_id")))


def assemble_lessons(spark, folder) -> DataFrame:
    documents = read_texts(spark, folder, "documents", "doc_id")
    cut = sections.section_responses(b.responses(documents)).withColumnRenamed(
        "doc_id", "request_id"
    )
    return sections.assemble(ground_requests(spark, folder), cut).withColumn(
        "citations", F.to_json("citations")
    )


def _missing(name: str) -> str:
    return f"""CASE WHEN "{name}" IS NULL OR "{name}" = '' THEN '{name}' END"""


def _validate_sql(cte: str, source: str, required: list[str], listed: bool) -> str:
    error = "'Missing required fields'"
    if listed:
        error += " || ': ' || array_to_string(m, ', ')"
    return f"""
WITH {cte}, checked AS (
  SELECT request_id,
    list_filter([{", ".join(_missing(c) for c in required)}], lambda x: x IS NOT NULL) AS m
  FROM {source})
SELECT request_id, len(m) = 0 AS valid, CASE WHEN len(m) > 0 THEN {error} END AS error FROM checked
"""


def _domain_sql() -> str:
    checks = {
        "bloomsLevel": BLOOMS_LEVELS,
        "difficultyLevel": DIFFICULTY_LEVELS,
        "duration": DURATIONS,
        "classSize": CLASS_SIZES,
        "grade": ["Brand#1", "Brand#2"],
    }
    parts = []
    for column, values in checks.items():
        allowed = ", ".join(f"'{v}'" for v in values)
        parts.append(
            f"""SELECT '{column}' AS "column", "{column}" AS value, count(*) AS violations
            FROM requests WHERE "{column}" IS NULL OR "{column}" NOT IN ({allowed})
            GROUP BY "{column}" """
        )
    return f"WITH {b.REQUESTS_SQL} " + " UNION ALL ".join(parts)


DEFAULTED_SQL = """
filled AS (
  SELECT request_id, "indicatorCode", "indicatorText", subject, grade, strand,
    coalesce(nullif("subStrand", ''), strand) AS "subStrand", "bloomsLevel",
    coalesce(nullif(duration, ''), '60') AS duration,
    coalesce(nullif("classSize", ''), '35') AS "classSize",
    coalesce(nullif("difficultyLevel", ''), 'average') AS "difficultyLevel", language
  FROM requests)
"""

_MINUTES = (
    "CAST(floor(try_cast(nullif(regexp_extract(duration, '^\\s*([+-]?\\d+)', 1), '') AS DOUBLE)"
    " * %s + 0.5) AS BIGINT)"
)

GROUNDED_SQL = """
grounded AS (
  SELECT r.*, c.context AS "foundryContext", c.context IS NOT NULL AS grounded
  FROM requests r LEFT JOIN (SELECT * FROM contexts WHERE context <> '') c
    ON r."indicatorCode" = c.code)
"""

SECTIONS_SQL = """
halves AS (
  SELECT doc_id, string_split(text, '---VISUAL CONTENT PROMPTS---') AS h FROM responses),
cuts AS (
  SELECT doc_id, h[1] AS notes, string_split(h[2], '---STUDENT READING MATERIAL---') AS s
  FROM halves),
first_mark AS (SELECT *, strpos(notes, '---TEACHER NOTES---') AS mark FROM cuts),
trimmed AS (
  SELECT doc_id,
    regexp_replace(CASE WHEN mark > 0 THEN substr(notes, 1, mark - 1) || substr(notes, mark + 19)
      ELSE notes END, '^\\s+|\\s+$', '', 'g') AS notes,
    regexp_replace(coalesce(s[1], ''), '^\\s+|\\s+$', '', 'g') AS visual,
    regexp_replace(coalesce(s[2], ''), '^\\s+|\\s+$', '', 'g') AS reading
  FROM first_mark),
sectioned AS (
  SELECT *, notes <> '' AND visual <> '' AND reading <> '' AS ok FROM trimmed)
"""


def _prompt_sql() -> str:
    return f"""
WITH {b.REQUESTS_SQL}, {b.CONTEXTS_SQL}, {GROUNDED_SQL},
{DEFAULTED_SQL.replace("FROM requests", "FROM grounded").replace("language", "language, "
    '"foundryContext"')},
minutes AS (
  SELECT *, coalesce(CAST({_MINUTES % "0.4"} AS VARCHAR), 'NaN') AS main,
    coalesce(CAST({_MINUTES % "0.3"} AS VARCHAR), 'NaN') AS practice, chr(10) AS nl
  FROM filled)
SELECT request_id,
  'Prepare a lesson for this standard.' || nl
  || 'Subject: ' || coalesce(subject, '') || nl
  || 'Grade: ' || coalesce(grade, '') || nl
  || 'Strand: ' || strand || ' / ' || "subStrand" || nl
  || 'Standard ' || "indicatorCode" || ': ' || "indicatorText" || nl
  || 'Taxonomy level: ' || coalesce("bloomsLevel", '') || nl
  || 'Time: ' || duration || ' minutes, of which ' || main || ' teaching and ' || practice
  || ' practice' || nl
  || 'Class: ' || "classSize" || ' learners' || nl
  || 'Language: {p.LANGUAGE_NOTES["English"]}' || nl
  || 'Level (' || "difficultyLevel" || '): ' || CASE "difficultyLevel"
       WHEN 'struggling' THEN '{p.DIFFICULTY_NOTES["struggling"]}'
       WHEN 'advanced' THEN '{p.DIFFICULTY_NOTES["advanced"]}'
       ELSE '{p.DIFFICULTY_NOTES["average"]}' END || nl
  || CASE WHEN "foundryContext" IS NULL THEN ''
       ELSE 'Source material:' || nl || "foundryContext" || nl END || nl
  || 'Answer in three parts under these markers:' || nl
  || '---TEACHER NOTES---' || nl || '---VISUAL CONTENT PROMPTS---' || nl
  || '---STUDENT READING MATERIAL---' || nl
  || 'Write the reading part in ' || coalesce(language, 'English') || '.' AS prompt
FROM minutes
"""


def _append_sql(op: str, more: str = "") -> str:
    return f"""WITH {b.BODIES_SQL}
        SELECT sha256(CAST(request_id AS VARCHAR)) AS id, {op}
          TIMESTAMP '2024-06-01 12:00:00' AS ts, request_id AS seq,
          "indicatorCode" AS indicator_code, subject, grade, strand,
          CASE WHEN "subStrand" = '' THEN strand ELSE "subStrand" END AS sub_strand,
          "teacherNotes" AS teacher_notes, "visualPrompts" AS visual_prompts,
          "studentReading" AS student_reading
        FROM bodies
        WHERE "indicatorCode" <> '' AND subject <> '' AND grade <> '' AND strand <> ''
          AND "teacherNotes" <> '' AND "visualPrompts" <> '' AND "studentReading" <> ''{more}"""


def _json_requests_sql() -> str:
    fields = [
        "indicatorCode", "indicatorText", "subject", "grade", "strand", "subStrand", "bloomsLevel",
        "duration", "classSize", "difficultyLevel", "language",
    ]
    read = ", ".join(f"""CASE WHEN NOT broken THEN "{f}" END AS "{f}" """ for f in fields)
    return f"""WITH {b.REQUESTS_SQL},
        lines AS (SELECT *, request_id % 17 = 3 AS broken FROM requests),
        missed AS (
          SELECT *, list_filter([{", ".join(_missing(c) for c in GENERATE_REQUIRED)}], lambda x: x IS NOT NULL) AS m
          FROM lines)
        SELECT {read}, CASE WHEN broken THEN 'request ' || request_id || ' {{' END AS malformed,
          NOT broken AND len(m) = 0 AS valid,
          CASE WHEN broken THEN 'Request is not valid JSON'
            WHEN len(m) > 0 THEN 'Missing required fields: ' || array_to_string(m, ', ') END AS error
        FROM missed"""


QUERIES = {
    "lessons_list": _lessons(lessons.list_lessons),
    "lessons_filter": _lessons(lambda s: lessons.list_lessons(s, SUBJECT, GRADE)),
    "lesson_by_id": _lessons(lambda s: lessons.lesson_by_id(s, LESSON_ID)),
    "lesson_removed": _lessons(lambda s: lessons.without_lesson(s, LESSON_ID)),
    "lessons_filter_count": _lessons(lambda s: lessons.count_lessons(s, SUBJECT, GRADE)),
    "saved_count": _lessons(lessons.count_lessons),
    "lesson_dates": lesson_dates,
    "lesson_append": lesson_append,
    "lesson_delete": lesson_delete,
    "lesson_store": lesson_store,
    "lesson_compacted": lesson_compacted,
    "json_requests": json_requests,
    "lesson_state": lambda spark, folder: lessons.lesson_state(
        b.change_log(_events(spark, folder))
    ),
    "validate_lessons": validate_lessons,
    "validate_generate": _checked(GENERATE_REQUIRED, False),
    "validate_activity": _checked(ACTIVITY_REQUIRED, False),
    "domain_check": _requests(
        lambda r: quality.domain_violations(
            r,
            {
                "bloomsLevel": BLOOMS_LEVELS,
                "difficultyLevel": DIFFICULTY_LEVELS,
                "duration": DURATIONS,
                "classSize": CLASS_SIZES,
                "grade": ["Brand#1", "Brand#2"],
            },
        )
    ),
    "apply_defaults": _requests(p.request_defaults),
    "grade_answers": graded,
    "quiz_scores": lambda spark, folder: grading.scores(graded(spark, folder)),
    "error_classes": lambda spark, folder: errors.error_counts(
        b.error_messages(_events(spark, folder))
    ),
    "ground_requests": ground_requests,
    "citations": citations,
    "assemble_lessons": assemble_lessons,
    "duration_alloc": _requests(
        lambda r: r.select(
            "request_id",
            "duration",
            p.allocate_minutes(F.col("duration"), 0.4).alias("main_minutes"),
            p.allocate_minutes(F.col("duration"), 0.3).alias("practice_minutes"),
        )
    ),
    "render_lesson_prompts": lambda spark, folder: p.render_lesson(
        ground_requests(spark, folder)
    ).select("request_id", "prompt"),
    "render_activity_prompts": _requests(
        lambda r: p.render(r, p.ACTIVITY_TEMPLATE).select("request_id", "prompt")
    ),
    "render_mapping_prompts": _requests(
        lambda r: p.render(r, p.MAPPING_TEMPLATE).select("request_id", "prompt")
    ),
    "request_grid": _requests(
        lambda r: p.request_grid(r.select("request_id", "indicatorCode", "subject", "grade"))
    ),
}

ORACLES = {
    "lessons_list": f"WITH {b.LESSONS_SQL} SELECT * FROM lessons ORDER BY created_at DESC, id",
    "lessons_filter": f"""WITH {b.LESSONS_SQL} SELECT * FROM lessons
        WHERE subject = '{SUBJECT}' AND grade = '{GRADE}' ORDER BY created_at DESC, id""",
    "lesson_by_id": f"WITH {b.LESSONS_SQL} SELECT * FROM lessons WHERE id = {LESSON_ID}",
    "lesson_removed": f"WITH {b.LESSONS_SQL} SELECT * FROM lessons WHERE id <> {LESSON_ID}",
    "lessons_filter_count": f"""WITH {b.LESSONS_SQL}
        SELECT count(*) AS lessons,
          CASE WHEN count(*) > 99 THEN '99+' ELSE CAST(count(*) AS VARCHAR) END AS badge
        FROM lessons WHERE subject = '{SUBJECT}' AND grade = '{GRADE}'""",
    "saved_count": f"""WITH {b.LESSONS_SQL}
        SELECT count(*) AS lessons,
          CASE WHEN count(*) > 99 THEN '99+' ELSE CAST(count(*) AS VARCHAR) END AS badge
        FROM lessons""",
    "lesson_dates": """SELECT o_orderkey,
          replace(strftime(o_orderdate, '%-d %b %Y'), 'Sep ', 'Sept ') AS short_date,
          strftime(o_orderdate, '%-d %B %Y') AS long_date
        FROM orders""",
    "lesson_append": _append_sql("'save' AS op,"),
    "lesson_store": _append_sql("", " AND request_id % 9 <> 0"),
    "lesson_compacted": _append_sql("", " AND request_id % 9 <> 0"),
    "json_requests": _json_requests_sql(),
    "lesson_delete": """SELECT event_id AS id, ts, event_id AS seq, event_type AS subject
        FROM events WHERE event_type <> 'error'""",
    "lesson_state": f"""WITH {b.LOG_SQL}
        SELECT id, ts, seq, subject FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS rn FROM log)
        WHERE rn = 1 AND op = 'save'""",
    "validate_lessons": _validate_sql(b.BODIES_SQL, "bodies", LESSON_REQUIRED, True),
    "validate_generate": _validate_sql(b.REQUESTS_SQL, "requests", GENERATE_REQUIRED, False),
    "validate_activity": _validate_sql(b.REQUESTS_SQL, "requests", ACTIVITY_REQUIRED, False),
    "domain_check": _domain_sql(),
    "apply_defaults": f"WITH {b.REQUESTS_SQL}, {DEFAULTED_SQL} SELECT * FROM filled",
    "grade_answers": """SELECT user_id AS session, event_type AS question,
          CAST(k % 4 AS INTEGER) AS label, k % 4 = length(event_type) % 4 AS is_correct
        FROM (
          SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
            row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
          FROM events) WHERE rn = 1""",
    "quiz_scores": """SELECT user_id AS session,
          count(*) FILTER (WHERE k % 4 = length(event_type) % 4) AS correct, count(*) AS answered
        FROM (
          SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
            row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
          FROM events) WHERE rn = 1 GROUP BY user_id""",
    "error_classes": f"""WITH {b.ERRORS_SQL}, classed AS (
          SELECT CASE
            WHEN regexp_matches(lower(message), 'rate limit|429|quota') THEN 'quota'
            WHEN regexp_matches(lower(message), 'network|fetch') THEN 'network'
            WHEN regexp_matches(lower(message), 'timeout|504|timed out') THEN 'timeout'
            WHEN regexp_matches(lower(message), 'invalid|401|403|api key|unauthorized')
              THEN 'api_key'
            ELSE 'other' END AS error_class
          FROM errors)
        SELECT error_class, count(*) AS messages,
          CASE error_class WHEN 'quota' THEN 'API quota reached' WHEN 'network' THEN 'Network issue'
            WHEN 'timeout' THEN 'Generation timed out' WHEN 'api_key' THEN 'API key issue'
            ELSE 'Generation failed' END AS title,
          CASE error_class
            WHEN 'quota' THEN
              'The AI service is busy. Wait a moment and retry — it usually resolves quickly.'
            WHEN 'network' THEN 'Check your internet connection and retry.'
            WHEN 'timeout' THEN 'The AI took too long to respond. Retrying almost always fixes this.'
            WHEN 'api_key' THEN 'There''s a problem with the API credentials. Please contact support.'
            ELSE 'Something went wrong on our end. Please try again.' END AS detail
        FROM classed GROUP BY error_class""",
    "ground_requests": f"""WITH {b.REQUESTS_SQL}, {b.CONTEXTS_SQL}, {GROUNDED_SQL}
        SELECT * FROM grounded""",
    "citations": f"""WITH {b.REQUESTS_SQL},
        checked AS ({_validate_sql(b.REQUESTS_SQL, "requests", GENERATE_REQUIRED, True)})
        SELECT request_id, error, CASE WHEN valid THEN 'foundry-' || "indicatorCode" END AS id,
          CASE WHEN valid THEN 'NaCCA Indicator ' || "indicatorCode" END AS text,
          CASE WHEN valid THEN '{sections.CITATION_SOURCE}' END AS source,
          CASE WHEN valid THEN 'foundry' END AS type
        FROM requests JOIN checked USING (request_id)""",
    "assemble_lessons": f"""WITH {b.REQUESTS_SQL}, {b.CONTEXTS_SQL}, {GROUNDED_SQL},
        {b.RESPONSES_SQL}, {SECTIONS_SQL}
        SELECT g.request_id, s.notes AS "teacherNotes", s.visual AS "visualPrompts",
          s.reading AS "studentReading", g."indicatorCode", g.subject, g.grade, g.strand,
          g."difficultyLevel",
          CAST(to_json([{{'id': 'foundry-' || g."indicatorCode",
            'text': 'NaCCA Indicator ' || g."indicatorCode",
            'source': '{sections.CITATION_SOURCE}', 'type': 'foundry'}}]) AS VARCHAR) AS citations,
          g."foundryContext"
        FROM grounded g JOIN sectioned s ON g.request_id = s.doc_id WHERE s.ok""",
    "duration_alloc": f"""WITH {b.REQUESTS_SQL}
        SELECT request_id, duration, {_MINUTES % "0.4"} AS main_minutes,
          {_MINUTES % "0.3"} AS practice_minutes
        FROM requests""",
    "render_lesson_prompts": _prompt_sql(),
    "render_activity_prompts": f"""WITH {b.REQUESTS_SQL}
        SELECT request_id, 'Write an assessment for this standard as one JSON object.' || chr(10)
          || 'Subject: ' || coalesce(subject, '') || chr(10) || 'Grade: ' || grade || chr(10)
          || 'Strand: ' || strand || chr(10) || 'Standard ' || "indicatorCode" || ': '
          || "indicatorText" || chr(10) || 'Taxonomy level: ' || coalesce("bloomsLevel", '')
          || chr(10)
          || 'Keys: mcqs (5, options A to D, one correct), writingPrompts (2), rubric (4).'
          AS prompt
        FROM requests""",
    "render_mapping_prompts": f"""WITH {b.REQUESTS_SQL}
        SELECT request_id,
          'Break this standard down by taxonomy level as one JSON object.' || chr(10)
          || 'Subject: ' || coalesce(subject, '') || chr(10) || 'Grade: ' || grade || chr(10)
          || 'Standard ' || "indicatorCode" || ': ' || "indicatorText" || chr(10)
          || 'Keys: primaryLevel, levels (all six), teachingSequence, successCriteria.' AS prompt
        FROM requests""",
    "request_grid": f"""WITH {b.REQUESTS_SQL}
        SELECT request_id, "indicatorCode", subject, grade, d.duration, c."classSize",
          l."difficultyLevel"
        FROM (SELECT request_id, "indicatorCode", subject, grade FROM requests) r,
          unnest(['40', '60', '80']) AS d(duration),
          unnest(['25', '35', '45', '60']) AS c("classSize"),
          unnest(['struggling', 'average', 'advanced']) AS l("difficultyLevel")""",
}
