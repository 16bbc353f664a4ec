"""The shared test tables, projected into the shapes the operators work on.

Each binding comes twice: as DataFrame code and, for the reference SQL, as a
common table expression written separately in DuckDB's dialect. Every binding
keeps all rows and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.operators.sections import READING_MARK, TEACHER_MARK, VISUAL_MARK
from lessonloom.sources.tables import read_table


def _choose(index: Column, options: list[Column | str | None]) -> Column:
    """The option numbered ``index``; the last one for any other number."""
    cols = [o if isinstance(o, Column) else F.lit(o) for o in options]
    out = cols[-1]
    for i, option in reversed(list(enumerate(cols[:-1]))):
        out = F.when(index == i, option).otherwise(out)
    return out


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


# --- standards tree -----------------------------------------------------------------

def tree(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Regions, nations, customers and orders as the four levels."""
    return {
        "subjects": read_table(spark, folder, "region").select(
            F.col("r_regionkey").alias("id"),
            F.col("r_name").alias("name"),
            F.lower("r_name").alias("slug"),
            F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("created_at"),
        ),
        "strands": read_table(spark, folder, "nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_regionkey").alias("subject_id"),
            F.col("n_name").alias("name"),
        ),
        "sub_strands": read_table(spark, folder, "customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").alias("strand_id"),
            F.col("c_name").alias("name"),
        ),
        "indicators": read_table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("sub_strand_id"),
            _text("O", F.col("o_orderkey")).alias("code"),
            _text(
                "Explain ", F.lower("o_orderpriority"), " handling of order ", F.col("o_orderkey")
            ).alias("text"),
            F.col("o_orderstatus").alias("blooms_level"),
            F.col("o_orderpriority").alias("grade"),
        ),
    }


TREE_SQL = """
subjects AS (
  SELECT r_regionkey AS id, r_name AS name, lower(r_name) AS slug,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM region),
strands AS (SELECT n_nationkey AS id, n_regionkey AS subject_id, n_name AS name FROM nation),
sub_strands AS (SELECT c_custkey AS id, c_nationkey AS strand_id, c_name AS name FROM customer),
indicators AS (
  SELECT o_orderkey AS id, o_custkey AS sub_strand_id, 'O' || o_orderkey AS code,
         'Explain ' || lower(o_orderpriority) || ' handling of order ' || o_orderkey AS text,
         o_orderstatus AS blooms_level, o_orderpriority AS grade
  FROM orders),
tree AS (
  SELECT s.name AS subject, s.slug, t.id AS strand_id, t.name AS strand_name,
         b.id AS sub_strand_id, b.name AS sub_strand_name, i.code AS indicator_code,
         i.text AS indicator_text, i.blooms_level AS indicator_blooms, i.grade AS indicator_grade
  FROM indicators i
  JOIN sub_strands b ON i.sub_strand_id = b.id
  JOIN strands t ON b.strand_id = t.id
  JOIN subjects s ON t.subject_id = s.id)
"""


def broken_tree(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tree with repeated codes, missing parents and nulls."""
    t = tree(spark, folder)
    customer = read_table(spark, folder, "customer")
    key = F.col("c_custkey")
    return {
        "subjects": t["subjects"].withColumn("slug", F.substring("slug", 1, 1)),
        "strands": t["strands"],
        "sub_strands": customer.select(
            F.when(F.col("c_acctbal") > 0, key).otherwise(-key).alias("id"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("strand_id"),
            F.col("c_name").alias("name"),
        ),
        "indicators": t["indicators"].withColumn(
            "code", _text(F.col("grade"), F.col("id") % 5000)
        ),
    }


BROKEN_SQL = """
subjects AS (
  SELECT r_regionkey AS id, r_name AS name, substr(lower(r_name), 1, 1) AS slug,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM region),
strands AS (SELECT n_nationkey AS id, n_regionkey AS subject_id, n_name AS name FROM nation),
sub_strands AS (
  SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS id,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS strand_id, c_name AS name
  FROM customer),
indicators AS (
  SELECT o_orderkey AS id, o_custkey AS sub_strand_id,
         o_orderpriority || (o_orderkey % 5000) AS code,
         'Explain ' || lower(o_orderpriority) || ' handling of order ' || o_orderkey AS text,
         o_orderstatus AS blooms_level, o_orderpriority AS grade
  FROM orders)
"""


def subject_docs(documents: DataFrame) -> DataFrame:
    """Each document as a nested subject: lines, sentences and clauses below it."""
    slug = _text(F.col("lang"), "-", F.col("source"))

    def clause(c: Column, i: Column) -> Column:
        return F.struct(
            _text("C", F.length(c), ".", i + 1).alias("code"),
            c.alias("text"),
            F.lit("Apply").alias("bloomsLevel"),
            F.lit("B7").alias("grade"),
        )

    def sentence(s: Column) -> Column:
        return F.struct(s.alias("name"), F.transform(F.split(s, ", "), clause).alias("indicators"))

    def line(text: Column) -> Column:
        return F.struct(
            text.alias("name"), F.transform(F.split(text, r"\. "), sentence).alias("subStrands")
        )

    return documents.select(
        "doc_id",
        F.struct(_text("Subject ", slug).alias("name"), slug.alias("slug")).alias("subject"),
        F.transform(F.split("text", "\n"), line).alias("strands"),
    )


SUBJECT_DOCS_SQL = """
d_strand AS (
  SELECT doc_id, lang || '-' || source AS slug, u.pos - 1 AS sp, u.v AS strand
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(v, pos)),
d_sub AS (
  SELECT doc_id, slug, sp, strand, u.pos - 1 AS bp, u.v AS sub
  FROM d_strand, unnest(string_split(strand, '. ')) WITH ORDINALITY AS u(v, pos)),
d_ind AS (
  SELECT doc_id, slug, sp, strand, bp, sub, u.pos - 1 AS ip, u.v AS clause,
         'C' || length(u.v) || '.' || u.pos AS code
  FROM d_sub, unnest(string_split(sub, ', ')) WITH ORDINALITY AS u(v, pos))
"""


# --- lesson store -------------------------------------------------------------------

def lessons(events: DataFrame) -> DataFrame:
    """One saved lesson per event."""
    return events.select(
        F.col("event_id").alias("id"),
        _text("E", F.col("user_id")).alias("indicator_code"),
        F.col("event_type").alias("subject"),
        _text("B", F.col("user_id") % 3 + 7).alias("grade"),
        _text("Strand ", F.col("event_id") % 13).alias("strand"),
        _text("Sub ", F.col("event_id") % 29).alias("sub_strand"),
        _text("Notes ", F.col("event_id")).alias("teacher_notes"),
        _text("Poster ", F.col("value")).alias("visual_prompts"),
        F.col("props").alias("student_reading"),
        F.col("ts").alias("created_at"),
    )


LESSONS_SQL = """
lessons AS (
  SELECT event_id AS id, 'E' || user_id AS indicator_code, event_type AS subject,
         'B' || (user_id % 3 + 7) AS grade, 'Strand ' || (event_id % 13) AS strand,
         'Sub ' || (event_id % 29) AS sub_strand, 'Notes ' || event_id AS teacher_notes,
         'Poster ' || value AS visual_prompts, props AS student_reading, ts AS created_at
  FROM events)
"""


def change_log(events: DataFrame) -> DataFrame:
    """Saves and deletes of one lesson per user."""
    return events.select(
        F.col("user_id").alias("id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("op"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("subject"),
    )


LOG_SQL = """
log AS (
  SELECT user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS op, ts,
         event_id AS seq, event_type AS subject
  FROM events)
"""


def answers(events: DataFrame) -> DataFrame:
    """Quiz clicks: a user answering the question named by the event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("session"),
        F.col("event_type").alias("question"),
        (k % 4).alias("label"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def options(events: DataFrame) -> DataFrame:
    """Four options per question, one of them correct."""
    return (
        events.select(F.col("event_type").alias("question"))
        .distinct()
        .select(
            "question",
            F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("label"),
        )
        .withColumn("is_correct", F.col("label") == F.length("question") % 4)
    )


def error_messages(events: DataFrame) -> DataFrame:
    """Failure messages in the usual wordings."""
    kinds = [
        "Rate limit reached for ",
        "HTTP 429 on ",
        "Failed to fetch ",
        "Network down during ",
        "Request Timed Out in ",
        "401 Unauthorized: ",
        "Invalid API key for ",
        "Unexpected token in ",
    ]
    return events.select(
        "event_id",
        _text(_choose(F.col("event_id") % 8, kinds), F.col("event_type")).alias("message"),
    )


ERRORS_SQL = """
errors AS (
  SELECT event_id,
         ['Rate limit reached for ', 'HTTP 429 on ', 'Failed to fetch ', 'Network down during ',
          'Request Timed Out in ', '401 Unauthorized: ', 'Invalid API key for ',
          'Unexpected token in '][CAST(event_id % 8 AS INTEGER) + 1] || event_type AS message
  FROM events)
"""


# --- requests -----------------------------------------------------------------------

def requests(part: DataFrame) -> DataFrame:
    """Lesson requests with blanks, nulls and out-of-range choices among them."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        key.alias("request_id"),
        F.when(key % 7 == 0, "").otherwise(_text("P", key)).alias("indicatorCode"),
        F.when(key % 7 == 1, "").otherwise(F.col("p_name")).alias("indicatorText"),
        F.when(key % 7 != 2, F.col("p_type")).alias("subject"),
        F.col("p_brand").alias("grade"),
        F.when(key % 7 == 3, "").otherwise(_text("Strand ", size)).alias("strand"),
        F.when(key % 5 != 0, _text("Sub ", size % 3)).otherwise("").alias("subStrand"),
        _choose(
            size % 8,
            ["Remember", "understand", "APPLY", "Analyse", "Evaluate", "Create", "Guess", None],
        ).alias("bloomsLevel"),
        _choose(key % 6, ["40", "60", "80", "", "90 min", "soon"]).alias("duration"),
        _choose(key % 5, ["25", "35", "45", None, "99"]).alias("classSize"),
        _choose(key % 4, ["struggling", "average", "advanced", "gifted"]).alias("difficultyLevel"),
        _choose(key % 3, ["English", "French", None]).alias("language"),
    )


REQUESTS_SQL = """
requests AS (
  SELECT p_partkey AS request_id,
         CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'P' || p_partkey END AS "indicatorCode",
         CASE WHEN p_partkey % 7 = 1 THEN '' ELSE p_name END AS "indicatorText",
         CASE WHEN p_partkey % 7 <> 2 THEN p_type END AS subject,
         p_brand AS grade,
         CASE WHEN p_partkey % 7 = 3 THEN '' ELSE 'Strand ' || p_size END AS strand,
         CASE WHEN p_partkey % 5 <> 0 THEN 'Sub ' || (p_size % 3) ELSE '' END AS "subStrand",
         ['Remember', 'understand', 'APPLY', 'Analyse', 'Evaluate', 'Create', 'Guess', NULL]
           [p_size % 8 + 1] AS "bloomsLevel",
         ['40', '60', '80', '', '90 min', 'soon'][CAST(p_partkey % 6 AS INTEGER) + 1] AS duration,
         ['25', '35', '45', NULL, '99'][CAST(p_partkey % 5 AS INTEGER) + 1] AS "classSize",
         ['struggling', 'average', 'advanced', 'gifted'][CAST(p_partkey % 4 AS INTEGER) + 1]
           AS "difficultyLevel",
         ['English', 'French', NULL][CAST(p_partkey % 3 AS INTEGER) + 1] AS language
  FROM part)
"""


def lesson_bodies(part: DataFrame) -> DataFrame:
    """Lesson-save bodies: requests with the three sections filled in."""
    key = F.col("request_id")
    return requests(part).select(
        "request_id",
        "indicatorCode",
        "subject",
        "grade",
        "strand",
        "subStrand",
        F.when(key % 11 != 0, _text("Notes ", key)).alias("teacherNotes"),
        _text("Visual ", key).alias("visualPrompts"),
        F.when(key % 13 == 0, "").otherwise(_text("Reading ", key)).alias("studentReading"),
    )


BODIES_SQL = (
    REQUESTS_SQL
    + """,
bodies AS (
  SELECT request_id, "indicatorCode", subject, grade, strand, "subStrand",
         CASE WHEN request_id % 11 <> 0 THEN 'Notes ' || request_id END AS "teacherNotes",
         'Visual ' || request_id AS "visualPrompts",
         CASE WHEN request_id % 13 = 0 THEN '' ELSE 'Reading ' || request_id END AS "studentReading"
  FROM requests)
"""
)


def contexts(documents: DataFrame) -> DataFrame:
    """Source material of every document, and an empty one for every third code, as
    where the retrieval found nothing."""
    doc = F.col("doc_id")
    found = F.struct(_text("P", doc).alias("code"), F.col("text").alias("context"), doc.alias("position"))
    nothing = F.struct(_text("P", doc * 3).alias("code"), F.lit("").alias("context"), doc.alias("position"))
    return documents.select(F.inline(F.array(found, nothing)))


CONTEXTS_SQL = """
contexts AS (
  SELECT 'P' || doc_id AS code, text AS context FROM documents
  UNION ALL
  SELECT 'P' || (doc_id * 3), '' FROM documents)
"""


# --- texts --------------------------------------------------------------------------

def responses(documents: DataFrame) -> DataFrame:
    """Generated responses around whole documents, well-formed and not."""
    text = F.col("text")
    visual = _text("1. **Classroom Poster** — ", text)
    reading = _text(text, "\n### Check Your Understanding\n1. Why?\n2) How?")
    full = _text(
        TEACHER_MARK, "\n", text, "\n", VISUAL_MARK, "\n", visual, "\n", READING_MARK, "\n", reading
    )
    return documents.select(
        "doc_id",
        _choose(
            F.col("doc_id") % 6,
            [
                full,
                _text(TEACHER_MARK, text, READING_MARK, reading),
                _text(TEACHER_MARK, text, VISUAL_MARK, visual),
                _text(full, VISUAL_MARK, text, READING_MARK, text),
                _text(TEACHER_MARK, text, VISUAL_MARK, " \n\t ", READING_MARK, reading),
                _text("Sure, here it is.\n", full, "\n", TEACHER_MARK),
            ],
        ).alias("text"),
    )


RESPONSES_SQL = """
pieces AS (
  SELECT doc_id, text, '---TEACHER NOTES---' AS t, '---VISUAL CONTENT PROMPTS---' AS v,
         '---STUDENT READING MATERIAL---' AS s, chr(10) AS nl,
         '1. **Classroom Poster** — ' || text AS visual,
         text || chr(10) || '### Check Your Understanding' || chr(10) || '1. Why?' || chr(10)
           || '2) How?' AS reading
  FROM documents),
whole AS (
  SELECT *, t || nl || text || nl || v || nl || visual || nl || s || nl || reading AS complete
  FROM pieces),
responses AS (
  SELECT doc_id,
         CASE doc_id % 6
           WHEN 0 THEN complete
           WHEN 1 THEN t || text || s || reading
           WHEN 2 THEN t || text || v || visual
           WHEN 3 THEN complete || v || text || s || text
           WHEN 4 THEN t || text || v || ' ' || nl || chr(9) || ' ' || s || reading
           ELSE 'Sure, here it is.' || nl || complete || nl || t
         END AS text
  FROM whole)
"""


def _json_safe(col: Column) -> Column:
    return F.translate(col, '"\\\n', "   ")


def activities(documents: DataFrame) -> DataFrame:
    """Activity JSON carrying whole documents; some of it broken."""
    variant = F.col("doc_id") % 6

    def option(label: str, right: Column) -> Column:
        return _text(
            '{"label":"', label, '","text":"', label, ' choice","isCorrect":',
            F.when(right, "true").otherwise("false"), "}",
        )

    def mcq(k: Column) -> Column:
        opts = [
            option("A", k % 4 == 0),
            option("B", k % 4 == 1),
            option("C", (k % 4 == 2) | (variant == 5)),
        ]
        last = F.when((variant == 4) & (k == 1), "").otherwise(
            F.concat(F.lit(","), option("D", k % 4 == 3))
        )
        explanation = F.when(k == 1, _json_safe(F.col("text"))).otherwise("see above")
        return _text(
            '{"question":"Q', k, " of ", F.col("doc_id"), '","options":[',
            opts[0], ",", opts[1], ",", opts[2], last,
            '],"explanation":"', explanation, '"}',
        )

    def criterion(k: Column) -> Column:
        return _text(
            '{"criterion":"C', k, '","excellent":"all","satisfactory":"most","needsWork":"few"}'
        )

    def listed(n: int, item) -> Column:
        return F.array_join(F.transform(F.array(*(F.lit(i + 1) for i in range(n))), item), ",")

    body = _text(
        '{"mcqs":[', listed(5, mcq),
        '],"writingPrompts":[{"prompt":"W1","sampleAnswer":"S1"},{"prompt":"W2","sampleAnswer":"S2"}]',
        ',"rubric":[', listed(4, criterion), "]}",
    )
    return documents.select(
        "doc_id",
        _choose(
            variant,
            [
                body,
                _text("```json\n", body, "\n```"),
                F.translate(body, '"', "'"),
                _text(body, " That is all."),
                body,
                body,
            ],
        ).alias("text"),
    )


_OPTION_SQL = (
    """'{"label":"%(l)s","text":"%(l)s choice","isCorrect":' || CASE WHEN %(c)s THEN 'true' """
    """ELSE 'false' END || '}'"""
)
ACTIVITIES_SQL = (
    """
act_mcq AS (
  SELECT doc_id, array_to_string(list_transform([1, 2, 3, 4, 5], lambda k:
    '{"question":"Q' || k || ' of ' || doc_id || '","options":['
    || """
    + _OPTION_SQL % {"l": "A", "c": "k % 4 = 0"}
    + " || ',' || "
    + _OPTION_SQL % {"l": "B", "c": "k % 4 = 1"}
    + " || ',' || "
    + _OPTION_SQL % {"l": "C", "c": "k % 4 = 2 OR doc_id % 6 = 5"}
    + """ || CASE WHEN doc_id % 6 = 4 AND k = 1 THEN '' ELSE ',' || """
    + _OPTION_SQL % {"l": "D", "c": "k % 4 = 3"}
    + """ END
    || '],"explanation":"'
    || CASE WHEN k = 1 THEN translate(text, '"\\' || chr(10), '   ') ELSE 'see above' END
    || '"}'), ',') AS mcqs
  FROM documents),
act_body AS (
  SELECT doc_id, '{"mcqs":[' || mcqs || '],"writingPrompts":[{"prompt":"W1","sampleAnswer":"S1"},'
    || '{"prompt":"W2","sampleAnswer":"S2"}],"rubric":['
    || array_to_string(list_transform([1, 2, 3, 4], lambda k: '{"criterion":"C' || k
       || '","excellent":"all","satisfactory":"most","needsWork":"few"}'), ',')
    || ']}' AS body
  FROM act_mcq),
activities AS (
  SELECT doc_id,
         CASE doc_id % 6
           WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
           WHEN 2 THEN replace(body, '"', '''')
           WHEN 3 THEN body || ' That is all.'
           ELSE body
         END AS text
  FROM act_body),
act_clean AS (
  SELECT doc_id,
         regexp_replace(regexp_replace(regexp_replace(text, '```json\\n?', '', 'g'),
           '```\\n?', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text
  FROM activities),
act_ok AS (
  SELECT doc_id, text AS j FROM act_clean
  WHERE json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT')
"""
)


def breakdowns(documents: DataFrame) -> DataFrame:
    """Taxonomy breakdown JSON; some lacks a level, some is broken."""
    variant = F.col("doc_id") % 4
    levels = ["Remember", "Understand", "Apply", "Analyse", "Evaluate"]
    rows = [
        _text(
            '{"level":"', name, '","active":',
            F.when(F.col("doc_id") % (i + 2) == 0, "true").otherwise("false"),
            ',"description":"',
            _json_safe(F.col("text")) if i == 0 else "as above",
            '","sampleActivity":"Try ', name, '"}',
        )
        for i, name in enumerate(levels)
    ]
    create = F.when(variant == 1, "").otherwise(
        ',{"level":"Create","active":false,"description":"make","sampleActivity":"Try Create"}'
    )
    body = _text(
        '{"primaryLevel":"Apply","levels":[',
        F.concat_ws(",", *rows),
        create,
        '],"teachingSequence":["one","two","three"],"successCriteria":["I can"]}',
    )
    return documents.select(
        "doc_id",
        _choose(
            variant, [body, body, _text("```\n", body, "```"), F.concat(body, F.lit("}"))]
        ).alias("text"),
    )


BREAKDOWNS_SQL = """
bd AS (
  SELECT doc_id, '{"primaryLevel":"Apply","levels":['
    || array_to_string(list_transform(['Remember', 'Understand', 'Apply', 'Analyse', 'Evaluate'],
         lambda name, i: '{"level":"' || name || '","active":'
           || CASE WHEN doc_id % (i + 1) = 0 THEN 'true' ELSE 'false' END || ',"description":"'
           || CASE WHEN i = 1 THEN translate(text, '"\\' || chr(10), '   ') ELSE 'as above' END
           || '","sampleActivity":"Try ' || name || '"}'), ',')
    || CASE WHEN doc_id % 4 = 1 THEN '' ELSE
       ',{"level":"Create","active":false,"description":"make","sampleActivity":"Try Create"}' END
    || '],"teachingSequence":["one","two","three"],"successCriteria":["I can"]}' AS j
  FROM documents
  WHERE doc_id % 4 <> 3)
"""


def markdown(documents: DataFrame) -> DataFrame:
    """Documents with markdown prefixes, inline tokens and display math."""
    doc = F.col("doc_id")

    def line(t: Column, i: Column) -> Column:
        prefix = _choose(
            i % 8, ["### ", "## ", "# ", "- ", _text(i + 1, ". "), "#### ", "\n", ""]
        )
        suffix = _choose(
            (doc + i) % 5,
            [
                _text(" **key B7.", doc % 9, ".1.1 term**"),
                _text(" $x_", i, "$"),
                " *note*",
                _text(" see B7.", doc % 9, ".1.1-SC"),
                "",
            ],
        )
        return _text(prefix, t, suffix)

    tail = _choose(doc % 3, ["\n$$ a+b $$ tail", "\n$$ unclosed B7.1.1.1", ""])
    return documents.select(
        "doc_id",
        F.concat(F.array_join(F.transform(F.split("text", "\n"), line), "\n"), tail).alias("text"),
    )


MARKDOWN_SQL = """
md AS (
  SELECT doc_id,
    array_to_string(list_transform(string_split(text, chr(10)), lambda t, n:
      CASE (n - 1) % 8 WHEN 0 THEN '### ' WHEN 1 THEN '## ' WHEN 2 THEN '# ' WHEN 3 THEN '- '
        WHEN 4 THEN n || '. ' WHEN 5 THEN '#### ' WHEN 6 THEN chr(10) ELSE '' END
      || t ||
      CASE (doc_id + n - 1) % 5 WHEN 0 THEN ' **key B7.' || (doc_id % 9) || '.1.1 term**'
        WHEN 1 THEN ' $x_' || (n - 1) || '$' WHEN 2 THEN ' *note*'
        WHEN 3 THEN ' see B7.' || (doc_id % 9) || '.1.1-SC' ELSE '' END), chr(10))
    || CASE doc_id % 3 WHEN 0 THEN chr(10) || '$$ a+b $$ tail'
         WHEN 1 THEN chr(10) || '$$ unclosed B7.1.1.1' ELSE '' END AS text
  FROM documents)
"""


def cited_markdown(documents: DataFrame) -> DataFrame:
    """Markdown documents that carry their own citations."""
    doc = F.col("doc_id")

    def cite(code: Column) -> Column:
        return F.struct(
            _text("c-", code).alias("id"),
            _text("Indicator ", code).alias("text"),
            F.lit("Curriculum").alias("source"),
            F.lit("curriculum").alias("type"),
        )

    codes = [
        _text("B8.", doc % 5, ".1.1"),
        _text("B7.", doc % 9, ".1.10"),
        _text("B7.", doc % 9, ".1.1"),
        _text("B7.", doc % 9, ".1.1-SC"),
    ]
    citations = F.filter(F.array(*(cite(c) for c in codes)), lambda c: doc % 4 != 3)
    return markdown(documents).withColumn("citations", citations)


def worksheets(documents: DataFrame) -> DataFrame:
    """Student texts with the question heading in its usual forms."""
    text, doc = F.col("text"), F.col("doc_id")
    ask = _text("\n1. Why ", doc, "?\n2) How?\n- Explain.\nIn two lines.\n3. ")
    return documents.select(
        "doc_id",
        _choose(
            doc % 5,
            [
                _text(text, "\n### Check Your Understanding", ask),
                _text(text, "\n## CHECK your understanding\n", text),
                _text(text, "\n**Check Your Understanding**", ask),
                _text(text, "\n###Check Your Understanding  \n"),
                _text("### Check Your Understanding\n\n", text, ask),
            ],
        ).alias("text"),
    )


WORKSHEETS_SQL = """
ws AS (
  SELECT doc_id,
    CASE doc_id % 5
      WHEN 0 THEN text || nl || '### Check Your Understanding' || ask
      WHEN 1 THEN text || nl || '## CHECK your understanding' || nl || text
      WHEN 2 THEN text || nl || '**Check Your Understanding**' || ask
      WHEN 3 THEN text || nl || '###Check Your Understanding  ' || nl
      ELSE '### Check Your Understanding' || nl || nl || text || ask
    END AS text
  FROM (SELECT doc_id, text, chr(10) AS nl,
          chr(10) || '1. Why ' || doc_id || '?' || chr(10) || '2) How?' || chr(10) || '- Explain.'
          || chr(10) || 'In two lines.' || chr(10) || '3. ' AS ask
        FROM documents))
"""


VISUAL_PREFIXES = [
    "1. **Classroom Poster** — ",
    "",
    "- ",
    "**Board Worked Example**: ",
    "Step 1: ",
    "3. **Photo** - ",
    "notebook page ",
    "**Notebook** ",
    "4. *Diagram* — ",
    "### 2. **Board** example: ",
    "   ",
    "photo of ",
]


def visual_prompts(documents: DataFrame) -> DataFrame:
    """Documents whose lines open, continue and switch the four sections."""
    doc = F.col("doc_id")
    return documents.select(
        "doc_id",
        F.array_join(
            F.transform(
                F.split("text", "\n"),
                lambda t, i: F.concat(_choose((doc + i) % 12, VISUAL_PREFIXES), t),
            ),
            "\n",
        ).alias("text"),
    )


VISUAL_SQL = (
    """
vp AS (
  SELECT doc_id,
    array_to_string(list_transform(string_split(text, chr(10)), lambda t, n:
      ["""
    + ", ".join("'" + p + "'" for p in VISUAL_PREFIXES)
    + """][CAST((doc_id + n - 1) % 12 AS INTEGER) + 1] || t), chr(10)) AS text
  FROM documents)
"""
)
