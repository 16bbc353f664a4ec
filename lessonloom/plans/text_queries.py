"""Queries over the generated-text corpus, with their reference SQL.

The SQL explodes lines and uses windows, quite unlike the in-row Spark plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.operators import activities, markdown, plain, sections, visuals, worksheets
from lessonloom.operators.visuals import DEFAULT_TITLES
from lessonloom.plans import bindings as b
from lessonloom.plans.lesson_queries import SECTIONS_SQL
from lessonloom.sources.tables import read_texts


def _documents(build):
    return lambda spark, folder: build(read_texts(spark, folder, "documents", "doc_id"))


def _activities(build):
    return _documents(lambda d: build(activities.parse_activities(b.activities(d))))


def _markdown(build):
    return _documents(lambda d: build(b.markdown(d)))


def _text_pieces(md: DataFrame) -> DataFrame:
    """Text outside display math, line by line."""
    pieces = markdown.md_math(md, "doc_id").where(F.col("kind") == "text")
    return markdown.md_lines(pieces, ["doc_id", "piece_no"], "body")


def activity_parse(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "doc_id",
        "status",
        F.array_size("activity.mcqs").alias("mcqs"),
        F.array_size("activity.rubric").alias("criteria"),
    )


_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

MD_LINES_SQL = """
md_piece AS (
  SELECT doc_id, u.pos - 1 AS piece_no, u.v AS body
  FROM md, unnest(string_split(text, '$$')) WITH ORDINALITY AS u(v, pos)),
md_line AS (
  SELECT doc_id, piece_no, u.pos - 1 AS line_no, u.v AS line
  FROM md_piece, unnest(string_split(body, chr(10))) WITH ORDINALITY AS u(v, pos)
  WHERE piece_no % 2 = 0),
md_kind AS (
  SELECT *, CASE
      WHEN regexp_matches(line, '^###\\s+.') THEN 'h3'
      WHEN regexp_matches(line, '^##\\s+.') THEN 'h2'
      WHEN regexp_matches(line, '^#\\s+.') THEN 'h1'
      WHEN regexp_matches(line, '^[-•]\\s+.') THEN 'bullet'
      WHEN regexp_matches(line, '^\\d+\\.\\s+.') THEN 'numbered'
      WHEN regexp_matches(line, '^\\s*$') THEN 'blank'
      ELSE 'paragraph' END AS kind
  FROM md_line),
md_content AS (
  SELECT doc_id, piece_no, line_no, kind,
    CASE WHEN kind = 'numbered' THEN regexp_extract(line, '^(\\d+)', 1) END AS number,
    CASE kind
      WHEN 'paragraph' THEN line
      WHEN 'blank' THEN ''
      WHEN 'numbered' THEN regexp_extract(line, '^\\d+\\.\\s+(.+)', 1)
      WHEN 'bullet' THEN regexp_extract(line, '^[-•]\\s+(.+)', 1)
      ELSE regexp_extract(line, '^#+\\s+(.+)', 1) END AS content
  FROM md_kind)
"""

_INLINE = (
    "[A-Z]\\d+\\.\\d+\\.\\d+\\.\\d+|\\$\\$[^$]+\\$\\$|\\$[^$]+\\$|\\*\\*[^*]+\\*\\*|\\*[^*]+\\*"
)


def _kind_sql(t: str) -> str:
    return f"""CASE WHEN regexp_matches({t}, '^[A-Z]') THEN 'code'
      WHEN {t}[1:2] = '$$' THEN 'display_math' WHEN {t}[1] = '$' THEN 'math'
      WHEN {t}[1:2] = '**' THEN 'bold' ELSE 'italic' END"""


def _bare_sql(t: str) -> str:
    return f"""CASE WHEN regexp_matches({t}, '^[A-Z]') THEN {t}
      WHEN {t}[1:2] IN ('$$', '**') THEN substr({t}, 3, length({t}) - 4)
      ELSE substr({t}, 2, length({t}) - 2) END"""


TOKENS_SQL = f"""
tok_1 AS (
  SELECT doc_id, piece_no, line_no, u.pos AS outer_no, {_kind_sql("u.v")} AS kind,
    {_bare_sql("u.v")} AS token
  FROM md_content, unnest(regexp_extract_all(content, '{_INLINE}')) WITH ORDINALITY AS u(v, pos)),
tok_2 AS (
  SELECT doc_id, piece_no, line_no, outer_no, u.pos AS inner_no, {_kind_sql("u.v")} AS kind,
    {_bare_sql("u.v")} AS token
  FROM tok_1, unnest(regexp_extract_all(token, '{_INLINE}')) WITH ORDINALITY AS u(v, pos)
  WHERE tok_1.kind IN ('bold', 'italic')),
tok AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, piece_no, line_no
      ORDER BY outer_no, depth, inner_no) AS INTEGER) AS token_no
  FROM (
    SELECT doc_id, piece_no, line_no, outer_no, 0 AS inner_no, 1 AS depth, kind, token FROM tok_1
    UNION ALL
    SELECT doc_id, piece_no, line_no, outer_no, inner_no, 2, kind, token FROM tok_2))
"""

CITES_SQL = """
cites AS (
  SELECT doc_id, u.pos AS cite_no, 'c-' || u.v AS citation_id, 'Indicator ' || u.v AS citation_text
  FROM documents, unnest(['B8.' || (doc_id % 5) || '.1.1', 'B7.' || (doc_id % 9) || '.1.10',
    'B7.' || (doc_id % 9) || '.1.1', 'B7.' || (doc_id % 9) || '.1.1-SC'])
    WITH ORDINALITY AS u(v, pos)
  WHERE doc_id % 4 <> 3)
"""

VP_LINES_SQL = """
vp_line AS (
  SELECT doc_id, u.pos AS pos, regexp_replace(u.v, '^\\s+|\\s+$', '', 'g') AS t
  FROM vp, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(v, pos)),
vp_kept AS (
  SELECT doc_id, t, lower(t) AS l,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no
  FROM vp_line WHERE t <> ''),
vp_key AS (
  SELECT *, CASE WHEN contains(t, '**') OR regexp_matches(t, '^[1-4]\\.') THEN CASE
      WHEN (contains(l, 'poster') OR contains(l, 'anchor chart'))
        AND (contains(t, '1.') OR contains(l, 'poster')) THEN 'poster'
      WHEN (contains(l, 'worked example') OR contains(l, 'board'))
        AND (contains(t, '2.') OR contains(l, 'example')) THEN 'board'
      WHEN (contains(l, 'photograph') OR contains(l, 'photo'))
        AND (contains(t, '3.') OR contains(l, 'photo')) THEN 'photo'
      WHEN (contains(l, 'notebook') OR contains(l, 'diagram'))
        AND (contains(t, '4.') OR contains(l, 'notebook') OR contains(l, 'diagram'))
        THEN 'notebook' END END AS key
  FROM vp_kept),
vp_fill AS (
  SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM vp_key)
"""

_HEADER = (
    "^(?:\\d+\\.|\\*|-|###)?\\s*(?:\\*\\*(.*?)\\*\\*|\\*(.*?)\\*)\\s*(?:[-—:]|&mdash;)?\\s*(.*)$"
)

VP_SECTIONS_SQL = f"""
vp_start AS (
  SELECT *, CASE section
      WHEN 'poster' THEN (contains(l, 'poster') OR contains(l, 'anchor chart'))
        AND (contains(t, '1.') OR contains(l, 'poster'))
      WHEN 'board' THEN (contains(l, 'worked example') OR contains(l, 'board'))
        AND (contains(t, '2.') OR contains(l, 'example'))
      WHEN 'photo' THEN contains(l, 'photo')
      ELSE (contains(l, 'notebook') OR contains(l, 'diagram'))
        AND (contains(t, '4.') OR contains(l, 'diagram')) END AS opens
  FROM vp_fill WHERE section IS NOT NULL),
vp_read AS (
  SELECT doc_id, line_no, section,
    CASE WHEN opens AND regexp_matches(t, '{_HEADER}') THEN coalesce(
      nullif(regexp_extract(t, '{_HEADER}', 1), ''), regexp_extract(t, '{_HEADER}', 2)) ELSE ''
      END AS title,
    CASE WHEN NOT opens THEN t
      WHEN regexp_matches(t, '{_HEADER}') THEN regexp_extract(t, '{_HEADER}', 3)
      ELSE regexp_replace(t, '^(?:\\d+\\.|\\*|-|###)\\s*', '') END AS body
  FROM vp_start),
vp_found AS (
  SELECT doc_id, section, arg_max(title, line_no) FILTER (WHERE title <> '') AS title,
    string_agg(body, chr(10) ORDER BY line_no) FILTER (WHERE body <> '') AS description
  FROM vp_read GROUP BY doc_id, section),
vp_short AS (
  SELECT d.doc_id FROM documents d LEFT JOIN vp_found f ON d.doc_id = f.doc_id
  GROUP BY d.doc_id HAVING coalesce(sum(length(f.description)), 0) < 30),
vp_para AS (
  SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n
  FROM vp_kept WHERE length(t) > 15 AND NOT starts_with(t, '###')
    AND doc_id IN (SELECT doc_id FROM vp_short)),
vp_sections AS (
  SELECT d.doc_id, k.section, coalesce(f.title, k.title) AS title,
    coalesce(p.t, f.description, '') AS description
  FROM documents d
  CROSS JOIN (VALUES {", ".join(f"({i + 1}, '{s}', '{t}')" for i, (s, t) in
                                enumerate(DEFAULT_TITLES.items()))}) k(n, section, title)
  LEFT JOIN vp_found f ON f.doc_id = d.doc_id AND f.section = k.section
  LEFT JOIN vp_para p ON p.doc_id = d.doc_id AND p.n = k.n)
"""


def _steps_sql(source: str) -> str:
    """Merged steps of ``source(doc_id, text)``, and the final steps."""
    return f"""
st_line AS (
  SELECT doc_id, u.pos AS pos, regexp_replace(u.v, '^\\s+|\\s+$', '', 'g') AS t
  FROM {source}, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(v, pos)),
st_mark AS (
  SELECT *, sum(CASE WHEN regexp_matches(t, '^(?:[-•*]|\\d+\\.)\\s*.+$')
      OR starts_with(lower(t), 'step') THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos) AS island,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM st_line WHERE t <> ''),
st_island AS (
  SELECT doc_id, island, string_agg(t, chr(10) ORDER BY pos) AS step, min(pos) AS pos
  FROM st_mark GROUP BY doc_id, island),
st_merged AS (
  SELECT doc_id, step,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS step_no,
    count(*) OVER (PARTITION BY doc_id) AS total
  FROM st_island),
st_sentence AS (
  SELECT doc_id, u.pos AS pos, regexp_replace(u.v, '^\\s+|\\s+$', '', 'g') AS step
  FROM {source}, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'),
    chr(1))) WITH ORDINALITY AS u(v, pos)
  WHERE doc_id NOT IN (SELECT doc_id FROM st_merged WHERE total > 1)),
st_final AS (
  SELECT doc_id, step_no, step FROM st_merged WHERE total > 1
  UNION ALL
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER), step
  FROM st_sentence WHERE step <> '')
"""


def _breakdown(d: DataFrame) -> DataFrame:
    return activities.breakdown_levels(activities.parse_breakdown(b.breakdowns(d)), "doc_id")


def visual_steps(d: DataFrame) -> DataFrame:
    """Steps of each document's board section."""
    board = visuals.visual_sections(b.visual_prompts(d), "doc_id").where(
        F.col("section") == "board"
    )
    return visuals.steps(board, "doc_id", "description")


QUERIES = {
    "section_responses": _documents(lambda d: sections.section_responses(b.responses(d))),
    "activity_parse": _activities(activity_parse),
    "mcq_rows": _activities(lambda a: activities.explode_questions(a, "doc_id")),
    "mcq_options": _activities(lambda a: activities.explode_options(a, "doc_id")),
    "writing_prompts": _activities(lambda a: activities.explode_prompts(a, "doc_id")),
    "rubric_rows": _activities(lambda a: activities.explode_rubric(a, "doc_id")),
    "activity_contract": _activities(lambda a: activities.check_activities(a, "doc_id")),
    "bloom_breakdown": _documents(_breakdown),
    "worksheet_reading": _documents(
        lambda d: worksheets.split_worksheet(b.worksheets(d)).select("doc_id", "reading")
    ),
    "worksheet_questions": _documents(
        lambda d: worksheets.worksheet_questions(b.worksheets(d), "doc_id")
    ),
    "worksheet_questions_bold": _documents(
        lambda d: worksheets.worksheet_questions(b.worksheets(d), "doc_id", accept_bold=True)
    ),
    "vp_forward_fill": _documents(
        lambda d: visuals.carried_sections(b.visual_prompts(d), "doc_id")
    ),
    "vp_sections": _documents(lambda d: visuals.visual_sections(b.visual_prompts(d), "doc_id")),
    "board_steps": _documents(visual_steps),
    "step_merge": _markdown(lambda m: visuals.merge_continuations(m, "doc_id")),
    "step_segments": _markdown(lambda m: visuals.steps(m, "doc_id")),
    "step_prefix": _markdown(lambda m: visuals.steps(m, "doc_id", upto=2)),
    "md_math": _markdown(lambda m: markdown.md_math(m, "doc_id")),
    "md_lines": _markdown(_text_pieces),
    "md_profile": _markdown(lambda m: markdown.md_profile(_text_pieces(m))),
    "md_tokens": _markdown(lambda m: markdown.md_tokens(m, "doc_id")),
    "citation_resolve": _documents(
        lambda d: markdown.resolve_citations(b.cited_markdown(d), "doc_id")
    ),
    "citation_resolve_exact": _documents(
        lambda d: markdown.resolve_citations(b.cited_markdown(d), "doc_id", exact=True)
    ),
    "excerpts": _markdown(
        lambda m: m.select("doc_id", plain.excerpt(F.col("text")).alias("excerpt"))
    ),
    "plain_text_a": _markdown(
        lambda m: m.select("doc_id", plain.plain_text(F.col("text"), "a").alias("plain"))
    ),
    "plain_text_b": _markdown(
        lambda m: m.select("doc_id", plain.plain_text(F.col("text"), "b").alias("plain"))
    ),
}


def _worksheet_sql(heading: str) -> str:
    section = _TRIM.format("string_split_regex(text, '" + heading + "')[2]")
    return f"""
WITH {b.WORKSHEETS_SQL},
section AS (SELECT doc_id, {section} AS s FROM ws),
item AS (
  SELECT doc_id, u.pos AS pos, {_TRIM.format("u.v")} AS q
  FROM section, unnest(string_split(
    regexp_replace(s, '(?m)^(?:\\d+[.)]|-\\s+)', chr(1), 'g'), chr(1))) WITH ORDINALITY AS u(v, pos)
  WHERE s <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS question_no,
  q AS question
FROM item WHERE q <> ''
"""


ORACLES = {
    "section_responses": f"""WITH {b.RESPONSES_SQL}, {SECTIONS_SQL}
        SELECT doc_id, CASE WHEN ok THEN notes END AS "teacherNotes",
          CASE WHEN ok THEN visual END AS "visualPrompts",
          CASE WHEN ok THEN reading END AS "studentReading",
          CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status,
          CASE WHEN NOT ok THEN '{sections.PARSE_ERROR}' END AS error,
          CASE WHEN NOT ok THEN text END AS "rawText"
        FROM sectioned JOIN responses USING (doc_id)""",
    "activity_parse": f"""WITH {b.ACTIVITIES_SQL}
        SELECT c.doc_id, CASE WHEN o.j IS NULL THEN 'failed' ELSE 'ok' END AS status,
          CAST(json_array_length(o.j, '$.mcqs') AS INTEGER) AS mcqs,
          CAST(json_array_length(o.j, '$.rubric') AS INTEGER) AS criteria
        FROM act_clean c LEFT JOIN act_ok o ON c.doc_id = o.doc_id""",
    "mcq_rows": f"""WITH {b.ACTIVITIES_SQL}
        SELECT doc_id, CAST(q.pos AS INTEGER) AS mcq_no,
          json_extract_string(q.v, '$.question') AS question,
          CAST(json_array_length(q.v, '$.options') AS INTEGER) AS options,
          json_extract_string(q.v, '$.explanation') AS explanation
        FROM act_ok, unnest(json_extract(j, '$.mcqs[*]')) WITH ORDINALITY AS q(v, pos)""",
    "mcq_options": f"""WITH {b.ACTIVITIES_SQL}
        SELECT doc_id, CAST(q.pos AS INTEGER) AS mcq_no,
          json_extract_string(q.v, '$.question') AS question,
          CAST(p.pos AS INTEGER) AS option_no, json_extract_string(p.v, '$.label') AS label,
          json_extract_string(p.v, '$.text') AS option_text,
          CAST(json_extract_string(p.v, '$.isCorrect') AS BOOLEAN) AS is_correct
        FROM act_ok, unnest(json_extract(j, '$.mcqs[*]')) WITH ORDINALITY AS q(v, pos),
          unnest(json_extract(q.v, '$.options[*]')) WITH ORDINALITY AS p(v, pos)""",
    "writing_prompts": f"""WITH {b.ACTIVITIES_SQL}
        SELECT doc_id, CAST(q.pos AS INTEGER) AS prompt_no,
          json_extract_string(q.v, '$.prompt') AS prompt,
          json_extract_string(q.v, '$.sampleAnswer') AS sample_answer
        FROM act_ok, unnest(json_extract(j, '$.writingPrompts[*]')) WITH ORDINALITY AS q(v, pos)""",
    "rubric_rows": f"""WITH {b.ACTIVITIES_SQL}
        SELECT doc_id, CAST(q.pos AS INTEGER) AS criterion_no,
          json_extract_string(q.v, '$.criterion') AS criterion,
          json_extract_string(q.v, '$.excellent') AS excellent,
          json_extract_string(q.v, '$.satisfactory') AS satisfactory,
          json_extract_string(q.v, '$.needsWork') AS needs_work
        FROM act_ok, unnest(json_extract(j, '$.rubric[*]')) WITH ORDINALITY AS q(v, pos)""",
    "activity_contract": f"""WITH {b.ACTIVITIES_SQL},
        question AS (
          SELECT doc_id, json_extract_string(q.v, '$.options[*].label') AS labels,
            len(list_filter(json_extract_string(q.v, '$.options[*].isCorrect'),
              lambda x: x = 'true')) AS right_ones
          FROM act_ok, unnest(json_extract(j, '$.mcqs[*]')) AS q(v)),
        per_doc AS (
          SELECT doc_id, count(*) AS n, bool_or(labels <> ['A', 'B', 'C', 'D']) AS bad_labels,
            bool_or(right_ones <> 1) AS bad_key
          FROM question GROUP BY doc_id)
        SELECT c.doc_id, CASE WHEN o.doc_id IS NOT NULL THEN array_to_string(list_filter([
            CASE WHEN coalesce(n, 0) <> 5 THEN 'mcq_count' END,
            CASE WHEN bad_labels THEN 'option_labels' END,
            CASE WHEN bad_key THEN 'correct_options' END,
            CASE WHEN json_array_length(j, '$.writingPrompts') <> 2
              THEN 'writing_prompt_count' END,
            CASE WHEN json_array_length(j, '$.rubric') <> 4 THEN 'criterion_count' END],
          lambda x: x IS NOT NULL), ',') END AS violations
        FROM act_clean c LEFT JOIN act_ok o ON c.doc_id = o.doc_id
          LEFT JOIN per_doc p ON o.doc_id = p.doc_id""",
    "bloom_breakdown": f"""WITH {b.BREAKDOWNS_SQL}
        SELECT doc_id, json_extract_string(j, '$.primaryLevel') AS primary_level,
          doc_id % 4 <> 1 AS complete,
          CAST(json_array_length(j, '$.teachingSequence') AS INTEGER) AS teaching_steps,
          CAST(json_array_length(j, '$.successCriteria') AS INTEGER) AS success_criteria,
          CAST(q.pos AS INTEGER) AS level_no, json_extract_string(q.v, '$.level') AS level,
          CAST(json_extract_string(q.v, '$.active') AS BOOLEAN) AS active,
          json_extract_string(q.v, '$.description') AS description,
          json_extract_string(q.v, '$.sampleActivity') AS sample_activity
        FROM bd, unnest(json_extract(j, '$.levels[*]')) WITH ORDINALITY AS q(v, pos)""",
    "worksheet_reading": f"""WITH {b.WORKSHEETS_SQL}
        SELECT doc_id, {_TRIM.format("string_split_regex(text, '(?i)###?\\s*Check Your Understanding')[1]")}
          AS reading FROM ws""",
    "worksheet_questions": _worksheet_sql("(?i)###?\\s*Check Your Understanding"),
    "worksheet_questions_bold": _worksheet_sql(
        "(?i)(?:###?\\s*|\\*\\*)Check Your Understanding(?:\\*\\*)?"
    ),
    "vp_forward_fill": f"""WITH {b.VISUAL_SQL}, {VP_LINES_SQL}
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, section, t AS line FROM vp_fill
        WHERE section IS NOT NULL""",
    "vp_sections": f"""WITH {b.VISUAL_SQL}, {VP_LINES_SQL}, {VP_SECTIONS_SQL}
        SELECT doc_id, section, title, description FROM vp_sections""",
    "board_steps": f"""WITH {b.VISUAL_SQL}, {VP_LINES_SQL}, {VP_SECTIONS_SQL},
        board AS (
          SELECT doc_id, description AS text FROM vp_sections
          WHERE section = 'board' AND description <> ''),
        {_steps_sql("board")}
        SELECT * FROM st_final""",
    "step_merge": f"""WITH {b.MARKDOWN_SQL}, {_steps_sql("md")}
        SELECT doc_id, step_no, step FROM st_merged""",
    "step_segments": f"WITH {b.MARKDOWN_SQL}, {_steps_sql('md')} SELECT * FROM st_final",
    "step_prefix": f"""WITH {b.MARKDOWN_SQL}, {_steps_sql('md')} SELECT * FROM st_final
        WHERE step_no <= 3""",
    "md_math": f"""WITH {b.MARKDOWN_SQL}
        SELECT doc_id, CAST(u.pos - 1 AS INTEGER) AS piece_no,
          CASE WHEN u.pos % 2 = 0 THEN 'math' ELSE 'text' END AS kind,
          CASE WHEN u.pos % 2 = 0 THEN {_TRIM.format("u.v")} ELSE u.v END AS body
        FROM md, unnest(string_split(text, '$$')) WITH ORDINALITY AS u(v, pos)""",
    "md_lines": f"""WITH {b.MARKDOWN_SQL}, {MD_LINES_SQL}
        SELECT doc_id, CAST(piece_no AS INTEGER) AS piece_no, CAST(line_no AS INTEGER) AS line_no,
          kind, number, content
        FROM md_content""",
    "md_profile": f"""WITH {b.MARKDOWN_SQL}, {MD_LINES_SQL}
        SELECT kind, count(*) AS lines FROM md_content GROUP BY kind""",
    "md_tokens": f"""WITH {b.MARKDOWN_SQL}, {MD_LINES_SQL}, {TOKENS_SQL}
        SELECT doc_id, CAST(piece_no AS INTEGER) AS piece_no, CAST(line_no AS INTEGER) AS line_no,
          token_no, depth, kind, token
        FROM tok""",
    "citation_resolve": f"""WITH {b.MARKDOWN_SQL}, {MD_LINES_SQL}, {TOKENS_SQL}, {CITES_SQL}
        SELECT t.doc_id, CAST(piece_no AS INTEGER) AS piece_no, CAST(line_no AS INTEGER) AS line_no,
          token_no, token, arg_min(citation_id, cite_no) AS citation_id,
          arg_min(citation_text, cite_no) AS citation_text
        FROM tok t LEFT JOIN cites c ON c.doc_id = t.doc_id AND contains(c.citation_text, t.token)
        WHERE t.kind = 'code' GROUP BY ALL""",
    "citation_resolve_exact": f"""WITH {b.MARKDOWN_SQL}, {CITES_SQL},
        tok AS (
          SELECT doc_id, CAST(u.pos AS INTEGER) AS token_no, u.v AS token
          FROM md, unnest(regexp_extract_all(text,
            '[A-Z]\\d+\\.\\d+\\.\\d+\\.\\d+(?:-[A-Z]+)?')) WITH ORDINALITY AS u(v, pos))
        SELECT t.doc_id, token_no, token, arg_min(citation_id, cite_no) AS citation_id,
          arg_min(citation_text, cite_no) AS citation_text
        FROM tok t LEFT JOIN cites c
          ON c.doc_id = t.doc_id AND c.citation_text = 'Indicator ' || t.token
        GROUP BY ALL""",
    "excerpts": f"""WITH {b.MARKDOWN_SQL}
        SELECT doc_id, substr(regexp_replace(regexp_replace(replace(text, '*', ''),
          '#{{1,3}}\\s', '', 'g'), '(?m)^-\\s', '', 'g'), 1, 120) || '...' AS excerpt
        FROM md""",
    "plain_text_a": f"""WITH {b.MARKDOWN_SQL}
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            text, '#{{1,6}}\\s+', '', 'g'), '\\*\\*([^\\n]+?)\\*\\*', '\\1', 'g'),
            '\\*([^\\n]+?)\\*', '\\1', 'g'), '`([^\\n]+?)`', '\\1', 'g'),
            '(?m)^[-*]\\s+', '• ', 'g') AS plain
        FROM md""",
    "plain_text_b": f"""WITH {b.MARKDOWN_SQL}
        SELECT doc_id, array_to_string(list_filter(list_transform(string_split(
          regexp_replace(regexp_replace(replace(text, '*', ''), '#{{1,3}}\\s?', '', 'g'),
            '(?m)^-\\s', '• ', 'g'), chr(10)),
          lambda t: {_TRIM.format("t")}), lambda t: t <> ''), chr(10)) AS plain
        FROM md""",
}
