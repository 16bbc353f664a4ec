"""Hand-worked cases of the text jobs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lessonloom.functions import text as tx
from lessonloom.operators import activities, markdown, plain, sections, visuals, worksheets
from lessonloom.operators.sections import READING_MARK as S
from lessonloom.operators.sections import TEACHER_MARK as T
from lessonloom.operators.sections import VISUAL_MARK as V

TITLES = visuals.DEFAULT_TITLES


def test_trim_and_units(value):
    assert value(tx.trimmed(F.col("x")), "﻿  a b \n") == "a b"
    assert value(tx.trimmed(F.col("x")), "\u0085a") == "\u0085a"
    assert value(tx.units(F.col("x")), "a😀") == 3
    assert value(tx.first_units(F.col("x"), 2), "a😀b") == "a"
    assert value(tx.first_units(F.col("x"), 3), "a😀b") == "a😀"
    assert value(tx.first_units(F.col("x"), 9), "a😀b") == "a😀b"
    assert value(tx.first_units(F.col("x"), 3), "abcd") == "abc"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (f"{T}n{V}v{S}r", ("n", "v", "r")),
        (f"pre {T} n {T}x{V} v﻿{S} r", ("pre  n " + T + "x", "v", "r")),
        (f"n{V}v{S}r", ("n", "v", "r")),
        (f"{T}n{V}v{S}r{V}lost{S}lost", ("n", "v", "r")),
        (f"{T}n{V}v{S}r{S}lost", ("n", "v", "r")),
        (f"{T}n{S}r{V}v", None),
        (f"{T}n{V} \n {S}r", None),
        (f"{T}{V}v{S}r", None),
        ("", None),
        (None, None),
    ],
)
def test_sections(texts, text, expected):
    row = sections.section_responses(texts([text])).first()
    got = (row.teacherNotes, row.visualPrompts, row.studentReading)
    assert row.rawText == (text if expected is None else None)
    if expected is None:
        assert row.status == "failed" and row.error == sections.PARSE_ERROR and got == (None,) * 3
    else:
        assert row.status == "ok" and row.error is None and got == expected


GOOD = '{"mcqs":[],"writingPrompts":[{"prompt":"p","sampleAnswer":"}}"}],"rubric":[]}'


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        (GOOD, True),
        (f"```json\n{GOOD}\n```", True),
        (f" ```{GOOD}``` ﻿", True),
        ("{}", True),
        (GOOD.replace('"', "'"), False),
        (GOOD + " x", False),
        (GOOD + "]", False),
        (GOOD + "}", False),
        (GOOD + "] x", False),
        (GOOD + "} x", False),
        (GOOD + "}] [{", False),
        (GOOD + ',"v":' + GOOD, False),
        (GOOD + "," + GOOD, False),
        (GOOD + GOOD, False),
        (f"[{GOOD}]", False),
        ('{"mcqs":[],}', False),
        ('{"mcqs":NaN}', False),
        ("null", False),
        ("", False),
        (None, False),
    ],
)
def test_strict_json(texts, text, ok):
    assert (activities.parse_activities(texts([text])).first().status == "ok") is ok


def test_contract(texts):
    def option(label, right):
        return f'{{"label":"{label}","text":"t","isCorrect":{right}}}'

    def mcq(*opts):
        return f'{{"question":"q","options":[{",".join(opts)}],"explanation":"e"}}'

    good = mcq(option("A", "true"), *(option(x, "false") for x in "BCD"))
    two = mcq(option("A", "true"), option("B", "true"), option("C", "false"), option("D", "false"))
    three = mcq(*(option(x, "false") for x in "ABC"))
    tail = '"writingPrompts":[{},{}],"rubric":[{},{},{},{}]'
    docs = [
        f'{{"mcqs":[{",".join([good] * 5)}],{tail}}}',
        f'{{"mcqs":[{",".join([good] * 4 + [two])}],{tail}}}',
        f'{{"mcqs":[{three}],"writingPrompts":[]}}',
        "nonsense",
        "{}",
    ]
    checked = activities.check_activities(activities.parse_activities(texts(docs)), "doc_id")
    assert [r.violations for r in checked.orderBy("doc_id").collect()] == [
        "",
        "correct_options",
        "mcq_count,option_labels,correct_options,writing_prompt_count,criterion_count",
        None,
        "mcq_count,writing_prompt_count,criterion_count",
    ]


@pytest.mark.parametrize(
    ("text", "bold", "expected"),
    [
        ("r\n## Check Your Understanding\n1. a\n2) b\n- c\nd", False, ["a", "b", "c\nd"]),
        ("r\n###CHECK YOUR understanding\nwhy?", False, ["why?"]),
        ("r\n**Check Your Understanding**\n1. a", False, []),
        ("r\n**Check Your Understanding**\n1. a", True, ["a"]),
        ("r\n### Check Your Understanding\n \n", False, []),
        ("## Check Your Understanding\nx 1. a\n12. b-\n-c\n-  d", False, ["x 1. a", "b-\n-c", "d"]),
        ("# Check Your Understanding\n1. a", False, []),
        ("", False, []),
        (None, False, []),
    ],
)
def test_worksheets(texts, text, bold, expected):
    rows = worksheets.worksheet_questions(texts([text]), "doc_id", accept_bold=bold)
    assert [r.question for r in rows.orderBy("question_no").collect()] == expected


def vp(texts, text):
    rows = visuals.visual_sections(texts([text]), "doc_id").collect()
    return {r.section: (r.title, r.description) for r in rows}


LONG = "described at great length for the class"


def test_visual_headers_and_titles(texts):
    got = vp(
        texts,
        "preamble is dropped\n"
        f"1. **Classroom Poster** — {LONG}\nmore\n\n"
        f"**Board Worked Example**: {LONG}\n"
        "3. **Photo** - shot\n**Second photo**\n"
        "### *plain diagram line*\n",
    )
    assert got["poster"] == ("Classroom Poster", f"{LONG}\nmore")
    # the optional list mark takes the first of two leading stars, so one is left over
    assert got["board"] == ("Board Worked Example", f"*: {LONG}")
    assert got["photo"][0] == "Second photo"
    # without "**" or a leading number a line does not switch the section
    assert got["photo"][1] == "shot\n*\n### *plain diagram line*"
    assert got["notebook"] == (TITLES["notebook"], "")


def test_notebook_without_number_or_diagram_is_body(texts):
    got = vp(texts, f"**Notebook** {LONG}\n4. *Notebook* — {LONG}")
    assert got["notebook"][0] == "Notebook"  # from the second line only
    assert got["notebook"][1] == f"**Notebook** {LONG}\n{LONG}"


def test_priority_and_unmatched_header(texts):
    got = vp(texts, f"1. poster on the board example {LONG}\n**x** photo\n- poster again")
    # no star pair: the list mark goes, the title stays
    assert got["poster"] == (TITLES["poster"], f"poster on the board example {LONG}")
    assert got["photo"] == ("x", "* photo\n- poster again")


def test_header_with_stray_carriage_return(texts):
    got = vp(texts, f"**Poster** one\rtwo {LONG}")
    assert got["poster"] == (TITLES["poster"], f"*Poster** one\rtwo {LONG}")


def test_short_text_falls_back_to_paragraphs(texts):
    got = vp(texts, "first paragraph here\nshort\n### heading that is long\nsecond paragraph here\n**Poster** tiny")
    assert got["poster"] == ("Poster", "first paragraph here")
    assert got["board"] == (TITLES["board"], "second paragraph here")
    assert got["photo"] == (TITLES["photo"], "")
    assert vp(texts, None)["poster"] == (TITLES["poster"], "")


def steps(texts, text, **kw):
    rows = visuals.steps(texts([text]), "doc_id", **kw).orderBy("step_no").collect()
    return [r.step for r in rows]


def test_steps(texts):
    assert steps(texts, "intro\nmore\nStep 1: a\nb\n\n- c\n12. d\n* e\n-") == [
        "intro\nmore", "Step 1: a\nb", "- c", "12. d", "* e\n-",
    ]
    assert steps(texts, "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert steps(texts, "Step one. Then two.") == ["Step one.", "Then two."]
    assert steps(texts, "") == [] and steps(texts, None) == []
    assert steps(texts, "  ") == ["  "]
    assert steps(texts, "1. a\n2. b\n3. c", upto=1) == ["1. a", "2. b"]


def test_carried_sections(texts):
    rows = visuals.carried_sections(texts(["x\n\n**Poster**\na\n2. board\n**photo**\nb"]), "doc_id")
    assert [(r.line_no, r.section, r.line) for r in rows.orderBy("line_no").collect()] == [
        (1, "poster", "**Poster**"), (2, "poster", "a"), (3, "board", "2. board"),
        (4, "photo", "**photo**"), (5, "photo", "b"),
    ]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("### a", ("h3", None, "a")),
        ("## a", ("h2", None, "a")),
        ("# a b ", ("h1", None, "a b ")),
        ("#### a", ("paragraph", None, "#### a")),
        ("#a", ("paragraph", None, "#a")),
        ("• a", ("bullet", None, "a")),
        ("-a", ("paragraph", None, "-a")),
        ("12.  text", ("numbered", "12", "text")),
        ("1.text", ("paragraph", None, "1.text")),
        (" # a", ("paragraph", None, " # a")),
        ("###   ", ("h3", None, " ")),
        ("- ", ("paragraph", None, "- ")),
        (" \t", ("blank", None, "")),
        ("# a\r", ("h1", None, "a")),
    ],
)
def test_line_kinds(texts, line, expected):
    row = markdown.md_lines(texts([line]), ["doc_id"]).first()
    assert (row.kind, row.number, row.content) == expected


def test_math_and_tokens(texts):
    rows = markdown.md_math(texts(["a$$ x $$b$$ open"]), "doc_id").orderBy("piece_no").collect()
    assert [(r.kind, r.body) for r in rows] == [
        ("text", "a"), ("math", "x"), ("text", "b"), ("math", "open"),
    ]
    text = "see B7.1.2.1-SC **bold $m$ B8.1.1.1** $y$ *it*\n$$ *no* $$ **x** ** *"
    got = markdown.md_tokens(texts([text]), "doc_id").orderBy("piece_no", "line_no", "token_no")
    assert [(r.depth, r.kind, r.token) for r in got.collect()] == [
        (1, "code", "B7.1.2.1"),
        (1, "bold", "bold $m$ B8.1.1.1"),
        (2, "math", "m"),
        (2, "code", "B8.1.1.1"),
        (1, "math", "y"),
        (1, "italic", "it"),
        (1, "bold", "x"),
        (1, "italic", " "),
    ]


def test_citations(spark):
    df = spark.createDataFrame(
        [(0, "B7.1.1.1-SC", [("a", "B7.1.1.10", "", ""), ("b", "B7.1.1.1-SC", "", "")]), (1, "B7.1.1.1", [])],
        "doc_id INT, text STRING, "
        "citations ARRAY<STRUCT<id: STRING, text: STRING, source: STRING, type: STRING>>",
    )
    loose = markdown.resolve_citations(df, "doc_id").orderBy("doc_id").collect()
    assert [(r.token, r.citation_id) for r in loose] == [("B7.1.1.1", "a"), ("B7.1.1.1", None)]
    exact = markdown.resolve_citations(df, "doc_id", exact=True).orderBy("doc_id").collect()
    assert [(r.token, r.citation_id) for r in exact] == [("B7.1.1.1-SC", "b"), ("B7.1.1.1", None)]


def test_plain_texts(value):
    raw = "# Head\n- **b** *i* `c`\n* star\n\n x - y\n#### deep"
    assert value(plain.plain_text(F.col("x"), "a"), raw) == "Head\n• b i c\n• star\n\n x - y\ndeep"
    assert value(plain.plain_text(F.col("x"), "b"), raw) == "Head\n• b i `c`\nstar\nx - y\ndeep"
    assert value(plain.plain_text(F.col("x"), "a"), "😀- a\r- b\u2028* c") == "😀- a\r• b\u2028• c"
    assert value(plain.excerpt(F.col("x")), "## **A**\n- b") == "A\nb..."
    assert value(plain.excerpt(F.col("x"), 3), "abcdef") == "abc..."
    assert "**" not in value(plain.plain_text(F.col("x"), "b"), "a ***b*** **")


def test_breakdown(texts):
    doc = '{"primaryLevel":"Apply","levels":[{"level":"Apply","active":true}],"teachingSequence":["a"],"successCriteria":[]}'
    parsed = activities.parse_breakdown(texts([doc, doc + "x"]))
    rows = activities.breakdown_levels(parsed, "doc_id").collect()
    assert [(r.doc_id, r.level, r.complete, r.teaching_steps) for r in rows] == [(0, "Apply", False, 1)]
