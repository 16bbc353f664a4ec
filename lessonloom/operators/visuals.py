"""Visual prompt sections and the steps of a worked example.

The state a line inherits from the lines above it is found by cutting each
document's own line array at its header lines (``islands``), inside the row.
A window over exploded lines would give the same rows but shuffle every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.rows import each
from lessonloom.functions.text import DOT, WS, bind, islands, lines, one_line, trimmed, units

# The four prompt sections, their default titles, and the patterns.
DEFAULT_TITLES = {
    "poster": "Classroom Poster / Anchor Chart",
    "board": "Board Worked Example",
    "photo": "Real-World Photograph Prompt",
    "notebook": "Student Notebook Diagram",
}
HEADER = (
    rf"^(?:\d+\.|\*|-|###)?[{WS}]*(?:\*\*({DOT}*?)\*\*|\*({DOT}*?)\*)"
    rf"[{WS}]*(?:[-—:]|(?i:&mdash;))?[{WS}]*"
)
HEADER_LINE = rf"{HEADER}({DOT}*)\z"
LIST_MARK = rf"^(?:\d+\.|\*|-|###)[{WS}]*"
STEP_MARK = r"^(?:[-•*]|\d+\.)[\s\S]"
STEP_LINE = rf"^(?:[-•*]|\d+\.)[{WS}]*{DOT}+\z"
SENTENCE_GAP = rf"(?<=[.!?])[{WS}]+"
SHORT_TOTAL = 30
SHORT_PARAGRAPH = 15


def _says(t: Column, low: Column) -> dict[str, Column]:
    """Whether a line names each section; the order is the priority."""
    poster, board = low.contains("poster"), low.contains("board")
    example, photo = low.contains("example"), low.contains("photo")
    notebook, diagram = low.contains("notebook"), low.contains("diagram")
    return {
        "poster": (poster | low.contains("anchor chart")) & (t.contains("1.") | poster),
        "board": (low.contains("worked example") | board) & (t.contains("2.") | example),
        "photo": photo,
        "notebook": notebook | diagram,
    }


def _starts(t: Column, low: Column) -> dict[str, Column]:
    """Whether a line opens the section it is in; stricter for the notebook."""
    diagram = low.contains("diagram")
    named = (low.contains("notebook") | diagram) & (t.contains("4.") | diagram)
    return dict(_says(t, low), notebook=named)


def _section_of(t: Column) -> Column:
    looks_like_header = t.contains("**") | t.rlike(r"^[1-4]\.")

    def named(low: Column) -> Column:
        key = F.lit(None).cast("string")
        for name, says in reversed(_says(t, low).items()):
            key = F.when(says, F.lit(name)).otherwise(key)
        return key

    return F.when(looks_like_header, bind(F.lower(t), named))


def _kept_lines(col: Column) -> Column:
    return F.filter(F.transform(lines(col), trimmed), lambda t: t != "")


def _runs(kept: Column) -> Column:
    """Runs of lines under one header: array of ``key, at, lines``."""

    def marks(ts: Column) -> Column:
        tagged = F.transform(ts, lambda t, i: F.struct(i.alias("at"), _section_of(t).alias("key")))
        return F.filter(tagged, lambda m: m["key"].isNotNull())

    return bind(
        kept,
        lambda ts: islands(
            ts,
            marks(ts),
            lambda m: m["at"],
            lambda m, run: F.struct(
                m["key"].alias("key"), m["at"].alias("at"), run.alias("lines")
            ),
        ),
    )


def carried_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each non-blank line under its section; lines before the first header are dropped."""
    runs = each(df, [key], _runs(_kept_lines(F.col(text))), "run_no", "run")
    return each(
        runs,
        [key, F.col("run.key").alias("key"), F.col("run.at").alias("at")],
        "run.lines",
        "offset",
        "line",
    ).select(
        key,
        (F.col("at") + F.col("offset")).alias("line_no"),
        F.col("key").alias("section"),
        "line",
    )


def _read_line(section: Column, t: Column) -> Column:
    """Title and body text a line contributes to its section."""

    def opens(low: Column) -> Column:
        starts = [(section == name) & start for name, start in _starts(t, low).items()]
        return starts[0] | starts[1] | starts[2] | starts[3]

    def part(title: Column | str, body: Column) -> Column:
        title = F.lit(title) if isinstance(title, str) else title
        return F.struct(section.alias("section"), title.alias("title"), body.alias("body"))

    def titled(pattern: str, body: Column) -> Column:
        bold, italic = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
        return part(bind(bold, lambda b: F.when(b != "", b).otherwise(italic)), body)

    def by_header(head: Column) -> Column:
        return F.when(head == "", unmarked).otherwise(
            titled(HEADER, F.substr(t, F.length(head) + 1))
        )

    unmarked = part("", F.regexp_replace(t, LIST_MARK, ""))
    # Without a stray terminator everything behind the header is its text, so the
    # pattern need not walk the rest of the line.
    plain = bind(F.regexp_extract(t, HEADER, 0), by_header)
    whole = F.when(
        t.rlike(HEADER_LINE), titled(HEADER_LINE, F.regexp_extract(t, HEADER_LINE, 3))
    ).otherwise(unmarked)
    opened = F.when(one_line(t), plain).otherwise(whole)
    return F.when(bind(F.lower(t), opens), opened).otherwise(part("", t))


def visual_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Four rows per document: section, title, description.

    The last title of a section wins, bodies are joined in order. When all
    descriptions together stay under 30 characters, the first four longer
    paragraphs stand in for them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = _kept_lines(body)
    read = F.flatten(
        F.transform(
            _runs(F.col("_kept")),
            lambda run: F.transform(run["lines"], lambda t: _read_line(run["key"], t)),
        )
    )

    def section(parts: Column, name: str) -> Column:
        mine = F.filter(parts, lambda p: p["section"] == name)
        titles = F.filter(mine, lambda p: p["title"] != "")
        bodies = F.filter(mine, lambda p: p["body"] != "")
        return F.struct(
            F.lit(name).alias("section"),
            F.coalesce(
                F.get(titles, F.size(titles) - 1)["title"], F.lit(DEFAULT_TITLES[name])
            ).alias("title"),
            F.array_join(F.transform(bodies, lambda p: p["body"]), "\n").alias("description"),
        )

    by_line = df.select(key, kept.alias("_kept"))
    by_section = by_line.select(
        key,
        "_kept",
        bind(read, lambda parts: F.array(*(section(parts, n) for n in DEFAULT_TITLES))).alias("_s"),
    )
    paragraphs = F.filter(
        "_kept", lambda t: (units(t) > SHORT_PARAGRAPH) & ~t.startswith("###")
    )

    def total(measure) -> Column:
        return F.aggregate("_s", F.lit(0), lambda n, s: n + measure(s["description"]))

    # Characters never outnumber units: most documents need no exact measure.
    short = (total(F.length) < SHORT_TOTAL) & (total(units) < SHORT_TOTAL)
    measured = by_section.select(key, "_s", F.when(short, paragraphs).alias("_fallback"))
    return each(measured, [key, "_fallback"], "_s", "p", "s").select(
        key,
        F.col("s.section").alias("section"),
        F.col("s.title").alias("title"),
        F.coalesce(F.get("_fallback", F.col("p")), F.col("s.description")).alias("description"),
    )


def _opens_step(t: Column) -> Column:
    listed = F.when(one_line(t), t.rlike(STEP_MARK)).otherwise(t.rlike(STEP_LINE))
    return listed | (F.lower(F.substring(t, 1, 4)) == "step")


def merged_steps(col: Column) -> Column:
    """Lines joined into steps: a line that opens no step continues the one before."""

    def marks(ts: Column) -> Column:
        at = F.transform(ts, lambda t, i: F.when((i == 0) | _opens_step(t), i))
        return F.array_compact(at)

    return bind(
        _kept_lines(col),
        lambda ts: islands(ts, marks(ts), lambda at: at, lambda at, run: F.array_join(run, "\n")),
    )


def step_list(col: Column) -> Column:
    """Steps of a worked example; its sentences when it is not a list."""
    sentences = F.filter(F.transform(F.split(col, SENTENCE_GAP), trimmed), lambda s: s != "")
    single = bind(sentences, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(col)))
    listed = bind(merged_steps(col), lambda s: F.when(F.size(s) > 1, s).otherwise(single))
    return F.when(F.coalesce(col, F.lit("")) != "", listed)


def merge_continuations(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per merged step, without the sentence fallback."""
    return _numbered(df.select(key, merged_steps(F.col(text)).alias("_steps")), key)


def steps(df: DataFrame, key: str, text: str = "text", upto: int | None = None) -> DataFrame:
    """One row per step, numbered from 1; ``upto`` keeps steps 0..upto as shown."""
    found = step_list(F.col(text))
    if upto is not None:
        found = F.slice(found, 1, upto + 1)
    return _numbered(df.select(key, found.alias("_steps")), key)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    return each(df, [key], "_steps", "p", "step").select(
        key, (F.col("p") + 1).alias("step_no"), "step"
    )
