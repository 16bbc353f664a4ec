"""What the physical plans must and must not contain."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as registry
from lessonloom.operators import activities, lessons, markdown, sections, visuals, worksheets
from lessonloom.plans import bindings as b
from lessonloom.sources import tables
from lessonloom.sources.tables import read_table, read_texts
from tests.conftest import ROOT

QUERIES = registry.queries()
# The training-data queries may run Arrow tasks; nothing else may.
FREE_STYLE = re.compile(r"op\d+_|pipeline$")


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product_and_no_python(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if not FREE_STYLE.match(name):
        assert not re.search(r"PythonUDF|EvalPython|InPandas|InArrow|MapPartitions", text)


@pytest.mark.parametrize(
    "job",
    [
        lambda d: sections.section_responses(b.responses(d)),
        lambda d: activities.explode_options(activities.parse_activities(b.activities(d)), "doc_id"),
        lambda d: activities.check_activities(activities.parse_activities(b.activities(d)), "doc_id"),
        lambda d: worksheets.worksheet_questions(b.worksheets(d), "doc_id"),
        lambda d: visuals.visual_sections(b.visual_prompts(d), "doc_id"),
        lambda d: visuals.carried_sections(b.visual_prompts(d), "doc_id"),
        lambda d: visuals.steps(b.markdown(d), "doc_id"),
        lambda d: markdown.md_tokens(b.markdown(d), "doc_id"),
        lambda d: markdown.resolve_citations(b.cited_markdown(d), "doc_id"),
    ],
)
def test_text_jobs_never_shuffle(job, spark, sf):
    text = plan(job(read_table(spark, sf, "documents")))
    assert "Exchange" not in text
    # parsing and splitting happen once: no filter repeats them below the explode
    assert not re.search(r"Condition : .*(from_json|split)\(", text)


def test_texts_are_spread_only_when_the_session_asks(spark, sf):
    assert "Exchange" in plan(read_texts(spark, sf, "documents", "doc_id"))
    asked = spark.conf.get(tables.TEXT_PARTITIONS)
    spark.conf.unset(tables.TEXT_PARTITIONS)
    try:
        assert "Exchange" not in plan(read_texts(spark, sf, "documents", "doc_id"))
    finally:
        spark.conf.set(tables.TEXT_PARTITIONS, asked)


def test_filters_and_columns_reach_the_scan(spark, sf):
    events = b.lessons(read_table(spark, sf, "events"))
    by_id = plan(lessons.lesson_by_id(events, 42))
    assert "EqualTo(event_id,42)" in by_id
    count = plan(lessons.count_lessons(events, "purchase", None))
    assert "EqualTo(event_type,purchase)" in count
    assert "ReadSchema: struct<event_type:string>" in count


def test_grade_filter_reaches_the_indicators(spark, sf):
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan(QUERIES["tree_filter"](spark, sf))


def test_no_collect_in_library_code():
    for folder, _, files in os.walk(os.path.join(ROOT, "lessonloom")):
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file), encoding="utf8") as source:
                    text = source.read()
                assert not re.search(r"toPandas|localCheckpoint|crossJoin", text), file
                # llm collects vocabularies, histograms and models of bounded size
                assert os.path.basename(folder) == "llm" or ".collect(" not in text, file
