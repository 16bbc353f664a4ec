"""Tree operators on a small hand-made tree and on the shared tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lessonloom.operators import tree
from lessonloom.operators.prompts import bloom_expectation
from lessonloom.plans import bindings as b


@pytest.fixture(scope="module")
def small(spark):
    """Two subjects; two strands share a name; one strand is empty."""
    frame = spark.createDataFrame
    return {
        "subjects": frame([(1, "Maths", "maths"), (2, "Art", "art")], "id INT, name STRING, slug STRING"),
        "strands": frame(
            [(1, 1, "Number"), (2, 1, "Number"), (3, 2, "Colour"), (4, 1, "Empty")],
            "id INT, subject_id INT, name STRING",
        ),
        "sub_strands": frame(
            [(1, 1, "Whole"), (2, 1, "Parts"), (3, 2, "Whole"), (4, 3, "Paint"), (5, 3, "None")],
            "id INT, strand_id INT, name STRING",
        ),
        "indicators": frame(
            [
                (1, 1, "B7.1", "Count to TEN", "Apply", "B7"),
                (2, 1, "B8.1", "Count on", "Apply", "B8"),
                (3, 2, "B7.2", "Halve", "Create", "B7"),
                (4, 3, "B7.3", "Count back", "Apply", "B7"),
                (5, 4, "B7.4", "Mix count", "Apply", "B7"),
            ],
            "id INT, sub_strand_id INT, code STRING, text STRING, blooms_level STRING, grade STRING",
        ),
    }


def shape(docs):
    return {
        r["strand_id"]: [(s["name"], [i["code"] for i in s["indicators"]]) for s in r["subStrands"]]
        for r in docs.collect()
    }


def test_subject_and_grade_apply_together(small):
    assert {r.indicator_code for r in tree.tree_rows(small, "maths", "B7").collect()} == {
        "B7.1", "B7.2", "B7.3",
    }
    assert tree.tree_rows(small, "maths", "").count() == 4
    assert tree.tree_rows(small, "MATHS").count() == 0


def test_nest_keeps_equal_names_apart_and_drops_empty_parents(small):
    assert shape(tree.nest(small)) == {
        1: [("Whole", ["B7.1", "B8.1"]), ("Parts", ["B7.2"])],
        2: [("Whole", ["B7.3"])],
        3: [("Paint", ["B7.4"])],
    }


def test_search_prunes_in_both_forms(small):
    expected = {1: [("Whole", ["B7.1", "B8.1"])], 2: [("Whole", ["B7.3"])]}
    assert shape(tree.nest(small, "maths", term="COUNT")) == expected
    assert shape(tree.search_nested(tree.nest(small, "maths"), "COUNT")) == expected
    rows = tree.tree_rows(small)
    assert tree.search(rows, "b8.1").count() == 1
    assert tree.search(rows, "   ").count() == 5
    assert tree.search(rows, " count").count() == 1  # compared untrimmed


def test_first_strand_of_a_name(small):
    codes = {r.code for r in tree.strand_indicators(small, "maths", None, "Number").collect()}
    assert codes == {"B7.1", "B8.1", "B7.2"}


def test_counts_agree_at_all_levels(small):
    subs = {r.sub_strand_id: r.indicators for r in tree.counts(small, "sub_strand").collect()}
    strands = {r.strand_id: (r.indicators, r.label) for r in tree.counts(small, "strand").collect()}
    assert subs == {1: 2, 2: 1, 3: 1, 4: 1}
    assert strands == {1: (3, "3 indicators"), 2: (1, "1 indicator"), 3: (1, "1 indicator")}
    assert tuple(tree.totals(small).first()) == (3, 5)
    assert tuple(tree.totals(small, "none").first()) == (0, 0)
    with pytest.raises(ValueError):
        tree.counts(small, "leaf")


def test_coverage_has_totals(small):
    got = {(r.subject, r.grade): (r.strands, r.indicators) for r in tree.coverage(small).collect()}
    assert got[(None, None)] == (3, 5)
    assert got[("Maths", None)] == (2, 4)
    assert got[("Maths", "B8")] == (1, 1)


def test_flatten_undoes_nest(spark, sf):
    tables = b.tree(spark, sf)
    rows = tree.tree_rows(tables).drop("sub_strand_id")
    back = tree.flatten(tree.nest(tables))
    assert Counter(map(tuple, rows.select(back.columns).collect())) == Counter(
        map(tuple, back.collect())
    )


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_large_strands_come_in_bounded_ordered_parts(spark, sf, limit):
    """A third of all indicators under one sub-strand; nothing lost, order kept."""
    tables = b.tree(spark, sf)
    hot = tables["indicators"].withColumn(
        "sub_strand_id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("sub_strand_id"))
    )
    tables = dict(tables, indicators=hot)
    whole = {r.strand_id: r.subStrands for r in tree.nest(tables, page_size=10**9).collect()}
    parts = tree.nest(tables, page_size=limit).collect()
    joined = {}
    for r in sorted(parts, key=lambda r: (r.strand_id, r.part)):
        codes = [(s.name, i.code) for s in r.subStrands for i in s.indicators]
        assert len(codes) <= limit
        joined.setdefault(r.strand_id, []).extend(codes)
    assert joined == {
        k: [(s.name, i.code) for s in subs for i in s.indicators] for k, subs in whole.items()
    }


def test_bloom_expectation_default_and_case(value):
    level = bloom_expectation(F.col("x"))
    assert value(level, "CREATE").startswith("Produce new")
    assert value(level, None).startswith("Explain ideas")
    assert value(level, "guess").startswith("Instructional standard")


def test_pages_do_not_depend_on_partitions(spark, sf):
    tables = b.tree(spark, sf)
    before, pages = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = tree.nest(tables, page_size=40).collect()
            pages.append(sorted((r.strand_id, r.part, str(r.subStrands)) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert pages[0] == pages[1]


def test_first_strand_of_a_name_has_indicators(small):
    strands = small["strands"]
    childless = strands.where("name = 'Number'").limit(1).withColumn("id", (strands["id"] - 1000).cast(strands.schema["id"].dataType))
    tables = dict(small, strands=strands.union(childless.select(strands.columns)))
    assert tree.strand_indicators(tables, "maths", None, "Number").count() == tree.strand_indicators(small, "maths", None, "Number").count() > 0


def test_subjects_with_one_name_stay_apart(small):
    same = dict(small, subjects=small["subjects"].withColumn("name", F.lit("M")))
    got = tree.coverage(same).where("level = 1").collect()
    assert len(got) == len({r.slug for r in got}) == tree.coverage(small).where("level = 1").count()
