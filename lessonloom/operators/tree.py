"""The standards tree: filter, search, nest, flatten, count.

``tables`` is a dict of four DataFrames (subjects, strands, sub_strands,
indicators) as in ``schemas``. Keys may be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.functions.lookups import lookup
from lessonloom.functions.ranks import global_rank
from lessonloom.functions.rows import each

# Indicators of one strand come in pages of this many, whatever its size, so that
# no task and no row ever holds an unbounded array.
PAGE_SIZE = 500


def subject_by_slug(subjects: DataFrame, slug: str) -> DataFrame:
    """The subject with exactly this slug; empty when there is none."""
    return subjects.where(F.col("slug") == slug).limit(1)


def _chosen(tables: dict[str, DataFrame], subject: str | None, grade: str | None):
    """The three upper levels joined, and the indicators, with filters applied
    before any join. Empty filters are no filters."""
    subjects = tables["subjects"]
    if subject:
        subjects = subjects.where(F.col("slug") == subject)
    indicators = tables["indicators"]
    if grade:
        indicators = indicators.where(F.col("grade") == grade)
    groups = (
        tables["sub_strands"]
        .select(F.col("id").alias("sub_strand_id"), "strand_id", F.col("name").alias("sub_strand_name"))
        .join(
            tables["strands"].select(
                F.col("id").alias("strand_id"), "subject_id", F.col("name").alias("strand_name")
            ),
            "strand_id",
        )
        .join(
            subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"), "slug"),
            "subject_id",
        )
    )
    return groups, indicators


def tree_rows(
    tables: dict[str, DataFrame],
    subject: str | None = None,
    grade: str | None = None,
    strand: str | None = None,
) -> DataFrame:
    """One row per indicator with its ancestors; parents without any vanish.

    Both filters apply when both are given.
    """
    groups, indicators = _chosen(tables, subject, grade)
    if strand:
        groups = groups.where(F.col("strand_name") == strand)
    return groups.join(indicators, "sub_strand_id").select(
        "subject",
        "slug",
        "strand_id",
        "strand_name",
        "sub_strand_id",
        "sub_strand_name",
        F.col("code").alias("indicator_code"),
        F.col("text").alias("indicator_text"),
        F.col("blooms_level").alias("indicator_blooms"),
        F.col("grade").alias("indicator_grade"),
    )


def strand_indicators(
    tables: dict[str, DataFrame], subject: str, grade: str | None, strand: str
) -> DataFrame:
    """Indicators of the first strand of this name that has any, each with its sub-strand.

    The first strand is the least of its sub-strands that hold an indicator, found on
    keys alone; texts are joined for that strand only.
    """
    groups, indicators = _chosen(tables, subject, grade)
    if strand:
        groups = groups.where(F.col("strand_name") == strand)
    used = groups.join(indicators.select("sub_strand_id"), "sub_strand_id", "left_semi")
    first = used.agg(F.min("strand_id").alias("strand_id"))
    return groups.join(first, "strand_id", "left_semi").join(indicators, "sub_strand_id").select(
        "code", "text", "blooms_level", "grade", F.col("sub_strand_name").alias("sub_strand")
    )


def _hit(term: str, text: Column, code: Column) -> Column:
    needle = term.lower()
    return F.lower(text).contains(needle) | F.lower(code).contains(needle)


def search(rows: DataFrame, term: str) -> DataFrame:
    """Rows whose text or code contains ``term``, whatever the case.

    A blank term keeps everything. Filtering ahead of nesting drops emptied
    sub-strands and strands by itself.
    """
    if not term.strip():
        return rows
    return rows.where(_hit(term, F.col("indicator_text"), F.col("indicator_code")))


def search_nested(tree: DataFrame, term: str) -> DataFrame:
    """The same search on documents that are already nested."""
    if not term.strip():
        return tree

    def matching(sub: Column) -> Column:
        hits = F.filter(sub["indicators"], lambda i: _hit(term, i["text"], i["code"]))
        return F.struct(sub["name"].alias("name"), hits.alias("indicators"))

    kept = F.filter(
        F.transform("subStrands", matching), lambda sub: F.size(sub["indicators"]) > 0
    )
    return tree.withColumn("subStrands", kept).where(F.size("subStrands") > 0)


def _leaf() -> Column:
    return F.struct(
        F.col("indicator_code").alias("code"),
        F.col("indicator_text").alias("text"),
        F.col("indicator_blooms").alias("bloomsLevel"),
        F.col("indicator_grade").alias("grade"),
    )


def _documents(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Group bounded sets of rows into documents; ``extra`` splits a strand."""
    strand = ["subject", "slug", "strand_id", "strand_name", *extra]
    subs = rows.groupBy(*strand, "sub_strand_id", "sub_strand_name").agg(
        F.array_sort(F.collect_list(_leaf())).alias("indicators")
    )
    keyed = F.struct(
        F.col("sub_strand_id").alias("id"), F.col("sub_strand_name").alias("name"), "indicators"
    )
    return subs.groupBy(*strand).agg(
        F.transform(
            F.array_sort(F.collect_list(keyed)),
            lambda s: F.struct(s["name"].alias("name"), s["indicators"].alias("indicators")),
        ).alias("subStrands")
    )


def nest(
    tables: dict[str, DataFrame],
    subject: str | None = None,
    grade: str | None = None,
    term: str = "",
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Nested strand documents: ``name, part, subStrands[name, indicators[...]]``.

    Siblings with equal names stay apart since grouping is by id. Sub-strands
    come in id order and indicators in code order. A strand comes in pages of
    ``page_size`` indicators in that order; ``part`` numbers them from 0, and
    reading the parts in turn gives the whole strand. Pages are cut by exact
    global ranks, so they depend neither on partitions nor on sizes.
    """
    rows = search(tree_rows(tables, subject, grade), term)
    ranked = global_rank(rows, ["strand_id"], ["sub_strand_id", "indicator_code", "indicator_text"], "_rank")
    paged = ranked.withColumn("part", F.floor(F.col("_rank") / page_size)).drop("_rank")
    return _documents(paged, ["part"]).select(
        "subject", "slug", "strand_id", F.col("strand_name").alias("name"), "part", "subStrands"
    )


def flatten(tree: DataFrame) -> DataFrame:
    """Back to one row per indicator, each carrying its sub-strand's name."""
    subs = each(tree, ["subject", "slug", "strand_id", "name"], "subStrands", "_p", "s")
    strand, sub = F.col("name").alias("strand_name"), F.col("s.name").alias("sub_strand_name")
    leaves = each(subs, ["subject", "slug", "strand_id", strand, sub], "s.indicators", "_p", "i")
    return leaves.select(
        "subject",
        "slug",
        "strand_id",
        "strand_name",
        "sub_strand_name",
        F.col("i.code").alias("indicator_code"),
        F.col("i.text").alias("indicator_text"),
        F.col("i.bloomsLevel").alias("indicator_blooms"),
        F.col("i.grade").alias("indicator_grade"),
    )


def _counted(tables, subject, grade) -> DataFrame:
    """Upper levels with the indicator count of each sub-strand.

    Counting per foreign key comes before the join, so a sub-strand holding a
    third of all indicators crosses the network as one partial count per task.
    """
    groups, indicators = _chosen(tables, subject, grade)
    per_sub = indicators.groupBy("sub_strand_id").agg(F.count(F.lit(1)).alias("indicators"))
    return groups.join(per_sub, "sub_strand_id")


def counts(
    tables: dict[str, DataFrame],
    level: str,
    subject: str | None = None,
    grade: str | None = None,
) -> DataFrame:
    """Indicator count per ``sub_strand`` or per ``strand``."""
    counted = _counted(tables, subject, grade)
    if level == "sub_strand":
        return counted.select(
            "strand_id", "strand_name", "sub_strand_id", "sub_strand_name", "indicators"
        ).withColumn("label", count_label("indicators"))
    if level == "strand":
        return counted.groupBy("strand_id", "strand_name").agg(
            F.sum("indicators").alias("indicators")
        ).withColumn("label", count_label("indicators"))
    raise ValueError(f"no such level: {level}")


def count_label(column: str) -> Column:
    """``1 indicator``, ``2 indicators``."""
    n = F.col(column)
    return F.concat(n.cast("string"), F.lit(" indicator"), F.when(n != 1, "s").otherwise(""))


def totals(
    tables: dict[str, DataFrame], subject: str | None = None, grade: str | None = None
) -> DataFrame:
    """Number of strands and of indicators, before any search."""
    return _counted(tables, subject, grade).agg(
        F.count_distinct("strand_id").alias("strands"),
        F.coalesce(F.sum("indicators"), F.lit(0).cast("bigint")).alias("indicators"),
    )


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Strands and indicators per subject and grade, with totals.

    Subjects are told apart by slug; names may repeat. ``level`` is 0 for a
    grade, 1 for a subject's total, 3 for the grand total. Two
    pre-aggregations shrink the indicators to one row per strand and grade
    before the rollup expands them.
    """
    groups, indicators = _chosen(tables, None, None)
    per_sub = indicators.groupBy("sub_strand_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    per_strand = (
        groups.join(per_sub, "sub_strand_id")
        .groupBy("slug", "subject", "strand_id", "grade")
        .agg(F.sum("n").alias("n"))
    )
    return per_strand.rollup("slug", "grade").agg(
        F.when(F.grouping("slug") == 0, F.max("subject")).alias("subject"),
        F.count_distinct("strand_id").alias("strands"),
        F.sum("n").alias("indicators"),
        F.grouping_id().alias("level"),
    )


def to_requests(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Tree rows as lesson requests, the subject shown by its label."""
    labelled = lookup(rows, labels, "slug", "slug", "label", "subject_label")
    return labelled.select(
        F.col("indicator_code").alias("code"),
        F.col("indicator_text").alias("text"),
        F.col("subject_label").alias("subject"),
        F.col("indicator_grade").alias("grade"),
        F.col("strand_name").alias("strand"),
        F.col("sub_strand_name").alias("subStrand"),
        F.col("indicator_blooms").alias("bloomsLevel"),
    )
