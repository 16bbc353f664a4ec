"""Loading nested standards documents, conflict-ignoring inserts, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.session import written


def _key(*parts: Column) -> Column:
    """Deterministic surrogate key of a path, so that re-runs are idempotent."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def _strands(docs: DataFrame) -> DataFrame:
    """One row per strand, and one without for a subject that has none.

    Here and below, the outer explodes evaluate each array once.
    """
    each = docs.select(F.col("subject.slug").alias("slug"), F.posexplode_outer("strands").alias("strand_pos", "strand"))
    key = _key(F.col("slug"), F.col("strand_pos").cast("string"), F.col("strand.name"))
    return each.withColumn("strand_id", key)


def _sub_strands(docs: DataFrame) -> DataFrame:
    """One row per sub-strand, and one without for a parent that has none."""
    each = _strands(docs).select(
        "slug", "strand_pos", "strand_id", F.posexplode_outer("strand.subStrands").alias("sub_pos", "sub")
    )
    return each.withColumn("sub_id", _key(F.col("strand_id"), F.col("sub_pos").cast("string"), F.col("sub.name")))


def _indicators(docs: DataFrame) -> DataFrame:
    """One row per indicator, and one without for a parent that has none."""
    return _sub_strands(docs).select(
        "slug", "strand_pos", "sub_pos", "sub_id", F.posexplode_outer("sub.indicators").alias("ind_pos", "ind")
    )


def normalize_tree(docs: DataFrame, rooted: bool = False) -> dict[str, DataFrame]:
    """Split nested subject documents into the four tables.

    With ``rooted`` every row also has ``root``, the key of its subject.

    Every child carries its parent's key. A key hashes the path of slug,
    ordinals and names, so siblings with equal names stay distinct. Each level
    reads the documents and explodes them down to itself, without a shuffle and
    without storing the exploded rows, which with their keys are a multiple of
    the documents. Documents that are costly to make should be stored first.
    """
    root = [_key(F.col("slug")).alias("root")] if rooted else []
    subjects = docs.select(F.col("subject.slug").alias("slug"), F.col("subject.name").alias("name")).select(
        _key(F.col("slug")).alias("id"), "name", "slug", *root
    )
    strands = _strands(docs).where(F.col("strand_pos").isNotNull()).select(
        F.col("strand_id").alias("id"),
        _key(F.col("slug")).alias("subject_id"),
        F.col("strand.name").alias("name"),
        *root,
    )
    sub_strands = _sub_strands(docs).where(F.col("sub_pos").isNotNull()).select(
        F.col("sub_id").alias("id"), "strand_id", F.col("sub.name").alias("name"), *root
    )
    indicators = _indicators(docs).where(F.col("ind_pos").isNotNull()).select(
        _key(F.col("sub_id"), F.col("ind_pos").cast("string"), F.col("ind.code")).alias("id"),
        F.col("sub_id").alias("sub_strand_id"),
        F.col("ind.code").alias("code"),
        F.col("ind.text").alias("text"),
        F.col("ind.bloomsLevel").alias("blooms_level"),
        F.col("ind.grade").alias("grade"),
        # source order of the indicator, for first-wins on a repeated code
        F.struct("slug", "strand_pos", "sub_pos", "ind_pos").alias("source_order"),
        *root,
    )
    return {
        "subjects": subjects,
        "strands": strands,
        "sub_strands": sub_strands,
        "indicators": indicators,
    }


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, remaining columns breaking ties.

    A minimum, unlike a ranking window, combines before the shuffle: a key
    holding a third of all rows leaves each task as a single row.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    ranked = [c for c in order if c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct(*ranked, *rest)).alias("_first"))
    return first.select(*key, "_first.*").select(*df.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` an insert that ignores conflicts would add.

    The first row of a repeated key wins, keys already present are dropped.
    Both sides are reduced to one row per key first, so neither side of the
    anti join is skewed.
    """
    taken = existing.select(*key).distinct()
    return first_per_key(new, key, order).join(taken, key, "left_anti")


def insert_new_subtrees(
    existing_subjects: DataFrame,
    docs: DataFrame,
    order: str,
    existing_indicators: DataFrame | None = None,
    rooted: bool = False,
) -> dict[str, DataFrame]:
    """Tables for the documents whose subject is new.

    An existing slug skips its whole subtree, and of several new documents
    with one slug the first by ``order`` is taken. Winners are found on two
    narrow columns, and they and their documents written once; ``order`` must be unique per document.
    Repeated indicator codes keep their first occurrence, and codes of
    ``existing_indicators`` are not inserted again. Documents without a slug
    and indicators without a code break the keys: they are left out of the
    tables and listed under ``rejected``.
    """
    keyed = F.col("subject.slug").isNotNull()
    winners = written(
        docs.where(keyed)
        .groupBy(F.col("subject.slug").alias("slug"))
        .agg(F.min(order).alias(order))
        .join(existing_subjects.select("slug").distinct(), "slug", "left_anti"),
        "winners",
    )
    chosen = written(docs.join(winners, order, "left_semi").select("subject", "strands"), "chosen")
    tables = normalize_tree(chosen, rooted)
    coded = tables["indicators"].where(F.col("code").isNotNull())
    codes = first_per_key(coded, ["code"], ["source_order"])
    if existing_indicators is not None:
        codes = codes.join(existing_indicators.select("code").distinct(), "code", "left_anti")
    rejected = (
        tables["indicators"]
        .where(F.col("code").isNull())
        .select(F.lit("indicators").alias("level"), F.col("source_order.slug").alias("parent"), F.col("text").alias("name"))
        .unionByName(
            docs.where(~keyed).select(
                F.lit("subjects").alias("level"),
                F.lit(None).cast("string").alias("parent"),
                F.col("subject.name").alias("name"),
            )
        )
    )
    return tables | {"indicators": codes, "rejected": rejected}


def cascade_delete(tables: dict[str, DataFrame], subject_ids: DataFrame) -> dict[str, DataFrame]:
    """Survivors at all four levels after deleting subjects.

    ``subject_ids`` has one column ``id``. Each level keeps what does not hang
    below a deleted parent; lessons are not part of the tree and stay.
    """

    def below(level: str, parent: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = gone.select(F.col("id").alias(parent))
        df = tables[level]
        return df.join(keys, parent, "left_anti").select(*df.columns), df.join(
            keys, parent, "left_semi"
        )

    kept = {"subjects": tables["subjects"].join(subject_ids.select("id"), "id", "left_anti")}
    gone = subject_ids
    for level, parent in (
        ("strands", "subject_id"),
        ("sub_strands", "strand_id"),
        ("indicators", "sub_strand_id"),
    ):
        kept[level], gone = below(level, parent, gone)
    return kept
