"""Keyword search over stored trigram postings.

The rows are stored once, numbered and in ranges of their numbers. Every run of three
characters of a row's lower-cased text or code is a posting (gram, row); postings are
stored in ranges of their grams, so that the scan's statistics leave only the files of
the wanted ones. A search counts its grams in a narrow table, takes the rarest few,
keeps the rows that have them all and tests those exactly. Terms under three
characters have no gram and scan the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.operators.tree import search
from lessonloom.session import with_rows

GRAM, RAREST = 3, 3


def grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a lower-cased text; none of a null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(cut, lambda g: F.length(g) == GRAM))


def build_index(rows: DataFrame, folder: str) -> None:
    """Store ``rows``, which have ``indicator_text`` and ``indicator_code``, and their postings.

    A frequent gram's postings are spread over files by their rows.
    """
    numbered = with_rows(rows, "indexed", "_row")
    numbered.repartitionByRange("_row").sortWithinPartitions("_row").write.parquet(f"{folder}/rows")
    both = F.array_union(grams(F.col("indicator_text")), grams(F.col("indicator_code")))
    postings = numbered.select(F.explode(both).alias("gram"), "_row")
    postings.repartitionByRange("gram", "_row").sortWithinPartitions("gram", "_row").write.parquet(f"{folder}/postings")
    stored = rows.sparkSession.read.schema("gram STRING, _row BIGINT").parquet(f"{folder}/postings")
    counts = stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")


def candidates(spark: SparkSession, folder: str, term: str) -> DataFrame | None:
    """``_row`` of the rows that hold the rarest grams of ``term``; None if it has none."""
    low = term.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    counts = spark.read.schema("gram STRING, n BIGINT").parquet(f"{folder}/grams").where(F.col("gram").isin(wanted))
    found = counts.agg(F.sort_array(F.collect_list(F.struct("n", "gram")))).first()[0]  # at most one per gram of the term
    postings = spark.read.schema("gram STRING, _row BIGINT").parquet(f"{folder}/postings")
    if len(found) < len(wanted):  # a gram that no row has
        return postings.select("_row").where(F.lit(False))
    rarest = [row["gram"] for row in found[:RAREST]]
    hits = postings.where(F.col("gram").isin(rarest)).groupBy("_row").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(rarest)).select("_row")


def search_indexed(spark: SparkSession, folder: str, term: str, schema: str) -> DataFrame:
    """What ``tree.search`` finds for ``term`` among the stored rows; ``schema`` is theirs."""
    rows = spark.read.schema(f"{schema}, _row BIGINT").parquet(f"{folder}/rows")
    some = candidates(spark, folder, term) if term.strip() else None
    if some is not None:
        rows = rows.join(some, "_row", "left_semi")
    return search(rows, term).drop("_row")
