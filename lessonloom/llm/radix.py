"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by their successive bytes, most significant first. A digit is
several bytes wide and widens from round to round, so a text of n bytes is
through after about log4(n / 64) rounds. A group of one is resolved and leaves
at once; a group whose texts have ended holds equal texts. Only undecided rows
go on, with what is left of their bytes. Equality is that of the bytes
themselves; no digest decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.llm.tasks import set_aside
from lessonloom.session import fresh_dir, lasting, scratch, shuffles_dropped, with_rows, written

FIRST_DIGIT, GROWTH, WIDEST = 64, 4, 1 << 20
_DONE, _OPEN = 0, 1


def normalised(text):
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row, doc_id, keep_row, keep_id, group_size, text_sha256`` for every row of ``docs``.

    Equal texts form a group; ``keep_id`` is its smallest doc_id (null if all
    are null) and ``keep_row`` the first row with that id, nulls last.
    ``_row`` is the row's number as given in ``docs`` if that column exists; it
    must then be stored with the rows.
    The digest is only reported. Null and empty texts are one group.
    """
    spark = docs.sparkSession
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    text_now = docs.select(row.alias("_row"), F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_t"))
    body = text_now.select(
        "_row",
        "doc_id",
        F.sha2("_t", 256).alias("text_sha256"),
        F.lit(0).cast("bigint").alias("_group"),
        F.col("_t").cast("binary").alias("_rest"),
    )
    if "_row" in docs.columns:
        active = body
    else:  # written once, so that row numbers stay as they are
        start = fresh_dir(spark, "radix")
        with shuffles_dropped(spark):
            body.write.parquet(start)
        active = spark.read.schema(body.schema).parquet(start)
    active = _narrowed(active)
    kept_type = T.StructType([T.StructField("n", T.BooleanType()), T.StructField("i", docs.schema[doc_id].dataType), T.StructField("_row", T.LongType())])
    schema = T.StructType(
        [
            *body.schema.fields[:3],
            T.StructField("_group", T.LongType()),
            T.StructField("_rest", T.BinaryType()),
            T.StructField("_keep", kept_type),
            T.StructField("group_size", T.LongType()),
            T.StructField("_state", T.IntegerType()),
        ]
    )
    finished, width = [], FIRST_DIGIT
    while True:
        path = fresh_dir(spark, "radix")
        with shuffles_dropped(spark):
            _round(active, width).select(*schema.names).write.partitionBy("_state").parquet(path)
        split = spark.read.schema(schema).parquet(path)
        finished.append(split.where(F.col("_state") == _DONE))
        active = split.where(F.col("_state") == _OPEN).select(*body.columns)
        if active.isEmpty():
            break
        width = min(width * GROWTH, WIDEST)
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.union(more)
    return whole.select(
        "_row",
        "doc_id",
        F.col("_keep._row").alias("keep_row"),
        F.col("_keep.i").alias("keep_id"),
        "group_size",
        "text_sha256",
    )


def _narrowed(active: DataFrame) -> DataFrame:
    """``active`` with only the first digit left of texts that nothing shares it with.

    The hashes of the repeated first digits are few and narrow. Where Spark
    finds that they fit a broadcast, bytes that no later round can need are
    not shuffled; groups are still told apart by the bytes alone.
    """
    digit = F.xxhash64(F.substring("_rest", 1, FIRST_DIGIT))
    counts = active.groupBy(digit.alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    shared = written(counts.where("_n > 1").select("_h"), "shared")
    marked = active.withColumn("_key", digit).join(shared, F.col("_key") == F.col("_h"), "left")
    rest = F.when(F.col("_h").isNull(), F.substring("_rest", 1, FIRST_DIGIT)).otherwise(F.col("_rest"))
    return marked.select(*[c for c in active.columns if c != "_rest"], rest.alias("_rest"))


def _round(active: DataFrame, width: int) -> DataFrame:
    """Split every group by its next digit.

    Sizes and keepers combine before the shuffle, so a group of a third of all
    rows costs one partial row per task; the join back is an equi-join whose
    hot keys adaptive execution can split.
    """
    cut = active.withColumn("_digit", F.substring("_rest", 1, width))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "_row")
    groups = cut.groupBy(F.col("_group").alias("_g"), F.col("_digit").alias("_d")).agg(
        F.count(F.lit(1)).alias("group_size"), F.min(order).alias("_keep")
    )
    met = cut.join(groups, (F.col("_group") == F.col("_g")) & (F.col("_digit") == F.col("_d")))
    over = (F.col("group_size") == 1) | (F.length("_digit") < width)
    return met.select(
        "_row",
        "doc_id",
        "text_sha256",
        F.col("_keep._row").alias("_group"),
        F.when(~over, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
        "_keep",
        "group_size",
        F.when(over, _DONE).otherwise(_OPEN).alias("_state"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the first with the smallest id.
    The columns are those of ``docs``, whatever their names."""
    docs, own = set_aside(docs, "_row")
    rows = with_rows(docs, "documents")
    with scratch(docs.sparkSession):
        groups = exact_groups(rows, doc_id, text)
        dropped = lasting(groups.where(F.col("_row") != F.col("keep_row")).select("_row"), "dropped")
    return rows.join(dropped, "_row", "left_anti").select(*own)
