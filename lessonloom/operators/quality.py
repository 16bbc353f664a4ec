"""Required fields, declared domains, and the constraints of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.text import missing
from lessonloom.schemas import MALFORMED

NOT_JSON = "Request is not valid JSON"


def with_missing(df: DataFrame, required: list[str]) -> DataFrame:
    """Adds ``missing_fields``: names of all missing required fields, in order."""
    names = F.array(*(F.when(missing(F.col(c)), F.lit(c)) for c in required))
    return df.withColumn("missing_fields", F.array_compact(names))


def with_status(df: DataFrame, required: list[str], listed: bool = True) -> DataFrame:
    """Adds ``valid`` and ``error``; the error names the fields when ``listed``.

    A line that was no JSON at all (``MALFORMED`` holds its text) has an error of its own.
    """
    text = F.lit("Missing required fields")
    if listed:
        text = F.concat(text, F.lit(": "), F.array_join("missing_fields", ", "))
    checked = with_missing(df, required).withColumn("valid", F.size("missing_fields") == 0)
    if MALFORMED in df.columns:
        broken = F.col(MALFORMED).isNotNull()
        text = F.when(broken, NOT_JSON).otherwise(text)
        checked = checked.withColumn("valid", F.col("valid") & ~broken)
    return checked.withColumn("error", F.when(~F.col("valid"), text)).drop("missing_fields")


def validate(df: DataFrame, required: list[str], listed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows as they are, and quarantined rows with their error."""
    checked = with_status(df, required, listed)
    good = checked.where("valid").drop("valid", "error")
    return good, checked.where(~F.col("valid")).drop("valid")


def domain_violations(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Count of each out-of-domain value per column, in one scan. Null is a violation."""
    checks = F.array(
        *(
            F.when(
                F.col(c).isNull() | ~F.col(c).isin(values),
                F.struct(F.lit(c).alias("column"), F.col(c).alias("value")),
            )
            for c, values in allowed.items()
        )
    )
    return (
        df.select(F.explode(F.array_compact(checks)).alias("v"))
        .groupBy("v.column", "v.value")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows or keys that break each declared constraint.

    Nulls per column, repeated unique keys (nulls may repeat), and children
    without a parent. Null counts travel with the grouping of the foreign key
    (of the unique key, where there is none), which combines before its
    shuffle; a table is read once for that, once as a parent, and the
    indicators once for their code.
    """

    def listed(df: DataFrame, level: str, *others: str) -> DataFrame:
        pairs = [(f"{level}.{c} not null", f"_null_{c}") for c in tables[level].columns]
        pairs += [(name, f"_check_{i}") for i, name in enumerate(others)]
        return df.select(
            F.inline(
                F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(c, F.lit(0).cast("bigint")).alias("violations")) for name, c in pairs))
            )
        )

    def null_counts(level: str):
        return [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in tables[level].columns]

    def summed(level: str):
        return [F.sum(f"_null_{c}").alias(f"_null_{c}") for c in tables[level].columns]

    def nulls_and_repeats(level: str, key: str) -> DataFrame:
        groups = tables[level].groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *null_counts(level))
        repeats = F.count_if((F.col("_n") > 1) & F.col(key).isNotNull())
        return listed(groups.agg(*summed(level), repeats.alias("_check_0")), level, f"{level}.{key} unique")

    def repeats(level: str, key: str) -> DataFrame:
        groups = tables[level].where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(F.count_if(F.col("_n") > 1).alias("violations")).select(
            F.lit(f"{level}.{key} unique").alias("check"), "violations"
        )

    def nulls_and_orphans(level: str, key: str, parent: str) -> DataFrame:
        refs = tables[level].groupBy(F.col(key).alias("_ref")).agg(F.count(F.lit(1)).alias("_n"), *null_counts(level))
        parents = tables[parent].select(F.col("id").alias("_parent")).distinct()
        lost = F.when(F.col("_ref").isNotNull() & F.col("_parent").isNull(), F.col("_n"))
        found = refs.join(parents, refs["_ref"] == parents["_parent"], "left")
        return listed(
            found.agg(*summed(level), F.sum(lost).alias("_check_0")), level, f"{level}.{key} references {parent}"
        )

    parts = [
        nulls_and_repeats("subjects", "slug"),
        nulls_and_orphans("strands", "subject_id", "subjects"),
        nulls_and_orphans("sub_strands", "strand_id", "strands"),
        nulls_and_orphans("indicators", "sub_strand_id", "sub_strands"),
        repeats("indicators", "code"),
    ]
    return reduce(DataFrame.unionByName, parts)
