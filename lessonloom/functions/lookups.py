"""Lookups with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.text import missing


def pick(col: Column, table: dict[str, str], default: str) -> Column:
    """Value of a small fixed table as a map literal; no join at all."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def left_match(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join of ``df`` to the unique ``dim_key`` of ``dim``.

    Rows without a key match nothing and may be many. A plain left join would
    send them all to one task; here a second join column, fixed for real keys,
    spreads them by a hash of the row. No broadcast hint: the size of ``dim``
    is Spark's to check, and past it a hot key is split by the adaptive skew
    join. That join needs a shuffle of its own on both sides, which the second
    column also brings about when ``dim`` comes from an aggregation by key. Its
    zero is worked out from the key, since a literal would be folded away.
    """
    absent = missing(F.col(key).cast("string"))
    spread = F.when(absent, F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) + 1).otherwise(0)
    left = df.withColumn("_spread", spread)
    zero = F.least(F.length(F.col(dim_key).cast("string")), F.lit(0)).cast("bigint")
    right = dim.withColumn("_zero", zero)
    on = (left[key] == right[dim_key]) & (left["_spread"] == right["_zero"])
    return left.join(right, on, "left").drop("_spread", "_zero", dim_key)


def lookup(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str,
    dim_value: str,
    out: str,
    order: list[str] | None = None,
) -> DataFrame:
    """Left join to ``dim``; the key itself stands in where there is no entry.

    The first entry of a repeated key wins, so rows never multiply.
    """
    first = dim.groupBy(F.col(dim_key).alias("_key")).agg(
        F.min_by(F.col(dim_value), F.struct(*(order or [dim_value]))).alias("_value")
    )
    matched = left_match(df, first, key, "_key")
    return matched.withColumn(out, F.coalesce("_value", key)).drop("_value")
