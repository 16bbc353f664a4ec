"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, items: Column | str, pos: str, item: str) -> DataFrame:
    """One row per element of ``items``, with its position from 0.

    For a plain ``posexplode`` the optimizer adds a filter on the array's size
    and pushes it below the projection that builds the array, so parsing or
    splitting would run twice per row. The outer form with a test of the
    position gives the same rows and evaluates the array once.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(
        F.col(pos).isNotNull()
    )
